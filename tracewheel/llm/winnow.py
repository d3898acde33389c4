"""Benchmark decontamination by winnowing.

A text's words are hashed, and of every WINDOW successive k-gram hashes the smallest, the first
among equals, is kept. Any SPAN = K + WINDOW - 1 words that two texts share hold one window of
k-grams, of which both keep the same one at the same place. So an equi-join of kept hashes
meets every shared span; each meeting is extended word by word to either side and is a hit if
it grows to SPAN words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewheel.llm.common import lower_ascii, stage, text_key

SPAN = 10
K = 5
WINDOW = SPAN - K + 1
#: Words of context that a k-gram carries to either side: all that a span around it can reach.
REACH = SPAN - K
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: At most so many benchmark fingerprints (about 200 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
SALTS = 16
PRINTS = "array<struct<h:bigint,p:int,before:array<bigint>,after:array<bigint>>>"


def item_words(text: Column) -> Column:
    """Lower-cased (A-Z) runs of letters, digits and characters beyond ASCII; none for null."""
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), BREAK), lambda w: F.length(w) > 0)


def word_hashes(texts: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` and _n (number of words) and _hw (a 64-bit hash of each)."""
    words = texts.select(*keep, item_words(F.col(text)).alias("_w"))
    return words.select(*keep, F.size("_w").alias("_n"), F.transform("_w", lambda w: F.xxhash64(w)).alias("_hw"))


def with_fingerprints(hashed: DataFrame) -> DataFrame:
    """Adds _prints: (h, p, before, after) of every kept k-gram, with the word hashes around it.

    before are up to REACH hashes nearest first, after likewise. Arrays are columns of their own
    before lambdas read them, so none is made again for each element.
    """
    hw = F.col("_hw")
    grams = F.when(F.col("_n") >= SPAN, F.transform(F.sequence(F.lit(0), F.col("_n") - K), lambda i: F.xxhash64(*[F.get(hw, i + j) for j in range(K)])))
    out = hashed.withColumn("_g", grams)
    g = F.col("_g")
    least = F.when(g.isNotNull(), F.transform(F.sequence(F.lit(1), F.size(g) - (WINDOW - 1)), lambda i: F.array_min(F.slice(g, i, WINDOW))))
    out = out.withColumn("_m", least)
    m = F.col("_m")
    # A window's kept k-gram is new if its hash is, or if the one kept before has left the window.
    fresh = F.filter(F.sequence(F.lit(1), F.size(m)), lambda i: (i == 1) | (F.get(m, i - 1) != F.get(m, i - 2)) | (F.get(g, i - 2) == F.get(m, i - 2)))
    out = out.withColumn("_at", F.when(m.isNotNull(), F.transform(fresh, lambda i: (i - 2 + F.array_position(F.slice(g, i, WINDOW), F.get(m, i - 1))).cast("int"))))

    def shown(p: Column) -> Column:
        low = F.greatest(F.lit(0), p - REACH)
        return F.struct(F.get(g, p).alias("h"), p.alias("p"), F.reverse(F.slice(hw, low + 1, p - low)).alias("before"), F.slice(hw, p + K + 1, REACH).alias("after"))

    return out.withColumn("_prints", F.transform("_at", shown)).drop("_g", "_m", "_at")


def agreeing(a: str, b: str) -> Column:
    """How many leading elements of two arrays are equal."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    wrong = F.array_position(same, F.lit(False))
    return F.when(wrong > 0, wrong - 1).otherwise(F.size(same)).cast("int")


def item_rows(benchmark: DataFrame) -> DataFrame:
    """(item, _n, _hw) of every item with words; a null id counts as the empty string."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text"))
    return word_hashes(items, "text", ["item"]).where("_n > 0").distinct()


def joined(left: DataFrame, right: DataFrame, on: Column, rows: int, how: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcasts ``right`` if it has at most ``most`` rows; beyond that the join shuffles both sides.

    There each row of ``right`` goes to SALTS salts and those of ``left`` are dealt over them by
    their place, so a k-gram that stands in very many texts does not meet in one task.
    """
    if rows <= most:
        return left.join(F.broadcast(right), on, how)
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns[:2], "p"), F.lit(SALTS)).cast("int"))
    copies = right.withColumn("_of_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(copies, on & (F.col("_salt") == F.col("_of_salt")), how).drop("_salt", "_of_salt")


def hit_ranges(docs: DataFrame, benchmark: DataFrame, keep: list[str], most: int = BROADCAST_ROWS) -> DataFrame:
    """``keep``, _n and a row for each range of words [lo, hi) that matches an item; rows without one have null there.

    Every row of ``docs`` appears at least once with a null range, so texts are read once.
    """
    items = stage(item_rows(benchmark), "items")
    long_items = with_fingerprints(items.where(F.col("_n") >= SPAN)).select("item", F.explode(F.coalesce("_prints", F.array().cast(PRINTS))).alias("x"))
    prints = stage(long_items.select(F.col("x.h").alias("bh"), "item", F.col("x.before").alias("item_before"), F.col("x.after").alias("item_after")).distinct(), "item-prints")
    shorts = {r[0] for r in items.where(F.col("_n") < SPAN).select("_n").distinct().collect()}  # at most SPAN - 1 lengths
    hashed = word_hashes(docs, "_text", keep)
    marked = with_fingerprints(hashed)
    # One more element a text, which joins with nothing, keeps texts without a hit; it hashes the text, so none gather.
    none = F.struct(F.xxhash64(F.lit("no k-gram"), *keep).alias("h"), F.lit(-1).alias("p"), F.array().cast("array<bigint>").alias("before"), F.array().cast("array<bigint>").alias("after"))
    rows = marked.select(*keep, "_n", F.explode(F.concat(F.array(none), F.coalesce("_prints", F.array().cast(PRINTS)))).alias("x"))
    rows = rows.select(*keep, "_n", "x.*")
    met = joined(rows, prints, F.col("h") == F.col("bh"), prints.count(), "left", most)
    met = met.where((F.col("p") < 0) | F.col("item").isNotNull())
    met = met.withColumns({"left": agreeing("before", "item_before"), "right": agreeing("after", "item_after")})
    good = (F.col("p") >= 0) & (F.col("left") + K + F.col("right") >= SPAN)
    low, high = F.col("p") - F.col("left"), F.col("p") + K + F.col("right")
    out = met.where((F.col("p") < 0) | good).select(*keep, "_n", (F.col("p") < 0).alias("own"), *[F.when(F.col("p") >= 0, c).alias(name) for name, c in (("item", F.col("item")), ("lo", low), ("hi", high))])
    for n in sorted(shorts):
        out = out.unionByName(short_hits(hashed, items, n, keep, most))  # one window each
    return out


def short_hits(hashed: DataFrame, items: DataFrame, n: int, keep: list[str], most: int) -> DataFrame:
    """Ranges of the texts' windows of ``n`` words that equal an item of ``n`` words."""
    hw = F.col("_hw")

    def window(i: Column) -> Column:
        return F.xxhash64(*[F.get(hw, i + j) for j in range(n)])

    wanted = items.where(F.col("_n") == n).select(window(F.lit(0)).alias("bh"), "item")
    places = F.transform(F.sequence(F.lit(0), F.col("_n") - n), lambda i: F.struct(window(i).alias("h"), i.alias("p")))
    rows = hashed.where(F.col("_n") >= n).select(*keep, "_n", F.explode(places).alias("x")).select(*keep, "_n", "x.h", "x.p")
    met = joined(rows, wanted, F.col("h") == F.col("bh"), wanted.count(), "inner", most)
    return met.select(*keep, "_n", F.lit(False).alias("own"), "item", F.col("p").alias("lo"), (F.col("p") + n).alias("hi"))


def covered(ranges: Column) -> Column:
    """The number of words in the union of sorted ranges (lo, hi)."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))
    return F.aggregate(ranges, start, lambda a, r: F.struct(F.greatest(a["end"], r["hi"]).alias("end"), (a["total"] + F.greatest(F.lit(0), r["hi"] - F.greatest(r["lo"], a["end"]))).alias("total")), lambda a: a["total"])


def contamination(docs: DataFrame, benchmark: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans) of every row of ``docs``.

    Null texts have no words. Rows that repeat are each returned; rows of one doc_id and
    different texts are told apart. An item of 1 to 9 words is one window, one without words
    none; items of one id are one item. Either table may be empty. Other columns are ignored.
    Beyond ``most`` fingerprints the benchmark is not broadcast.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("_text")).withColumn("_key", text_key(F.col("_text")))
    hits = hit_ranges(keyed, benchmark, ["doc_id", "_key"], most)
    found = hits.groupBy("doc_id", "_key").agg(
        F.max("_n").alias("n_words"),
        F.count(F.when(F.col("own"), 1)).alias("copies"),
        F.sort_array(F.collect_set(F.when(F.col("lo").isNotNull(), F.struct("lo", "hi")))).alias("spans"),
        F.sort_array(F.collect_set("item")).alias("items"),
    )
    found = found.withColumn("n_hit", covered(F.col("spans")).cast("long")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return found.select("doc_id", F.col("n_words").cast("long").alias("n_words"), "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "spans")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of ``docs`` without a hit, with all their columns, whatever their names; either table may be empty."""
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"), text_key(F.col("text").cast("string")).alias("key"), own)
    hits = hit_ranges(keyed.select("id", "key", F.col("row.text").cast("string").alias("_text")), benchmark, ["id", "key"], most)
    bad = stage(hits.where("lo is not null").select("id", "key").distinct(), "contaminated")
    few = bad.count() <= most
    return keyed.join(F.broadcast(bad) if few else bad, ["id", "key"], "left_anti").select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contamination(docs, benchmark).drop("spans")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
                  list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
             list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item, n, array_to_string(ws[i:i+n-1], ' ') AS g
       FROM (SELECT item, ws, least(len(ws), 10) AS n, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM b WHERE len(ws) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, n, i, array_to_string(ws[i:i+n-1], ' ') AS g
       FROM (SELECT rid, n, ws, unnest(range(1, len(ws) - n + 2)) AS i FROM d, ns WHERE len(ws) >= n)),
h AS (SELECT rid, i, dw.n, item FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
p AS (SELECT rid, count(DISTINCT w) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS w FROM h) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p ON d.rid = p.rid LEFT JOIN t ON d.rid = t.rid
"""
