"""Mixing sources to target weights, in blocks of tokens.

The words of a source, its documents one after another, are cut into blocks of fixed length. A
mix of N slots is cut into output shards of fixed length; a shard's counts by source are a
multinomial draw, each of its slots falling to a source in proportion to the source's slots of
the mix. Over all shards the draws miss the targets by chance; so the last slots of sources
drawn too often are given to those drawn too seldom, and the sums are the targets. The slots of
a source, numbered through its shards, are mapped to its blocks by a pseudorandom permutation of
its own, once round per epoch, and blocks are joined by index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewheel.llm.common import chunks_for, count_space_words, only, prefix_sums, running_position, space_words, stage, text_key

BLOCK_WORDS = 256
SHARD_SLOTS = 1024
SHARE = 1.5
MOST = 2.0
WEIGHTS = (5, 2, 1)
SEED = 20240229
#: Rounds of the shuffle.
ROUNDS = 24
#: Cells into which a line of ranges is cut to find a point's range by an equi-join.
CELLS = 4096
#: At most so many ranges of sources are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


def permute(index: Column, n: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """A keyed permutation of 0..n-1 for any n >= 1: the swap-or-not shuffle.

    Each round pairs x with (k - x) mod n for a round key k and swaps the pair if a hash bit
    of its larger member says so, so every round, and all of them, are one-to-one.
    """
    zero = F.lit(0).cast("long")

    def turn(x: Column, r: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(key, r), n) - x, n)
        return F.when(F.xxhash64(key, r, F.greatest(x, mirror)).bitwiseAND(1) == 1, mirror).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), index + zero, turn)


def targets(sizes: DataFrame, share: float = SHARE, most: float = MOST, weights=WEIGHTS) -> DataFrame:
    """Adds target: ``share`` of all sizes dealt by weight, none above ``most`` times its size.

    ``sizes`` has one row a source (source, source_size). What a stopped source leaves is dealt
    among the others by weight until none is above: all that are not stopped get the same
    amount a unit of weight, and the sources in order of limit a unit of weight show where the
    stops end. Sources sort by code point, null last.
    """
    by_name, n = F.col("source").asc_nulls_last(), sizes.count()
    ranked = prefix_sums(sizes, n, [by_name], rank=F.lit(1).cast("long"))
    weighed = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int")))
    limited = weighed.withColumn("limit", F.lit(most) * F.col("source_size")).withColumn("limit_unit", F.col("limit") / F.col("weight"))
    summed = prefix_sums(limited, n, [F.col("limit_unit"), F.col("weight"), by_name], stopped=F.col("limit"), closed=F.col("weight"))
    whole, weight = summed.agg(F.sum("source_size"), F.sum("weight")).collect()[0]
    unit = (F.lit(share * (whole or 0)) - F.col("stopped")) / (F.lit(weight or 1.0) - F.col("closed"))
    level = summed.agg(F.max(F.when(F.col("limit_unit") >= unit, unit))).collect()[0][0]
    goal = F.col("limit") if level is None else F.least("limit", F.lit(level) * F.col("weight"))
    return summed.select("source", "source_size", goal.alias("target"))


def source_plan(rows: DataFrame, block: int) -> DataFrame:
    """One row a source: its target, words a mix takes, and its numbers of blocks and slots."""
    sizes = stage(rows.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")), "mix-sources")
    goal = targets(sizes).withColumn("words", F.floor(F.col("target") + 1e-6).cast("long"))
    size = F.greatest(F.col("source_size"), F.lit(1))
    return (
        goal.withColumn("epochs", F.floor(F.col("words") / size).cast("long"))
        .withColumn("rest", F.col("words") - F.col("epochs") * F.col("source_size"))
        .withColumn("full", F.floor(F.col("source_size") / block).cast("long"))
        .withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
        .withColumn("slots", F.col("epochs") * F.col("blocks") + F.ceil(F.col("rest") / block).cast("long"))
    )


def spread_over(df: DataFrame) -> int:
    """Partitions to deal few rows to that grow to many: a number that is stated is not coalesced."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def in_ranges(rows: DataFrame, point: str, ranges: DataFrame, n: int, total: int) -> DataFrame:
    """``rows`` with the columns of the range (low, high) of ``ranges``, at most ``n``, that holds ``point``.

    The ranges are disjoint and lie in 0..total-1. The line is cut into cells; a range is in each
    cell that it meets, a point in one, so they meet by an equi-join on the cell.
    """
    width = max(1, -(-total // CELLS))
    cells = ranges.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("low") / width).cast("long"), F.floor((F.col("high") - 1) / width).cast("long"))))
    cells = F.broadcast(cells) if n + CELLS <= BROADCAST_ROWS else cells
    found = rows.withColumn("_in", F.floor(F.col(point) / width).cast("long"))
    return found.join(cells, (F.col("_in") == F.col("_cell")) & (F.col(point) >= F.col("low")) & (F.col(point) < F.col("high"))).drop("_cell", "_in")


def draw_counts(plan: DataFrame, total: int, shard_slots: int, seed: int) -> DataFrame:
    """(shard, source, n): how many of each output shard's slots fall to each source, a multinomial draw a shard."""
    by_name = F.col("source").asc_nulls_last()
    n = plan.count()
    ranges = prefix_sums(plan.where("slots > 0").select("source", "slots"), n, [by_name], low=F.col("slots")).select("source", "low", (F.col("low") + F.col("slots")).alias("high"))
    shards = plan.sparkSession.range(0, -(-total // shard_slots), 1, spread_over(plan)).withColumnRenamed("id", "shard")
    last = F.least(F.lit(total), (F.col("shard") + 1) * shard_slots) - 1
    slots = shards.select("shard", F.explode(F.sequence(F.col("shard") * shard_slots, last)).alias("slot"))
    drawn = slots.select("shard", F.pmod(F.xxhash64(F.lit(seed), "slot"), F.lit(total)).alias("point"))
    return in_ranges(drawn, "point", ranges, n, total).groupBy("shard", "source").agg(F.count("*").alias("n"))


def mix_slots(plan: DataFrame, shard_slots: int, seed: int) -> DataFrame:
    """(shard, source, index): every slot of the mix, with its number among the source's slots, 0 to slots - 1.

    A source's draws are numbered through its shards. Numbers beyond its slots are surplus; they
    are numbered through all sources and fall, in that order, to the sources that lack slots.
    """
    spark = plan.sparkSession
    total = plan.agg(F.coalesce(F.sum("slots"), F.lit(0))).collect()[0][0]
    if not total:
        return spark.createDataFrame([], "shard long, source string, index long")
    counts = draw_counts(plan, total, shard_slots, seed)
    chunks, n = chunks_for(-(-total // shard_slots)), plan.count()
    counts = running_position(stage(counts, "mix-counts"), ["source"], [F.col("shard")], F.xxhash64("shard"), F.col("n"), chunks, "first")
    wanted = plan.where("slots > 0").select(F.col("source").alias("_source"), "slots")
    counts = stage(counts.join(wanted, F.col("source").eqNullSafe(F.col("_source"))).drop("_source"), "mix-draws")
    drawn = counts.groupBy(F.col("source").alias("_source")).agg(F.sum("n").alias("drawn"))
    lack = plan.where("slots > 0").select("source", "slots").join(drawn, F.col("source").eqNullSafe(F.col("_source")), "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    lack = lack.where("slots > drawn").select("source", "drawn", (F.col("slots") - F.col("drawn")).alias("lack"))
    lack = prefix_sums(lack, n, [F.col("source").asc_nulls_last()], low=F.col("lack"))
    lack = stage(lack.select("source", "drawn", "low", (F.col("low") + F.col("lack")).alias("high")), "mix-lack")
    missing = lack.agg(F.coalesce(F.max("high"), F.lit(0))).collect()[0][0]
    surplus = F.greatest(F.lit(0).cast("long"), F.col("first") + F.col("n") - F.greatest("first", "slots"))
    counts = counts.withColumn("surplus", surplus)
    kept = counts.where("n > surplus").repartition(spread_over(plan), "shard", "source").select("shard", "source", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - F.col("surplus") - 1)).alias("index"))
    if not missing:
        return kept
    over = running_position(counts.where("surplus > 0").select("shard", "source", "surplus"), [], [F.col("shard"), F.col("source")], F.xxhash64("shard", "source"), F.col("surplus"), chunks, "at")
    over = over.select("shard", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("surplus") - 1)).alias("point"))
    return kept.unionByName(in_ranges(over, "point", lack, n, missing).select("shard", "source", (F.col("drawn") + F.col("point") - F.col("low")).alias("index")))


def slot_blocks(slots: DataFrame, plan: DataFrame, block: int, seed: int) -> DataFrame:
    """(shard, source, block, epoch, limit): the block of every slot and how many words of it the slot takes.

    In each epoch the full blocks come in permuted order and the short one at the end of the
    source last, so the words before place k are k blocks' and the last slot of all takes only
    what is left of the target.
    """
    s = plan.select(F.col("source").alias("_source"), "epochs", "rest", "full", "blocks")
    slots = slots.join(s, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    slots = slots.withColumn("epoch", F.floor(F.col("index") / F.col("blocks")).cast("long")).withColumn("place", F.pmod("index", "blocks"))
    key = F.xxhash64(F.lit(seed), F.coalesce("source", F.lit("\0")), F.col("epoch"))
    found = F.when(F.col("place") < F.col("full"), permute(F.col("place"), F.greatest(F.col("full"), F.lit(1).cast("long")), key)).otherwise(F.col("place"))
    left = F.when(F.col("epoch") < F.col("epochs"), F.lit(block).cast("long")).otherwise(F.col("rest") - F.col("place") * block)
    return slots.select("shard", "source", "epoch", "index", found.alias("block"), F.least(left, F.lit(block).cast("long")).alias("limit"))


def pieces(rows: DataFrame, block: int, keep: list[str]) -> DataFrame:
    """(source, block, at, from_word, n_words) of every row's part in every block; rows without words have one null part."""
    first, last = F.floor(F.col("start") / block).cast("long"), F.floor((F.col("start") + F.col("size") - 1) / block).cast("long")
    blocks = F.when(F.col("size") > 0, F.sequence(first, last))
    out = rows.select("source", "start", "size", *keep, F.explode_outer(blocks).alias("block"))
    begin = F.greatest(F.col("start"), F.col("block") * block)
    stop = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    return out.select("source", "start", "size", *keep, "block", (begin - F.col("block") * block).alias("at"), (begin - F.col("start")).alias("from_word"), (stop - begin).alias("n_words"))


def sized_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, h) of every row, kept as a table: texts are read once."""
    rows = only(docs, doc_id="long", source="string", text="string")
    return stage(rows.select("doc_id", "source", count_space_words(F.col("text")).alias("size"), text_key(F.col("text")).alias("h")), "sizes")


def mixed_pieces(sized: DataFrame, block: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The mix as rows (the parts of every document that has words, with shard, index, epoch and words taken), and the plan."""
    plan = stage(source_plan(sized, block), "mix-plan")
    placed = running_position(sized.where("size > 0"), ["source"], [F.col("doc_id"), F.col("h")], F.xxhash64("doc_id", "h"), F.col("size"), chunks_for(sized.count()), "start")
    slots = slot_blocks(mix_slots(plan, shard_slots, seed), plan, block, seed)
    slots = slots.withColumnsRenamed({"source": "_source", "block": "_block"})
    parts = pieces(placed, block, ["doc_id", "h"])
    # Slots grow with the corpus and are never broadcast, though their plan starts from one row.
    mixed = parts.join(slots.hint("merge"), F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block")), "left").drop("_source", "_block")
    taken = F.greatest(F.lit(0).cast("long"), F.least(F.col("n_words"), F.col("limit") - F.col("at")))
    return mixed.withColumn("taken", F.when(F.col("limit").isNull(), F.lit(0).cast("long")).otherwise(taken)), plan


def mix_report(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row of ``docs``.

    Null and blank texts have size 0 and are taken 0 times; a null source is a source; a source
    without words has target 0. Rows that repeat are documents of their own. Other columns are
    ignored; an empty table gives an empty one.
    """
    sized = sized_rows(docs)
    mixed, plan = mixed_pieces(sized, **how)
    per_row = mixed.groupBy("source", "start", "doc_id", "size").agg(F.sum("taken").alias("taken")).drop("start")
    wordless = sized.where("size = 0").select("source", "doc_id", "size", F.lit(0).cast("long").alias("taken"))
    goal = plan.select(F.col("source").alias("_source"), "source_size", "target")
    out = per_row.unionByName(wordless).join(goal, F.col("source").eqNullSafe(F.col("_source")))
    return out.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), F.col("taken").cast("long").alias("taken"))


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """``docs`` as the mix takes them: a row a document and epoch in which it is taken, with the words taken.

    A document taken whole keeps its text as it is; of one taken in part the words taken are
    joined by blanks, in order. n_chars, if there is such a column, is the length of the text.
    Documents without a word are not in the mix, so a table without words gives an empty one.
    All columns are kept, whatever their names; they must be of types that can be ordered.
    """
    names = docs.columns
    mixed, _ = mixed_pieces(sized_rows(docs), **how)
    key = {"s": F.coalesce(F.col("source").cast("string"), F.lit("\0")), "id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))}
    taken = mixed.where("taken > 0").groupBy("source", "start", "doc_id", "h", "size", "epoch").agg(F.sum("taken").alias("taken"), F.sort_array(F.collect_list(F.struct("from_word", "taken"))).alias("parts"))
    copies = taken.groupBy("source", "start", "doc_id", "h", "size").agg(F.collect_list(F.struct("taken", "parts")).alias("epochs"))
    copies = copies.select(*[c.alias(n) for n, c in key.items()], "h", "size", "start", "epochs")
    # Rows equal in source, doc_id and text each have a place of their own in the source.
    same = Window.partitionBy("s", "id", "h")
    copies = copies.withColumn("copy", F.row_number().over(same.orderBy("start"))).drop("start")
    worded = docs.where(F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]"))
    keyed = worded.select(*[c.alias(n) for n, c in key.items()], text_key(F.col("text").cast("string")).alias("h"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    keyed = keyed.withColumn("copy", F.row_number().over(same.orderBy(*[F.col("row")[c] for c in names if c not in ("doc_id", "text", "source")], F.lit(1))))
    took = keyed.join(copies, ["s", "id", "h", "copy"]).withColumn("e", F.explode("epochs"))
    part, text = F.col("e.taken") < F.col("size"), F.col("row.text")
    took = took.withColumn("words", F.when(part, space_words(text.cast("string"))))
    cut = F.array_join(F.flatten(F.transform("e.parts", lambda p: F.slice(F.col("words"), (p["from_word"] + 1).cast("int"), p["taken"].cast("int")))), " ")
    took = took.withColumn("mixed_text", F.when(part, cut).otherwise(text))
    new = {"text": F.col("mixed_text"), "n_chars": F.length("mixed_text")}
    return took.select(*[new[c].cast(docs.schema[c].dataType).alias(c) if c in new else F.col("row")[c].alias(c) for c in names])


def query(spark, sf_dir: str) -> DataFrame:
    """The report of a mix of all documents; edge cases are those of ``mix_report``."""
    return mix_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
