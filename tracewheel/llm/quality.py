"""Quality rules: a table of thresholds compiled into one projection, without user functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewheel.llm.common import SPACES, lower_ascii, space_words

SYMBOLS = r"[#*$%&|<>]"
#: Common function words of the languages that are kept.
STOP_WORDS = {
    "en": "the be to of and that have with in a is for it on as was at by from this an or are not".split(),
    "fr": "le la les de des du un une et est que qui en pour par dans sur au aux avec pas ce il elle ne se".split(),
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch an".split(),
    "es": "el la los las de y en un una que es por con para del al se no su lo como más".split(),
}

#: (rule, measure, least, most): a text is kept if every measure lies within its limits; None leaves a side open.
THRESHOLDS = (
    ("words", "n_words", 50, None),
    ("word_length", "mean_word_chars", 2.0, 20.0),
    ("symbols", "symbols_per_word", None, 0.1),
    ("stop_words", "stop_word_ratio", 0.05, None),
    ("repeated_lines", "dup_line_ratio", None, 0.3),
    ("bullet_lines", "bullet_line_ratio", None, 0.9),
    ("ellipsis_lines", "ellipsis_line_ratio", None, 0.3),
)

#: Fewer repeated lines than these are chance, not repetition: their ratio is 0.
LEAST_DUP_LINES = 3

BASE_WORDS = 50
BASE_REPEAT_PERCENT = 50


def repeated_cover(sorted_windows: str, width: int) -> Column:
    """How many word positions lie in windows whose hash occurs twice; ``sorted_windows`` holds (h, p) in order."""
    s = F.col(sorted_windows)
    same = lambda i: F.coalesce(F.get(s, i)["h"], F.lit(None))  # noqa: E731  null outside the array
    at = F.transform(s, lambda x, i: F.when((same(i - 1) == x["h"]) | (same(i + 1) == x["h"]), x["p"]))
    places = F.sort_array(F.array_compact(at))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))
    return F.aggregate(places, start, lambda a, p: F.struct((p + width).alias("end"), (a["total"] + p + width - F.greatest(p, a["end"])).alias("total")), lambda a: a["total"])


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every measure of the rules, prefixed ``_q_`` so that no column of ``docs`` is hidden.

    Repeated windows are found by sorting 64-bit window hashes with their positions, and only
    in texts where some hash occurs twice; all within the row, in n log n steps.
    """
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    out = docs.withColumn("_q_text", t).withColumn("_q_words", space_words(F.col("_q_text")))
    out = out.withColumn("_q_lines", F.filter(F.split("_q_text", "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0))
    out = out.withColumn("_q_n_words", F.size("_q_words").cast("long"))
    w = F.col("_q_words")
    windows = F.when(F.col("_q_n_words") >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))
    out = out.withColumn("_q_windows", windows)
    hashes = F.col("_q_windows")
    repeats = F.size(F.array_distinct(hashes)) < F.size(hashes)
    out = out.withColumn("_q_sorted", F.when(repeats, F.sort_array(F.transform(hashes, lambda h, p: F.struct(h.alias("h"), p.alias("p"))))))
    lines = F.greatest(F.size("_q_lines"), F.lit(1))
    n = F.greatest(F.col("_q_n_words"), F.lit(1))
    stops = sorted({w for ws in STOP_WORDS.values() for w in ws})
    measures = {
        "word_chars": F.length(F.array_join("_q_words", "")).cast("long"),
        "n_symbols": F.regexp_count("_q_text", F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"),
        "n_repeat_words": F.when(F.col("_q_sorted").isNull(), F.lit(0)).otherwise(repeated_cover("_q_sorted", 3)).cast("long"),
        "n_stop_words": F.size(F.filter(space_words(lower_ascii(F.col("_q_text"))), lambda x: x.isin(stops))).cast("long"),
        "bullet_line_ratio": F.size(F.filter("_q_lines", lambda x: F.ltrim(x).rlike("^[-*•]"))) / lines,
        "ellipsis_line_ratio": F.size(F.filter("_q_lines", lambda x: F.rtrim(x).rlike("(\\.\\.\\.|…)$"))) / lines,
    }
    out = out.withColumns({f"_q_{k}": v for k, v in measures.items()})
    return out.withColumns({"_q_mean_word_chars": F.col("_q_word_chars") / n, "_q_symbols_per_word": F.col("_q_n_symbols") / n, "_q_stop_word_ratio": F.col("_q_n_stop_words") / n, "_q_dup_line_ratio": F.when(F.col("_q_n_dup_lines") >= LEAST_DUP_LINES, F.col("_q_n_dup_lines") / lines).otherwise(0.0)})


def compiled(thresholds=THRESHOLDS) -> Column:
    """The names of the rules that a measured row fails, in the table's order: one expression of the projection."""
    failed = []
    for rule, name, least, most in thresholds:
        m, bad = F.col(f"_q_{name}"), F.lit(False)
        if least is not None:
            bad = bad | (m < least)
        if most is not None:
            bad = bad | (m > most)
        failed.append(F.when(bad, F.lit(rule)))
    return F.array_compact(F.array(*failed))


def base_failed() -> Column:
    return (F.col("_q_n_words") < BASE_WORDS) | (100 * F.col("_q_n_repeat_words") > BASE_REPEAT_PERCENT * F.col("_q_n_words"))


def quality_report(docs: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """Measures and verdict of every row; a null or blank text has no words and fails.

    Rows may repeat, an empty table gives an empty one, other columns are ignored.
    """
    q = measure(docs.select("doc_id", F.col("text").cast("string").alias("text")))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    failed = compiled(thresholds)
    row = F.struct(*[F.col(f"_q_{c}").alias(c) for c in names], base_failed().alias("base_failed"), (~base_failed() & (F.size(failed) == 0)).alias("kept"), failed.alias("failed_rules"))
    # A filter on the verdict stays above the generator; below it, it would make every measure again for each use.
    return q.select("doc_id", F.explode(F.array(row)).alias("q")).select("doc_id", "q.*")


def keep_good(docs: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """The rows of ``docs`` that pass the base test and every rule, with all their columns; none of an empty table.

    The verdict passes through a generator, below which the optimizer moves no filter: moved
    there, the measures would be made again for each use.
    """
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    q = measure(docs.select(own, F.col("text").cast("string").alias("text")))
    q = q.select("row", F.explode(F.array(~base_failed() & (F.size(compiled(thresholds)) == 0))).alias("_q_kept"))
    return q.where("_q_kept").select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    """The report of all documents; edge cases are those of ``quality_report``."""
    return quality_report(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("failed_rules")


def _sql_limits() -> str:
    out = []
    for _, name, least, most in THRESHOLDS:
        out += [f"{name} >= {least}"] * (least is not None) + [f"{name} <= {most}"] * (most is not None)
    return " AND ".join(out)


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: NOT regexp_full_match(x, '[\\x20\\x09-\\x0D]*')) AS ls FROM d),
g AS (SELECT rid, unnest(range(1, len(ws) - 1)) AS i, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2])) AS tri FROM w WHERE len(ws) >= 3),
k AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, tri) AS c FROM g),
r AS (SELECT rid, count(DISTINCT i + o) AS n_repeat_words FROM k, (VALUES (0), (1), (2)) AS v(o) WHERE c > 1 GROUP BY rid),
m AS (SELECT w.rid, doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
             length(t) - length(regexp_replace(t, '{SYMBOLS}', '', 'g')) AS n_symbols,
             len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
             len(list_filter(string_split_regex(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: list_contains({sorted({w for ws in STOP_WORDS.values() for w in ws})}, x))) AS n_stop_words,
             len(list_filter(ls, lambda x: regexp_matches(ltrim(x, ' '), '^[-*•]'))) / greatest(len(ls), 1) AS bullet_line_ratio,
             len(list_filter(ls, lambda x: regexp_matches(rtrim(x, ' '), '(\\.\\.\\.|…)$'))) / greatest(len(ls), 1) AS ellipsis_line_ratio,
             greatest(len(ls), 1) AS lines
      FROM w LEFT JOIN r ON w.rid = r.rid),
q AS (SELECT *, word_chars / greatest(n_words, 1) AS mean_word_chars, n_symbols / greatest(n_words, 1) AS symbols_per_word,
             n_stop_words / greatest(n_words, 1) AS stop_word_ratio, CASE WHEN n_dup_lines >= {LEAST_DUP_LINES} THEN n_dup_lines / lines ELSE 0 END AS dup_line_ratio, n_words < {BASE_WORDS} OR 100 * n_repeat_words > {BASE_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND {_sql_limits()} AS kept
FROM q
"""
