"""Helpers shared by the corpus operators: shared storage, words, hashing, prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewheel.storage import fresh_path, staged

__all__ = ["fresh_path"]

#: ASCII white space: space and \t \n \v \f \r.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs at most the tasks that it ran.
    """
    return staged(df, name)


def only(df: DataFrame, **kinds: str) -> DataFrame:
    """The named columns cast to the given types; all other columns are left out."""
    return df.select(*[F.col(f"`{c}`").cast(kind).alias(c) for c, kind in kinds.items()])


def space_words(text: Column) -> Column:
    """The maximal runs of anything but ASCII white space; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def count_space_words(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(F.length(trimmed) == 0, F.lit(0)).otherwise(F.size(F.split(trimmed, SPACE_RUN))).cast("long")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else. ``lower`` does just that where all characters are ASCII."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def text_key(text: Column) -> Column:
    """64 bits that tell texts apart beside their doc_id; null has its own value."""
    return F.when(text.isNull(), F.lit(0)).otherwise(F.xxhash64(text, F.lit(7)))


def chunks_for(rows: int, each: int = 200_000) -> int:
    """Chunks of about ``each`` rows; at least so many that a hot group is spread over any usual number of tasks."""
    return max(256, -(-rows // each))


#: Tables of at most so many rows are put in order by one task.
FEW_ROWS = 100_000


def prefix_sums(df: DataFrame, rows: int, order: list[Column], **sums: Column) -> DataFrame:
    """Adds, for each name, the sum of its column over all rows that come before in ``order``.

    ``rows`` is a bound of the number of rows. Beyond FEW_ROWS rows are range-partitioned, sorted
    and written; each partition sums its own and one row a partition is summed over all, so no
    task meets all rows. ``order`` must tell rows apart.
    """
    if rows <= FEW_ROWS:
        earlier = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.select("*", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(name) for name, c in sums.items()])
    names = {f"_v{k}": c for k, c in enumerate(sums.values())}
    ordered = df.withColumns(names).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stage(ordered.withColumn("_at", F.monotonically_increasing_id()), "ordered").withColumn("_part", F.shiftrightunsigned("_at", 33))
    totals = placed.groupBy("_part").agg(*[F.sum(v).alias(f"_t{v}") for v in names])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_part", *[F.sum(f"_t{v}").over(before).alias(f"_s{v}") for v in names])
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    local = placed.select("*", *[F.sum(v).over(inside).alias(f"_i{v}") for v in names]).join(F.broadcast(starts), "_part")  # a row a partition
    nothing = {v: F.lit(0).cast(placed.schema[v].dataType) for v in names}
    return local.select(*df.columns, *[(F.coalesce(f"_s{v}", nothing[v]) + F.coalesce(f"_i{v}", nothing[v])).alias(name) for name, v in zip(sums, names, strict=True)])


def running_position(df: DataFrame, group: list[str], order: list[Column], spread: Column, weight: Column, chunks: int, at: str) -> DataFrame:
    """Adds ``at``: the sum of ``weight`` over the rows of the same group that come before.

    Two levels: rows of a group are dealt by ``spread`` over ``chunks`` windows, each summed
    by its own task, then the chunk totals are summed. So a group that holds a third of all
    rows never meets in one task. The order is (chunk, ``order``); rows equal in all of it
    are interchangeable.
    """
    chunked = df.withColumn("_chunk", F.pmod(spread, F.lit(chunks)).cast("int")).withColumn("_weight", weight.cast("long"))
    totals = chunked.groupBy(*group, "_chunk").agg(F.sum("_weight").alias("_total"))
    before = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_chunk").alias("_c"), F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*group, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = chunked.withColumn("_inside", F.coalesce(F.sum("_weight").over(inside), F.lit(0)))
    same = F.col("_chunk") == F.col("_c")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return local.join(starts, same).withColumn(at, F.col("_start") + F.col("_inside")).drop("_c", "_start", "_inside", "_weight", "_total", *[f"_g{i}" for i in range(len(group))])
