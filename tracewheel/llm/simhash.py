"""SimHash near-duplicates: fingerprints linked by the generalised pigeonhole principle.

Two 64-bit fingerprints that differ in at most ``tau`` bits must, for any split of the bits
into parts with thresholds t_i where sum(t_i + 1) = tau + 1, differ in at most t_i bits of
some part i. So each fingerprint is indexed by the value of every part and probes each part
with all values within t_i bits. Bits that correlate share a part, and the thresholds are
those of least estimated work (candidates and probes), found by dynamic programming.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewheel.llm.common import only, stage, text_key
from tracewheel.llm.components import connected_components

BITS = 64
TAU = 4
WORDS = 4
SEED = 42
#: What one probe row (made, shuffled, sorted) costs against one candidate compared.
PROBE_COST = 12.0
#: No part is probed with more values than this; two parts of 32 bits need 529 and 33, so a plan always exists.
MOST_PROBES = 4096


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """The SimHash of a text's word shingles as an unsigned integer; 0 for a text without words."""
    import xxhash

    found = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII white space only
    if not found:
        return 0
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    n = max(1, len(found) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = ends[min(words, len(found)) - 1 :].tolist()
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 65536):
        hashes = np.array([digest(joined[s:e], seed) for s, e in zip(starts[at : at + 65536], stops[at : at + 65536], strict=True)], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="uint64").astype("int64")


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    return df.withColumn(name, F.pandas_udf(fingerprints, "long")(F.col(text).cast("string")))


def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and the 64 x 64 counts of bits set together, over all of ``fp``."""

    def partial(batches):
        total = np.zeros((BITS, BITS), np.int64)
        n = 0
        for batch in batches:
            raw = batch["fp"].to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(raw, axis=1, bitorder="little").astype(np.float32)
            for at in range(0, len(bits), 1 << 20):  # float32 counts are exact up to 2^24
                total += (bits[at : at + (1 << 20)].T @ bits[at : at + (1 << 20)]).astype(np.int64)
            n += len(bits)
        if n:
            i, j = np.triu_indices(BITS)
            yield pd.DataFrame({"i": np.append(i, -1), "j": np.append(j, -1), "c": np.append(total[i, j], n)})

    rows = prints.select("fp").mapInPandas(partial, "i int, j int, c long").groupBy("i", "j").agg(F.sum("c").alias("c")).collect()
    together, n = np.zeros((BITS, BITS)), 0
    for i, j, c in rows:
        if i < 0:
            n = c
        else:
            together[i, j] = together[j, i] = c
    return n, together


def correlated_parts(n: int, together: np.ndarray, parts: int) -> list[list[int]]:
    """Splits the bits into ``parts`` near-equal groups, each grown by the bit that correlates most with it."""
    p = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((together / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    free, out = list(range(BITS)), []
    for k in range(parts):
        width = (BITS - sum(map(len, out))) // (parts - k)
        sub = corr[np.ix_(free, free)]
        group = [free[int(np.argmax(sub.sum(axis=1)))]]
        free.remove(group[0])
        while len(group) < width:
            best = max(free, key=lambda b: (corr[b, group].sum(), -b))
            group.append(best)
            free.remove(best)
        out.append(sorted(group))
    return out


def close_chance(p: np.ndarray, bits: list[int], most: int) -> list[float]:
    """Chance that two fingerprints differ in at most 0, 1 ... ``most`` of ``bits``, bits taken as independent."""
    chance = np.zeros(most + 1)
    chance[0] = 1.0
    for b in bits:
        d = 2 * p[b] * (1 - p[b])
        chance[1:] = chance[1:] * (1 - d) + chance[:-1] * d
        chance[0] *= 1 - d
    return np.cumsum(chance).tolist()


def n_probes(width: int, threshold: int) -> int:
    """How many values of a part of ``width`` bits lie within ``threshold`` bits of one."""
    return sum(comb(width, s) for s in range(threshold + 1))


def allocate(n: int, p: np.ndarray, parts: list[list[int]], tau: int) -> tuple[float, int, list[int]] | None:
    """Estimated cost, probes and thresholds t_i >= -1 with sum(t_i + 1) = tau + 1 of least cost, then of fewest probes.

    -1 leaves a part out. None if every choice probes some part with more than MOST_PROBES values.
    """
    best: dict[int, tuple[float, int, list[int]]] = {0: (0.0, 0, [])}
    for part in parts:
        chance = close_chance(p, part, min(tau, len(part)))
        probes = [0] + [n_probes(len(part), t) for t in range(len(chance))]
        cost = [0.0] + [n * n / 2 * c + PROBE_COST * n * (1 + k) for c, k in zip(chance, probes[1:], strict=True)]
        step: dict[int, tuple[float, int, list[int]]] = {}
        for used, (c, k, chosen) in best.items():
            for t, (more, added) in enumerate(zip(cost, probes, strict=True)):
                if added <= MOST_PROBES and used + t <= tau + 1:
                    option = (c + more, k + added, [*chosen, t - 1])
                    step[used + t] = min(step.get(used + t, option), option)
        best = step
    return best.get(tau + 1)


def plan_parts(n: int, together: np.ndarray, tau: int = TAU) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each part that is probed, over all numbers of parts from 1 to tau + 1."""
    p = np.diag(together) / max(n, 1)
    options = []
    for m in range(1, tau + 2):
        parts = correlated_parts(n, together, m)
        if found := allocate(n, p, parts, tau):
            options.append((*found[:2], [(b, t) for b, t in zip(parts, found[2], strict=True) if t >= 0]))
    return min(options)[2]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _mask(bits) -> int:
    return sum(1 << b for b in bits)


def index_rows(prints: DataFrame, plan: list[tuple[list[int], int]], extra: list[str]) -> DataFrame:
    """(part, sig, fp): the value of each part."""
    keys = F.array(*[F.struct(F.lit(k).alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(_mask(bits)))).alias("sig")) for k, (bits, _) in enumerate(plan)])
    return prints.select(F.explode(keys).alias("k"), "fp", *extra).select("k.part", "k.sig", "fp", *extra)


def probe_rows(prints: DataFrame, plan: list[tuple[list[int], int]], extra: list[str]) -> DataFrame:
    """(part, sig, fp): every value within the part's threshold. The bits to turn are constants of the plan."""

    def probes(k: int, bits: list[int], t: int):
        turns = [_signed(_mask(c)) for s in range(t + 1) for c in combinations(bits, s)]
        own = F.col("fp").bitwiseAND(F.lit(_signed(_mask(bits))))
        return F.transform(F.array(*[F.lit(x).cast("long") for x in turns]), lambda x: F.struct(F.lit(k).alias("part"), own.bitwiseXOR(x).alias("sig")))

    keys = [probes(k, bits, t) for k, (bits, t) in enumerate(plan)]
    return prints.select(F.explode(F.concat(*keys)).alias("k"), "fp", *extra).select("k.part", "k.sig", "fp", *extra)


def link_components(prints: DataFrame, tau: int = TAU) -> DataFrame:
    """(fp, root) of the distinct fingerprints that have a link; links are pairs at ``tau`` bits or fewer.

    First every bucket's smallest member is compared with all that probe the bucket. That joins
    most of a dense group in a number of rows linear in its size. Then only members of a bucket
    that are still in different components are compared: within a bucket, the largest component
    is set aside, the others are compared with all. No link between components is lost, and a
    group of thousands of near copies makes no pairs within itself. Without a fingerprint there
    is no plan and no link.
    """
    n, together = bit_statistics(prints)
    if not n:
        return prints.select("fp", F.col("fp").alias("root"))
    plan = plan_parts(n, together, tau)
    index = index_rows(prints, plan, [])
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= tau
    pivots = index.groupBy("part", "sig").agg(F.min("fp").alias("other"))
    stars = probe_rows(prints, plan, []).join(pivots, ["part", "sig"]).where(near & (F.col("fp") != F.col("other")))
    stars = stage(stars.select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b")).distinct(), "stars")
    first = connected_components(stars)
    known = stage(prints.select("fp").join(first.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("comp")), "known")

    members = index_rows(known, plan, ["comp"])
    sizes = members.groupBy("part", "sig", "comp").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("part", "sig").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.count("*").alias("comps"))
    probes = probe_rows(known, plan, ["comp"]).withColumnsRenamed({"fp": "other", "comp": "other_comp"})
    # A pair's two sides see the same bucket from either side, so the pairs wanted are (outside the main one, any other).
    sided = members.join(largest, ["part", "sig"])
    few = sided.where("comp <> main").drop("main", "comps")
    cross = few.join(probes, ["part", "sig"]).where(near & (F.col("comp") != F.col("other_comp")))
    main = sided.where("comp = main").select("part", "sig", "fp", "comp")
    outside = probes.join(largest.select("part", "sig", "main"), ["part", "sig"]).where("other_comp <> main").drop("main")
    back = main.join(outside, ["part", "sig"]).where(near)
    links = cross.select("comp", "other_comp").union(back.select("comp", "other_comp")).distinct()
    merged = connected_components(links, "comp", "other_comp")
    return known.join(merged.withColumnRenamed("node", "comp"), "comp", "left").select("fp", F.coalesce("root", "comp").alias("root"))


def near_duplicates(docs: DataFrame, tau: int = TAU) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs``.

    A null or blank text has fingerprint zero and links like any other. Exact copies share a
    fingerprint and meet before any pair is made. component_id is the smallest doc_id of the
    component (nulls do not count; null if all are null). Rows may repeat; an empty table gives
    an empty one; other columns are ignored.
    """
    rows = stage(with_fingerprint(only(docs, doc_id="long", text="string"), "text", "fp").drop("text"), "fingerprints")
    prints = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "prints")
    roots = link_components(prints.select("fp"), tau).join(prints, "fp")
    # Both sides of the joins are plain tables, so that a component or a fingerprint of very many rows can be split.
    roots = stage(roots.select("fp", "root", "first"), "component-roots")
    smallest = stage(roots.groupBy("root").agg(F.min("first").alias("component_id")), "components")
    labels = stage(roots.select("fp", "root").join(smallest, "root").select("fp", "component_id"), "labels")
    return rows.join(labels, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, tau: int = TAU) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id (nulls last), then of the smallest text key.

    Rows equal in both are one document repeated; the one of the smallest content stays. All
    columns are kept, whatever their names; they must be of types that can be ordered. An empty
    table gives an empty one.
    """
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("id"), text_key(F.col("text").cast("string")).alias("key"), own)
    rows = stage(with_fingerprint(keyed.select("id", "key", F.col("row.text").alias("text")), "text", "fp").drop("text"), "fingerprints")
    prints = stage(rows.groupBy("fp").agg(F.min(F.struct("id", "key")).alias("first")), "prints")
    roots = link_components(prints.select("fp"), tau).join(prints, "fp")
    kept = stage(roots.groupBy("root").agg(F.min("first").alias("k")).select("k.id", "k.key"), "kept")
    stay = keyed.join(kept, ["id", "key"]).groupBy("id", "key").agg(F.min("row").alias("row"))
    return stay.select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
