import pytest
from conftest import SF, same_rows

import corpus_pipeline
from tracewheel.llm import mixing, quality, simhash, winnow
from tracewheel.llm.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, SF), duck.sql(ORACLES[name]).df())


def test_every_oracle_is_sql():
    assert all(isinstance(sql, str) for sql in ORACLES.values())


def test_pipeline_applies_its_stages_in_order(spark, duck):
    """Each stage's decisions, taken from the operators' reports, give the documents that the next one reads."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r["doc_id"] for r in quality.quality_report(docs).where("kept").collect()}
    docs = docs.where(docs["doc_id"].isin(kept))
    first = {r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    docs = docs.where(docs["doc_id"].isin(first))
    clean = {r["doc_id"] for r in winnow.contamination(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).where("not contaminated").collect()}
    docs = docs.where(docs["doc_id"].isin(clean))
    taken = {r["doc_id"] for r in mixing.mix_report(docs).where("taken > 0").collect()}
    rows = corpus_pipeline.run(spark, SF).orderBy("start").collect()
    assert {r["doc_id"] for r in rows} == taken
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "simhash near-dedup", "benchmark decontamination", "source mixing", "token binary output"]


CLASH = ["_id", "_key", "h", "fp", "row", "start", "size", "shard", "_q_words", "a.b"]


def written(tmp_path, docs):
    """A folder with documents (doc_id, text, lang, source, n_chars and clashing columns) and a benchmark."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    kinds = [("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64()), *[(c, pa.string()) for c in CLASH]]
    cols = {n: pa.array([d[k] if k < 5 else f"own {n}" for d in docs], kind) for k, (n, kind) in enumerate(kinds)}
    pq.write_table(pa.table(cols), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([1, None], pa.int64()), "text": pa.array(["one two three four five six seven eight nine ten", None])}), tmp_path / "benchmark.parquet")
    return f"file://{tmp_path}"


def words(k, n=60):
    return " ".join(f"the w{k}x{j} of" if j % 3 else f"and v{k * 7 + j}" for j in range(n))


EDGE = [(1, words(1), "en", "a", 1), (1, words(1), "en", "a", 1), (2, None, None, None, None), (3, "", "en", "a", 0), (None, words(2), None, None, None), (None, words(2), None, None, None),
        (4, words(3, 4000), "en", "b", 5), (5, words(4) + " one two three four five six seven eight nine ten", "en", "b", 6), (6, words(5), "fr", "c", 7), (7, words(1).upper().lower(), "en", "c", 1)]


@pytest.mark.parametrize("docs", [[], [(1, "too short", "en", "a", 9), (2, None, None, None, None)]])
def test_pipeline_of_nothing_is_empty(spark, tmp_path, docs):
    assert corpus_pipeline.run(spark, written(tmp_path, docs)).collect() == []


def test_pipeline_handles_odd_rows(spark, tmp_path):
    sf = written(tmp_path, EDGE)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        got = docs.collect()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *CLASH], name
        assert got and all(r[c] == f"own {c}" for r in got for c in CLASH), name
        ids = sorted({str(r["doc_id"]) for r in got})
        assert ids == (["1", "4", "5", "6", "7", "None"] if name == "quality rules" else ["1", "4", "5", "6", "None"] if name == "simhash near-dedup" else ["1", "4", "6", "None"]), name
    rows = corpus_pipeline.run(spark, sf).orderBy("start").collect()
    assert {str(r["doc_id"]) for r in rows} == {"1", "4", "6", "None"}
    assert [r["start"] for r in rows] == [sum(x["n_tokens"] for x in rows[:k]) for k in range(len(rows))]
