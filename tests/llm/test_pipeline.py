"""The pipeline's stages on a small table, each against a plain version of what it should keep."""

import os

import pytest

import corpus_pipeline as C

DATA = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_stages(spark, tmp_path):
    from figquarry.llm import secret_scan, simhash
    from figquarry.llm.common import table

    docs = table(spark, DATA, "documents")
    columns, before = docs.columns, docs.count()
    for k, (name, stage) in enumerate(C.STAGES):
        out = stage(spark, docs, DATA)
        out.write.parquet(path := str(tmp_path / str(k)))
        out = spark.read.parquet(path)
        if name == "toxicity":
            assert before * 0.7 < out.count() < before
        if name == "simhash_near_dedup":
            groups = {r.doc_id: r.component_id for r in simhash.alike(docs).collect()}
            assert sorted(r.doc_id for r in out.select("doc_id").collect()) == sorted({c for c in groups.values()})
        if name == "secret_scan":
            assert secret_scan.scan(out).agg({"n_assign": "sum", "n_access": "sum", "n_hex": "sum"}).first()[0] == 0
            assert out.count() == docs.count()
        if k < len(C.STAGES) - 1:
            assert out.columns == columns
            docs = out
    last = spark.read.parquet(path)
    assert last.select("doc_id").distinct().count() == docs.count()


def test_run_and_empty(spark, tmp_path):
    assert C.run(spark, DATA).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    for name in os.listdir(DATA):
        if name.split(".")[0] in ("documents", "labels", "benchmark"):
            spark.read.parquet(f"{DATA}/{name}").limit(0).write.parquet(str(tmp_path / name))
    assert C.run(spark, str(tmp_path)).count() == 0


def test_near_copies_with_clashing_columns(spark):
    names = ["_kept", "_rows", "_row", "kept", "rows", "row", "id", "_apart", "component_id", "rep", "label"]
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long, "a"), (2, long + " end", "b"), (2, long + " end", "b"), (3, None, "c"), (4, "", "d"), (None, "x", "e"), (None, "x", "e"), (None, None, "f"), (5, "own words here", "g"), (5, "other words there", "h")]
    df = spark.createDataFrame([(i, t, s, *[s] * len(names)) for i, t, s in rows], "doc_id int, text string, source string, " + ", ".join(f"{n} string" for n in names))
    out = C.drop_near_copies(spark, df, DATA)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text or "", r.source) for r in out.collect())
    assert [g[:2] for g in got] == [(False, 1), (False, 3), (False, 5), (True, 0), (True, 0)] and all(r._kept == r.source == r.row for r in out.collect())
