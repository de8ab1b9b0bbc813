"""Every registered query of the library against its SQL, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from figquarry.plans import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
#: Queries of narrow tables whose rows make much work.
SPREAD = ["quad_shapes", "question_build", "question_prompts"]
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def rows(df: pd.DataFrame) -> list[tuple]:
    text = lambda x: "~" if x is None or x is pd.NA or x is pd.NaT or x != x else f"{x:.9g}" if isinstance(x, float) else str(x)
    return sorted(tuple(map(text, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    df, rel = QUERIES[name](spark, DATA), duck.sql(SQL[name])
    kinds = dict(zip(rel.columns, map(str, rel.types)))
    assert {c: TYPES[k] for c, k in df.dtypes if k in TYPES} == {c: kinds[c] for c, k in df.dtypes if k in TYPES}
    assert rows(df.toPandas()) == rows(rel.df())


def agrees_on(spark, folder, name, table, df):
    """Whether a query agrees with its SQL on a table of the test's own."""
    df.write.parquet(f"{folder}/{table}.parquet")
    with duckdb.connect() as own:
        own.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
        return rows(QUERIES[name](spark, str(folder)).toPandas()) == rows(own.sql(SQL[name]).df())


def test_file_names_of_numbers_beyond_six_digits(spark, tmp_path):
    part = spark.read.parquet(f"{DATA}/part.parquet").withColumn("p_partkey", F.col("p_partkey") * 99_991)
    assert part.agg(F.max("p_partkey")).first()[0] > 9_999_999
    assert agrees_on(spark, tmp_path, "file_names", "part", part)


def test_page_fields_of_references_that_are_cut_or_of_other_kinds(spark, tmp_path):
    title = ["say &quot;a&quot;", "cut &amp", "cut &a", "&amp;copy; &copy; &middot; &amp;amp;", "&lt;b&gt; &#65;", "a  \n b"]
    pages = [(i, f'<title>{x}</title><h1> {x}</h1><p>b<li><a href="/?a=1&amp;b=&quot;{i}">{x}</a>') for i, x in enumerate(title)]
    pages += [(10, "<h1>no title</h1><p>"), (11, ""), (12, None)]
    assert agrees_on(spark, tmp_path, "page_fields", "pages", spark.createDataFrame(pages, "page_id long, html string"))


@pytest.mark.parametrize("name", SPREAD)
def test_work_on_a_narrow_table_is_spread(spark, name):
    assert QUERIES[name](spark, DATA).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_questions_are_made_once(spark):
    plan = QUERIES["question_build"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert sum("ArrowEvalPython" in line for line in plan) == 1  # sky ranges come in batches
    assert not any("Filter" in line and "size(" in line for line in plan)  # a filter before the explode makes them again


def test_a_table_of_quads_is_a_single_split(spark):
    assert spark.read.parquet(f"{DATA}/customer.parquet").rdd.getNumPartitions() == 1  # what the test above rests on


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"gbt_oof", "baseline_table"}))
def test_runs_alike_twice(spark, name):
    a, b = (rows(QUERIES[name](spark, DATA).toPandas()) for _ in range(2))
    assert a and a == b


def test_out_of_fold_counts_every_row_once(spark):
    found = QUERIES["gbt_oof"](spark, DATA).toPandas()
    assert found.n.sum() == spark.read.parquet(f"{DATA}/embeddings.parquet").count()


def test_baselines_are_scored_alike(spark):
    found = {r.features: (r.n, r.accuracy, r.deviation) for r in QUERIES["baseline_table"](spark, DATA).collect()}
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").selectExpr("label % 2 AS y").toPandas().y
    assert set(found) == {"majority", "all"} | {f"{w} {f}" for w in ("only", "without") for f in ("field_size", "concentration", "span", "sign")}
    assert {n for n, *_ in found.values()} == {len(rows)} and found["majority"][1] == pytest.approx(100 * max(rows.mean(), 1 - rows.mean()))
    assert all(20 < a < 80 and 0 <= d < 30 for _, a, d in found.values())


def test_noise_has_its_mean_and_spread(spark):
    f = QUERIES["noisy_field"](spark, DATA).toPandas()
    plane = f.ix / 63 + 0.5 * f.iy / 63
    assert abs((f.value / plane.where(plane > 0)).std() - 0.1) < 0.01 and abs((f.added - f.value).std() - 0.5) < 0.03 and abs((f.added - f.value).mean()) < 0.03
    u = QUERIES["stable_hashes"](spark, DATA).toPandas()
    assert u.u.between(0, 1, inclusive="left").all() and abs(u.u.mean() - 0.5) < 0.05 and abs(u.u.corr(u.other)) < 0.1 and u.u.nunique() == len(u)


def test_fields_fill_their_grids(spark):
    f = QUERIES["field_dispatch"](spark, DATA).toPandas()
    shape = f.groupby("fig_id").agg(n=("ix", "size"), nx=("ix", "max"), ny=("iy", "max"), low=("value", "min"), high=("value", "max"), spread=("value", "nunique"))
    assert len(shape) == 25 and (shape.n == (shape.nx + 1) * 9).all() and (shape.ny == 8).all() and sorted(set(shape.nx + 1)) == [12, 13, 14, 15, 16]
    assert shape.low.between(0, 10).all() and shape.high.between(1, 13).all() and (shape.spread > 20).all()
    p = QUERIES["plot_data"](spark, DATA).toPandas()
    lines = p[p.line >= 0].sort_values(["k", "line", "i"])
    assert len(lines) == sum(k % 3 + 1 for k in range(25)) * 20 and (lines.groupby(["k", "line"]).x.diff().dropna() >= 0).all() and len(p) - len(lines) == 500


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())
