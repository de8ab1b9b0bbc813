"""Queries that write tables and read them again: the sources and sinks of the library. They write under the shared scratch folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources import files as IO
from ..streaming import incremental as I
from .registry import query, r


@query("SELECT event_type AS run, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE event_type IN ('click', 'view') GROUP BY 1")
def answer_store(t):
    """S3: answers kept by run and model; a filter on the run reads only its folders"""
    e = t("events").select(F.col("event_type").alias("run"), F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model"), "event_id", "value")
    path = IO.scratch(e.sparkSession)
    IO.write_answers(e, path)
    return IO.read_answers(e.sparkSession, path).where(F.col("run").isin("click", "view")).groupBy("run").agg(F.count("*").alias("n"), r(F.sum("value"), 4).alias("total"))


@query("SELECT l_returnflag AS flag, count(*) AS n, sum(l_orderkey)::BIGINT AS keys, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1")
def csv_shards(t):
    """Shards appended by several writers and read as one table"""
    li = t("lineitem").select(F.col("l_returnflag").alias("flag"), "l_orderkey", "l_quantity")
    path = IO.scratch(li.sparkSession)
    IO.append_shards(li.where("l_orderkey % 2 = 0"), path)
    IO.append_shards(li.where("l_orderkey % 2 <> 0"), path)
    read = IO.read_csv(li.sparkSession, path, "flag STRING, l_orderkey BIGINT, l_quantity DOUBLE")
    return read.groupBy("flag").agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("keys"), r(F.sum("l_quantity"), 2).alias("quantity"))


@query("SELECT s_suppkey AS k, CASE WHEN s_acctbal > 6000 THEN 'third' WHEN s_acctbal > 2000 THEN 'second' ELSE 'first' END AS batch, CASE WHEN s_acctbal > 2000 THEN s_nationkey + 1 ELSE s_nationkey END::INT AS v FROM supplier")
def csv_checkpoints(t):
    """A table brought up to date by three batches, each a version of its own"""
    s = t("supplier").select(F.col("s_suppkey").alias("k"), "s_acctbal", F.col("s_nationkey").alias("v"))
    path, schema = IO.scratch(s.sparkSession), "k BIGINT, batch STRING, v INT"
    IO.checkpoint(s.select("k", F.lit("first").alias("batch"), "v"), path, ["k"], schema)
    IO.checkpoint(s.where("s_acctbal > 2000").select("k", F.lit("second").alias("batch"), (F.col("v") + 1).alias("v")), path, ["k"], schema)
    return IO.checkpoint(s.where("s_acctbal > 6000").select("k", F.lit("third").alias("batch"), (F.col("v") + 1).alias("v")), path, ["k"], schema)


@query("""WITH s AS (SELECT s_suppkey AS k, s_name AS preset, s_nationkey AS seed, s_acctbal > 5000 AS updated FROM supplier)
SELECT k, CASE WHEN updated THEN 'aged' ELSE preset END AS preset, CASE WHEN updated THEN NULL ELSE seed END::INT AS seed, CASE WHEN updated THEN 'fold|stain' END AS effects FROM s
UNION ALL SELECT k + 1000000, 'aged', NULL, 'fold|stain' FROM s WHERE updated""")
def manifest_merge(t):
    """A manifest of JSON lines with sorted keys, merged with new and changed records, written and read again"""
    s = t("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("preset"), F.col("s_nationkey").alias("seed"), "s_acctbal")
    spark, schema = s.sparkSession, "k BIGINT, preset STRING, seed INT, effects ARRAY<STRING>"
    path, first = IO.scratch(spark), IO.scratch(spark)
    IO.write_manifest(s.drop("s_acctbal"), first, ["k"])
    IO.update_manifest(IO.read_manifest(spark, first, schema), path, ["k"])
    aged = [F.lit("aged").alias("preset"), F.lit(None).cast("int").alias("seed"), F.array(F.lit("fold"), F.lit("stain")).alias("effects")]
    changed = s.where("s_acctbal > 5000").select("k", *aged)
    new = changed.unionByName(changed.withColumn("k", F.col("k") + 1_000_000))
    return IO.update_manifest(new, path, ["k"]).select("k", "preset", "seed", F.array_join("effects", "|").alias("effects"))


@query("SELECT p_partkey AS k, 'say \"' || p_name || '\\' || p_brand AS name, p_size AS size FROM part")
def json_documents(t):
    """A folder of documents, JSON strings that hold JSON, one a file, written and read as a data source"""
    p = t("part").select(F.col("p_partkey").alias("k"), F.concat(F.lit('say "'), "p_name", F.lit("\\"), "p_brand").alias("name"), F.col("p_size").alias("size"))
    path = IO.scratch(p.sparkSession)
    IO.save_documents(p, path, F.format_string("figure_%06d", "k"))
    good, _ = IO.read_documents(p.sparkSession, path, "k BIGINT, name STRING, size INT")
    return good.select("record.*")


@query("SELECT c_custkey AS k, c_name AS name, CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS segment, round(c_acctbal, 2) AS balance FROM customer")
def table_sink(t):
    """A sorted table for people, read again"""
    c = t("customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("segment"), F.col("c_acctbal").alias("balance"))
    path = IO.scratch(c.sparkSession)
    IO.write_table(c, path, ["k"])
    return IO.read_csv(c.sparkSession, path, "k BIGINT, name STRING, segment STRING, balance DOUBLE").withColumn("balance", r("balance", 2))


@query("""SELECT p_partkey AS k, p_name || '.fits' AS pdf, p_brand AS object, p_type AS survey, p_partkey AS number, CASE WHEN p_partkey BETWEEN 1 AND 60 THEN 'contour' WHEN p_partkey BETWEEN 61 AND 120 THEN 'gmm' END AS block FROM part""")
def file_names(t):
    """Fields of file names; a figure's number and the half-open block it is in"""
    path = F.concat(F.lit("/cache/x/image_"), "p_name", F.lit(".fits_OBJ_"), "p_brand", F.lit("_SURVEY_"), "p_type", F.lit("_height0.5.fits"))
    fields = IO.file_record(path)
    number, block = IO.figure_block(F.format_string("Picture_%06d.json", "p_partkey"), [("contour", 0, 60), ("gmm", 60, 120)])
    return t("part").select(F.col("p_partkey").alias("k"), *[x.alias(n) for n, x in fields.items()], number.cast("long").alias("number"), block.alias("block"))


@query("SELECT DISTINCT l_returnflag AS object, l_linestatus AS survey, CAST(l_linenumber AS VARCHAR) AS pdf FROM lineitem")
def failure_log(t):
    """ST2: a log of CSV shards as a stream with bounded state, each failure once in a versioned table"""
    li = t("lineitem").select(F.col("l_returnflag").alias("object"), F.col("l_linestatus").alias("survey"), F.col("l_linenumber").cast("string").alias("pdf"), F.lit("no survey").alias("reason"))
    spark, path, out = li.sparkSession, IO.scratch(li.sparkSession), IO.scratch(li.sparkSession)
    IO.append_shards(li.where("survey = 'F'"), path)
    IO.append_shards(li.where("survey <> 'F'"), path)
    stream = I.stream_log(spark, path, "object STRING, survey STRING, pdf STRING, reason STRING", ["object", "survey", "pdf"])
    I.keep_log(stream, f"{out}/log", ["object", "survey", "pdf"], f"{out}/state").awaitTermination()
    return IO.versions.read(spark, f"{out}/log").select("object", "survey", "pdf")


@query()
def stable_hashes(t):
    """Uniform numbers hashed from keys. Spark's own hash: tested for range, spread and repeatability"""
    return t("orders").select("o_orderkey", S.hash_u01(42, "o_orderkey").alias("u"), S.hash_u01(43, "o_orderkey").alias("other"))
