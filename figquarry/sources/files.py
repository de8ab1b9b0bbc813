"""Sources and sinks: double-encoded JSON documents, shard directories of CSV, answer tables, pages, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.html import html_pairs
from ..functions.parse import decode_twice as decode_twice
from ..functions.scalars import c, plain_text
from . import encoded, versions
from .scratch import scratch as scratch


def read_documents(spark: SparkSession, path: str, schema: str | None = None) -> tuple[DataFrame, DataFrame]:
    """One row for each file of a folder (path, name, json, and the parsed record if a schema is given), and the
    unreadable ones apart with the reason (error)."""
    encoded.register(spark)
    found = spark.read.format(encoded.FORMAT).load(path)
    good, bad = found.where("error IS NULL").drop("error"), found.where("error IS NOT NULL").select("path", "name", "error")
    return (good.withColumn("record", F.from_json("json", schema)) if schema else good), bad


def save_documents(df: DataFrame, path: str, name: Column, mode: str = "append") -> None:
    """Each row as a file of its own, a JSON string that holds JSON; all of a job's files become visible at once."""
    encoded.register(df.sparkSession)
    df.select(name.alias("name"), F.to_json(F.struct(*df.columns)).alias("json")).write.format(encoded.FORMAT).mode(mode).save(path)


def write_documents(df: DataFrame, path: str) -> None:
    """Each row as a JSON string that holds JSON, committed as a whole by Spark's output committer."""
    text = F.to_json(F.struct(*df.columns))
    escaped = F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    df.select(escaped.alias("value")).write.mode("overwrite").text(path)


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """S3: answers stored under run=/model=: both become columns, and filters on them prune folders."""
    return spark.read.parquet(path)


def write_answers(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("run", "model").parquet(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file or a folder of shards, with header and a given schema."""
    return spark.read.csv(path, header=True, schema=schema)


def append_shards(df: DataFrame, path: str) -> None:
    """Every task adds a file of its own."""
    df.write.mode("append").csv(path, header=True)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows that aren't in new, and new."""
    return old.join(new.select(*keys), keys, "left_anti").select(*old.columns).unionByName(new, allowMissingColumns=True)


def upsert_into(new: DataFrame, path: str, keys: list[str], form: str = "parquet", writer: str | None = None, batch: int = 0) -> DataFrame:
    """A versioned table (see versions) brought up to date by a batch, whoever else writes to it: rows of new replace
    those of their keys, and the result is sorted by key. Returns the table as committed."""
    spark = new.sparkSession
    merge = lambda old: (upsert(old, new, keys) if old is not None else new).orderBy(*keys)
    return versions.read(spark, path, versions.commit(spark, path, merge, form, writer, batch).number)


def checkpoint(new: DataFrame, path: str, keys: list[str], schema: str) -> DataFrame:
    """A CSV table of a given schema brought up to date by a batch, sorted by key: what a crash leaves behind is the
    version before. Returns the table."""
    typed = new.sparkSession.createDataFrame([], schema).unionByName(new)
    return upsert_into(typed, path, keys, "csv")


def update_manifest(new: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """A versioned manifest of JSON lines with sorted keys, merged with new and changed records. Returns it."""
    return upsert_into(new.select(*sorted(new.columns)), path, keys, "json")


def write_manifest(df: DataFrame, path: str, keys: list[str]) -> None:
    """A manifest as JSON lines in order of key, the fields of each in order of name; missing ones are left out."""
    line = F.to_json(F.struct(*sorted(df.columns)))
    df.orderBy(*keys).select(line.alias("value")).write.mode("overwrite").text(path)


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """S12"""
    return spark.read.schema(schema).json(path)


def write_table(df: DataFrame, path: str, order: list[str]) -> None:
    """A sorted CSV table with header, for people: NULL as an empty field."""
    df.orderBy(*order).write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue='""')


def file_record(path) -> dict[str, Column]:
    """The fields of image_<pdf>_OBJ_<object>_SURVEY_<survey>_height... file names."""
    name = F.regexp_extract(c(path), r"([^/]+)$", 1)
    field = lambda p: F.nullif(F.regexp_extract(name, p, 1), F.lit(""))
    return {"pdf": field(r"^image_(.+?)_OBJ_"), "object": field(r"_OBJ_(.+?)_SURVEY_"), "survey": field(r"_SURVEY_(.+?)_height")}


def figure_block(name, blocks: list[tuple[str, int, int]], pattern: str = r"(\d+)") -> tuple[Column, Column]:
    """A figure's number, and the block (low, high] that it is in."""
    number = F.regexp_extract(c(name), pattern, 1).try_cast("int")
    category = F.lit(None).cast("string")
    for label, low, high in reversed(blocks):
        category = F.when((number > low) & (number <= high), label).otherwise(category)
    return number, category


def html_field(html, pattern: str) -> Column:
    """The text of a pattern's first group, tags and entities resolved."""
    return F.nullif(plain_text(F.regexp_extract(c(html), pattern, 1)), F.lit(""))


def html_table(html, allowed: list[str] | None = None) -> Column:
    """Header cell -> data cell of HTML tables as a map, restricted to allowed keys."""
    pairs = html_pairs(html)
    return F.map_filter(pairs, lambda k, _: k.isin(allowed)) if allowed else pairs
