"""What several operators of this package share: input columns, scratch tables, checked broadcasts, a worker's memory."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table with two narrow columns up to which it may be broadcast (some 50 MB); larger ones are joined by a shuffle.
BROADCAST_ROWS = 2_000_000

#: Bytes of rows that go to a Python worker at once, unless the session sets its own bound: with long texts Spark's default of rows is too much.
BATCH_BYTES = 4 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
#: What a worker remembers of single words: bytes in all (an estimate of keys, values and table), and the longest word kept.
MEMO_BYTES = 80 << 20
MEMO_WORD = 64
_ENTRY_BYTES = 180
_scratch: set[str] = set()
_local: dict[str, str] = {}
_held: list[Any] = [None, None]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only doc_id and text, so that no further column can clash with one an operator makes."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def scratch_dir(spark: SparkSession) -> str:
    """A new folder that all executors share: under spark.checkpoint.dir. Where that is unset, under the warehouse on a
    cluster, and under a temporary folder if driver and executors are one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and re.match(r"local(\[|$)", spark.sparkContext.master):
        base = _local.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="figquarry-"))
    own = f"{(base or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/{spark.sparkContext.applicationId}"
    if own not in _scratch:  # goes when the application ends
        path = spark._jvm.org.apache.hadoop.fs.Path(own)
        store = path.getFileSystem(spark._jsc.hadoopConfiguration())
        store.mkdirs(path)
        store.deleteOnExit(path)
        _scratch.add(own)
    return f"{own}/{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Writes df to a scratch table and reads it again: cuts the lineage, and survives the loss of executors."""
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has max_rows rows at most (they are counted), else df as it is."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def join_apart(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left joined with right (one row a key) by a long key that right was grouped by.

    The join is by the key's complement, which no side is dealt out by yet: so both are dealt out for this join alone,
    and Spark can split the rows of a large key, which it can't where a side comes straight from its aggregation.
    """
    other = right.withColumn("_apart", F.bitwise_not(F.col(key))).drop(key)
    return left.join(other, F.bitwise_not(F.col(key)) == F.col("_apart")).drop("_apart")


def clean_labels(labels: DataFrame, column: str) -> DataFrame:
    """One row (doc_id, label 0/1) a document; rows with a null are left out, contradictory ones count as the larger label."""
    return (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
        .where("doc_id IS NOT NULL AND label IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )


def with_label(docs: DataFrame, labels: DataFrame, column: str, how: str = "inner") -> DataFrame:
    """docs (doc_id, text) with the label. Labels are broadcast if few, so that texts aren't shuffled."""
    return docs.join(small_side(clean_labels(labels, column)), "doc_id", how)


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of doc_id as text, modulo; null ids have none."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


def in_arrow(df: DataFrame, run: Callable, schema: Any) -> DataFrame:
    """df.mapInArrow in batches of at most BATCH_BYTES (or what the session has set)."""
    if df.sparkSession.conf.get(_BATCH_CONF, None) is None:
        df.sparkSession.conf.set(_BATCH_CONF, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def held_by_worker(key: tuple, make: Callable[[], Any]) -> Any:
    """What `make` returns, made once for as long as a worker works for the same operator: a worker holds one such thing."""
    if _held[0] != key:
        _held[:] = [None, None]
        gc.collect()
        _held[:] = [key, make()]
    return _held[1]


class Memo:
    """Values of words, remembered within a bound of bytes.

    Two generations: when the younger has half of the bytes, it becomes the older, and what is used again moves up.
    Words longer than MEMO_WORD are never kept.
    """

    def __init__(self, limit: int = MEMO_BYTES) -> None:
        self.limit, self.used = limit, 0
        self.young: dict[str, Any] = {}
        self.old: dict[str, Any] = {}

    def values(self, words: Sequence[str], compute: Callable[[list[str]], Iterable[Any]]) -> list[Any]:
        """The value of each word; compute(new words) gives those that aren't remembered (never None)."""
        got = list(map(self.young.get, words))
        if None not in got:
            return got
        missing = {w: self.old.get(w) for w, g in zip(words, got) if g is None}
        new = [w for w, v in missing.items() if v is None]
        missing |= zip(new, compute(new)) if new else ()
        for w, v in missing.items():
            if len(w) <= MEMO_WORD:
                self.used += _ENTRY_BYTES + 2 * len(w) + (len(v) if isinstance(v, bytes) else 0)
                self.young[w] = v
        if self.used > self.limit // 2:
            self.young, self.old, self.used = {}, self.young, 0
        return [missing[w] if g is None else g for w, g in zip(words, got)]
