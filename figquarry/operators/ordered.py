"""Ordered passes that never bring a whole key together: places, running sums and neighbours by a two-level scan.

Rows are dealt into ranges of (keys, order) by splitters that Spark samples from them, so one large key spreads over all
tasks however its order column is distributed. Each range is worked through on its own and leaves a summary row for each
key that it holds part of: rows, sums, first and last values. A pass over those (as many for a key as it has ranges) gives
what came before, which is added to the rows.

The ranges are written to a scratch table before anything refers to them by number: a lost executor can't change them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .keys import beside


#: Rows of a key up to which one task orders them: a key of this size is sorted in well under a second.
LARGE = 100_000


def _has_large(df: DataFrame, keys: Sequence[str]) -> bool:
    """Whether any key has more than LARGE rows."""
    if not keys:
        return df.limit(LARGE + 1).count() > LARGE
    return not df.groupBy(*keys).agg(F.count("*").alias("_rows")).where(F.col("_rows") > LARGE).isEmpty()


def ranged(df: DataFrame, keys: Sequence[str], order: Sequence[Column], ranges: int | None = None) -> DataFrame:
    """df with `_range`, the number of the range of (keys, order) that a row is in, and `_salt`, which tells equal rows apart.

    ranges: as many as shuffle partitions unless given. Rows that agree in all keys and the whole order are split too.
    """
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = df.withColumn("_salt", F.rand(20_011))
    dealt = salted.repartitionByRange(max(1, n), *[F.col(k) for k in keys], *order, F.col("_salt"))
    return written(dealt.withColumn("_range", F.spark_partition_id()))


def scan(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], place: str | None = None, total: str | None = None, sums: dict[str, Column] | None = None,
    previous: dict[str, Column] | None = None, following: dict[str, Column] | None = None, ranges: int | None = None,
) -> DataFrame:
    """df with, for each row among those of its key in the given order:

    place: how many rows come before it; total: the key's rows; sums: the running sum of a column, the row's own value
    included and NULL as 0; previous and following: the value of a column in the row before and after (NULL where there
    is none). A missing key is a key. Rows that agree in the whole order stand in some order, the same for all that one
    call returns. order may be any expressions, ascending or descending.
    """
    keys, own, across = list(keys), Window.partitionBy("_range", *keys).orderBy(*order, "_salt"), Window.partitionBy(*keys).orderBy("_range")
    below, so_far = across.rowsBetween(Window.unboundedPreceding, -1), own.rowsBetween(Window.unboundedPreceding, 0)
    # each result: its column (v) beside the row, what it is within the range (l), what a range leaves (s), what is carried over (c)
    inputs, local, summary, carry, out = {}, {"_place": F.row_number().over(own).cast("long") - 1}, {"_rows": F.count("*")}, {"_before": F.coalesce(F.sum("_rows").over(below), F.lit(0))}, []
    if total:
        carry["_total"] = F.sum("_rows").over(Window.partitionBy(*keys))
    for i, (name, x) in enumerate((sums or {}).items()):
        inputs[f"_v{i}"] = F.coalesce(x, F.lit(0))
        local[f"_l{i}"], summary[f"_s{i}"], carry[f"_c{i}"] = F.sum(f"_v{i}").over(so_far), F.sum(f"_v{i}"), F.sum(f"_s{i}").over(below)
        out.append((F.col(f"_l{i}") + F.coalesce(f"_c{i}", F.lit(0))).alias(name))
    for some, step, end, tag in ((previous, F.lag, F.max_by, "p"), (following, F.lead, F.min_by, "f")):
        for i, (name, x) in enumerate((some or {}).items()):
            v, l, s, c = (f"_{kind}{tag}{i}" for kind in "vlsc")
            inputs[v] = F.struct(x.alias("x"))
            local[l], summary[s], carry[c] = step(v).over(own), end(v, "_place"), step(s).over(across)
            out.append(F.coalesce(l, c)["x"].alias(name))
    placed = ranged(df.withColumns(inputs) if inputs else df, keys, order, ranges).withColumns(local)
    carried = placed.groupBy(*keys, "_range").agg(*[x.alias(n) for n, x in summary.items()]).withColumns(carry).select(*keys, "_range", *carry)
    joined = beside(placed, carried, [*keys, "_range"])
    first = [(F.col("_place") + F.col("_before")).alias(place)] if place else []
    return joined.select(*df.columns, *first, *([F.col("_total").alias(total)] if total else []), *out)


def _at_once(df: DataFrame, keys: list[str], order: Sequence[Column], place: str | None, total: str | None, sums: dict, previous: dict, following: dict) -> DataFrame:
    """scan for keys that a task can hold."""
    whole = Window.partitionBy(*keys)
    own = whole.orderBy(*order)
    out = {place: F.row_number().over(own).cast("long") - 1} if place else {}
    out |= {total: F.count("*").over(whole)} if total else {}
    out |= {name: F.sum(F.coalesce(x, F.lit(0))).over(own.rowsBetween(Window.unboundedPreceding, 0)) for name, x in sums.items()}
    out |= {name: F.lag(x).over(own) for name, x in previous.items()} | {name: F.lead(x).over(own) for name, x in following.items()}
    return df.select(*df.columns, *[x.alias(name) for name, x in out.items()])


def numbered(df: DataFrame, order: Sequence[Column], name: str = "number", keys: Sequence[str] = ()) -> DataFrame:
    """df with the place of each row (from 0) among its key's rows in an order."""
    return scan(df, keys, order, place=name)
