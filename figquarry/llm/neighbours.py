"""Approximate nearest neighbours by largest inner product: multiprobe p-stable hashing, exact distances afterwards.

Vectors are indexed by shells of norm (each down to half the norm of the one before). In a shell largest inner product
becomes least distance by one more component, sqrt(M^2 - |x|^2) with M the shell's largest norm, 0 for a query, which is
scaled to norm M. Each of `tables` tables hashes a vector by k functions floor((a.x + b) / width), a normal. A query visits
the buckets of a table in the order of their estimated probability to hold a neighbour: along each function a neighbour
lies at normal(rho u + c, s) if the query lies at u, so a bucket's probability is a product of normal slices. It goes on
until the probabilities of all tables together are `success`. rho, c and s are fitted on a bounded sample (the `sample`
rows of a shell with the least hashes of their ids); everything else covers every row. k grows with the logarithm of a
shell's rows; a shell of few rows is one bucket.

Equal vectors are searched once: of each only the `top` + 1 least ids can be in any answer, and they are kept with it. A
bucket and the queries that visit it are dealt into blocks of at most `block` vectors; a task compares blocks by one matrix
product and returns each query's best, whose scores are summed in component order in double precision.
No candidate is dropped other than for being behind `top` others.

Defined results: vectors that are null, empty, zero or hold a null, NaN or infinite component take no part, neither do rows
without id, nor vectors of another length than the commonest (of equally common ones the longest); of rows that share an id the one
with the least vector counts; ties go to the smaller id. No rows give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import in_arrow, join_apart, materialise, small_side

TOP = 20
EVERY = 20
TABLES = 4
SUCCESS = 0.94
SAMPLE = 4096
#: A table has log2(rows / BUCKET) functions; vectors of a block at most.
BUCKET = 1024
BLOCK = 4096
#: Width of a slot over the spread of a projection.
WIDTH = 3.0
#: Shells of norm: the last holds all that is shorter. Vectors of the samples that are tried as queries in fitting.
SHELLS = 16
ASKED = 512
#: Queries for which a task looks for buckets at once.
QUERIES_AT_ONCE = 64


def usable(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id long, x: one row an id, its vector of the commonest length. -0.0 becomes 0.0."""
    kind = "array<float>" if dict(rows.dtypes)[embedding] == "array<float>" else "array<double>"
    x = F.col(embedding).cast(kind)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == math.inf))
    fit = rows.select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull())
    fit = fit.where(~F.exists("x", lambda v: v.isNull())).where(~bad & F.exists("x", lambda v: v != 0))
    length = fit.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1)
    fit = fit.join(F.broadcast(length.select("d")), F.size("x") == F.col("d"), "left_semi")
    zero = F.lit(0).cast(kind.removeprefix("array<").removesuffix(">"))
    return fit.groupBy("vec_id").agg(F.min("x").alias("x")).select("vec_id", F.transform("x", lambda v: v + zero).alias("x"))


def classes(vectors: DataFrame, asked: Column, top: int) -> DataFrame:
    """A row for each different vector: id (the least), x, ids (the top + 1 least), asked (whether any of its rows is a query)."""
    least = Window.partitionBy("x").orderBy("vec_id")
    few = vectors.withColumn("r", F.row_number().over(least)).where(F.col("r") <= top + 1)  # Spark keeps so many in each task before the shuffle
    few = few.groupBy("x").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    queries = vectors.where(asked).groupBy("x").agg(F.lit(True).alias("asked"))
    return few.join(queries, "x", "left").select(F.col("ids")[0].alias("id"), "x", "ids", F.coalesce("asked", F.lit(False)).alias("asked"))


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


class Hashing:
    """The functions of a shell's tables, fitted on a sample: a few arrays, sent with the tasks. largest: the shell's
    largest norm; asked: vectors to try as queries."""

    def __init__(self, sample: np.ndarray, asked: np.ndarray, rows: int, largest: float, tables: int, success: float, seed: int = 13) -> None:
        self.largest, self.success = largest, success
        extra = self.augmented(sample)
        self.centre = extra.mean(axis=0)
        spread = math.sqrt(((extra - self.centre) ** 2).sum() / len(extra)) or 1.0
        self.k = max(0, round(math.log2(max(1, rows) / BUCKET)))
        rng = np.random.default_rng(seed)
        self.a = rng.standard_normal((tables if self.k else 1, self.k, extra.shape[1]))
        self.width = WIDTH * spread
        self.b = rng.uniform(0, self.width, self.a.shape[:2])
        inner = asked @ sample.T
        inner[(asked[:, None, :1] == sample[None, :, :1])[:, :, 0] & (norms(asked)[:, None] == norms(sample)[None, :])] = -math.inf  # itself
        rank = min(len(sample) - 1, max(0, round(TOP * len(sample) / max(rows, 1)) - 1))  # the sample's neighbour that is as far as the last of TOP in all rows
        near = np.argpartition(-inner, rank, axis=1)[:, rank]
        q, x = self.plain(asked), (extra - self.centre)[near]
        from_mean = q - q.mean(axis=0)
        self.rho = float((from_mean * x).sum() / max((from_mean * from_mean).sum(), 1e-300))
        offset = (x - self.rho * q).mean(axis=0)
        self.s = max(float(np.sqrt(np.median(((x - self.rho * q - offset) ** 2).sum(axis=1)))), 1e-3 * spread)
        self.shift = np.einsum("tkd,d->tk", self.a, offset)

    def augmented(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x, np.sqrt(np.maximum(0.0, self.largest**2 - (x * x).sum(axis=1)))[:, None]], axis=1)

    def plain(self, x: np.ndarray) -> np.ndarray:
        """Queries in the shell's space."""
        return np.concatenate([x * (self.largest / norms(x))[:, None], np.zeros((len(x), 1))], axis=1) - self.centre

    def rows(self, x: np.ndarray) -> np.ndarray:
        """Buckets (n, tables) of vectors."""
        u = np.einsum("nd,tkd->ntk", self.augmented(x) - self.centre, self.a, optimize=True)
        return folded(np.floor((u + self.b) / self.width).astype(np.int64))

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, table, bucket) for the buckets that queries visit, in estimated order of success."""
        tables, k, _ = self.a.shape
        lies = self.rho * np.einsum("nd,tkd->ntk", self.plain(x), self.a, optimize=True) + self.shift
        lies, offset = lies.reshape(len(x) * tables, k), np.tile(self.b, (len(x), 1))  # a row for each query and table
        reach = max(1, math.ceil(5 * self.s / self.width))
        steps = np.floor((lies + offset) / self.width)[:, :, None] + np.arange(-reach, reach + 1)
        low = (steps * self.width - offset[:, :, None] - lies[:, :, None]) / self.s
        slices = normal(low + self.width / self.s) - normal(low)
        goal, beam = 1 - (1 - self.success) ** (1 / tables), 64
        chosen, share = best_products(steps, slices, beam)
        while (short := share.sum(axis=1) < goal).any() and beam < (2 * reach + 1) ** k:
            beam *= 4
            more, probability = best_products(steps[short], slices[short], beam)
            if more.shape[1] > chosen.shape[1]:
                wider = ((0, 0), (0, more.shape[1] - chosen.shape[1]), (0, 0))
                chosen, share = np.pad(chosen, wider), np.pad(share, wider[:2])
            chosen[short, : more.shape[1]], share[short, : more.shape[1]] = more, probability
        before = np.cumsum(share, axis=1) - share
        row, col = np.nonzero((before < goal) & (share > 0))
        return row // tables, row % tables, folded(chosen[row, col].astype(np.int64))


class Index:
    """The shells of all vectors. samples: for each shell that holds any, its number, a sample, how many rows it has and their largest norm."""

    def __init__(self, largest: float, samples: list[tuple[int, np.ndarray, int, float]], tables: int, success: float) -> None:
        self.largest, self.tables = largest, tables
        every = np.concatenate([x for _, x, _, _ in samples]) if samples else np.empty((0, 1))
        asked = every[:: max(1, len(every) // ASKED)]
        self.shells = {n: Hashing(x, asked, rows, most, tables, success, n + 13) for n, x, rows, most in samples}

    def rows(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(vector, table, bucket) of vectors; tables are numbered through the shells."""
        known = np.array(list(self.shells))
        own = np.floor(np.log2(self.largest / norms(x)))
        own = known[np.abs(own[:, None] - known).argmin(axis=1)]  # a norm at a boundary may round into a shell that has no rows
        out = [(np.empty(0, np.int64),) * 3]
        for n, shell in self.shells.items():
            at = np.flatnonzero(own == n)
            found = shell.rows(x[at])
            tables = found.shape[1]
            out.append((np.repeat(at, tables), n * self.tables + np.tile(np.arange(tables), len(at)), found.ravel()))
        return tuple(np.concatenate(c) for c in zip(*out))

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = [(q, n * self.tables + t, bucket) for n, shell in self.shells.items() for q, t, bucket in [shell.visits(x)]]
        return tuple(np.concatenate(c) for c in zip(*found))


def normal(z: np.ndarray) -> np.ndarray:
    """The normal distribution function, to 1e-7."""
    t = 1 / (1 + 0.2316419 * np.abs(z))
    tail = np.exp(-z * z / 2) / math.sqrt(2 * math.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return np.where(z > 0, 1 - tail, tail)


def folded(slots: np.ndarray) -> np.ndarray:
    """One 64-bit number for each row of slot numbers."""
    h = np.full(slots.shape[:-1], 0x9E3779B97F4A7C15, np.uint64)
    for i in range(slots.shape[-1]):
        h = (h ^ slots[..., i].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def best_products(steps: np.ndarray, slices: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the `beam` most probable choices of one step a function, most probable first: (rows, beam, k), (rows, beam).

    Function by function, only the best beginnings are kept: what begins behind `beam` others ends behind them."""
    n, k, c = slices.shape
    share, chosen = np.ones((n, 1)), np.zeros((n, 1, 0))
    for i in range(k):
        every = (share[:, :, None] * slices[:, i, None, :]).reshape(n, -1)
        keep = np.argsort(-every, axis=1, kind="stable")[:, :beam]
        share = np.take_along_axis(every, keep, 1)
        begun = np.take_along_axis(chosen, (keep // c)[:, :, None], 1)
        chosen = np.concatenate([begun, np.take_along_axis(steps[:, i], keep % c, 1)[:, :, None]], axis=2)
    return chosen, share


def matrix(column: pa.Array) -> np.ndarray:
    """A list column as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, summed in the order of components: equal vectors have equal scores wherever they stand."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += a[:, k] * b[:, k]
    return total


_FOUND = pa.list_(pa.struct([("less", pa.float64()), ("id", pa.int64())]))


def best_of_block(queries: pa.Table, rows: pa.Table, top: int) -> pa.Table:
    """For each query of a block its best rows of the block, other than itself: q, found (score negated and id, best first)."""
    form = pa.schema([("q", pa.int64()), ("found", _FOUND)])
    if not queries.num_rows or not rows.num_rows:
        return form.empty_table()
    q, x = matrix(queries["x"]), matrix(rows["x"])
    q_id, x_id = queries["id"].to_numpy(), rows["id"].to_numpy()
    found = q @ x.T
    found[q_id[:, None] == x_id[None, :]] = -np.inf
    n = min(top, len(x))
    near = np.argpartition(-found, n - 1, axis=1)[:, :n]
    i, j = np.repeat(np.arange(len(q)), n), near.ravel()
    real = found[i, j] > -np.inf
    i, j = i[real], j[real]
    less, of = -inner_products(q[i], x[j]), x_id[j]
    order = np.lexsort((of, less, i))
    ends = np.concatenate([[0], np.cumsum(np.bincount(i, minlength=len(q)))]).astype(np.int32)
    best = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(less[order]), pa.array(of[order])], ["less", "id"]))
    return pa.table([pa.array(q_id), best.cast(_FOUND)], schema=form)


def search(rows: DataFrame, asked: Column, top: int = TOP, tables: int = TABLES, success: float = SUCCESS, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each row for which `asked` (of vec_id) holds its `top` nearest others, as found."""
    spark = rows.sparkSession
    vectors = usable(rows)
    every = materialise(classes(vectors, asked, top))
    norm = F.aggregate("x", F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double"))
    largest = math.sqrt(every.agg(F.max(norm)).first()[0] or 0.0)
    shell = F.greatest(F.lit(0), F.least(F.lit(SHELLS - 1), F.floor(F.log2(F.lit(largest) / F.sqrt(norm))))).cast("int")
    sizes = every.groupBy(shell.alias("shell")).agg(F.count("*").alias("n"), F.sqrt(F.max(norm)).alias("most")).collect()  # SHELLS rows at most
    few = {r.shell: every.where(shell == r.shell).orderBy(F.xxhash64("id"), "id").limit(sample).select("x").toArrow() for r in sizes}  # `sample` rows a shell
    index_of = Index(largest, [(r.shell, matrix(few[r.shell]["x"]), r.n, r.most) for r in sorted(sizes)], tables, success)

    def batch_of(batch, of, t, bucket):
        of = pa.array(of)
        return pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(t.astype(np.int32)), pa.array(bucket)], ["id", "x", "t", "bucket"])

    def hashed(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch_of(batch, *index_of.rows(matrix(batch.column(1))))

    def visited(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, QUERIES_AT_ONCE):
                part = batch.slice(k, QUERIES_AT_ONCE)
                yield batch_of(part, *index_of.visits(matrix(part.column(1))))

    kind = dict(every.dtypes)["x"]
    form = f"id long, x {kind}, t int, bucket long"
    index = in_arrow(every.select("id", "x"), hashed, form)
    sizes = small_side(materialise(index.groupBy("t", "bucket").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))))
    calls = in_arrow(every.where("asked").select("id", "x"), visited, form).join(sizes, ["t", "bucket"])  # buckets that hold something
    asks = calls.groupBy("t", "bucket").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("parts"))
    asks = small_side(materialise(asks))
    # a bucket of b blocks that p parts of queries visit: every block meets every part in a group of its own
    mine = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every_one = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = calls.join(asks, ["t", "bucket"]).withColumn("part", mine("parts")).withColumn("block", every_one("blocks"))
    right = index.join(sizes, ["t", "bucket"]).join(asks, ["t", "bucket"]).withColumn("block", mine("blocks")).withColumn("part", every_one("parts"))
    group = ["t", "bucket", "block", "part"]
    pick = lambda some: some.select("id", "x", *group).groupBy(*group)
    met = pick(left).cogroup(pick(right)).applyInArrow(lambda a, b: best_of_block(a, b, top), "q long, found array<struct<less: double, id: long>>")
    # a row a visit, not one a candidate: a query's lists are joined, those found through several tables counted once
    lists = met.groupBy("q").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))), 1, top).alias("found"))
    merged = lists.select("q", F.explode("found").alias("f")).select("q", F.col("f.id").alias("id"), (-F.col("f.less")).alias("score"))
    itself = every.where("asked").select(F.col("id").alias("q"), "id", norm.alias("score"))
    near = materialise(merged.union(itself))

    # back from different vectors to rows: at most top + 1 ids of each, then top + 1 ids in all, the query itself among them or not
    members = every.select("id", F.explode("ids").alias("vec_id"))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    listed = near.join(members, "id").withColumn("r", F.row_number().over(best)).where(F.col("r") <= top + 1)
    answers = listed.groupBy("q").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "vec_id", "score"))).alias("found"))
    known = every.where("asked").select(F.col("id").alias("q"), F.col("x").alias("same"))
    placed = vectors.where(asked).join(known, F.col("same") == F.col("x")).select(F.col("vec_id").alias("query_id"), "q")
    result = join_apart(placed, answers, "q")
    others = F.slice(F.filter("found", lambda f: f["vec_id"] != F.col("query_id")), 1, top)
    return result.select("query_id", F.posexplode(others).alias("pos", "f")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("f.vec_id").alias("vec_id"), F.col("f.score").alias("score"))
