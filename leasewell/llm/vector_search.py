"""Exact top-k inner-product search with vector-approximation files.

Every vector is turned into integers (``floor(64 * x)``).  Two files are written: the *exact file* holds the integers,
the *approximation file* a signed cell of ``CELL_BITS`` bits for each component.  The cells of a vector are
``2**shift`` integers wide, as its largest component asks, so a vector of large components is coarse by itself alone.

1. *Scan.*  A task holds a block of queries and a block of cells.  With ``low`` the lower corner of a cell, ``q . v`` lies
   between ``q . low - below`` and ``q . low + above``, so one matrix product bounds every score.  Vectors that cannot
   reach the k-th best lower bound of their block are out, then those that cannot reach that of all blocks.
2. *Read.*  What is left has an order by upper bound.  The exact vectors of the first ``READ`` of each query are fetched by
   a join with the exact file; then of the others only those whose upper bound reaches the k-th exact score.  The rest
   cannot be among the k best, so the result is certain.

Queries are a stated set, met with all rows in blocks: cells (a byte a component) move once for each block of queries,
queries once for each block of rows.  Blocks hold so many components that a task's memory is bounded whatever the
number of dimensions, and are dealt by row, so equal vectors or ids do not gather.

Defined cases: vectors that are null, or hold a null component or one that is not finite (64 times as large), take no
part; vectors are compared with those of the same number of dimensions; rows that share an id are rows of their own: each is
a candidate of queries with other ids, and if they are queries, the candidates of all of them are ranked together; a
score beyond 64 bits is the nearest number of 64 bits; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leasewell.llm.session import scratch, written

K = 20
SCALE = 64
CELL_BITS = 6
#: Components of the queries and of the rows that a task holds.
QUERY_CELLS, ROW_CELLS = 1 << 18, 1 << 20
#: Queries bounded at a time in a task.
SCAN = 128
#: Exact vectors of each query that are read first, for each of its k.
READ = 2


def write_files(rows: DataFrame, path: str, vec_id: str = "vec_id", embedding: str = "embedding") -> None:
    """Write the exact and the approximation file of all complete vectors below a folder."""
    x = F.col(embedding)
    large = lambda c: F.abs(c.cast("double") * SCALE)
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (large(c) < float("inf")))
    ints = F.transform(x, lambda c: _floor(c.cast("double") * float(SCALE)))
    exact = rows.where(F.col(vec_id).isNotNull() & x.isNotNull() & whole).select(F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("long").alias("vec_id"), F.size(x).alias("dims"), ints.alias("v"))
    exact.write.parquet(f"{path}/exact")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            flat, offsets = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()))])
            owner = np.repeat(np.arange(len(batch)), np.diff(offsets))
            most = np.zeros(len(batch))
            np.maximum.at(most, owner, np.abs(flat))
            shift = np.maximum(np.frexp(most)[1] - (CELL_BITS - 1), 0)
            cell = np.floor(np.ldexp(flat, -shift[owner])).astype(np.int8).tobytes()
            cells = [cell[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "vec_id", "dims")), pa.array(shift, pa.int32()), pa.array(cells, pa.binary())], ["row", "vec_id", "dims", "shift", "cells"])

    spark = rows.sparkSession
    spark.read.parquet(f"{path}/exact").mapInArrow(run, "row long, vec_id long, dims int, shift int, cells binary").write.parquet(f"{path}/cells")


def _floor(x: Column) -> Column:
    """The floor of a double as a double, however large."""
    return F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)


def bounds(q: np.ndarray, cells: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of queries (rows) and vectors given by cells (columns)."""
    with np.errstate(over="ignore", invalid="ignore"):
        largest = np.abs(q).sum(axis=1).max(initial=0) * 2.0**CELL_BITS
        kind = np.float32 if largest < 2**23 else np.float64  # sums up to there are exact
        product = (q.astype(kind) @ cells.astype(kind).T).astype(np.float64)
        width = np.ldexp(1.0, shift)
        low = product * width
        unsure = np.abs(low) * 2.0**-40 + (0 if largest < 2**23 else largest * width * 2.0**-40)
        above, below = (np.outer(np.clip(side, 0, None).sum(axis=1), width - 1) for side in (q, -q))
        lower, upper = low - below - unsure, low + above + unsure
    sure = np.isfinite(lower) & np.isfinite(upper)
    most = 2.0**63  # where scores end
    return np.clip(np.where(sure, lower, -np.inf), -most, most), np.clip(np.where(sure, upper, np.inf), -most, most)


def _scan(k: int):
    names = ["query_row", "query_id", "row", "vec_id", "lower", "upper"]

    def run(key, left, right):
        out = []
        if len(left) and len(right):
            q = left.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(left), -1)
            cells = np.frombuffer(b"".join(right.column("cells").to_pylist()), np.int8).reshape(len(right), -1)
            shift, v_id, v_row = (right.column(c).to_numpy() for c in ("shift", "vec_id", "row"))
            q_id, q_row = (left.column(c).to_numpy() for c in ("vec_id", "row"))
            for first in range(0, len(q), SCAN):
                part = slice(first, first + SCAN)
                lower, upper = bounds(q[part], cells, shift)
                own = q_id[part][:, None] == v_id[None, :]
                lower[own] = upper[own] = -np.inf
                n = min(k, lower.shape[1])
                least = np.partition(lower, lower.shape[1] - n, axis=1)[:, lower.shape[1] - n]
                i, j = np.nonzero((upper >= least[:, None]) & ~own)
                out.append((q_row[part][i], q_id[part][i], v_row[j], v_id[j], lower[i, j], upper[i, j]))
        columns = zip(*out, strict=True) if out else [[np.zeros(0, np.int64)]] * 4 + [[np.zeros(0)]] * 2
        return pa.table(dict(zip(names, (pa.array(np.concatenate(c)) for c in columns), strict=True)))

    return run


def candidates(spark: SparkSession, path: str, queries: Column, k: int = K, query_cells: int = QUERY_CELLS, row_cells: int = ROW_CELLS) -> DataFrame:
    """(query_row, query_id, row, vec_id, lower, upper) of all pairs that the approximation file cannot rule out."""
    exact, cells = spark.read.parquet(f"{path}/exact"), spark.read.parquet(f"{path}/cells")
    blocks = lambda n, room: F.ceil(n / F.greatest(F.lit(64), F.floor(room / F.greatest(F.col("dims"), F.lit(1))))).cast("int")
    sizes = cells.groupBy("dims").agg(F.count("*").alias("n"), F.count_if(queries).alias("asked"))
    sizes = sizes.where("asked > 0").select("dims", blocks(F.col("n"), row_cells).alias("rbs"), blocks(F.col("asked"), query_cells).alias("qbs"))
    block = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = exact.where(queries).join(sizes, "dims").withColumn("qb", block("qbs")).select("row", "vec_id", "v", "dims", "qb", spread("rbs").alias("rb"))
    right = cells.join(sizes, "dims").withColumn("rb", block("rbs")).select("row", "vec_id", "shift", "cells", "dims", "rb", spread("qbs").alias("qb"))
    keys = ["dims", "qb", "rb"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_scan(k), "query_row long, query_id long, row long, vec_id long, lower double, upper double")
    found = written(found, "bounded")
    # the k-th best lower bound of all blocks; queries of one id are ranked together
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("lower")))
    kth = found.select("query_id", "lower", best.alias("place")).where(F.col("place") == k).select("query_id", F.col("lower").alias("least"))
    return found.join(kth, "query_id", "left").where("least is null or upper >= least").drop("least")


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with both exact vectors -> their scores, exact in integers."""
    for batch in batches:
        q, v = batch.column("q"), batch.column("v")
        a, b = (x.flatten().to_numpy(zero_copy_only=False) for x in (q, v))
        size = np.diff(q.offsets.to_numpy())
        edge = np.concatenate([[0], np.cumsum(size)])
        with np.errstate(over="ignore", invalid="ignore"):
            product = a * b
            score = np.zeros(len(batch))
            some = np.flatnonzero(size)
            score[some] = np.add.reduceat(product, edge[some]) if len(some) else 0
            exact = np.add.reduceat(np.abs(product), edge[some]) < 2.0**53 if len(some) else np.zeros(0, bool)
        out = np.zeros(len(batch), np.int64)
        out[some[exact]] = score[some[exact]].astype(np.int64)
        for k in some[~exact]:
            value = sum(int(x) * int(y) for x, y in zip(a[edge[k] : edge[k + 1]], b[edge[k] : edge[k + 1]], strict=True))
            out[k] = min(max(value, -(1 << 63)), (1 << 63) - 1)
        yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("vec_id"), pa.array(out)], ["query_id", "vec_id", "score"])


def search(spark: SparkSession, path: str, queries: Column, k: int = K, query_cells: int = QUERY_CELLS, row_cells: int = ROW_CELLS) -> DataFrame:
    """(query_id, rank, vec_id, score) over the files below a folder: for each row for which ``queries`` (over vec_id)
    holds, the k rows of other ids of highest inner product."""
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("upper"), F.desc("lower"), "row", "query_row"))
    pairs = written(candidates(spark, path, queries, k, query_cells, row_cells).withColumn("place", order), "candidates")
    exact = spark.read.parquet(f"{path}/exact")
    asked = exact.where(queries).select(F.col("row").alias("query_row"), F.col("v").alias("q"))

    def read(some: DataFrame) -> DataFrame:
        held = some.select("query_row", "query_id", "row", "vec_id").join(exact.select("row", "v"), "row").join(asked, "query_row")
        return held.select("query_id", "vec_id", "q", "v").mapInArrow(_scored, "query_id long, vec_id long, score long")

    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    first = written(read(pairs.where(F.col("place") <= READ * k)), "first-read")
    kth = first.withColumn("rank", best).where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    rest = pairs.where(F.col("place") > READ * k).join(kth, "query_id").where("upper >= least")
    found = first.unionByName(read(rest))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(rows: DataFrame, queries: Column, k: int = K, vec_id: str = "vec_id", embedding: str = "embedding", query_cells: int = QUERY_CELLS, row_cells: int = ROW_CELLS) -> DataFrame:
    """(query_id, rank, vec_id, score) of a table: both files are written to the shared folder and searched."""
    path = scratch(rows.sparkSession, "vectors")
    write_files(rows, path, vec_id, embedding)
    return search(rows.sparkSession, path, queries, k, query_cells, row_cells)
