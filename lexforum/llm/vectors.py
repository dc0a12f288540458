"""What the two vector searches share: clean vectors, shards of bounded size, and the exchange of queries and shards.

A vector that is null, holds a null or non-finite component, or (for cosine) is
zero takes no part, neither as query nor as candidate. Vectors of different
lengths are not compared. Rows with equal vectors form one class; since a query
asks for k rows and leaves out its own, the k + 1 smallest ids of a class are
all that any result can name, and classes keep these. Several rows with one id
are one candidate for each of their vectors, and never answers to that id.
An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .shared import checkpointed, prepare

#: Vectors of a shard and shards of a group, about; queries of a block at most.
SHARD_ROWS, GROUP_SHARDS, QUERY_ROWS = 4096, 4, 32768


def matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and vectors (float64) of a batch's usable rows, by vector length. Columns: id, vector."""
    lists = batch.column(1)
    if isinstance(lists, pa.FixedSizeListArray):
        lists = lists.cast(pa.list_(lists.type.value_type))
    lengths = np.nan_to_num(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
    flat = lists.flatten().cast(pa.float64())
    values = flat.to_numpy(zero_copy_only=False)  # null: nan
    usable = ~np.asarray(lists.is_null()) & (lengths > 0) & ~np.asarray(batch.column(0).is_null())
    starts = np.cumsum(lengths) - lengths
    for dim in np.unique(lengths[usable]):
        rows = np.flatnonzero(usable & (lengths == dim))
        matrix = values[starts[rows][:, None] + np.arange(dim)]
        fine = np.isfinite(matrix).all(1)
        if fine.any():
            yield rows[fine], matrix[fine]


def row_hashes(matrix: np.ndarray) -> np.ndarray:
    """64-bit hash of each row's values."""
    data = np.ascontiguousarray(matrix + 0.0).view(np.uint64)  # -0.0 becomes 0.0
    h = np.zeros(len(data), np.uint64)
    for j in range(data.shape[1]):
        h = kernel.mix(h * np.uint64(0x9E3779B97F4A7C15) + data[:, j] + np.uint64(j + 1))
    return h


def classes(ids: np.ndarray, matrix: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows, and of each at most `keep` smallest distinct ids: vectors, ids joined, and their offsets."""
    h = row_hashes(matrix)
    order = np.lexsort((ids, h))
    h, ids = h[order], ids[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (matrix[order[1:]] != matrix[order[:-1]]).any(1)
    again = np.zeros(len(h), bool)
    again[1:] = ~new[1:] & (ids[1:] == ids[:-1])
    klass = np.cumsum(new) - 1
    once = ~again
    rank = np.cumsum(once) - 1
    rank -= rank[np.flatnonzero(new)][klass]
    stay = once & (rank < keep)
    vectors = matrix[order[new]]
    return vectors, ids[stay], np.searchsorted(klass[stay], np.arange(len(vectors) + 1))


def pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpack(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as f:
        return {k: f[k] for k in f.files}


Index = dict[str, np.ndarray]


def top_k(
    table: DataFrame,
    id_col: str,
    vector_col: str,
    every: int,
    k: int,
    clean: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]],
    build: Callable[[np.ndarray], Index],
    search: Callable[[list[Index], np.ndarray, np.ndarray, int, np.ndarray], Iterator[tuple[int, np.ndarray, np.ndarray]]],
    score_type: str,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """The k best candidates of each query row (id divisible by `every`): query_id, rank, vec_id, score.

    clean gives the vectors in the form to index and which rows take part; build indexes one shard's distinct
    vectors; search goes through a group's shards with a block of queries and yields, for each query, its place
    and the ids and scores that may be among its best; it is given a score that the k-th best reaches at least.
    """
    spark = table.sparkSession
    prepare(spark)
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    shards = max(1, -(-rows.count() // shard_rows))
    groups = -(-shards // GROUP_SHARDS)

    def cleaned(batches: Iterator[pa.RecordBatch], queries: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).fill_null(0).to_numpy()
            for at, matrix in matrices(batch):
                matrix, fine = clean(matrix)
                at, matrix = at[fine], np.ascontiguousarray(matrix[fine])
                own = ids[at]
                if queries:
                    pick = own % every == 0
                    own, matrix = own[pick], matrix[pick]
                elif len(own):
                    vectors, own, off = classes(own, matrix, k + 1)
                    matrix = np.repeat(vectors, np.diff(off), 0)
                if len(own):
                    h = row_hashes(matrix)
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), matrix.shape[1], np.int32)), pa.array((h % np.uint64(shards)).astype(np.int32)), pa.array([x.tobytes() for x in matrix], pa.binary())], ["id", "dim", "shard", "v"])

    schema = "id long, dim int, shard int, v binary"
    dtype = clean(np.ones((1, 1)))[0].dtype

    def matrix_of(column: pa.ChunkedArray, dim: int) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, dim)

    def built(part: pa.Table) -> pa.Table:
        dim = part["dim"][0].as_py()
        vectors, ids, off = classes(part["id"].to_numpy(), matrix_of(part["v"], dim), k + 1)
        index = build(vectors) | {"vectors": vectors, "ids": ids, "off": off}
        shard = part["shard"][0].as_py()
        return pa.table({"dim": pa.array([dim], pa.int32()), "grp": pa.array([shard // GROUP_SHARDS], pa.int32()), "shard": pa.array([shard], pa.int32()), "payload": pa.array([pack(**index)], pa.binary())})

    # A number of partitions of its own, as the work is in the shards and not in their bytes: they are not put together again.
    index = checkpointed(rows.mapInArrow(lambda b: cleaned(b, False), schema).repartition(4 * shards, "dim", "shard").groupBy("dim", "shard").applyInArrow(built, "dim int, grp int, shard int, payload binary"))
    queries = rows.where(F.col("id") % every == 0).mapInArrow(lambda b: cleaned(b, True), schema)
    blocks = max(1, -(-rows.where(F.col("id") % every == 0).count() // QUERY_ROWS))
    # Each block of queries meets each group of shards once: a bounded number of both in a task. First its home group,
    # whose k-th score is where the others start from.
    home = F.pmod(F.xxhash64(F.lit(5), "id", "v"), F.lit(groups)).cast("int")
    queries = queries.select("id", "dim", "v", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int").alias("block"), home.alias("home"))
    left = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    result = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64() if score_type == "double" else pa.int64())])

    def searched(shards: pa.Table, part: pa.Table) -> pa.Table:
        if not shards.num_rows or not part.num_rows:
            return result.empty_table()
        dim = part["dim"][0].as_py()
        indexes = [unpack(x) for x in shards.sort_by("shard")["payload"].to_pylist()]
        own, kth = part["id"].to_numpy(), part["kth"].to_numpy()
        q, v, s = [], [], []
        for i, ids, scores in search(indexes, matrix_of(part["v"], dim), own, k, kth):
            order = np.lexsort((ids, -scores))[:k]
            q.append(np.full(len(order), own[i])), v.append(ids[order]), s.append(scores[order])
        if not q:
            return result.empty_table()
        return pa.table([np.concatenate(q), np.concatenate(v), np.concatenate(s)], schema=result)

    def met(asked: DataFrame) -> DataFrame:
        parts = 4 * groups * blocks
        cells = left.repartition(parts, "dim", "grp", "block").groupBy("dim", "grp", "block").cogroup(asked.repartition(parts, "dim", "grp", "block").groupBy("dim", "grp", "block"))
        return cells.applyInArrow(searched, f"query_id long, vec_id long, score {score_type}")

    none = F.lit(float("-inf")).alias("kth")
    first = checkpointed(met(queries.select("id", "dim", "v", "block", F.col("home").alias("grp"), none)))
    found = first
    if groups > 1:
        # Ids may repeat, so a bound holds for an id only if each of its vectors has one; the least of them is taken.
        per = queries.groupBy("id").agg(F.count(F.lit(1)).alias("rows"))
        bound = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").cast("double").alias("least")).join(per.withColumnRenamed("id", "query_id"), "query_id").where((F.col("rows") == 1) & (F.col("n") == k))
        others = queries.join(bound.select(F.col("query_id").alias("id"), "least"), "id", "left").withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).where("grp <> home")
        found = first.unionByName(met(others.select("id", "dim", "v", "block", "grp", F.coalesce("least", F.lit(float("-inf"))).alias("kth"))))
    # A query has k rows from each group; array sorting needs no order over all rows.
    best = F.slice(F.array_sort(F.array_distinct(F.collect_list(F.struct((-F.col("score")).alias("m"), "vec_id", "score")))), 1, k)
    return found.groupBy("query_id").agg(best.alias("best")).select("query_id", F.posexplode("best").alias("pos", "b")).select("query_id", (F.col("pos") + 1).alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))
