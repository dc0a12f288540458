"""Vector codes by product quantisation: filtering Lloyd over KD-trees.

Every vector is cut into equal consecutive parts, and each part position has a
codebook. Every partition builds a KD-tree over its vectors' parts once, of at most
SHARD_ROWS vectors each; a node keeps the tight box, the sum and the count of what
lies below it. In a round a node passes on only the codebook entries that some point
of its box may be nearest to; where one is left, the whole subtree goes to it by its
cached sum and count, and only leaves with several look at single parts. The trees
are written once and read by each round; what a round sends back is one sum for each
entry, component and task, so codebooks are all that the driver holds.

Components are the integers floor(1024 x), taken as doubles, and all arithmetic is
exact: `limit` holds them to the range in which the squared distance of two vectors
fits 64 bits (for 64 components x from -262,144 to 262,143; larger ones are held at
its ends).

Null vectors and those with null or non-finite components give no row. The length of
vectors is that of the least kept vec_id; rows of other lengths, and all rows where it
is not a multiple of the parts, keep their row with null code and error. Null vec_ids
come last among the codebooks' first entries, rows of one vec_id by their components.
With fewer rows than entries the codebooks are shorter. Repeated rows count as often
as they come. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from .shared import checkpointed, hot_from, join_keyed, prepare
from .vectors import pack, unpack

#: Vectors of one tree and parts of a leaf at most; components are scaled by SCALE.
SHARD_ROWS, LEAF, SCALE = 16384, 48, 1024


def limit(dim: int) -> int:
    """Largest size of a component for which the squared distance of two vectors fits 64 bits."""
    return math.isqrt((2**62) // max(1, dim)) // 2


def integers(matrix: np.ndarray) -> np.ndarray:
    most = limit(matrix.shape[1])
    return np.clip(np.floor(matrix.astype(np.float64) * SCALE), -most, most).astype(np.int64)


def tree(points: np.ndarray) -> dict[str, np.ndarray]:
    """order: rows by leaf; of each node: first, last (its range of order), left (first child, the second follows; -1: leaf), low, high, sum."""
    order = np.arange(len(points), dtype=np.int32)
    first, last, left = [0], [len(points)], [-1]
    low, high = [points.min(0)], [points.max(0)]
    i = 0
    while i < len(first):
        a, b = first[i], last[i]
        spread = high[i] - low[i]
        if b - a > LEAF and spread.any():
            own = order[a:b]
            column = points[own, int(spread.argmax())]
            middle = (b - a) // 2
            order[a:b] = own[np.argpartition(column, middle)]
            left[i] = len(first)
            for x, y in ((a, a + middle), (a + middle, b)):
                part = points[order[x:y]]
                first.append(x), last.append(y), left.append(-1), low.append(part.min(0)), high.append(part.max(0))
        i += 1
    first, last = np.array(first, np.int32), np.array(last, np.int32)
    upto = np.zeros((len(points) + 1, points.shape[1]), np.int64)
    np.cumsum(points[order], 0, out=upto[1:])
    return {"order": order, "first": first, "last": last, "left": np.array(left, np.int32), "low": np.array(low), "high": np.array(high), "sum": upto[last] - upto[first]}


def _small(*arrays: np.ndarray) -> bool:
    """Whether sums of products of these stay exact as doubles."""
    most = max((float(np.abs(a).max()) for a in arrays if a.size), default=0.0)
    return 8 * most * most * max(1, arrays[0].shape[-1]) < 2.0**53


def filtered(t: dict[str, np.ndarray], book: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Nodes whose parts are all that is left to look at, and the entries (ascending) that may be nearest; levels go together.

    Of the entries of a node, the one nearest to the middle of its box is held against each other one: the other stays
    only if the point of the box that is best for it is nearer to it (or as near, if its index is lower).
    """
    kind = np.float64 if _small(t["low"], t["high"], book) else object
    entry = book.astype(kind)
    square = (entry * entry).sum(1)
    nodes = np.zeros(1, np.int64)
    masks = np.ones((1, len(book)), bool)
    index = np.arange(len(book))
    while len(nodes):
        low, high = t["low"][nodes].astype(kind), t["high"][nodes].astype(kind)
        middle, width = low + high, high - low  # twice the middle; doubled to stay whole
        reach = square[None, :] - middle @ entry.T
        reach = np.where(masks, reach, np.inf if kind is np.float64 else 1 << 80)
        best = reach.argmin(1)
        ahead = reach - reach[np.arange(len(nodes)), best][:, None]
        # The box's width along the line to each other entry takes at most this off.
        off = np.empty(ahead.shape, kind)
        for i in range(0, len(nodes), 64):
            off[i : i + 64] = (np.abs(entry[None] - entry[best[i : i + 64]][:, None]) * width[i : i + 64][:, None]).sum(2)
        gain = ahead - off
        masks &= (gain < 0) | ((gain == 0) & (index[None] < best[:, None]))
        masks[np.arange(len(nodes)), best] = True
        ends = (masks.sum(1) == 1) | (t["left"][nodes] < 0)
        for i in np.flatnonzero(ends):
            yield int(nodes[i]), np.flatnonzero(masks[i])
        inner = np.flatnonzero(~ends)
        children = t["left"][nodes[inner]]
        nodes, masks = np.stack([children, children + 1], 1).ravel().astype(np.int64), np.repeat(masks[inner], 2, 0)


def distances(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances as 64-bit integers."""
    if _small(points, entries):
        p, e = points.astype(np.float64), entries.astype(np.float64)
        return ((p * p).sum(1)[:, None] - 2 * (p @ e.T) + (e * e).sum(1)[None]).astype(np.int64)
    return np.stack([((points - e) ** 2).sum(1) for e in entries], 1)


def moments(points: np.ndarray, t: dict[str, np.ndarray], book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and number of the parts nearest to each entry."""
    sums, counts = np.zeros_like(book), np.zeros(len(book), np.int64)
    for node, entries in filtered(t, book):
        a, b = t["first"][node], t["last"][node]
        if len(entries) == 1:
            sums[entries[0]] += t["sum"][node]
            counts[entries[0]] += b - a
        else:
            own = points[t["order"][a:b]]
            to = entries[distances(own, book[entries]).argmin(1)]
            np.add.at(sums, to, own)
            counts += np.bincount(to, minlength=len(book))
    return sums, counts


def codes(points: np.ndarray, t: dict[str, np.ndarray], book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each part and the squared distance to it."""
    label, error = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
    for node, entries in filtered(t, book):
        own = t["order"][t["first"][node] : t["last"][node]]
        far = distances(points[own], book[entries])
        at = far.argmin(1)
        label[own], error[own] = entries[at], far[np.arange(len(own)), at]
    return label, error


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.FixedSizeListArray):
        column = column.cast(pa.list_(column.type.value_type))
    return column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)


def _shards(batches: Iterator[pa.RecordBatch], dim: int, parts: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One row for each tree: its rows' ids and labels, and points with a tree of each part. Columns in: id, label, vector."""
    width = dim // parts

    def built(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        own = pa.Table.from_batches(held).combine_chunks()
        matrix = integers(_matrix(own.column(2).chunk(0), dim))
        arrays = {"points": matrix.astype(np.int32) if limit(dim) < 2**31 else matrix}
        for p in range(parts):
            arrays |= {f"{k}{p}": v for k, v in tree(matrix[:, p * width : (p + 1) * width]).items()}
        rows = pa.StructArray.from_arrays([own.column(0).chunk(0), own.column(1).chunk(0)], ["id", "label"])
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows).cast(schema.field(0).type), pa.array([pack(**arrays)], pa.binary())], schema=schema)

    held, n = [], 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            take = min(batch.num_rows - at, SHARD_ROWS - n)
            held.append(batch.slice(at, take))
            n, at = n + take, at + take
            if n == SHARD_ROWS:
                yield built(held)
                held, n = [], 0
    if n:
        yield built(held)


def _opened(payload: bytes, parts: int) -> Iterator[tuple[np.ndarray, dict[str, np.ndarray]]]:
    arrays = unpack(payload)
    points = arrays["points"].astype(np.int64)
    width = points.shape[1] // parts
    for p in range(parts):
        yield points[:, p * width : (p + 1) * width], {k: arrays[f"{k}{p}"] for k in ("order", "first", "last", "left", "low", "high", "sum")}


def _finite(vector: Column) -> Column:
    return F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def compress(table: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """Rows (id, label, code: the entries' indexes as an array, error) and the final codebooks, one for each part position."""
    spark = table.sparkSession
    prepare(spark)
    kept = table.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & _finite("v"))
    uncoded = lambda rows: rows.select("id", "label", F.lit(None).cast("array<int>").alias("code"), F.lit(None).cast("bigint").alias("error"))
    least = kept.orderBy(F.col("id").asc_nulls_last(), "v").select(F.size("v")).first()
    if least is None or least[0] % parts or not least[0]:
        return uncoded(kept), []
    dim, width = least[0], least[0] // parts
    fit = F.size("v") == dim
    seeds = np.array([r[0] for r in kept.where(fit).orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()])
    books = [np.ascontiguousarray(integers(seeds)[:, p * width : (p + 1) * width]) for p in range(parts)]

    row = StructType([*kept.schema.fields[:2]])
    schema = StructType().add("rows", ArrayType(row)).add("payload", "binary")
    arrow = spark.createDataFrame([], schema).toArrow().schema
    shards = checkpointed(kept.where(fit).mapInArrow(lambda b: _shards(b, dim, parts, arrow), schema))

    def assigned(batches: Iterator[pa.RecordBatch], books: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        sums, counts = [np.zeros_like(b) for b in books], [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            for payload in batch.column("payload").to_pylist():
                for p, (points, t) in enumerate(_opened(payload, parts)):
                    s, c = moments(points, t, books[p])
                    sums[p] += s
                    counts[p] += c
        part, entry = (np.concatenate(x) for x in zip(*((np.full(int((c > 0).sum()), p), np.flatnonzero(c)) for p, c in enumerate(counts)), strict=True))
        if len(part):
            value = np.stack([np.r_[counts[p][e], sums[p][e]] for p, e in zip(part, entry, strict=True)])
            at = np.tile(np.arange(width + 1), len(part))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part, width + 1)), pa.array(np.repeat(entry, width + 1)), pa.array(at), pa.array(value.ravel())], ["part", "entry", "at", "value"])

    for _ in range(rounds):
        now = books
        found = shards.select("payload").mapInArrow(lambda b, now=now: assigned(b, now), "part long, entry long, at long, value long").groupBy("part", "entry", "at").agg(F.sum("value").alias("value")).toPandas()
        books = [b.copy() for b in books]
        counts = {(p, e): v for p, e, a, v in found.itertuples(index=False) if a == 0}
        for p, e, a, v in found.itertuples(index=False):
            if a:
                books[p][e, a - 1] = v // counts[p, e]

    coded = StructType([*row.fields]).add("code", ArrayType(IntegerType())).add("error", "long")
    target = spark.createDataFrame([], coded).toArrow().schema

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, payload in zip(batch.column("rows"), batch.column("payload").to_pylist(), strict=True):
                each = [codes(points, t, books[p]) for p, (points, t) in enumerate(_opened(payload, parts))]
                flat = pa.array(np.stack([c for c, _ in each], 1).ravel().astype(np.int32))
                n = len(rows.values)
                code = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * parts), flat)
                own = rows.values.flatten()
                yield pa.RecordBatch.from_arrays([own[0], own[1], code.cast(target.field(2).type), pa.array(sum(e for _, e in each))], schema=target)

    return shards.mapInArrow(final, coded).unionByName(uncoded(kept.where(~fit))), books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def summary(table: DataFrame, **options) -> DataFrame:
    """vec_id, code (two hex digits for each part), error, label_error (of the rows with an equal label; nulls are one), codebooks_sha256."""
    if options.get("entries", 256) > 256:
        raise ValueError("two hex digits name 256 entries at most")
    rows, books = compress(table, **options)
    # The label as a key that is never null: rows of a frequent label are spread, its sum is broadcast.
    key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")).alias("key")
    text = F.lower(F.array_join(F.transform("code", lambda c: F.lpad(F.hex(c), 2, "0")), ""))
    rows = checkpointed(rows.select(F.col("id").alias("vec_id"), text.alias("code"), "error", key))
    sums = rows.groupBy("key").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n"))
    return join_keyed(rows, sums, ["key"], "n", hot_from(table.sparkSession, rows.count())).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
