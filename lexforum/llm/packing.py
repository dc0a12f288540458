"""Sum-of-squares packing of tokenised documents into fixed-length sequences.

Every document's ids end with one separator id. Documents longer than a
sequence are cut into whole sequences from the end, so that only the first
piece may be shorter. Whole pieces fill a sequence each; the others are dealt
evenly to shards, and in each shard the sum-of-squares rule places every piece, larger
ones first: into the open sequence that holds it for which the sum over gaps of (open
sequences with that gap) squared becomes smallest; a sequence is opened where none
holds the piece. Shards hold a bounded number of pieces, so that no task grows with
the input and what shards leave open stays a small, fixed share.

Null text: the separator alone. Repeated rows are packed as often as they occur.
Texts are read whole, however long. An empty table gives an empty result. Other
columns are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, kernel
from .shared import checkpointed

#: Pieces that one shard packs, about.
SHARD_PIECES = 65_536
#: Bytes of text that are encoded at once: a worker stays for a minute after its task, with what these took.
ENCODE_BYTES = 512 << 10


class SumOfSquares:
    """Open sequences by residual gap; place() follows the sum-of-squares rule."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)  # open sequences by gap; those without a gap do not count
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.made = 0

    def place(self, size: int) -> tuple[int, int]:
        """Sequence and offset of a piece of 1 to capacity tokens."""
        b, n = self.capacity, self.count
        # Moving a sequence from gap g to g - size changes the sum by 2 (n[g - size] - n[g]) + 2; one that gets full, by 1 - 2 n[g]. Halved:
        cost = np.where(n[size:b] > 0, -n[size:b] + 1.0, np.inf)  # for g = size .. b - 1
        cost[1:] += n[1 : b - size] if size < b else 0
        cost[:1] -= 0.5
        if len(cost) and cost.min() < np.inf:
            g = size + int(cost.argmin())  # the smallest gap among equals
            n[g] -= 1
            sequence = self.open[g].pop()
        else:
            g, sequence = b, self.made
            self.made += 1
        if g > size:
            n[g - size] += 1
            self.open[g - size].append(sequence)
        return sequence, b - g


def pack_shard(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sequence and offset of each piece, and the number of sequences: larger pieces first, equal ones as they come."""
    packer = SumOfSquares(capacity)
    sequence, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        sequence[i], offset[i] = packer.place(int(sizes[i]))
    return sequence, offset, packer.made


def pieces(docs: DataFrame, path: str, capacity: int = 1024, separator: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id_col, piece, start, length, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = bpe.encoder(path)
        for batch, data, off in kernel.blocks(batches, size=ENCODE_BYTES):
            ids, before = e.encode(data, off)
            n = np.diff(before) + 1
            joined = np.full(int(n.sum()), separator, "<u4")
            joined[np.arange(len(ids)) + np.repeat(np.arange(len(n)), np.diff(before))] = ids
            at = np.cumsum(n) - n
            count = -(-n // capacity)
            doc = np.repeat(np.arange(len(n)), count)
            piece = kernel.ragged(np.zeros(len(n), np.int64), count)
            first = n - (count - 1) * capacity
            start = np.where(piece > 0, first[doc] + (piece - 1) * capacity, 0)
            length = np.where(piece > 0, capacity, first[doc])
            raw = joined.tobytes()
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((at[doc] + start).tolist(), (at[doc] + start + length).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], ["id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long").withColumnRenamed("id", id_col)


def pack(docs: DataFrame, path: str, capacity: int = 1024, separator: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id_col, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = checkpointed(pieces(docs, path, capacity, separator, id_col, text_col))
    short = cut.where(F.col("length") < capacity)
    shards = max(1, -(-short.count() // SHARD_PIECES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A shard is one partition of a bounded number of small rows.
        batches = [b for b in batches if b.num_rows]
        if batches:
            table = pa.Table.from_batches(batches).combine_chunks()
            sequence, offset, _ = pack_shard(np.asarray(table["length"]), capacity)
            yield from table.append_column("local", pa.array(sequence)).append_column("offset", pa.array(offset)).to_batches()

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)
    # Rounds of dealing send every partition's rows evenly to all shards, so no key can make one large.
    packed = short.repartition(shards).mapInArrow(run, f"{columns}, local long, offset long")
    # Numbers of a partition's sequences lie apart from all others': partition number and counter, whole pieces above them.
    packed = packed.withColumn("sequence_id", F.shiftleft(F.spark_partition_id().cast("long"), 32) + F.col("local")).drop("local")
    whole = cut.where(F.col("length") == capacity).withColumn("sequence_id", F.lit(1 << 62) + F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    names = [*cut.columns, "sequence_id", "offset"]
    return packed.select(names).unionByName(whole.select(names))
