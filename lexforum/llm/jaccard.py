"""N-gram Jaccard join: exact links between texts whose sets of word shingles have a Jaccard similarity of 0.8 or more.

A size-aware heavy-light join. Elements are ordered from rare to frequent.

1. One pass over the texts gives each text's set of shingle hashes. Sets travel
   as packed arrays, dealt by hash range, to find how many sets hold a hash.
   A hash held by one set alone can never be shared, so only repeated ones go on
   (with the sizes they suffice for exact intersections). A text of which fewer
   than 80 % of the shingles are repeated has no links.
2. Equal sets form one class; classes are joined, not texts.
3. Small sets (light) enumerate the 2-subsets of their rarest elements: two sets
   that link share two elements among their n - ceil(0.8 n) + 2 rarest ones.
   Large sets (heavy) scan the inverted lists of their n - ceil(0.8 n) + 1
   rarest elements, where light sets are listed too as far as their sizes reach.
   The boundary is the size from which listing costs less, by the measured
   frequencies of elements.
4. Sets that share a key are compared with one of them only (keys of very many
   sets by parts), then, for some rounds, what is still apart with one more, and
   last all pairs of a key in different components that can link by their sizes and by
   what follows the key in their order of elements. So a key
   shared by a group of near copies costs as many comparisons as it has sets,
   and no link between two components can be missed.

Null or wordless text: empty set, linked with nothing. Texts of fewer than five
words have one shingle. Rows with an equal id are joined by their texts like
others; null ids take part, and count in a component only for other rows. An
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel
from .components import components
from .shared import buckets, checkpointed, free_shuffles, hot_from, join_keyed, prepare

#: Words of a shingle; per cent of the union that two linked sets share; elements of a light set's subsets.
WORDS, PERCENT, SUBSET = 5, 80, 2
#: Texts (and bytes) whose sets travel together.
CHUNK_TEXTS, CHUNK_BYTES = 4096, 12 << 20
#: Members of a key that are compared with one first member.
KEY_MEMBERS = 4096
#: Rounds of comparing with one more set of a key before all that is left is compared.
HEADS = 4


def shingles(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each document's shingles."""
    h, before = kernel.word_hashes(data, off)
    factors = [np.uint64(pow(0x9E3779B97F4A7C15, i + 1, 1 << 64)) for i in range(WORDS)]
    rolled = np.zeros(max(0, len(h) - WORDS + 1), np.uint64)
    for i in range(WORDS):
        rolled += h[i : len(h) - WORDS + 1 + i] * factors[i]
    rolled = kernel.mix(rolled)
    out = []
    for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
        if b - a >= WORDS:
            s = np.sort(rolled[a : b - WORDS + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            total = np.array([b - a], np.uint64)
            for i in range(a, b):
                total = total * np.uint64(0xD1342543DE82EF95) + h[i : i + 1] * factors[i - a]
            out.append(kernel.mix(total))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(s: np.ndarray) -> str:
    """128-bit name of a set."""
    with np.errstate(over="ignore"):
        x, y = kernel.mix(s ^ np.uint64(0x1234567)), kernel.mix(s * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1))
        return f"{int(x.sum(dtype=np.uint64)):016x}{int(y.sum(dtype=np.uint64)):016x}" + f"{len(s):x}"


def needed(n: np.ndarray | int) -> np.ndarray | int:
    """Elements that a set of n must share with any set it links with: ceil(PERCENT n / 100)."""
    return -(-n * PERCENT // 100)


def _code(count: np.ndarray) -> np.ndarray:
    """Frequencies in one byte, in order: exact up to 127, powers of two above."""
    return np.where(count < 128, count, 121 + np.log2(np.maximum(count, 1)).astype(np.int64)).astype(np.uint8)


def pack(element: np.ndarray, text: np.ndarray, texts: int, code: np.ndarray | None = None) -> bytes:
    """Elements of one hash range, ordered by text, in 5 bytes each (40 bits; the range stands for more), with codes if given, and the texts they belong to.

    Texts are told by how many elements each has or, where the range holds few, by each element's step from the text
    before, whichever takes less, in integers as narrow as they fit: the more ranges, the fewer elements one has, and
    a count for every text would come to outweigh them.
    """
    counts, steps = np.bincount(text, minlength=texts), np.diff(text, prepend=0)
    told = [x.astype(np.min_scalar_type(int(x.max(initial=0)))) for x in (counts, steps)]
    by_step = told[1].nbytes < told[0].nbytes
    own = told[by_step].astype(f"<u{min(4, told[by_step].itemsize)}")
    head = np.array([len(element), texts, own.itemsize | by_step << 8], "<u4").tobytes()
    high = ((element >> np.uint64(32)) & np.uint64(0xFF)).astype(np.uint8).tobytes()
    return head + own.tobytes() + element.astype("<u4").tobytes() + high + (b"" if code is None else code.tobytes())


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
    """Elements, their texts, the number of texts, and codes (empty if none were given)."""
    m, texts, form = np.frombuffer(blob, "<u4", 3).tolist()
    width, by_step = form & 0xFF, form >> 8
    own = np.frombuffer(blob, f"<u{width}", m if by_step else texts, 12).astype(np.int64)
    at = 12 + own.size * width
    low = np.frombuffer(blob, "<u4", m, at).astype(np.uint64)
    high = np.frombuffer(blob, np.uint8, m, at + 4 * m).astype(np.uint64)
    text = np.cumsum(own) if by_step else np.repeat(np.arange(texts), own)
    return low | high << np.uint64(32), text, texts, np.frombuffer(blob, np.uint8, -1, at + 5 * m)


def _sets(docs: DataFrame, id_col: str, text_col: str, parts: int) -> DataFrame:
    """Step 1 up to the exchange. Rows: kind 0, a chunk's elements of one hash range; kind 1, a chunk's texts."""

    def flush(number: int, ids: list[pa.Array], sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        names = [signature(s) if len(s) else "" for s in sets]
        # Of equal sets in a chunk the first speaks for all.
        first: dict[str, int] = {}
        own = np.array([first.setdefault(x, i) == i for i, x in enumerate(names)])
        speaks = [s for s, o in zip(sets, own, strict=True) if o]
        chunk_id = pa.concat_arrays(ids)
        chunk = TaskContext.get().partitionId() << 32 | number  # the same when a lost task is run again
        joined = np.concatenate([*speaks, np.zeros(0, np.uint64)])
        text = np.repeat(np.flatnonzero(own), [len(s) for s in speaks])
        part = ((joined >> np.uint64(33)) % np.uint64(parts)).astype(np.uint16 if parts <= 65536 else np.uint32)
        order = np.argsort(part, kind="stable")  # texts stay in order within a range
        packed, text = joined[order], text[order]
        edges = np.searchsorted(part[order], np.arange(parts + 1))
        some = np.flatnonzero(np.diff(edges))
        none = pa.nulls(len(some), chunk_id.type)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), chunk)), pa.array(np.zeros(len(some), np.int32)), pa.array([pack(packed[a:b], text[a:b], len(sets)) for a, b in zip(edges[some], edges[some + 1], strict=True)], pa.binary()), pa.array([None] * len(some), pa.string()), none, pa.nulls(len(some), pa.int32()), pa.nulls(len(some), pa.int32())], NAMES)
        m = len(sets)
        yield pa.RecordBatch.from_arrays([pa.array((np.arange(m) % parts).astype(np.int32)), pa.array(np.full(m, chunk)), pa.array(np.ones(m, np.int32)), pa.nulls(m, pa.binary()), pa.array(names, pa.string()), chunk_id, pa.array([len(s) for s in sets], pa.int32()), pa.array(np.arange(m, dtype=np.int32))], NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sets, size, number = [], [], 0, 0
        for batch, data, off in kernel.blocks(batches):
            if sets and (len(sets) + batch.num_rows > CHUNK_TEXTS or size + len(data) > CHUNK_BYTES):
                yield from flush(number, ids, sets)
                ids, sets, size, number = [], [], 0, number + 1
            ids.append(batch.column(0)), sets.extend(shingles(data, off))
            size += len(data)
        if sets:
            yield from flush(number, ids, sets)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"part int, chunk long, kind int, packed binary, name string, id {kind}, n int, at int")


NAMES = ["part", "chunk", "kind", "packed", "name", "id", "n", "at"]


def _repeated(part: pa.Table) -> pa.Table:
    """Of a hash range: each chunk's elements that more than one set holds, with their frequency codes behind them. Texts' rows pass."""
    is_set = np.asarray(part["kind"]) == 0
    rows = part.filter(pa.array(is_set))
    sets = [unpack(x) for x in rows["packed"].to_pylist()]
    element = np.concatenate([*(x[0] for x in sets), np.zeros(0, np.uint64)])
    order = np.argsort(element, kind="stable")
    s = element[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, len(s)))
    code = np.empty(len(s), np.uint8)
    code[order] = np.repeat(_code(count), count)
    out, a = [], 0
    for own, text, texts, _ in sets:
        more = (c := code[a : a + len(own)]) > 1
        out.append(pack(own[more], text[more], texts, c[more]))
        a += len(own)
    rows = rows.set_column(rows.schema.get_field_index("packed"), "packed", pa.array(out, pa.binary()))
    return pa.concat_tables([rows.cast(part.schema), part.filter(pa.array(~is_set))])


def _texts(id_kind: str):
    """Of a chunk: one row per text: id, name, n, and for sets that can have links their repeated elements (sorted) with frequency codes."""

    def run(part: pa.Table) -> pa.Table:
        kinds = np.asarray(part["kind"])
        texts = part.filter(pa.array(kinds == 1)).sort_by("at").combine_chunks()
        rows = part.filter(pa.array(kinds == 0))
        elements, codes, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)]
        for blob, p in zip(rows["packed"].to_pylist(), rows["part"].to_pylist(), strict=True):
            element, text, _, code = unpack(blob)
            # An element's name: its bits mixed with its range.
            elements.append(element + kernel.mix(np.array([p + 1], np.uint64))), codes.append(code), owners.append(text)
        name, code, text = np.concatenate(elements), np.concatenate(codes), np.concatenate(owners)
        n = np.asarray(texts["n"]).astype(np.int64)
        held = np.bincount(text, minlength=len(n))
        order = np.lexsort((name, text))
        name, code, at = name[order], code[order], np.concatenate(([0], np.cumsum(held)))
        sets = [name[at[i] : at[i + 1]].tobytes() + code[at[i] : at[i + 1]].tobytes() if n[i] and held[i] >= needed(int(n[i])) else None for i in range(len(n))]
        return pa.table([texts["id"], texts["name"], texts["n"], pa.array(sets, pa.binary())], names=["id", "name", "n", "elements"])

    return run, f"id {id_kind}, name string, n int, elements binary"


def _rare(n: int, blob: bytes, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The repeated elements among a set's n - needed + k rarest ones, rarest first, and their places in the set's order."""
    m = len(blob) // 9
    name, code = np.frombuffer(blob, np.uint64, m), np.frombuffer(blob, np.uint8, m, 8 * m)
    most = max(0, n - int(needed(n)) + k - (n - m))
    return name[np.lexsort((name, code))[:most]], n - m + np.arange(min(most, m))


def _keys(batches: Iterator[pa.RecordBatch], boundary: int) -> Iterator[pa.RecordBatch]:
    """Keys of each set: light sets' subsets (kind 2) and listed elements (kind 1 for heavy sets, 0 for light ones near the boundary).

    left: how many elements of the set stand behind the key's last one, the key's own included. weight: mean frequency
    (by code, in hundredths) of the set's elements; of a group of near copies the text they come from has the largest.
    """
    reach = int(needed(boundary + 1))  # a light set this large can link with a heavy one
    for batch in batches:
        keys, owner, kinds, left, weight = [], [], [], [], []
        for i, (n, blob) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            m = len(blob) // 9
            weight.append(100 * (int(np.frombuffer(blob, np.uint8, m, 8 * m).sum()) + n - m) // n)
            if n > boundary or n >= reach:
                e, place = _rare(n, blob, 1)
                keys.append(e), owner.append(np.full(len(e), i)), kinds.append(np.full(len(e), int(n > boundary))), left.append(n - place)
            if n <= boundary:
                e, place = _rare(n, blob, SUBSET)
                x, y = np.triu_indices(len(e), 1)
                # Each key once a set, so that rows need no exchange to be told apart.
                s, first = np.unique(kernel.mix(e[x] * np.uint64(0x9E3779B97F4A7C15) + kernel.mix(e[y])), return_index=True)
                keys.append(s), owner.append(np.full(len(s), i)), kinds.append(np.full(len(s), 2)), left.append(n - place[y[first]] - 1 + SUBSET)
        if keys and (o := np.concatenate(owner)).size:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(kinds).astype(np.int32)), pa.array(np.concatenate(left).astype(np.int32)), pa.array(np.array(weight, np.int32)[o]), batch.column(0).take(pa.array(o)), batch.column(1).take(pa.array(o))], ["key", "kind", "left", "weight", "name", "n"])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sets link. Columns: a, b, na, nb, ea, eb."""
    for batch in batches:
        good = []
        na, nb, ea, eb = (batch.column(i).to_pylist() for i in range(2, 6))
        for i in range(batch.num_rows):
            x, y = np.frombuffer(ea[i], np.uint64, len(ea[i]) // 9), np.frombuffer(eb[i], np.uint64, len(eb[i]) // 9)
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            both = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0
            good.append(100 * both >= PERCENT * (na[i] + nb[i] - both))
        kept = batch.filter(pa.array(good))
        yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], ["a", "b"])


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of sets that link, by their numbers."""
    x = sets.select(F.col("name").alias("a"), F.col("n").alias("na"), F.col("elements").alias("ea"))
    y = sets.select(F.col("name").alias("b"), F.col("n").alias("nb"), F.col("elements").alias("eb"))
    full = pairs.join(x, "a").join(y, "b").select("a", "b", "na", "nb", "ea", "eb")
    return checkpointed(full.mapInArrow(_links, "a long, b long"))


def boundary(sets: DataFrame) -> int:
    """Largest size up to which enumerating subsets costs less than scanning inverted lists.

    Costs by size, in rows: a listed element costs its entry and a look at each set that holds it, as many as its
    frequency; a subset costs its entry, twice, as there are many with no partner, and a look at each set that would
    hold both elements if they met by chance. One row for each size of a set comes back.
    """
    every = max(1, sets.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for n, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                m = len(blob) // 9
                code = np.sort(np.frombuffer(blob, np.uint8, m, 8 * m))
                often = np.where(code < 128, code, np.exp2(np.minimum(code.astype(float), 184) - 121))
                most = n - int(needed(n)) + 1 - (n - m)
                own, more = often[: max(0, most)], often[: max(0, most + 1)]
                rows.append((n, len(more) * (len(more) - 1.0) + (more.sum() ** 2 - (more**2).sum()) / (2 * every), len(own) + own.sum()))
            if rows:
                n, light, heavy = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(n, pa.int32()), pa.array(light, pa.float64()), pa.array(heavy, pa.float64())], ["n", "light", "heavy"])

    rows = sets.select("n", "elements").mapInArrow(run, "n int, light double, heavy double").groupBy("n").agg(F.sum("light").alias("light"), F.sum("heavy").alias("heavy")).orderBy("n").collect()
    best, at, total = 0.0, 0, 0.0
    for r in rows:
        total += r.light - r.heavy
        if total < best:
            best, at = total, r.n
    return at


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text: id_col, n_shingles, set_name (equal for equal sets), component_id (the smallest id reachable by links)."""
    spark = docs.sparkSession
    prepare(spark)
    parts = buckets(spark)
    id_kind = docs.schema[id_col].dataType.simpleString()
    sent = _sets(docs, id_col, text_col, parts)
    repeated = checkpointed(sent.groupBy("part").applyInArrow(_repeated, sent.schema))
    free_shuffles(spark)
    run, schema = _texts(id_kind)
    texts = checkpointed(repeated.groupBy("chunk").applyInArrow(run, schema))
    free_shuffles(spark)
    named = texts.where("n > 0")
    # One set for each name; the blob is read once, by its first text. From here to the components sets go by numbers, fixed once they are written.
    sets = named.where("elements is not null").groupBy("name").agg(F.first("n").alias("n"), F.first("elements").alias("elements"))
    sets = checkpointed(sets.withColumn("number", F.monotonically_increasing_id()))
    links = _set_links(sets.select(F.col("number").alias("name"), "n", "elements"))
    member = components(links).join(sets.select(F.col("number").alias("node"), "name"), "node").select("name", F.col("component").cast("string").alias("component"))  # shorter than any name
    least = named.groupBy("name").agg(F.min("id").alias("own"), F.count(F.lit(1)).alias("rows"))
    root = least.join(member, "name", "left").select("name", "own", "rows", F.coalesce("component", "name").alias("component"))
    smallest = root.groupBy("component").agg(F.min("own").alias("component_id"))
    by_name = root.join(smallest, "component").select("name", "rows", "component_id")
    # Texts without a set have no name to meet by; those of a set with many copies are spread.
    out = join_keyed(named.select("id", "name", "n"), by_name, ["name"], "rows", hot_from(spark, texts.count())).select("id", "n", "name", "component_id")
    out = out.unionByName(texts.where("n = 0").select("id", "n", "name", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.col("name").alias("set_name"), "component_id")


def _set_links(sets: DataFrame) -> DataFrame:
    """Links (a, b) that connect the same sets as all links do. sets: name (a number), n, elements."""
    limit = boundary(sets)
    keys = sets.select("name", "n", "elements").mapInArrow(lambda b: _keys(b, limit), "key long, kind int, left int, weight int, name long, n int")
    keys = keys.withColumn("subset", F.col("kind") == 2)
    # Keys of one set alone, and lists without a heavy set, make no candidates.
    many = keys.groupBy("key", "subset").agg(F.count(F.lit(1)).alias("sets"), F.max("kind").alias("top"), F.struct(F.bit_xor(F.xxhash64("name")), F.bit_xor(F.xxhash64(F.lit(7), "name"))).alias("content"), F.sum("left").alias("room")).where("sets > 1 and (subset or top = 1)")
    # Of keys with the same members the one that comes first in their order is enough: any pair's first shared key is one of these.
    once = checkpointed(many.groupBy("content", "subset", "sets").agg(F.max_by("key", F.struct("room", "key")).alias("key")).select("key", "subset", "sets", F.ceil(F.col("sets") / KEY_MEMBERS).cast("int").alias("split")))
    spark = sets.sparkSession
    hot = hot_from(spark, once.agg(F.sum("sets")).first()[0] or 0)
    runs = checkpointed(join_keyed(keys, once, ["key", "subset"], "sets", hot).select("key", "subset", "name", "n", "kind", "left", "weight", "split", "sets"))
    free_shuffles(spark)
    involved = checkpointed(sets.join(runs.select("name").distinct(), "name", "left_semi"))
    salt = F.pmod(F.xxhash64("name"), F.col("split"))
    # First round: members of a key (of one part of it, if it is large) with the set there whose elements are the most frequent, heavy ones first.
    links = _verify(_with_head(runs.withColumn("salt", salt).withColumn("component", F.col("name")), ["key", "subset", "salt"], F.col("weight"), hot), involved)
    # Further rounds: what a key still holds apart is compared with one more of its sets, drawn anew, while that links any.
    for turn in range(HEADS):
        more = checkpointed(_with_head(_open(runs, components(links), hot), ["key", "subset"], F.xxhash64(F.lit(turn), "name"), hot))
        if more.isEmpty():
            break
        new = _verify(more, involved)
        if new.isEmpty():
            break
        links = checkpointed(links.unionByName(new).distinct())
        free_shuffles(spark)
    rest = _cross_pairs(_open(runs, components(links), hot), hot)
    return links.unionByName(_verify(rest, involved))


def _by_heat(rows: DataFrame, hot: int) -> list[tuple[DataFrame, bool]]:
    """The rows of hot keys, which are few keys, and those of all others."""
    return [(rows.where(F.col("sets") >= hot), True), (rows.where(F.col("sets") < hot), False)]


def _open(runs: DataFrame, label: DataFrame, hot: int) -> DataFrame:
    """Rows of keys whose sets lie in several components, with the component of each."""
    named = runs.join(label.withColumnRenamed("node", "name"), "name", "left").withColumn("component", F.coalesce("component", "name"))
    keys = checkpointed(named.groupBy("key", "subset").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.max("sets").alias("sets")).where("x <> y").select("key", "subset", "sets"))
    return checkpointed(join_keyed(named, keys, ["key", "subset"], "sets", hot))


def _fits(p: dict[str, Column], q: dict[str, Column]) -> Column:
    """Whether two sets with a key in common can link: by kind, and by what can follow the key in both (true for the first key that linked sets share)."""
    both = p["n"] + q["n"]
    return (p["subset"] | (p["kind"] == 1) | (q["kind"] == 1)) & (F.least(p["left"], q["left"]) * (100 + PERCENT) >= both * PERCENT) & (F.least(p["n"], q["n"]) * 100 >= F.greatest(p["n"], q["n"]) * PERCENT)


def _with_head(members: DataFrame, by: list[str], order: Column, hot: int) -> DataFrame:
    """Distinct pairs (a, b) of each key's head (heavy ones first, then by `order`) and its members of other components that can link with it."""
    out = None
    for own, few in _by_heat(members, hot):
        heads = own.groupBy(*by).agg(F.max(F.struct("kind", order.alias("order"), "n", "name", "left", "component")).alias("h"))
        joined = own.join(F.broadcast(heads) if few else heads, by)  # hot keys are few, and so are their parts
        out = joined if out is None else out.unionByName(joined)
    h = {c: F.col(f"h.{c}") for c in ("name", "n", "kind", "left")} | {"subset": F.col("subset")}
    m = {c: F.col(c) for c in ("name", "n", "kind", "left", "subset")}
    pairs = out.where((F.col("component") != F.col("h.component")) & _fits(h, m))
    return pairs.select(F.least(h["name"], m["name"]).alias("a"), F.greatest(h["name"], m["name"]).alias("b")).distinct()


#: Parts at most that each side of a hot key's pairs is cut into.
PAIR_PARTS = 4


def _cross_pairs(named: DataFrame, hot: int) -> DataFrame:
    """All pairs of a key that lie in different components and can link: what comparing with heads has left open.

    Both sides of a hot key are cut, the more the larger it is, and each part of one meets each part of the other in a
    task of its own: at most PAIR_PARTS squared tasks, a row goes to PAIR_PARTS of them at most.
    """
    columns = ("name", "n", "kind", "left", "component")
    parts = F.least(F.lit(PAIR_PARTS), F.ceil(F.sqrt(F.col("sets") / hot))).cast("int")
    own, every = F.pmod(F.xxhash64("name"), parts).cast("int"), F.explode(F.sequence(F.lit(0), parts - 1))
    p = named.select("key", "subset", own.alias("row"), every.alias("column"), *(F.col(c).alias(f"p_{c}") for c in columns))
    q = named.select("key", "subset", every.alias("row"), own.alias("column"), *(F.col(c).alias(f"q_{c}") for c in columns))
    of = lambda side: {c: F.col(f"{side}_{c}") for c in columns} | {"subset": F.col("subset")}
    pairs = p.join(q, ["key", "subset", "row", "column"]).where((F.col("p_name") < F.col("q_name")) & (F.col("p_component") != F.col("q_component")) & _fits(of("p"), of("q")))
    return pairs.select(F.col("p_name").alias("a"), F.col("q_name").alias("b")).distinct()
