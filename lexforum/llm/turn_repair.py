"""Repair of conversations to the grammar s?(ua)+ of roles by the cheapest edits.

Each conversation's rows go by turn (nulls first; rows of one turn by role, then by the
SHA-256 of their text, copies together). A row's first fault counts: blank, duplicate
(role and text came before), truncated. Edits: keep (0), rerole to user or assistant (1),
delete (2; blank and duplicate rows must go), insert an empty user or assistant text (5);
a truncated row that stays adds 5.

The costs are layers of bitsets: bit (layer, state) of a word says that what follows
can still be accepted from that state of the grammar at exactly that cost. A row's word
comes from the next row's by shifts alone: an edit that costs c moves the bits up c
layers, a role moves them between the four states. The costs of the four states never
lie more than 15 apart (any state reaches any other that matters by two insertions and
a deletion), so 16 layers over the least one are all there are to keep: one 64-bit word
for each row, whatever the total. The first layer with the start state gives the cost;
following the bits from there, the ASCII-least edit first, gives the least audit.

Texts are hashed by Spark, and rows of 100 bytes are sorted by conversation and streamed,
so a conversation holds some 20 bytes a row in its task; in a second pass the texts
stream by once more, behind their conversation's audit, into its hash. One conversation
is one task's, as its audit and its hash are single values, but never in one piece.

Null conv_ids are one conversation. Null roles and texts are one space; an empty or
unknown role cannot be kept. A conversation whose rows are all lost, and one without
faults, have their row like any other; an empty table gives an empty result. Other
columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import checkpointed, prepare

#: Spaces, and ends of a sentence.
SPACES, ENDS = " \t\n\x0b\x0c\r", (".", "!", "?")
#: States: start, after system, after user, after assistant; accepted are the first and the last.
START, SYSTEM, USER, ASSISTANT = range(4)
LAYERS = 16
_ALL = (1 << 4 * LAYERS) - 1
_IN = [sum(1 << 4 * layer + state for layer in range(LAYERS)) for state in range(4)]
#: Faults of a row.
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
_INITIALS = {"s": 1, "u": 2, "a": 3}
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_NAMES = {USER: "user", ASSISTANT: "assistant"}


def _before_user(x: int) -> int:
    """States from which a user's turn leads to the states of x."""
    at = x & _IN[USER]
    return at >> 2 | at >> 1 | at << 1


def _before_assistant(x: int) -> int:
    return (x & _IN[ASSISTANT]) >> 1


def _before(initial: int, x: int) -> int:
    if initial == 1:
        return (x & _IN[SYSTEM]) >> 1
    return _before_user(x) if initial == 2 else _before_assistant(x) if initial == 3 else 0


def _settled(x: int, base: int) -> tuple[int, int]:
    """With insertions, and moved down to its least layer."""
    for _ in range(3):
        x |= (_before_user(x) | _before_assistant(x)) << 20
    down = ((x & -x).bit_length() - 1) // 4
    return x >> 4 * down & _ALL, base + down


def layers(rows: bytes) -> tuple[array, array]:
    """Words and least layers before each row and after the last. A row: 4 x fault + initial (0: unknown, 1 s, 2 u, 3 a)."""
    words, bases = array("Q", bytes(8 * (len(rows) + 1))), array("q", bytes(8 * (len(rows) + 1)))
    x, base = _settled(1 << START | 1 << ASSISTANT, 0)
    words[len(rows)], bases[len(rows)] = x, base
    for i in range(len(rows) - 1, -1, -1):
        fault, initial = divmod(rows[i], 4)
        y = x << 8
        if fault in (FINE, TRUNCATED):
            stays = _before(initial, x) | (_before_user(x) | _before_assistant(x)) << 4
            y |= stays << 20 if fault == TRUNCATED else stays
        x, base = _settled(y, base)
        words[i], bases[i] = x, base
    return words, bases


def audit(rows: bytes) -> tuple[int, str]:
    """Least cost, and of the edits at that cost the ASCII-least initials."""
    words, bases = layers(rows)

    def accepted(i: int, state: int, cost: int) -> bool:
        layer = cost - bases[i]
        return 0 <= layer < LAYERS and bool(words[i] >> 4 * layer + state & 1)

    state, i, out = START, 0, []
    cost = total = bases[0] + next(k for k in range(LAYERS) if words[0] >> 4 * k + START & 1)
    while cost or i < len(rows):
        fault, initial = divmod(rows[i], 4) if i < len(rows) else (BLANK, 0)
        extra = 5 if fault == TRUNCATED else 0
        kept = next((q for q in (SYSTEM, USER, ASSISTANT) if initial == q and _before(q, 1 << q) >> state & 1), None)
        if i < len(rows) and accepted(i + 1, state, cost - 2):
            out.append("D")
            i, cost = i + 1, cost - 2
        elif accepted(i, _NEXT[state], cost - 5):
            out.append("I")
            state, cost = _NEXT[state], cost - 5
        elif fault in (FINE, TRUNCATED) and kept is not None and accepted(i + 1, kept, cost - extra):
            out.append("K")
            state, i, cost = kept, i + 1, cost - extra
        else:
            out.append("R")
            state, i, cost = _NEXT[state], i + 1, cost - extra - 1
    return total, "".join(out)


def damaged(table: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copy of each row after damage; a row that is lost stays once with a null copy."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = (F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn")).cast("binary")) % 20).alias("code")
    rows = table.select("conv_id", "turn", named("role").alias("role"), named("text").alias("text"), code)
    role = F.when(F.col("code") == 4, F.lit("user")).otherwise(F.col("role"))
    text = F.when(F.col("code") == 1, F.lit("")).when(F.col("code") == 2, F.translate("text", "".join(ENDS), "")).otherwise(F.col("text"))
    copies = F.when(F.col("code") == 0, F.array(F.lit(None).cast("int"))).when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def _signs(rows: DataFrame) -> DataFrame:
    """What the first pass needs of each row: its order, its role's initial, its fault without duplicates, and its place among equal ones."""
    trimmed = F.rtrim("text", F.lit(SPACES))
    fault: Column = F.when(trimmed == "", BLANK).when(~F.right(trimmed, F.lit(1)).isin(*ENDS), TRUNCATED).otherwise(FINE)
    initial = F.left("role", F.lit(1))
    number = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0)
    light = rows.select("conv_id", "turn", "role", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("hash"), "copy", number.cast("int").alias("initial"), fault.alias("fault"))
    same = Window.partitionBy("conv_id", "role", "hash").orderBy(F.col("turn").asc_nulls_first(), "copy")
    return light.repartition("conv_id").withColumn("again", F.col("copy").isNotNull() & (F.sum(F.col("copy").isNotNull().cast("int")).over(same.rowsBetween(Window.unboundedPreceding, 0)) > 1))


def _judged(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One row for each conversation of sorted rows. Columns: conv_id, turn, initial, fault, again, lost."""
    nothing = object()
    conv, rows, out = nothing, bytearray(), []
    counts, illegal, last, turns, low, high, seen = [0] * 4, 0, None, 0, None, None, None

    def done() -> None:
        cost, edits = audit(bytes(rows))
        out.append((conv, high - low + 1 - turns if turns else 0, *counts[1:], illegal, cost, edits))

    def given() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    for batch in batches:
        for c, turn, initial, fault, again, lost in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if conv is nothing or c != conv:
                if conv is not nothing:
                    done()
                conv, rows = c, bytearray()
                counts, illegal, last, turns, low, high, seen = [0] * 4, 0, None, 0, None, None, None
            if lost:
                continue
            if turn is not None and turn != seen:
                turns, seen, high, low = turns + 1, turn, turn, turn if low is None else low
            if fault != BLANK and again:
                fault = DUPLICATE
            counts[fault] += 1
            if last is not None and (last, initial) not in ((1, 2), (2, 3), (3, 2)):
                illegal += 1
            last = initial
            rows.append(4 * fault + initial)
        if len(out) > 1000:
            yield given()
            out.clear()
    if conv is not nothing:
        done()
    if out:
        yield given()


def _hashed(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """conv_id, repaired_sha256. Columns: conv_id, audit (of a conversation's first row), role, text."""
    nothing = object()
    conv, edits, at, state, sha, first, out = nothing, "", 0, START, None, True, []

    def line(role: str, text: str) -> None:
        nonlocal first
        sha.update((role + ":" + text if first else "\n" + role + ":" + text).encode())
        first = False

    def inserted() -> None:
        nonlocal at, state
        while at < len(edits) and edits[at] == "I":
            state = _NEXT[state]
            line(_NAMES[state], "")
            at += 1

    def done() -> None:
        inserted()
        out.append((conv, sha.hexdigest()))

    for batch in batches:
        for c, audit, role, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if audit is not None:
                if conv is not nothing:
                    done()
                conv, edits, at, state, sha, first = c, audit, 0, START, hashlib.sha256(), True
                continue
            inserted()
            edit = edits[at]
            at += 1
            if edit == "K":
                state = _INITIALS[role[0]]
                line(role, text)
            elif edit == "R":
                state = _NEXT[state]
                line(_NAMES[state], text)
        if len(out) > 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out.clear()
    if conv is not nothing:
        done()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def repair(rows: DataFrame) -> DataFrame:
    """Of rows (conv_id, turn, role, text, copy: null where only the conversation's name counts) one row for each conversation:
    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    spark = rows.sparkSession
    prepare(spark)
    kind = rows.schema["conv_id"].dataType.simpleString()
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("hash"), F.col("copy")]
    names = f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    target = spark.createDataFrame([], names).toArrow().schema
    sorted_ = _signs(rows).sortWithinPartitions(*order, "again")
    judged = checkpointed(sorted_.select("conv_id", "turn", "initial", "fault", "again", F.col("copy").isNull().alias("lost")).mapInArrow(lambda b: _judged(b, target), names))
    # The texts follow their conversation's audit.
    texts = rows.where(F.col("copy").isNotNull()).select("conv_id", F.lit(1).alias("after"), F.lit(None).cast("string").alias("audit"), "turn", "role", "text", F.sha2(F.col("text").cast("binary"), 256).alias("hash"), "copy")
    heads = judged.select("conv_id", F.lit(0).alias("after"), "audit")
    both = texts.unionByName(heads, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions("conv_id", "after", *order[1:])
    digests = spark.createDataFrame([], f"conv_id {kind}, repaired_sha256 string").toArrow().schema
    hashed = both.select("conv_id", "audit", "role", "text").mapInArrow(lambda b: _hashed(b, digests), f"conv_id {kind}, repaired_sha256 string")
    return judged.join(hashed.withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
