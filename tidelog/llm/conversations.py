"""Repair of the structure of conversations by the cheapest edits of their turns."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import spread_join, stored

#: What edits cost, and what a truncated turn adds that is not deleted.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Places in tables of roles, the place of what comes before all turns, and that of what comes after them.
SYSTEM, USER, ASSISTANT, START, END = range(5)
#: Whether a turn may stay, and at what price.
CLEAN, CUT_OFF, MUST_GO = range(3)
#: Roles to insert between two retained turns, so that roles go (system)? (user assistant)+ or there are none; pairs that are not here can't be.
BETWEEN = {
    (START, SYSTEM): "",
    (START, USER): "",
    (START, ASSISTANT): "u",
    (START, END): "",
    (SYSTEM, USER): "",
    (SYSTEM, ASSISTANT): "u",
    (SYSTEM, END): "ua",
    (USER, ASSISTANT): "",
    (USER, USER): "a",
    (USER, END): "a",
    (ASSISTANT, USER): "",
    (ASSISTANT, ASSISTANT): "u",
    (ASSISTANT, END): "",
}
NAMES = {"u": "user", "a": "assistant"}
#: Bytes of text in a batch of results.
BATCH_BYTES = 4 << 20

_WHITE = r"[\x20\x09-\x0D]"


def cheapest(codes: bytes | bytearray) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits of one conversation.

    A code is four times CLEAN, CUT_OFF or MUST_GO, plus the place of the turn's role (START for
    any other). The audit has K, R, D and I for turns kept, reroled and deleted and for inserted
    ones; of equal costs the ASCII-least.

    The retained turns are a subsequence. From the last turn on, ``h`` is the least cost from a
    turn that is retained in a role. The next retained turn is found in constant time: what is
    deleted in between is a difference of prefix sums, so a running minimum of ``h`` plus
    the prefix sum for each role is enough, and the two roles say what is inserted.

    Among equal costs audits decide without being compared: D is the least letter, so the later
    next turn wins, no next turn before all; of the same turn in two roles, the one with more
    inserted before it (I is less than K and R), then K.
    """
    n = len(codes)
    inf = 1 << 60
    best, at, letter = [inf] * 3, [n] * 3, ["R"] * 3
    after = [array("q", bytes(8 * n)) for _ in range(3)]  # the next retained turn and its role

    def pick(q: int, i: int) -> tuple[int, int, int]:
        """(cost, next turn, its role) from a turn ``i`` in the role ``q`` on."""
        gone = DELETE * (i + 1)
        top = (DELETE * n - gone + INSERT * len(BETWEEN[q, END]), -n, 0, "", END)
        for r in (SYSTEM, USER, ASSISTANT):
            between = BETWEEN.get((q, r))
            if between is not None and best[r] < inf:
                top = min(top, (best[r] - gone + INSERT * len(between), -at[r], -len(between), letter[r], r))
        return top[0], -top[1], top[4]

    for i in range(n - 1, -1, -1):
        state, own = divmod(codes[i], 4)
        if state == MUST_GO:
            continue
        price = TRUNCATED * (state == CUT_OFF)
        found = []
        for r in {own, USER, ASSISTANT} - {START}:
            rest, j, next_role = pick(r, i)
            after[r][i] = j * 8 + next_role
            found.append((r, price + REROLE * (r != own) + rest))
        for r, h in found:
            if h + DELETE * i < best[r]:  # of equal costs the later turn stays
                best[r], at[r], letter[r] = h + DELETE * i, i, "K" if r == own else "R"
    cost, j, r = pick(START, -1)
    audit, i, q = [], -1, START
    while True:
        audit += ["D" * (j - i - 1), "I" * len(BETWEEN[q, r])]
        if r == END:
            return cost, "".join(audit)
        audit.append("K" if codes[j] % 4 == r else "R")
        i, q = j, r
        j, r = divmod(after[q][i], 8)


def _illegal(codes: bytearray) -> int:
    """Neighbours whose roles are not system and user, user and assistant or assistant and user."""
    fine = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
    return sum((a % 4, b % 4) not in fine for a, b in zip(codes, codes[1:]))


def in_order(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, pos, state, fault) of every turn.

    ``pos`` grows in the order of (conv_id, turn, role, text), nulls first; null roles and texts
    count as one space. ``fault`` is the first of blank, duplicate (role and text came earlier in
    the conversation) and truncated (the last character that is not ASCII white space is none of
    ``.!?``), or null; ``state`` says what it means for the repair. Rows are dealt out by ranges that
    may cut a conversation, and equal rows too, so a long one is spread over tasks.
    """
    space = F.lit(" ")
    rows = turns.select(
        F.col(conv_id).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), space).alias("role"),
        F.coalesce(F.col(text).cast("string"), space).alias("text"),
        F.monotonically_increasing_id().alias("row"),
    )
    order = ["conv_id", "turn", "role", "text", "row"]
    who = F.sha2(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("-")), F.length("role"), "role", "text"), 256)
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(placed.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("pos"), F.unhex(who).alias("who")), "turns")
    repeats = placed.groupBy("who").agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1")
    told = spread_join(placed, repeats.select("who", "first"), ["who"], ["pos"], how="left", counts=repeats)
    fault = (
        F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "blank")
        .when(F.col("pos") > F.col("first"), "duplicate")
        .when(~F.col("text").rlike(rf"[.!?]{_WHITE}*\z"), "truncated")
    )
    told = told.withColumn("fault", fault)
    state = F.when(F.col("fault").isNull(), CLEAN).when(F.col("fault") == "truncated", CUT_OFF).otherwise(MUST_GO)
    return told.select("conv_id", "turn", "role", "text", "pos", state.alias("state"), "fault")


def _code() -> Column:
    initial = F.substring("role", 1, 1)
    own = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(START)
    return (F.col("state") * 4 + own).cast("tinyint")


def plans(ordered: DataFrame) -> DataFrame:
    """(conv_id, illegal, cost, audit) of every conversation of ``in_order``.

    The audit is one string, so one task makes it; it reads the turns' codes in order and keeps
    a byte and three numbers for each, and no text.
    """
    fields = [ordered.schema["conv_id"], *(T.StructField(n, t) for n, t in (("illegal", T.LongType()), ("cost", T.LongType()), ("audit", T.StringType())))]
    coded = ordered.select("conv_id", "pos", _code().alias("code")).repartition("conv_id").sortWithinPartitions("conv_id", "pos")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, names = None, [f.name for f in fields]

        def made(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (kind, pa.int64(), pa.int64(), pa.string()))], names)

        conv, codes, done = None, bytearray(), []
        for batch in batches:
            kind = batch.column("conv_id").type
            for c, code in zip(batch.column("conv_id").to_pylist(), batch.column("code").to_pylist()):
                if c != conv and codes:
                    done.append((conv, _illegal(codes), *cheapest(codes)))
                    codes = bytearray()
                conv = c
                codes.append(code)
            if len(done) >= 1000:
                yield made(done)
                done = []
        if codes:
            done.append((conv, _illegal(codes), *cheapest(codes)))
        if done:
            yield made(done)

    return coded.mapInArrow(work, T.StructType(fields))


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, place, edit, role, text) of retained and inserted turns, from rows in order of which a conversation's first is its audit."""
    conv, audit, k, place, last = None, "", 0, 0, START
    letters = {"s": SYSTEM, "u": USER, "a": ASSISTANT}

    def inserted(until: int) -> Iterator[tuple]:
        nonlocal place
        for x in BETWEEN[last, until]:
            yield conv, place, "insert", NAMES[x], ""
            place += 1

    for batch in batches:
        for c, pos, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "pos", "role", "text"))):
            if pos < 0:
                if audit:
                    yield from inserted(END)
                conv, audit, k, place, last = c, text, 0, 0, START
                continue
            gap = k
            while audit[k] == "I":
                k += 1
            what = audit[k]
            k += 1
            if what == "D":
                continue
            # a turn in its own role keeps its name; of two roles a new one may have, the insertions before it tell which is meant
            own = letters.get(role[:1])
            if what == "R":
                n = k - 1 - gap
                own = next(r for r in (USER, ASSISTANT) if r != own and len(BETWEEN.get((last, r), "---")) == n)
                role = NAMES["ua"[own - USER]]
            yield from inserted(own)
            yield conv, place, "keep" if what == "K" else "rerole", role, text
            place, last = place + 1, own
    if audit:
        yield from inserted(END)


def repaired(ordered: DataFrame, planned: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the turns after the edits of ``plans``, by conversation in order.

    Texts are streamed in order behind their conversation's audit and not kept.
    """
    conv = ordered.schema["conv_id"]
    audits = planned.select("conv_id", F.lit(-1).cast("long").alias("pos"), F.lit("").alias("role"), F.col("audit").alias("text"))
    rows = ordered.select("conv_id", "pos", "role", "text").union(audits).repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    names = ["conv_id", "place", "edit", "role", "text"]
    schema = T.StructType([conv, T.StructField("place", T.LongType()), *(T.StructField(n, T.StringType()) for n in names[2:])])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def read() -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for batch in batches:
                kind = batch.column("conv_id").type
                yield batch

        def made(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (kind, pa.int64(), *[pa.string()] * 3))], names)

        out, size = [], 0
        for row in _edited(read()):
            out.append(row)
            size += 100 + len(row[4])
            if size > BATCH_BYTES:
                yield made(out)
                out, size = [], 0
        if out:
            yield made(out)

    return rows.mapInArrow(work, schema)


def digests(fixed: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the conversations of ``repaired`` that have turns: the hash of ``role:text``, joined by newlines.

    Such a hash is made in order, so one task makes it; it keeps nothing but its state.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, None
        for batch in batches:
            done = []
            for c, place, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "place", "role", "text"))):
                if place == 0:
                    if state is not None:
                        done.append((conv, state.hexdigest()))
                    conv, state = c, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            kind = batch.column("conv_id").type
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (kind, pa.string()))], ["conv_id", "repaired_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([state.hexdigest()])], ["conv_id", "repaired_sha256"])

    return fixed.mapInArrow(work, T.StructType([fixed.schema["conv_id"], T.StructField("repaired_sha256", T.StringType())]))


def summary(ordered: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated) of every conversation; sums are made in parts, so a long one is no burden.

    ``gaps`` counts the turn numbers that are lacking between the least and the greatest; 0 if all are null.
    """
    faults = [F.count_if(F.col("fault") == x).alias(x) for x in ("blank", "duplicate", "truncated")]
    by_turn = ordered.groupBy("conv_id", "turn").agg(*faults)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps")
    return by_turn.groupBy("conv_id").agg(gaps, *(F.sum(x).alias(x) for x in ("blank", "duplicate", "truncated")))


def repair(turns: DataFrame, **columns: str) -> tuple[DataFrame, DataFrame]:
    """(a row per conversation with its faults, costs, audit and hash, its repaired turns); ``columns`` are those of ``in_order``.

    A null conv_id is one conversation. Conversations of which nothing stays have an empty hash's
    value and no repaired turns; an empty table gives empty ones. Other columns are not looked at.
    """
    ordered = stored(in_order(turns, **columns), "ordered")
    planned = stored(plans(ordered), "plans")
    fixed = repaired(ordered, planned)
    same = lambda a, b: a["conv_id"].eqNullSafe(b["conv_id"])
    faults, hashes = summary(ordered), digests(fixed)
    out = planned.join(faults, same(planned, faults)).drop(faults["conv_id"])
    out = out.join(hashes, same(out, hashes), "left").drop(hashes["conv_id"])
    empty = F.sha2(F.lit(""), 256)
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select("conv_id", *numbers, "audit", F.coalesce("repaired_sha256", empty).alias("repaired_sha256")), fixed
