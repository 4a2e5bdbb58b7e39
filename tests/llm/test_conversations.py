"""Repair of conversations against an exhaustive search, and on rows with nulls, ties and repeats."""

import hashlib
import random

from tidelog.llm import conversations as conv
from tidelog.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string, audit string, pos string"


def exact(codes):
    """The least (cost, audit) from each state on, turn by turn; the strings themselves decide ties."""
    step = {"x": "sua", "s": "ua", "u": "ua", "a": "ua"}
    between = {("x", "a"): 1, ("s", "a"): 1, ("u", "u"): 1, ("a", "a"): 1}
    g = {"x": (0, ""), "s": (10, "II"), "u": (5, "I"), "a": (0, "")}
    for code in reversed(codes):
        state, own = divmod(code, 4)
        new = {}
        for q in "xsua":
            found = [(2 + g[q][0], "D" + g[q][1])]
            for r in step[q] if state != conv.MUST_GO else "":
                m = between.get((q, r), 0)
                same = "sua"[own : own + 1] == r
                if same or r != "s":
                    found.append((5 * m + 5 * (state == conv.CUT_OFF) + (not same) + g[r][0], "I" * m + ("K" if same else "R") + g[r][1]))
            new[q] = min(found)
        g = new
    return g["x"]


def test_cheapest_equals_search_over_all_edits():
    rng = random.Random(3)
    for _ in range(3000):
        codes = bytes(4 * rng.choice([0, 0, 0, 1, 2]) + rng.randrange(4) for _ in range(rng.randrange(9)))
        assert conv.cheapest(codes) == exact(codes), codes
    long = bytes(rng.choices([0, 1, 2, 3, 5, 6, 9], k=30_000))
    assert conv.cheapest(long) == exact(long)


def by_hand(rows):
    """Faults, costs and the repaired text of one conversation's rows, in order."""
    seen, codes, faults = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        body = text.strip(" \t\n\v\f\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        if fault:
            faults[fault] += 1
        state = {"": 0, "truncated": 1}.get(fault, 2)
        codes.append(4 * state + ("sua".find(role[:1]) if role[:1] and role[:1] in "sua" else 3))
    cost, audit = exact(bytes(codes))
    out, i, roles = [], 0, []
    for letter in audit:
        if letter != "D":
            after = {"s": "u", "u": "a", "a": "u"}.get(roles[-1] if roles else "", "u")
            kept = rows[i][1] if letter == "K" else {"u": "user", "a": "assistant"}[after]
            roles.append(kept[:1])
            out.append(f"{kept}:{'' if letter == 'I' else rows[i][2]}")
        i += letter != "I"
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, *faults.values(), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def test_rows_with_nulls_ties_repeats_and_other_columns(spark):
    rng = random.Random(9)
    rows = []
    for c in [*range(40), None]:
        for t in range(rng.randrange(1, 9)):
            turn = rng.choice([t, t, t, None, 2])
            role = rng.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"])
            text = rng.choice(["Yes.", "no", "", None, " \t", "What? ", "é!", "Line.\nmore", f"w{rng.randrange(5)}."])
            rows.append((c, turn, role, text, "x", "y"))
    rows += [(7, 1, "user", "again.", "x", "y")] * 50
    frame = spark.createDataFrame(rows, SCHEMA)
    found, fixed = conv.repair(frame)
    got = {r.conv_id: tuple(r)[1:] for r in found.collect()}
    want = {}
    for c in {r[0] for r in rows}:
        own = sorted([(r[1], r[2] if r[2] is not None else " ", r[3] if r[3] is not None else " ") for r in rows if r[0] == c], key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        want[c] = by_hand(own)
    assert got == want
    roles = {}
    for r in sorted(fixed.collect(), key=lambda r: r.place):
        roles.setdefault(r.conv_id, []).append(r.role[:1])
    assert all(r.count("s") <= (r[0] == "s") and "".join(r).lstrip("s") == "ua" * ((len(r) - r.count("s")) // 2) for r in roles.values())
    empty, none = conv.repair(frame.where("false"))
    assert empty.count() == none.count() == 0


def test_query_names_every_conversation(spark, sf_dir):
    df = queries.op12_conversation_repair(spark, sf_dir)
    assert df.dtypes == [("conv_id", "bigint"), *[(c, "bigint") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", "string"), ("repaired_sha256", "string")]
    assert df.count() == spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id").distinct().count()
