"""Conversation repair against exhaustive search and against plain dynamic programming."""

import hashlib
import random
import zlib
from itertools import product

import pytest

from seriesloom.llm import conversations as cv

WHITE = " \t\n\x0b\x0c\r"
NEXT = {0: 2, 1: 2, 2: 3, 3: 2}


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        strip = text.strip(WHITE)
        out.append("blank" if not strip else "duplicate" if (role, text) in seen else "truncated" if strip[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def all_ways(rows, faults):
    """Every audit with at most two insertions at a place, and its cost."""
    def go(i, state, cost, audit):
        inserted = [(state, cost, audit)]
        for _ in range(2):
            s, c, a = inserted[-1]
            inserted.append((NEXT[s], c + 3, a + "I"))
        for s, c, a in inserted:
            if i == len(rows):
                if s in (0, 3):
                    yield c, a
                continue
            yield from go(i + 1, s, c + 4, a + "D")
            if faults[i] in ("blank", "duplicate"):
                continue
            more = 3 * (faults[i] == "truncated")
            yield from go(i + 1, NEXT[s], c + 3 + more, a + "R")
            kept = {"s": 1 if s == 0 else None, "u": 2 if s != 2 else None, "a": 3 if s == 2 else None}.get(rows[i][0][:1])
            if kept:
                yield from go(i + 1, kept, c + more, a + "K")

    return min(go(0, 0, 0, ""))


def by_table(rows, faults):
    """The same with a table of best (cost, audit) per row and state, for long conversations."""
    best = {0: (0, "")}

    def insertions(held):
        for _ in range(2):
            for s, (c, a) in list(held.items()):
                held[NEXT[s]] = min(held.get(NEXT[s], (1 << 30, "")), (c + 3, a + "I"))
        return held

    for (role, _), fault in zip(rows, faults):
        new = {}

        def put(s, value):
            new[s] = min(new.get(s, (1 << 30, "")), value)

        # all ways of inserting before the row count, also those that come second to a state
        for s0, (c0, a0) in best.items():
            s, c, a = s0, c0, a0
            for _ in range(3):
                put(s, (c + 4, a + "D"))
                if fault not in ("blank", "duplicate"):
                    more = 3 * (fault == "truncated")
                    put(NEXT[s], (c + 3 + more, a + "R"))
                    kept = {"s": 1 if s == 0 else None, "u": 2 if s != 2 else None, "a": 3 if s == 2 else None}.get(role[:1])
                    if kept:
                        put(kept, (c + more, a + "K"))
                s, c, a = NEXT[s], c + 3, a + "I"
        best = new
    ends = insertions(best)
    return min(ends[s] for s in (0, 3) if s in ends)


def applied(rows, audit):
    out, state, left = [], 0, list(rows)
    for e in audit:
        if e == "I":
            state = NEXT[state]
            out.append((cv.ROLES[state], ""))
            continue
        role, text = left.pop(0)
        if e == "R":
            state = NEXT[state]
            out.append((cv.ROLES[state], text))
        elif e == "K":
            state = "-sua".index(role[0])
            out.append((role, text))
    return out


def damaged(conv, turn, role, text):
    name = "".join(" " if v is None else str(v) for v in (conv,)) + ":" + (" " if turn is None else str(turn))
    kind = zlib.crc32(name.encode()) % 20
    role, text = " " if role is None else role, " " if text is None else text
    if kind == 1:
        text = ""
    if kind == 2:
        text = "".join(c for c in text if c not in ".!?")
    return [] if kind == 0 else [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def plain(given, search=by_table):
    groups = {}
    for conv, turn, role, text in given:
        groups.setdefault(conv, []).extend(damaged(conv, turn, role, text))
    out = {}
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = [r[0] for r in rows if r[0] is not None]
        said = [(r[1], r[2]) for r in rows]
        faults = faults_of(said)
        initials = [r[:1] for r, _ in said]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit = search(said, faults) if rows else (0, "")
        lines = "\n".join(f"{r}:{t}" for r, t in applied(said, audit))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256(lines.encode()).hexdigest())
    return out


def found(frame):
    return {r[0]: tuple(r)[1:] for r in cv.report(cv.Repair(cv.damaged(frame)), frame).collect()}


NAMES = "conv_id long, turn long, role string, text string"


def random_rows(rng, conv, n, turns=None):
    roles = ["user", "assistant", "system", "tool", "", "usher", None]
    texts = ["Yes.", "No!", "cut", " ", "", None, "Why?  \n", "Yes.", "more. text", "é🙂."]
    return [(conv, t if rng.random() > 0.05 else None, rng.choice(roles), rng.choice(texts) if rng.random() < 0.7 else f"text {rng.random()}.") for t in range(n)]


def test_every_short_conversation_against_exhaustive_search():
    kinds = [(r, t) for r in ("system", "user", "assistant", "tool") for t in ("whole.", "cut", "")]
    for n in range(4):
        for pick in product(kinds, repeat=n):
            rows = [(r, f"{i}{t}" if t else t) for i, (r, t) in enumerate(pick)]
            faults = faults_of(rows)
            want = all_ways(rows, faults)
            codes = bytes(cv.INITIALS.index(r[0]) * 4 + ["", "blank", "duplicate", "truncated"].index(f) if r[0] in "sua" else ["", "blank", "duplicate", "truncated"].index(f) for (r, _), f in zip(rows, faults))
            cost, last = cv.last_state(cv.Rows(codes).forward(0, n, cv.START))
            assert (cost, "".join(cv.audit_of(codes, cv.START, last)) + cv.tail(last)) == want == by_table(rows, faults)


def test_pieces_meet_at_the_same_states():
    rng = random.Random(5)
    for n in (5, 17, 100):
        for _ in range(30):
            kinds = bytes(rng.randrange(16) for _ in range(n))
            whole = cv.Rows(kinds)
            cost, last = cv.last_state(whole.forward(0, n, cv.START))
            cuts = sorted(rng.sample(range(1, n), 3))
            parts = [kinds[a:b] for a, b in zip([0, *cuts], [*cuts, n])]
            value = cv.combine([cv.piece_value(p) for p in parts], 0, 4)
            assert value == cv.piece_value(kinds)
            states = cv.split([cv.piece_value(p) for p in parts], 0, 4, bytes([0, last]))
            assert "".join("".join(cv.audit_of(p, *s)) for p, s in zip(parts, states)) == "".join(cv.audit_of(kinds, 0, last))


@pytest.mark.parametrize("bits, height", [(12, 8), (2, 1)])
def test_against_plain(spark, monkeypatch, bits, height):
    monkeypatch.setattr(cv, "PIECE_BITS", bits)
    monkeypatch.setattr(cv, "HEIGHT", height)
    monkeypatch.setattr(cv, "CHUNK", 1 << 20 if bits > 2 else 40)
    rng = random.Random(bits)
    rows = [r for conv in range(60) for r in random_rows(rng, conv, rng.randrange(1, 9))]
    rows += random_rows(rng, 1000, 300) + random_rows(rng, None, 7)
    rows += [(2000, 0, "user", "x" * 100_000), (2000, 1, "assistant", "y. " * 30_000), (2001, None, "user", "Hi."), (2001, None, "user", "Hi.")]
    rows += [(3000, 2**62, "user", "far."), (3000, -(2**62), "assistant", "away.")]
    frame = spark.createDataFrame([(*r, "e") for r in rows], NAMES + ", audit string")
    want, got = plain(rows), found(frame)
    assert got.keys() == want.keys()
    for conv in want:
        assert got[conv] == want[conv], conv
    assert found(frame.limit(0)) == {}
    kept = cv.Repair(cv.damaged(frame)).turns().orderBy("conv_id", "piece", "place").filter("conv_id = 1000").collect()
    text = "\n".join(f"{r['role']}:{r['text']}" for r in kept)
    assert hashlib.sha256(text.encode()).hexdigest() == want[1000][-1]


def test_query_on_whole_table(spark, data):
    import __spark_entry__ as entry

    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r)[1:] for r in entry.queries()["op13_conversation_repair"](spark, data).collect()}
    assert got == plain(rows)
