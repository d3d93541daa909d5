"""Repair of conversations whose turns have faults, by Hirschberg's divide and conquer.

A conversation is well formed when the initials of its roles read ``(s?(ua)+)?``. Four states follow that
form: nothing yet, after the system's turn, after a user's, after an assistant's. Every row is kept,
given another role or deleted, and empty turns may be inserted; the cheapest edits are sought, of equally
cheap ones the audit (the edits' initials) that comes first.

Costs run through a conversation as vectors of four numbers. A forward vector carries, beside each
state's cost, the rank of its least audit: audits up to a row all end with that row's edit, so none begins
another, and one rank settles every tie. Forward and backward vectors meet in the middle; of the
states of least total cost the one of least rank is crossed, and both halves are solved the same way. No
table of all states is kept.

Conversations have any length. Their rows are put in one global order and cut into pieces of bounded size; a piece
gives a 4 x 4 table of costs and ranks, a tree of pieces is swept up and back (``sweeps``) to find the state at each
cut by the same crossing rule, and each piece is then solved between its two states.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from seriesloom.llm.common import BLANK
from seriesloom.llm.sweeps import in_order, numbered, sweep
from seriesloom.sources.panels import stage

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
# States: nothing yet, after a system turn, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
INITIALS = "-sua"
ROLES = {USER: "user", ASSISTANT: "assistant"}
STATES = range(4)
NEVER = 1 << 40
# Rows of a piece, and the fan-out of the tree of pieces as a power of two.
PIECE_BITS, HEIGHT = 12, 8
# Characters of repaired text that go on to the last digest at once.
CHUNK = 1 << 20

# Faults of a row.
SOUND, EMPTY, REPEATED, CUT = range(4)

Vector = tuple[tuple[int, ...], tuple[int, ...]]
Table = tuple[Vector, ...]


# --- one row ---------------------------------------------------------------------------------


def _turn_after(state: int) -> int:
    """The state that a user's or assistant's turn leads to."""
    return ASSISTANT if state == USER else USER


def _edits(state: int, initial: int, fault: int) -> Iterator[tuple[int, str, int]]:
    """Ways through one row from a state: cost, edits and the state after it."""
    added, before = 0, ""
    for _ in range(3):  # a third insertion comes back to a state that one has reached
        yield added + DELETE, before + "D", state
        if fault not in (EMPTY, REPEATED):
            more = TRUNCATED if fault == CUT else 0
            yield added + REROLE + more, before + "R", _turn_after(state)
            if initial == _turn_after(state) or (initial == SYSTEM and state == START):
                yield added + KEEP + more, before + "K", initial
        added, before, state = added + INSERT, before + "I", _turn_after(state)


@cache
def row_edits(kind: int) -> dict[tuple[int, int], tuple[int, str]]:
    """Cheapest and least edits for one row from a state to another. ``kind`` is initial and fault."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for state in STATES:
        for cost, edits, after in _edits(state, kind // 4, kind % 4):
            best[state, after] = min(best.get((state, after), (NEVER, "")), (cost, edits))
    return best


@cache
def row_table(kind: int) -> Table:
    best = row_edits(kind)
    rows = []
    for state in STATES:
        costs = tuple(best[state, after][0] if (state, after) in best else NEVER for after in STATES)
        order = sorted(STATES, key=lambda after, s=state: best.get((s, after), (0, "~"))[1])
        rows.append((costs, tuple(order.index(after) for after in STATES)))
    return tuple(rows)


def tail(state: int) -> str:
    """Insertions that complete a conversation behind its last row."""
    return {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}[state]


def tail_cost(state: int) -> int:
    return INSERT * len(tail(state))


# --- vectors and tables ------------------------------------------------------------------------


def advance(vector: Vector, table: Table) -> Vector:
    """A forward vector behind a row or piece."""
    costs, ranks = vector
    out, via = [], []
    for after in STATES:
        cost, rank, state = min((costs[s] + table[s][0][after], ranks[s], s) for s in STATES)
        out.append(min(cost, NEVER))
        # states out of reach come last, in their own order
        via.append((False, rank, table[state][1][after], after) if cost < NEVER else (True, 0, 0, after))
    order = sorted(via)
    return tuple(out), tuple(order.index(v) for v in via)


def retreat(costs: tuple[int, ...], table: Table) -> tuple[int, ...]:
    """A backward vector of costs before a row or piece."""
    return tuple(min(NEVER, *(table[s][0][after] + costs[after] for after in STATES)) for s in STATES)


@cache
def _advance_row(costs: tuple[int, ...], ranks: tuple[int, ...], kind: int) -> Vector:
    return advance((costs, ranks), row_table(kind))


@cache
def _retreat_row(costs: tuple[int, ...], kind: int) -> tuple[int, ...]:
    return retreat(costs, row_table(kind))


def _lowered(costs: tuple[int, ...]) -> tuple[int, tuple[int, ...]]:
    """Costs above their least, so that few different vectors occur and each is worked out once."""
    least = min(costs)
    return least, tuple(c - least if c < NEVER else NEVER for c in costs)


class Rows:
    """Rows of a piece by their kinds."""

    def __init__(self, kinds: bytes):
        self.kinds = kinds

    def __len__(self) -> int:
        return len(self.kinds)

    def forward(self, lo: int, hi: int, state: int) -> Vector:
        costs, ranks = _only(state), tuple(STATES)
        total = 0
        for kind in self.kinds[lo:hi]:
            costs, ranks = _advance_row(costs, ranks, kind)
            least, costs = _lowered(costs)
            total += least
        return tuple(min(NEVER, c + total) for c in costs), ranks

    def backward(self, lo: int, hi: int, state: int) -> tuple[int, ...]:
        costs = _only(state)
        total = 0
        for kind in reversed(self.kinds[lo:hi]):
            least, costs = _lowered(_retreat_row(costs, kind))
            total += least
        return tuple(min(NEVER, c + total) for c in costs)


class Pieces:
    """Neighbouring pieces by their tables."""

    def __init__(self, tables: list[Table]):
        self.tables = tables

    def __len__(self) -> int:
        return len(self.tables)

    def forward(self, lo: int, hi: int, state: int) -> Vector:
        vector = _only(state), tuple(STATES)
        for table in self.tables[lo:hi]:
            vector = advance(vector, table)
        return vector

    def backward(self, lo: int, hi: int, state: int) -> tuple[int, ...]:
        costs = _only(state)
        for table in reversed(self.tables[lo:hi]):
            costs = retreat(costs, table)
        return costs


def _only(state: int) -> tuple[int, ...]:
    return tuple(0 if s == state else NEVER for s in STATES)


def whole_table(parts: Rows | Pieces) -> Table:
    return tuple(parts.forward(0, len(parts), s) for s in STATES)


def crossings(parts: Rows | Pieces, first: int, last: int) -> list[int]:
    """States before, between and behind the parts on the best way from state ``first`` to ``last``."""
    states = [first] * (len(parts) + 1)
    states[-1] = last

    def solve(lo: int, hi: int) -> None:
        if hi - lo < 2:
            return
        middle = (lo + hi) // 2
        costs, ranks = parts.forward(lo, middle, states[lo])
        onward = parts.backward(middle, hi, states[hi])
        states[middle] = min(STATES, key=lambda s: (costs[s] + onward[s], ranks[s]))
        solve(lo, middle)
        solve(middle, hi)

    solve(0, len(parts))
    return states


def last_state(vector: Vector) -> tuple[int, int]:
    """Total cost and the state behind the last row on the best way through a whole conversation."""
    costs, ranks = vector
    cost, _, state = min((costs[s] + tail_cost(s), ranks[s], s) for s in STATES)
    return cost, state


def audit_of(kinds: bytes, first: int, last: int) -> list[str]:
    """Edits at each row of a piece, insertions before it included."""
    states = crossings(Rows(kinds), first, last)
    return [row_edits(kind)[a, b][1] for kind, a, b in zip(kinds, states, states[1:])]


# --- a piece's value: counts, first and last initial, table -----------------------------------------

COUNTS = ("blank", "duplicate", "truncated", "illegal")
LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}


def piece_value(kinds: bytes) -> bytes:
    initials = [k // 4 for k in kinds]
    faults = [k % 4 for k in kinds]
    illegal = sum(pair not in LEGAL for pair in zip(initials, initials[1:]))
    counts = [faults.count(EMPTY), faults.count(REPEATED), faults.count(CUT), illegal]
    return _packed(counts, initials[0], initials[-1], whole_table(Rows(kinds)))


def _packed(counts: list[int], first: int, last: int, table: Table) -> bytes:
    return array("q", [*counts, first, last, *(v for costs, ranks in table for v in (*costs, *ranks))]).tobytes()


def unpacked(value: bytes) -> tuple[list[int], int, int, Table]:
    numbers = array("q")
    numbers.frombytes(value)
    rows = [numbers[6 + 8 * s : 14 + 8 * s].tolist() for s in STATES]
    return numbers[:4].tolist(), numbers[4], numbers[5], tuple((tuple(r[:4]), tuple(r[4:])) for r in rows)


def combine(values: list[bytes], _first: int, _size: int) -> bytes:
    parts = [unpacked(v) for v in values]
    counts = [sum(p[0][i] for p in parts) for i in range(len(COUNTS))]
    counts[3] += sum((a[2], b[1]) not in LEGAL for a, b in zip(parts, parts[1:]))
    return _packed(counts, parts[0][1], parts[-1][2], whole_table(Pieces([p[3] for p in parts])))


def split(values: list[bytes], _first: int, _size: int, state: bytes) -> list[bytes]:
    states = crossings(Pieces([unpacked(v)[3] for v in values]), *state)
    return [bytes(pair) for pair in zip(states, states[1:])]


# --- on Spark ------------------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """The test damage: ``conv_id, turn, role, text`` after faults drawn by the hash of ``conv_id:turn``.

    Of 20 classes 0 drops a row, 1 empties its text, 2 removes its ``. ! ?``, 3 repeats it, 4 makes the user say it.
    A null is one blank, but in ``conv_id`` and ``turn`` only for the hash.
    """
    spaced = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    kind = F.crc32(F.concat(spaced["conv_id"], F.lit(":"), spaced["turn"]).cast("binary")) % 20
    text = F.when(F.col("_kind") == 1, F.lit("")).when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = conversations.select("conv_id", "turn", spaced["role"].alias("role"), spaced["text"].alias("text"), kind.alias("_kind"))
    rows = rows.filter("_kind <> 0").withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.when(F.col("_kind") == 3, 2).otherwise(1))))
    role = F.when(F.col("_kind") == 4, F.lit("user")).otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"))


def _placed(rows: DataFrame) -> DataFrame:
    """Rows in order with what their edits depend on: ``row_id, initial, fault`` (but for repetition), ``said``."""
    last = F.substring(F.rtrim("text", F.lit(BLANK)), -1, 1)
    fault = F.when(last == "", EMPTY).when(last.isin(".", "!", "?"), SOUND).otherwise(CUT)
    initial = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for s in (SYSTEM, USER, ASSISTANT) for v in (INITIALS[s], s)]), F.substring("role", 1, 1)), F.lit(0))
    said = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    made = {"initial": initial, "fault": fault, "said": said, "_salt": F.monotonically_increasing_id()}
    # rows of one turn go by role and beginning, then by digest; equal rows may trade places
    ties = [F.col("role"), F.substring("text", 1, 200), F.col("said"), F.col("_salt")]
    return in_order(rows.withColumns(made), [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), *ties], "turns").drop("_salt")


def _piece() -> Column:
    return F.shiftright("row_id", PIECE_BITS).alias("piece")


def _pieces(placed: DataFrame) -> DataFrame:
    """``conv_id, piece, kinds``: a byte a row. A repetition is any row but the first that says the same."""
    rows = placed.select("conv_id", "row_id", "initial", "fault", "said")
    known = rows.filter(F.col("fault") != EMPTY).groupBy("conv_id", "said").agg(F.min("row_id").alias("row_id")).select("row_id", F.lit(True).alias("first"))
    found = rows.select("conv_id", "row_id", "initial", "fault").join(known, "row_id", "left")
    fault = F.when((F.col("fault") != EMPTY) & F.col("first").isNull(), REPEATED).otherwise(F.col("fault"))
    kind = F.struct("row_id", (F.col("initial") * 4 + fault).cast("byte").alias("kind"))
    # at most 2**PIECE_BITS rows a piece
    return found.groupBy("conv_id", _piece()).agg(F.array_sort(F.collect_list(kind)).alias("rows")).select(
        "conv_id", "piece", F.col("rows.kind").alias("kinds")
    )


def _valued(pieces: DataFrame) -> DataFrame:
    schema = StructType([pieces.schema["conv_id"], *StructType.fromDDL("piece long, kinds binary, value binary").fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [bytes(k) for k in batch.column("kinds").to_pylist()]
            columns = [batch.column("conv_id"), batch.column("piece"), pa.array(kinds, pa.binary()), pa.array([piece_value(k) for k in kinds], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return pieces.mapInArrow(run, schema)


def _numbers(totals: DataFrame) -> DataFrame:
    """Counts, cost and the states at both ends of whole conversations."""
    made = ", ".join(f"{c} long" for c in (*COUNTS, "cost")) + ", state binary"
    schema = StructType([*totals.schema.fields, *StructType.fromDDL(made).fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [unpacked(v) for v in batch.column("value").to_pylist()]
            ends = [last_state(p[3][START]) for p in parts]
            columns = [pa.array([p[0][i] for p in parts], pa.int64()) for i in range(len(COUNTS))]
            columns += [pa.array([e[0] for e in ends], pa.int64()), pa.array([bytes([START, e[1]]) for e in ends], pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], schema=arrow)

    return totals.mapInArrow(run, schema)


class Editor:
    """The turns that one piece's edits give, row by row."""

    def __init__(self, info: dict):
        self.info = info
        self.edits = audit_of(info["kinds"], *info["state"])
        self.last = info["index"] == info["size"] - 1
        self.audit = "".join(self.edits) + (tail(info["state"][1]) if self.last else "")
        self.at, self.state = 0, info["state"][0]

    def _added(self, text: str) -> tuple[str, str]:
        self.state = _turn_after(self.state)
        return ROLES[self.state], text

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """Edit, role and text of the turns that come of the next row."""
        for edit in self.edits[self.at]:
            if edit == "K":
                self.state = INITIALS.index(role[0])
                yield edit, role, text
            elif edit != "D":
                yield edit, *self._added(text if edit == "R" else "")
        self.at += 1

    def close(self) -> Iterator[tuple[str, str, str]]:
        """Turns that complete a conversation, if the piece is its last."""
        for edit in tail(self.info["state"][1]) if self.last else "":
            yield edit, *self._added("")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Editor, bool, list[tuple[str, str, str]]]]:
    """Turns of every row, its piece's editor, and whether that ends; rows come sorted by piece, the piece's own first."""
    editor = None
    for whole in batches:
        for lo in range(0, whole.num_rows, 1024):
            for r in whole.slice(lo, 1024).to_pylist():
                if r["row_id"] >= 0:
                    yield editor, False, list(editor.row(r["role"], r["text"]))
                    continue
                if editor:
                    yield editor, True, list(editor.close())
                editor = Editor(r)
    if editor:
        yield editor, True, list(editor.close())


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 256, weight: int = 4 * CHUNK) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    heavy = 0
    for row in rows:
        held.append(row)
        heavy += sum(len(v) for v in row if isinstance(v, str))
        if len(held) >= size or heavy >= weight:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, heavy = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


class Repair:
    """Conversations ``rows (conv_id, turn, role, text)`` and their cheapest repair.

    Rows go by turn, a null first, then by role and beginning of the text; a null role or text counts as one blank.
    Rows of null ``conv_id`` are one conversation.
    """

    def __init__(self, rows: DataFrame):
        plain = rows.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
        self.placed = _placed(plain)
        values = _valued(_pieces(self.placed))
        nodes = numbered(in_order(values, [F.asc_nulls_first("conv_id"), F.asc("piece")], "turn-pieces"), "conv_id").drop("row_id")
        self.totals: DataFrame | None = None

        def finish(roots: DataFrame) -> DataFrame:
            self.totals = stage(_numbers(roots), "turn-totals")
            return self.totals.drop(*COUNTS, "cost")

        self.states = sweep(nodes, "conv_id", HEIGHT, combine, finish, split, "turn-tree")

    def _rows_by_piece(self) -> DataFrame:
        told = self.states.select("conv_id", "piece", F.lit(-1).cast("long").alias("row_id"), "kinds", "state", "index", "size")
        both = self.placed.select("conv_id", _piece(), "row_id", "role", "text").unionByName(told, allowMissingColumns=True)
        return both.repartition("conv_id", "piece").sortWithinPartitions("conv_id", "piece", "row_id")

    def counts(self) -> DataFrame:
        """``conv_id``, the numbers of faulty rows and of illegal neighbours, and the cost of the repair."""
        return self.totals.select("conv_id", *COUNTS, "cost")

    def gaps(self) -> DataFrame:
        """Turn numbers missing between the least and the greatest."""
        wide = [F.col(c).cast("decimal(38,0)") for c in ("most", "least", "n")]
        held = self.placed.select("conv_id", "turn").filter(F.col("turn").isNotNull()).distinct()
        ends = held.groupBy("conv_id").agg(F.max("turn").alias("most"), F.min("turn").alias("least"), F.count(F.lit(1)).alias("n"))
        return ends.select("conv_id", (wide[0] - wide[1] + 1 - wide[2]).cast("long").alias("gaps"))

    def turns(self) -> DataFrame:
        """The repaired conversations: ``conv_id, piece, place, edit, role, text``, in order of piece and place."""
        by = self._rows_by_piece()
        schema = StructType([by.schema["conv_id"], *StructType.fromDDL("piece long, place long, edit string, role string, text string").fields])
        arrow = to_arrow_schema(schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows() -> Iterator[tuple]:
                place = 0
                for editor, ends, turns in _edited(batches):
                    for turn in turns:
                        yield editor.info["conv_id"], editor.info["piece"], place, *turn
                        place += 1
                    place = 0 if ends else place

            return _batches(rows(), arrow)

        return by.mapInArrow(run, schema)

    def digests(self) -> DataFrame:
        """``conv_id, audit, repaired_sha256``: all edits, and the digest of the repaired ``role:text`` lines.

        A digest is one sequence of bytes by its nature: of a conversation of several pieces one task reads the
        repaired text, in chunks and holding one at a time. Other conversations are done where their piece is.
        """
        by = self._rows_by_piece()
        names = "piece long, part long, pieces long, audit string, text string, repaired_sha256 string"
        schema = StructType([by.schema["conv_id"], *StructType.fromDDL(names).fields])
        arrow = to_arrow_schema(schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows() -> Iterator[tuple]:
                held: list[str] = []
                size, part, begun, digest = 0, 0, False, hashlib.sha256()
                for editor, ends, turns in _edited(batches):
                    info = editor.info
                    alone = info["size"] == 1
                    for _, role, text in turns:
                        line = "\n" * begun + f"{role}:{text}"
                        begun = True
                        if alone:
                            digest.update(line.encode())
                        else:
                            held.append(line)
                            size += len(line)
                    if ends:
                        yield info["conv_id"], info["piece"], part, info["size"], editor.audit, "".join(held), digest.hexdigest() if alone else None
                        held, size, part, begun, digest = [], 0, 0, False, hashlib.sha256()
                    elif size >= CHUNK:
                        yield info["conv_id"], info["piece"], part, info["size"], "", "".join(held), None
                        held, size, part = [], 0, part + 1

            return _batches(rows(), arrow)

        written = stage(by.mapInArrow(run, schema), "turn-texts")
        alone = written.filter("pieces = 1").select("conv_id", "audit", "repaired_sha256")
        return alone.unionByName(_long_digests(written.filter("pieces > 1")))


def _long_digests(written: DataFrame) -> DataFrame:
    """Digests of conversations of several pieces, each streamed through one task."""
    schema = StructType([written.schema["conv_id"], *StructType.fromDDL("audit string, repaired_sha256 string").fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            conv, digest, audit, begun = None, None, [], False
            for whole in batches:
                for lo in range(0, whole.num_rows, 16):
                    for r in whole.slice(lo, 16).to_pylist():
                        if digest is None or r["conv_id"] != conv:
                            if digest:
                                yield conv, "".join(audit), digest.hexdigest()
                            conv, digest, audit, begun = r["conv_id"], hashlib.sha256(), [], False
                        if r["text"]:
                            if begun and not r["part"]:
                                digest.update(b"\n")
                            digest.update(r["text"].encode())
                            begun = True
                        audit.append(r["audit"])
            if digest:
                yield conv, "".join(audit), digest.hexdigest()

        return _batches(rows(), arrow)

    ordered = written.repartition("conv_id").sortWithinPartitions("conv_id", "piece", "part")
    return ordered.mapInArrow(run, schema)


def report(repair: Repair, conversations: DataFrame) -> DataFrame:
    """One row per ``conv_id`` of ``conversations``: gaps, counts, cost, audit and digest of its repair.

    A conversation without rows in the repair has zeros, an empty audit and the digest of nothing.
    """
    out = conversations.select("conv_id").distinct()
    for part in (repair.gaps(), repair.counts(), repair.digests()):
        out = out.join(part.withColumnRenamed("conv_id", "_own"), F.col("conv_id").eqNullSafe(F.col("_own")), "left").drop("_own")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", *COUNTS, "cost")]
    nothing = F.lit(hashlib.sha256().hexdigest())
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))
