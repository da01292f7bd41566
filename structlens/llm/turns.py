"""Repair of the turn structure of conversations by dynamic programming over the turns that stay.

A conversation's turns, in order, become turns whose role initials read (s?(ua)+)?. Turns are kept (free), given the role
user or assistant (3) or deleted (4; blank and repeated ones must be), and empty turns of either role are inserted (3); a
truncated turn that stays costs 3 more. Of the cheapest edits the audit - K, R, D and I in order - is the least in ASCII.

Only turns that stay are states: what lies between two of them is deleted, at the price of a difference of prefix sums, and
the pair of their roles says whether a turn is inserted. So each turn needs, for each role, one running minimum over what
comes later, and ties go to the later turn (more D first), then to an insert, then to keeping. A conversation of any
length is cut into chunks of bounded size; each is priced for every state before and after it, a scan over these few numbers
chooses the states (one row a chunk, whatever its texts), and the chunks are then edited one by one. No window and no
list ever spans a conversation; only its own audit and digest, one value each, grow with it.

Rows (conv_id, turn, role, text); other columns are ignored. Order: turn, nulls first, then role and text by code point.
A null role or text is one space, a null conv_id a conversation of its own. Equal rows stay together and count as often
as they occur, the later ones as duplicates. A turn with an empty role has no initial and fits nowhere: it is given a role
or deleted. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ._common import BLANKS, Stored

#: Of a chunk: most distinct rows and, above one row, bytes of text.
CHUNK_ROWS, CHUNK_BYTES = 4096, 1 << 20
#: Rows of a batch that a task returns, of less than CHUNK_BYTES and a chunk.
BATCH_ROWS = 1024
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States: nothing yet, then the role of the last turn.
BEGIN, S, U, A = range(4)
ROLE = {U: "user", A: "assistant"}
#: Inserts that end a conversation, by state.
CLOSING = {BEGIN: 0, S: 2, U: 1, A: 0}
#: Inserts between a state and the next turn's role; a pair that is missing can't be.
BETWEEN = {(BEGIN, S): 0, (BEGIN, U): 0, (S, U): 0, (U, A): 0, (A, U): 0, (BEGIN, A): 1, (S, A): 1, (U, U): 1, (A, A): 1}

LEGAL = ("su", "ua", "au")
NEVER = 1 << 62


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) of damaged conversations. crc32 of conv_id:turn modulo 20: 0 drops the row, 1
    empties its text, 2 takes its . ! ? away, 3 repeats it, 4 makes it the user's; nulls count as one space."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat(one("conv_id"), F.lit(":"), one("turn")), "utf-8")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(one("text"), "[.!?]", "")).otherwise(one("text"))
    role, copies = F.when(kind == 4, "user").otherwise(one("role")), F.when(kind == 3, 2).otherwise(1)
    return conversations.where(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.cast("long").alias("copies"))


class Repair:
    """The repair of conversations (conv_id, turn, role, text and perhaps copies): decided once, read in several ways."""

    def __init__(self, conversations: DataFrame):
        one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
        copies = F.col("copies") if "copies" in conversations.columns else F.lit(1).cast("long").alias("copies")
        rows = conversations.select("conv_id", "turn", one("role"), one("text"), copies)
        kind = rows.schema["conv_id"].dataType
        self.chunks = Stored(_chunks(_first_marked(rows), kind), "chunks")
        self.plan = Stored(_planned(self.chunks.df.drop("flags", "copies", "roles", "texts"), kind), "plan")
        self.schema = T.StructType([T.StructField("conv_id", kind)])

    def _edited(self) -> DataFrame:
        at = self.plan.df.withColumnRenamed("conv_id", "conv").withColumnRenamed("chunk", "at")
        chunks = self.chunks.df.select("conv_id", "chunk", "flags", "copies", "roles", "texts")
        return chunks.join(at, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("chunk") == F.col("at"))).drop("conv", "at")

    def turns(self) -> DataFrame:
        """(conv_id, chunk, position, edit, role, text): the repaired turns, edit K, R or I, ordered by chunk and position."""
        schema = T.StructType([*self.schema, *T._parse_datatype_string("chunk long, position long, edit string, role string, text string")])

        def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
            for row in _rows(batches):
                out = _edit(row)[1] + _closing(row)
                yield sum(len(x[2]) for x in out), [(row["conv_id"], row["chunk"], i, *x) for i, x in enumerate(out)]

        return self._edited().mapInArrow(lambda batches: _batches(edited(batches), schema), schema)

    def summary(self) -> DataFrame:
        """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation with rows."""
        kind = T._parse_datatype_string("chunk long, audit string, turns binary, last boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long")
        pieces = T.StructType([*self.schema, *kind])
        names = ("last", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")

        def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
            for row in _rows(batches):
                audit, turns = _edit(row)
                end = _closing(row)
                lines = [f"{role}:{text}" for _, role, text in turns + end]
                text = "\n".join(lines).encode() if lines else None
                yield len(text or b""), [(row["conv_id"], row["chunk"], audit + "I" * len(end), text, *[row[n] for n in names])]

        schema = T.StructType([*self.schema, *T._parse_datatype_string("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")])

        def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
            audit, digest, empty = [], hashlib.sha256(), True
            for row in _rows(batches):
                audit.append(row["audit"])
                if row["turns"] is not None:
                    digest.update((b"" if empty else b"\n") + row["turns"])
                    empty = False
                if row["last"]:
                    audit = "".join(audit)
                    yield len(audit), [(row["conv_id"], *[row[n] for n in names[1:]], audit, digest.hexdigest())]
                    audit, digest, empty = [], hashlib.sha256(), True

        sent = self._edited().mapInArrow(lambda batches: _batches(edited(batches), pieces), pieces)
        sent = sent.repartition("conv_id").sortWithinPartitions("conv_id", "chunk")
        return sent.mapInArrow(lambda batches: _batches(joined(batches), schema), schema)


def audit(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """The summary of rows' repair for every conv_id of conversations; zeros, no audit and the digest of nothing for those
    that rows doesn't have."""
    every = conversations.select(F.col("conv_id").alias("conv")).distinct()
    found = every.join(Repair(rows).summary(), F.col("conv").eqNullSafe(F.col("conv_id")), "left")
    none = hashlib.sha256().hexdigest()
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select(F.col("conv").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(none)).alias("repaired_sha256"))


def _first_marked(rows: DataFrame) -> DataFrame:
    """Distinct rows with their copies; first says whether no earlier turn has the same role and text.

    Equal rows, and equal texts of a conversation, are aggregated before they are sent, so neither gathers in a task.
    """
    same = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    digest = F.sha2("text", 256)
    order = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"))
    first = same.groupBy("conv_id", "role", digest.alias("digest")).agg(F.min(order).alias("at"))
    first = first.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), "digest", F.col("at.turn").alias("t"), F.lit(True).alias("first"))
    met = F.col("conv_id").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t")) & (F.col("role") == F.col("r")) & (F.col("d") == F.col("digest"))
    out = same.withColumn("d", digest).join(first, met, "left")
    return out.select("conv_id", "turn", "role", "text", "copies", F.coalesce("first", F.lit(False)).alias("first"))


def _chunks(rows: DataFrame, kind: T.DataType) -> DataFrame:
    """A row for each chunk: what its rows are, and what it costs between any two states."""
    known = F.length(F.regexp_replace("text", BLANKS, "")) > 0
    ends = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1).isin(".", "!", "?")
    code = F.when(~known, 1).when(~F.col("first"), 2).when(~ends, 3).otherwise(0)
    # Beginnings keep the bounds small and never contradict the order of whole texts.
    near = [F.col("conv_id"), F.col("turn"), F.substring("role", 1, 64), F.when(F.length("role") <= 64, F.substring("text", 1, 64))]
    dealt = rows.withColumn("fault", code).repartitionByRange(*near).sortWithinPartitions("conv_id", "turn", "role", "text")
    dealt = dealt.select("conv_id", "turn", "role", F.when(F.col("fault").isin(0, 3), F.col("text")).alias("text"), "copies", "fault")
    fields = "chunk long, flags binary, copies array<long>, roles array<string>, texts array<string>, low long, high long, n_turns long, first_turn long, last_turn long, "
    fields += "first_initial string, last_initial string, blank long, duplicate long, truncated long, illegal long, costs array<long>, ranks binary"
    schema = T.StructType([T.StructField("conv_id", kind), *T._parse_datatype_string(fields)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for row in _rows(batches):
            if held and (row["conv_id"] != held[0]["conv_id"] or len(held) >= CHUNK_ROWS or size >= CHUNK_BYTES):
                yield size, [_chunk(held, number)]
                number, held, size = number + 1, [], 0
            held.append(row)
            size += len(row["text"] or "")
        if held:
            yield size, [_chunk(held, number)]

    return dealt.mapInArrow(lambda batches: _batches(cut(batches), schema), schema)


def _chunk(rows: list[dict], number: int) -> tuple:
    copies, initials = [r["copies"] for r in rows], [r["role"][:1] for r in rows]
    faults = [r["fault"] for r in rows]
    flags = bytes(_flag(i, f) for i, f in zip(initials, faults, strict=True))
    turns = [r["turn"] for r in rows]
    known = [t for t in turns if t is not None]
    pairs = sum(n - 1 for n in copies) + sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
    blank = sum(n for n, f in zip(copies, faults, strict=True) if f == 1)
    repeated = sum(n if f == 2 else n - 1 for n, f in zip(copies, faults, strict=True) if f != 1)
    costs, ranks = _prices(flags, copies)
    return (
        rows[0]["conv_id"], number, flags, copies, [r["role"] for r in rows], [r["text"] for r in rows], known[0] if known else None, known[-1] if known else None,
        len(set(known)), turns[0], turns[-1], initials[0], initials[-1], blank, repeated, faults.count(3), pairs, costs, ranks,
    )


def _flag(initial: str, fault: int) -> int:
    """The role's state (0 if it has none), 4 for what must go, 8 for what is truncated."""
    return {"s": S, "u": U, "a": A}.get(initial, 0) | (4 if fault in (1, 2) else 8 if fault == 3 else 0)


def _backward(flags: bytes, copies: list[int], goal: int):
    """(for each state before the chunk the least cost to have `goal` after it, and the next retained (row, role, edit); the
    same after each retained row and role)."""
    total = DELETE * sum(copies)
    #: By role: the least of (deletions before a row, its use, and all after it), and where it is; the later row wins ties.
    least = {S: (NEVER, -1, 0), U: (NEVER, -1, 0), A: (NEVER, -1, 0)}

    def best(state: int, done: int):
        # (cost, the later row first, an insert first, keeping before a new role): the order of the audits' letters.
        found = (total - done, -len(flags), 0, 0, None) if state == goal else (NEVER, 0, 0, 0, None)
        for role, (cost, at, edit) in least.items():
            n = BETWEEN.get((state, role))
            if n is not None and cost < NEVER:
                found = min(found, (cost - done + INSERT * n, -at, -n, edit, role))
        return found

    after: dict[tuple[int, int], tuple] = {}
    before = total
    for j in range(len(flags) - 1, -1, -1):
        done = before
        before -= DELETE * copies[j]
        flag = flags[j]
        if flag & 4:
            continue
        own, more = flag & 3, DELETE * (copies[j] - 1) + (TRUNCATED if flag & 8 else 0)
        new = []
        for role in (S, U, A):
            if role != own and role == S:
                continue
            rest = after[j, role] = best(role, done)
            if rest[0] < NEVER:
                new.append((role, before + more + (0 if role == own else REROLE) + rest[0], 0 if role == own else 1))
        for role, cost, edit in new:
            if cost < least[role][0]:
                least[role] = (cost, j, edit)
    return [best(state, 0) for state in range(4)], after


def _path(start: tuple, after: dict, n: int) -> bytes:
    """Of each row the number of its edit."""
    out, step = bytearray(n), start
    while step[4] is not None:
        at, role = -step[1], step[4]
        out[at] = 1 + step[3] if step[2] else 3 + step[3]
        step = after[at, role]
    return bytes(out)


def _prices(flags: bytes, copies: list[int]) -> tuple[list[int], bytes]:
    """Costs from each state to each, and of each first state the order of the audits that lead to the others."""
    found = [_backward(flags, copies, goal) for goal in range(4)]
    costs, ranks = [], bytearray()
    for state in range(4):
        starts = [found[goal][0][state] for goal in range(4)]
        costs += [s[0] for s in starts]
        paths = {goal: _path(s, found[goal][1], len(flags)) for goal, s in enumerate(starts) if s[0] < NEVER}
        order = sorted(paths, key=paths.get)
        ranks += bytes(order.index(goal) if goal in paths else 9 for goal in range(4))
    return costs, bytes(ranks)


def _planned(prices: DataFrame, kind: T.DataType) -> DataFrame:
    """For each chunk the states before and after it; the last one of a conversation also has its counts and cost."""
    fields = "chunk long, state long, goal long, last boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
    schema = T.StructType([T.StructField("conv_id", kind), *T._parse_datatype_string(fields)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
        held = None
        for row in _rows(batches):
            if held is None or row["conv_id"] != held.conv:
                if held is not None:
                    yield 0, held.rows()
                held = _Scan(row["conv_id"])
            held.add(row)
        if held is not None:
            yield 0, held.rows()

    return prices.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(lambda batches: _batches(scan(batches), schema), schema)


class _Scan:
    """The cheapest way through the chunks of one conversation: a number and four states of each are kept."""

    def __init__(self, conv):
        self.conv, self.numbers, self.steps = conv, [], bytearray()
        self.costs, self.ranks = [0, NEVER, NEVER, NEVER], [0, 9, 9, 9]
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.low = self.high = self.turn = self.initial = None
        self.n_turns = 0

    def add(self, row: dict) -> None:
        for name in self.counts:
            self.counts[name] += row[name]
        if self.initial is not None and self.initial + row["first_initial"] not in LEGAL:
            self.counts["illegal"] += 1
        self.n_turns += row["n_turns"] - (self.turn is not None and self.turn == row["first_turn"])
        self.low = row["low"] if self.low is None else self.low
        self.high = row["high"] if row["high"] is not None else self.high
        self.initial, self.turn = row["last_initial"], row["last_turn"]
        best = []
        for goal in range(4):
            ways = [(self.costs[s] + row["costs"][4 * s + goal], self.ranks[s], row["ranks"][4 * s + goal], s) for s in range(4)]
            best.append(min((w for w in ways if w[0] < NEVER), default=(NEVER, 9, 9, 0)))
        order = sorted(range(4), key=lambda goal: best[goal][1:3])
        self.costs, self.ranks = [b[0] for b in best], [order.index(goal) for goal in range(4)]
        self.numbers.append(row["chunk"])
        self.steps.append(sum(b[3] << 2 * goal for goal, b in enumerate(best)))

    def rows(self) -> list[tuple]:
        cost, _, goal = min((c + INSERT * CLOSING[g], self.ranks[g], g) for g, c in enumerate(self.costs) if c < NEVER)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.n_turns
        out, last = [], (gaps, *self.counts.values(), cost)
        for number, step in zip(reversed(self.numbers), reversed(self.steps), strict=True):
            state = step >> 2 * goal & 3
            out.append((self.conv, number, state, goal, not out, *last))
            goal = state
        return out


def _edit(row: dict) -> tuple[str, list[tuple[str, str, str]]]:
    """(audit, [(edit, role, text)]) of a chunk between its two states."""
    flags, copies = row["flags"], row["copies"]
    starts, after = _backward(flags, copies, row["goal"])
    step, letters, turns = starts[row["state"]], [], []
    chosen = {}
    while step[4] is not None:
        chosen[-step[1]] = step
        step = after[-step[1], step[4]]
    for j, n in enumerate(copies):
        if j not in chosen:
            letters.append("D" * n)
            continue
        _, _, inserted, edit, role = chosen[j]
        if inserted:
            letters.append("I")
            turns.append(("I", ROLE[U + A - role], ""))
        letters.append("KR"[edit] + "D" * (n - 1))
        turns.append(("KR"[edit], ROLE[role] if edit else row["roles"][j], row["texts"][j]))
    return "".join(letters), turns


def _closing(row: dict) -> list[tuple[str, str, str]]:
    return [("I", ROLE[r], "") for r in (U, A)[2 - CLOSING[row["goal"]] :]] if row["last"] else []


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _batches(rows: Iterator[tuple[int, list[tuple]]], schema: T.StructType) -> Iterator[pa.RecordBatch]:
    """Batches of rows that come in lists with their bytes."""
    arrow, held, size = to_arrow_schema(schema), [], 0
    for n, some in rows:
        held += some
        size += n
        if len(held) >= BATCH_ROWS or size >= CHUNK_BYTES:
            yield _batch(held, arrow)
            held, size = [], 0
    if held:
        yield _batch(held, arrow)


def _batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)
