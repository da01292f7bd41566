"""Conversation repair against every sequence of edits, one letter at a time."""

import hashlib
import random
import zlib

import pytest

from structlens.llm import turns

COLUMNS = "conv_id LONG, turn LONG, role STRING, text STRING"
BLANK = " \t\n\x0b\f\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        elif kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        elif kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        kept = text.strip(BLANK)
        out.append("blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, fault):
    """(cost, audit, turns) over single edits, from the last row back; two inserts in a row lead to the same state."""
    follows, name, price = {"": "su", "s": "u", "u": "a", "a": "u"}, {"u": "user", "a": "assistant"}, {"K": 0, "R": 3, "D": 4, "I": 3}
    best = {(len(rows), state, 2): (0, "", ()) for state in ("", "a")}
    for i in range(len(rows), -1, -1):
        for inserts in (2, 1, 0):
            for state in follows:
                ways = [("I", r, i) for r in follows[state] if r != "s"] if inserts < 2 else []
                if i < len(rows):
                    ways.append(("D", state, i + 1))
                    if fault[i] not in ("blank", "duplicate"):
                        first = rows[i][2][:1]
                        ways += [("K", first, i + 1)] if first and first in follows[state] else []
                        ways += [("R", r, i + 1) for r in follows[state] if r != "s"]
                found = [best[i, state, 2]] if i == len(rows) and (i, state, 2) in best else []
                for letter, to, at in ways:
                    rest = best.get((at, to, inserts + 1 if letter == "I" else 0))
                    if rest is not None:
                        cost = price[letter] + (3 if letter in "KR" and fault[i] == "truncated" else 0)
                        turn = () if letter == "D" else ((rows[i][2], rows[i][3]),) if letter == "K" else ((name[to], rows[i][3] if letter == "R" else ""),)
                        found.append((cost + rest[0], letter + rest[1], turn + rest[2]))
                if found:
                    best[i, state, inserts] = min(found, key=lambda x: x[:2])
    return best[0, "", 0]


def expected(rows):
    out = {conv: (conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) for conv, *_ in rows}
    after = damaged(rows)
    for conv in {r[0] for r in after}:
        mine = sorted((r for r in after if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        fault = faults(mine)
        known = [r[1] for r in mine if r[1] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:], strict=False))
        cost, audit, kept = cheapest(mine, fault)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out[conv] = (conv, gaps, *[fault.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, digest)
    return out


def conversations(seed, n):
    rng = random.Random(seed)
    texts = ["a.", "b!", "c", "", " ", None, "d?", "e. ", "long " * 30 + ".", "ünï.", "f"]
    rows = []
    for conv in [None, *range(n)]:
        turn = rng.choice([0, -3])
        for _ in range(rng.randrange(1, 12)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            rows.append((conv, rng.choice([turn, turn, turn, None]), role, rng.choice(texts) if rng.random() < 0.5 else f"x{rng.random()}."))
            turn += rng.choice([1, 1, 1, 0, 2])
        if rng.random() < 0.2:
            rows.append(rows[-1])
    return rows


def result(spark, rows, **more):
    df = spark.createDataFrame(rows, COLUMNS)
    for name in more.get("clash", ()):
        df = df.withColumn(name, df["turn"])
    out = turns.audit(df, turns.damage(df)).collect()
    assert len(out) == len({r[0] for r in rows})
    return {r[0]: tuple(r) for r in out}


@pytest.mark.parametrize("chunk", [4096, 2])
def test_repairs_are_the_cheapest_and_least(spark, monkeypatch, chunk):
    monkeypatch.setattr(turns, "CHUNK_ROWS", chunk)
    rows = conversations(chunk, 150)
    assert result(spark, rows, clash=("chunk", "first", "copies_", "audit", "state", "c", "d")) == expected(rows)


def test_one_conversation_over_many_tasks(spark, monkeypatch):
    """Most rows are of one conversation, many of them equal; chunks of few rows, dealt over many tasks."""
    monkeypatch.setattr(turns, "CHUNK_ROWS", 7)
    rng = random.Random(4)
    rows = [(1, i // 2, rng.choice(["user", "assistant", "system"]), rng.choice(["same.", f"t{i}.", f"u{i}", ""])) for i in range(160)]
    rows += [(1, 30, "user", "again.")] * 40 + [(2, 0, "user", "x.")]
    assert result(spark, rows) == expected(rows)
    df = spark.createDataFrame(rows, COLUMNS)
    repaired = turns.Repair(turns.damage(df)).turns().where("conv_id = 1").orderBy("chunk", "position").collect()
    joined = "\n".join(f"{r['role']}:{r['text']}" for r in repaired)
    assert hashlib.sha256(joined.encode()).hexdigest() == expected(rows)[1][-1]


def test_empty_and_dropped_conversations(spark):
    assert result(spark, []) == {}
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert result(spark, [(gone, 0, "user", "x")])[gone] == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    rows = [(None, None, None, None), (5, None, "user", "very " * 200_000 + "long.")]
    assert result(spark, rows) == expected(rows)
