"""Small documents of many kinds."""

import random

import pytest

ROWS = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG"


def texts(seed: int = 3, n: int = 60) -> list[str | None]:
    """Random texts with copies, near copies, shared passages, repeated lines, blanks, nulls and one very long text."""
    rng = random.Random(seed)
    words = ["the", "of", "und", "été", "ñandú", "alpha", "beta", "gamma", "delta", "x", "A", "B1", "co-op", "fin."] + [f"w{i}" for i in range(300)]
    make = lambda k: [rng.choice(words) for _ in range(k)]
    passage = make(30)
    out: list[str | None] = [None, "", "  \n\t ", "one", "one", "two words", "Two WORDS"]
    while len(out) < n:
        kind = rng.randrange(6)
        base = make(rng.randrange(5, 120))
        if kind == 1 and out[-1]:
            out.append(out[-1])
        elif kind == 2:
            out.append(" ".join(base[:20] + passage + base[20:]))
        elif kind == 3:
            out.append(" ".join(base))
            for _ in range(3):
                near = list(base)
                near[rng.randrange(len(near))] = rng.choice(words)
                out.append(" ".join(near))
        elif kind == 4:
            line = " ".join(make(8))
            out.append("\n".join([line, " ".join(base), line, "", line]))
        else:
            out.append(" ".join(base).replace(" w1", "\tw1").replace(" the", "\n the"))
    out.append(" ".join(make(9000)))
    return out


@pytest.fixture(scope="session")
def documents(spark):
    rng = random.Random(5)
    rows = [(i * 3, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", None]), len(t or "")) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, ROWS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], ROWS)
