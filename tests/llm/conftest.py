from __future__ import annotations

import random

import pytest

WORDS = "the of and to in is that it was for on are with as his they at be this from have or by one had not but what all were".split()


def sentence(r: random.Random, n: int) -> list[str]:
    return [r.choice(WORDS) if r.random() < 0.4 else "".join(r.choice("aeiou") + r.choice("bcdfgklmnprst") for _ in range(r.randint(1, 4))) for _ in range(n)]


@pytest.fixture(scope="session")
def texts() -> list[tuple[int, str | None]]:
    """Ids and texts with copies, near copies, shared passages, empty, null, odd and very long ones."""
    r = random.Random(13)
    out: list[str | None] = [None, "", " \n\t ", "one", "One", "two  words", " ", "é ﬁ 世界 😀\r\nx", "a" * 300, "ab" * 400]
    passage = " ".join(sentence(r, 60))
    for _ in range(40):
        words = sentence(r, r.randint(5, 160))
        out.append(" ".join(words).capitalize() + ".")
        if r.random() < 0.4:
            out.append(out[-1])
        if r.random() < 0.5:
            near = list(words)
            for _ in range(max(1, len(near) // r.choice((12, 25, 40)))):
                near[r.randrange(len(near))] = r.choice(WORDS)
            out.append(" ".join(near).capitalize() + ".")
        if r.random() < 0.3:
            out.append(" ".join(words[:20]) + "\n" + passage + "\n" + " ".join(words[20:]))
    out.append(" ".join(sentence(r, 20_000)))
    r.shuffle(out)
    rows = [(7 * i, t) for i, t in enumerate(out)]
    return rows + [rows[5], rows[9]]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts with extra columns whose names clash with the operators' own."""
    rows = [(i, t, "x", None, [1], "en" if i % 2 else "de", "s", 0) for i, t in texts]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string, key long, keys array<int>, lang string, source string, n_chars long")
    return df.repartition(5)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.filter("false")
