import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    r = random.Random(seed)
    words = [f"{r.choice('abcdefghk')}{r.choice('aeiou')}{i}" for i in range(vocabulary)]
    out = []
    for i in range(n):
        out.append(r.choice(words) + (".\n" if i % 17 == 16 else ""))
    return " ".join(out)


def thue_morse(n: int, two: str) -> str:
    """The first n letters of the Thue-Morse sequence over two letters."""
    return "".join(two[i.bit_count() % 2] for i in range(n))


def table(spark, rows):
    """documents from (doc_id, text) or (doc_id, text, source) rows."""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else f"s{(r[0] or 0) % 5}", len(r[1] or "")) for r in rows], DOCS)


@pytest.fixture(scope="session")
def corpus():
    """Texts with copies, near copies, shared passages, a hot word, a very long text, and empty and null ones."""
    rows = [(i, prose(i, 40 + 13 * i % 150)) for i in range(1, 40)]
    passage = prose(99, 70)
    rows += [(i, prose(i, 30) + " " + passage + " " + prose(i + 1000, 25)) for i in range(40, 52)]
    rows += [(i, rows[3][1]) for i in range(52, 58)]
    for i in range(58, 66):
        w = rows[10][1].split(" ")
        w[i % len(w)] = f"changed{i}"
        rows.append((i, " ".join(w)))
    rows += [(66, "the " * 300), (67, "the " * 120), (68, ""), (69, None), (70, "one"), (71, "one"), (72, "  \n\t "), (73, prose(5, 30000, 3000)), (74, "Ünïcödé ñandú 漢字 " * 60)]
    return rows
