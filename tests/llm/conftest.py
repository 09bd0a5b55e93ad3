import random

import pytest

WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "ru", "te", "vu", "za", "dé", "ño") for b in ("ban", "cor", "dil", "fen", "gus", "hop", "jar")]


def prose(rng: random.Random, n: int) -> str:
    out, left = [], 0
    for k in range(n):
        word = rng.choice(WORDS) + rng.choice(("", "", "s", "ed"))
        if left == 0:
            left, word = rng.randint(2, 9), word.capitalize()
        left -= 1
        out.append(word + (rng.choice((".", ".", "!", ".\n")) if left == 0 else ""))
    return " ".join(out).replace("\n ", "\n")


@pytest.fixture(scope="session")
def rng():
    return random.Random(7)


def messy(rng: random.Random) -> list[tuple]:
    """(doc_id, text): copies, near copies, shared passages, empty, null, tiny and very long texts, repeated rows."""
    base = [prose(rng, n) for n in (60, 90, 120, 200, 350, 40)]
    passage = prose(rng, 90)
    rows = [(k, t) for k, t in enumerate(base)]
    for k in range(12):  # near copies of one text
        words = base[3].split(" ")
        for _ in range(k):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        rows.append((100 + k, " ".join(words)))
    rows += [(200 + k, base[1]) for k in range(8)]
    rows += [(300 + k, prose(rng, 30) + "\n" + passage + "\n" + prose(rng, 30)) for k in range(7)]
    rows += [(400, ""), (401, None), (402, "One."), (403, " \n\t\n "), (404, "a b c"), (405, "a b c"), (406, "x y z w"), (407, "ÉÀ ß\u2003ｗide \U0001f600 text, yes.")]
    rows += [(500, " ".join([base[2], passage] * 6)), (501, "lo " * 900), (502, "ban " * 900)]
    rows += [rows[0], rows[9], (None, base[0]), (None, None)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return messy(random.Random(3))


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The messy rows with columns whose names operators use for their own."""
    extra = "lang string, source string, n_chars long, n_lines int, matches string, digest string, component_id int, key string, text_hash int, own_id long, OWN_HASH string, `drop` int, own_ranges int, gone_id int, matches_ int"
    data = [(i, t, "en", None, None if t is None else len(t), 1, "m", "d", 3, None, 5, 6, "h", 7, 8, 9, 10) for i, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, " + extra)


@pytest.fixture(scope="session")
def none(spark, docs):
    return spark.createDataFrame([], docs.schema)
