import random

from tripmart.llm import decontaminate
from tests.llm.conftest import prose


def test_exact_edited_upper_cased_and_clean(spark):
    rng = random.Random(5)
    items = [(k, prose(rng, 30)) for k in range(6)] + [(90, None), (91, ""), (92, "two words"), (None, "x y z w v")]
    edited = items[1][1].split()
    for k in (4, 11, 17, 23, 28):
        edited[k] = "changed"
    cut = items[2][1].split()
    del cut[12:14]
    rows = [
        (0, prose(rng, 20) + " " + items[0][1] + " " + prose(rng, 20)), (1, prose(rng, 20) + " " + " ".join(edited) + " " + prose(rng, 300)), (2, " ".join(cut)),
        (3, items[3][1].upper().replace(".", "!!")), (4, prose(rng, 400)), (5, None), (6, ""), (7, " ".join(items[4][1].split()[:5])), (8, items[4][1] + "\n" + items[5][1]), (8, items[4][1] + "\n" + items[5][1]),
    ]
    t = spark.createDataFrame([(*r, "m") for r in rows], "doc_id long, text string, matches string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for part_words in (decontaminate.PART_WORDS, 40):  # one part, or several passes
        found = [(r.doc_id, {m["item"] for m in r.matches}) for r in decontaminate.mark(t, bench, part_words=part_words).collect()]
        assert sorted((d, sorted(s)) for d, s in found) == [(0, [0]), (1, [1]), (2, [2]), (3, [3]), (4, []), (5, []), (6, []), (7, []), (8, [4, 5]), (8, [4, 5])]
    left = decontaminate.clean(t, bench)
    assert left.columns == t.columns and sorted((r.doc_id, r.matches) for r in left.collect()) == [(k, "m") for k in (4, 5, 6, 7)]
    assert decontaminate.clean(t, bench.limit(0)).count() == len(rows)
    assert decontaminate.mark(t.limit(0), bench).count() == 0


def test_alignment_against_plain_dynamic_programme():
    import numpy as np

    rng = np.random.default_rng(2)
    items = [rng.integers(2, 9, rng.integers(4, 12)).astype(np.uint64) for _ in range(40)]
    windows = [rng.integers(2, 9, rng.integers(4, 30)).astype(np.uint64) for _ in range(40)]

    def plain(a, b):
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        return h.max() / (2 * len(a))

    assert np.allclose(decontaminate.align(items, windows), [plain(a, b) for a, b in zip(items, windows, strict=True)])


def plain_words(text):
    return "".join(c if c.isalnum() or ord(c) > 126 else " " for c in (text or "").lower()).split()


def plain_score(item, text):
    """Best local alignment of an item with a whole text, word by word, as a share of the item's full score."""
    best, before = 0, [0] * (len(text) + 1)
    for a in item:
        now = [0]
        for j, b in enumerate(text):
            now.append(max(0, before[j] + (2 if a == b else -1), before[j + 1] - 1, now[j] - 1))
        best, before = max(best, *now), now
    return best / (2 * len(item))


def test_marks_against_every_alignment(spark):
    rng = random.Random(21)
    some = lambda n: [f"v{rng.randrange(900)}" for _ in range(n)]
    items = [(k, " ".join(some(rng.randint(4, 24)))) for k in range(12)] + [(12, "v1 v2"), (7, "repeated id " + " ".join(some(8)))]
    rows = []
    for k in range(30):
        words = some(rng.randint(0, 40))
        for i, text in rng.sample(items, rng.randint(0, 3)):
            words += [w for w in text.split() if rng.random() > 0.12] + some(rng.randint(0, 9))
        rows.append((k, " ".join(words)))
    t, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for r in decontaminate.mark(t, bench).collect():
        want = {}
        for i, text in items:
            if len(plain_words(text)) >= decontaminate.N and (score := plain_score(plain_words(text), plain_words(r.text))) >= decontaminate.THRESHOLD:
                want[i] = max(want.get(i, 0), score)
        got = {m["item"]: m["score"] for m in r.matches if m["item"] != 12}
        assert got == want and [(-m["score"], m["item"]) for m in r.matches] == sorted((-m["score"], m["item"]) for m in r.matches)
