import collections
import random

import numpy as np
import pytest

from tests.llm.conftest import WORDS, prose
from tripmart.llm import minhash
from tripmart.llm.components import components
from tripmart.llm.text import SPACES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    words = (text or "").translate(LOWER).encode().split()
    if len(words) < k:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute(rows, k):
    sets = {i: shingles(t, k) for i, t in rows if i is not None}
    label = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((label[i], label[j]))
                for x in label:
                    label[x] = a if label[x] == b else label[x]
    return {i: (len(s), label[i]) for i, s in sets.items()}


@pytest.mark.parametrize("k", [4, 5])
def test_against_brute_force(docs, rows, k):
    got = minhash.near_duplicates(docs, k)
    want = brute(rows, k)
    out = got.collect()
    assert len(out) == len(rows)
    for r in out:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id)


def test_large_group_in_small_blocks(spark, monkeypatch):
    rng = random.Random(9)
    base = prose(rng, 160).split(" ")
    rows = []
    for k in range(90):
        words = list(base)
        for _ in range(rng.randint(1, 9)):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        rows.append((1000 - k, " ".join(words)))
    t = spark.createDataFrame(rows, "doc_id int, text string")
    for block, wide in ((256, 64), (12, 64), (12, 2)):
        monkeypatch.setattr(minhash.confirmed_links, "__defaults__", (block, wide))
        got = {r.doc_id: r.component_id for r in minhash.near_duplicates(t, 4).collect()}
        want = {i: c for i, (_, c) in brute(rows, 4).items()}
        assert got == want


def test_empty(none):
    assert minhash.near_duplicates(none).count() == 0
    assert minhash.keep_one(none).count() == 0


def test_rows_of_one_id_are_kept_by_their_texts(spark):
    a, b = ("one two three four five six seven", "nine ten eleven twelve thirteen fourteen")
    rows = [(1, a, 0), (1, a, 0), (5, a, 0), (5, b, 0), (None, a, 0), (None, None, 0), (7, None, 0), (8, "", 0)]
    out = minhash.keep_one(spark.createDataFrame(rows, "doc_id int, text string, gone_id int"))
    assert out.columns == ["doc_id", "text", "gone_id"]
    assert collections.Counter((r.doc_id, r.text) for r in out.collect()) == collections.Counter(r[:2] for r in rows if r[:2] != (5, a))


def test_components(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(60)] + [(100, 100 + k) for k in range(1, 80)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(500, 500)]
    label = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in range(len(label)):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == label
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_sub_keys_follow_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 500, dtype=np.uint64)
    b = np.concatenate([a[:450], rng.integers(0, 2**63, 50, dtype=np.uint64)])  # 450 of 550
    keys = minhash.sub_keys(np.concatenate([a, b]), np.array([0, 500]))
    same = (keys[0] == keys[1]).reshape(2, -1).any(1)
    assert same.all() and collections.Counter(SPACES)[32] == 1
