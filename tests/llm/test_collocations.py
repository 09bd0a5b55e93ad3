import collections
import random
import re

import pytest

from tripmart.llm import collocations
from tripmart.llm.common import cut

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def counted(rows):
    counts, total = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for n in range(1, 5):
                for k in range(len(words) - n + 1):
                    counts[lang][tuple(words[k : k + n])] += 1
    return counts, total


def plain(rows, min_count, top=2000, share=80):
    counts, total = counted(rows)
    out = []
    for lang, f in counts.items():
        found = {g: a for g, a in f.items() if len(g) > 1 and a >= min_count}
        gone = {g[k : k + n] for g, x in found.items() for n in range(2, len(g)) for k in range(len(g) - n + 1) if 100 * x >= share * f[g[k : k + n]]}
        best = []
        for g, a in found.items():
            if g not in gone:
                score, _, left, right = min((2_000_000 * a // (f[g[:k]] + f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
                best.append((-score, -a, " ".join(g).encode(), left, right))
        out += [(lang, k + 1, g.decode(), -a, left, right, total[lang], -score) for k, (score, a, g, left, right) in enumerate(sorted(best)[:top])]
    return sorted(out)


def made(seed: int):
    """Few words, so that phrases repeat; passages that many rows share; odd spaces, languages and letters."""
    rng = random.Random(seed)
    word = ["the", "Of", "and", "ÉTÉ", "naïve", "x", "in one", "\U0001f600", "a\x00b", "long" * 40]
    passage = " ".join(f"w{k}" for k in range(60))
    rows = []
    for _ in range(120):
        text = "".join(rng.choice(word) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "!? "]) for _ in range(rng.randint(0, 60)))
        rows.append((rng.choice(["en", "en", "de", None, "und", ""]), text))
    rows += [("en", f"{passage} end{k % 3}. {passage}") for k in range(20)]
    rows += [("en", "ha " * 500), ("de", None), (None, ""), ("en", " \t .,\n"), (None, "a b c d")] + rows[:30]
    return rows


@pytest.mark.parametrize("seed,min_count", [(1, 1), (2, 3), (3, 30), (4, 300)])
def test_against_brute_force(spark, seed, min_count, monkeypatch):
    monkeypatch.setattr(collocations, "SLICE", 3000)
    monkeypatch.setattr(collocations, "LEAST_BITS", 1 << 16)
    rows = made(seed)
    docs = spark.createDataFrame([(lang, 5, text, 1, "z") for lang, text in rows], "lang string, n int, text string, f int, `a.b` string").repartition(3)
    out = collocations.mine(docs, min_count)
    assert out.columns == COLUMNS
    assert sorted(map(tuple, out.collect())) == plain(rows, min_count)


def test_top_and_share(spark):
    rows = made(5)
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(map(tuple, collocations.mine(docs, 2, top=3, share=40).collect())) == plain(rows, 2, 3, 40)


def test_other_names_and_empty(spark):
    docs = spark.createDataFrame([("en", "a b. " * 40)], "`my.lang` string, `my``text` string")
    assert [tuple(r) for r in collocations.mine(docs, lang="my.lang", text="my`text").collect()] == [("en", 1, "a b", 40, 40, 40, 80, 1_000_000)]
    assert collocations.mine(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert collocations.mine(spark.createDataFrame([("en", None), (None, " . ")], "lang string, text string")).count() == 0


@pytest.mark.parametrize("piece", [1, 7, 4096])
def test_paths_hold_every_frequent_edge_once(spark, piece, monkeypatch):
    monkeypatch.setattr(collocations, "PIECE", piece)
    rows = made(6)
    edges = cut(collocations.runs(spark.createDataFrame(rows, "lang string, text string"), 5), "test-edges")
    frequent = {n: f.where("f >= 5") for n, f in collocations.flows(edges).items()}
    paths = collocations.compact(frequent[4], frequent[3]).collect()
    got = collections.Counter()
    for r in paths:
        words = r.path.split(" ")
        assert len(words) == r.n_edges + 3
        got.update((r.lang, tuple(words[k : k + 4]), r.f) for k in range(r.n_edges))
    counts, _ = counted(rows)
    assert got == collections.Counter((lang, g, a) for lang, f in counts.items() for g, a in f.items() if len(g) == 4 and a >= 5)
    assert max(r.n_edges for r in paths) == min(piece, 57)  # all edges of the passage
    for n in (1, 2, 3):
        assert {(r.lang, tuple(r.gram.split(" "))): r.f for r in frequent[n].collect()} == {(lang, g): a for lang, f in counts.items() for g, a in f.items() if len(g) == n and a >= 5}
