import random

from tests.llm.conftest import prose
from tests.llm.test_spans import brute
from tripmart.llm import span_dedup


def kept(spark, rows):
    return {r.doc_id: r.text for r in span_dedup.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_lines_of_one_and_two_words(spark):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(10**6)}"
    listed = "\n".join(" ".join(word() for _ in range(1 + k % 2)) for k in range(40))
    spaceless = "\n".join("".join(chr(0x4E00 + rng.randrange(5000)) for _ in range(12)) for _ in range(7))
    for passage in (listed, spaceless):
        rows = [(k, f"{prose(rng, 20)}.\n{passage}\n{prose(rng, 20)}") for k in range(4)]
        out = kept(spark, rows)
        assert out[0] == rows[0][1]
        for k in range(1, 4):
            assert not set(passage.split("\n")) & set(out[k].split("\n"))
            assert out[k] == rows[k][1].replace(passage + "\n", "")


def test_passages_of_51_words_without_punctuation(spark):
    rng = random.Random(6)
    some = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    passages = [some(51) for _ in range(300)]
    rows = [(i * 1000 + k, " ".join([some(rng.randrange(40)), p, some(rng.randrange(40))])) for k, p in enumerate(passages) for i in range(3)]
    out = kept(spark, rows)
    texts = dict(rows)
    for k, p in enumerate(passages):
        assert out[k] == texts[k]
        for i in (1, 2):
            left = out[i * 1000 + k].split()
            assert [w for w in left if w not in p.split()] == [w for w in texts[i * 1000 + k].split() if w not in p.split()]
            assert sum(w in left for w in p.split()) <= 51 - span_dedup.MIN_WORDS


def test_null_and_repeated_doc_ids_with_different_texts(spark):
    rng = random.Random(8)
    passage = prose(rng, 60)
    rows = [(i, f"{prose(rng, n)}.\n{passage}\n{prose(rng, 9)}") for i, n in ((None, 80), (None, 20), (7, 90), (7, 15), (8, 40))]
    rows += [(i, f"{prose(rng, 12)}.") for i in (None, 7, 7)]
    t = spark.createDataFrame(rows, "doc_id long, text string")
    order = t.selectExpr("doc_id", "xxhash64(text) x", "text").sort("doc_id", "x").collect()
    want = brute([(k, r.text) for k, r in enumerate(order)])
    place = {r.text: k for k, r in enumerate(order)}
    plain = {k: (n, m) for k, n, m in want}
    got = span_dedup.drop_repeats(t).selectExpr("n_sentences", "n_removed", "doc_id", "text").collect()
    assert sorted((r.n_sentences, r.n_removed) for r in got) == sorted(plain.values())
    clean = {t for _, t in rows if plain[place[t]][1] == 0}
    assert clean <= {r.text for r in got} and len(clean) == 4
