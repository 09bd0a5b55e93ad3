"""Two texts of over a megabyte that differ in one word, in a small table."""

import random

import numpy as np
import pytest

from tripmart.llm import chat, collocations, decontaminate, line_dedup, minhash, packing, quality, repair, span_dedup, suffix_dedup, url_filter
from tests.llm.conftest import prose
from tests.llm import test_collocations, test_repair
from tests.llm.test_suffixes import brute
from tripmart.llm.text import SLICE_BYTES


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(31)
    words = " ".join(prose(rng, 3000) for _ in range(60)).split(" ")
    other = list(words)
    other[len(words) // 2] = "different"
    return [" ".join(words), " ".join(other), prose(rng, 50)]


@pytest.fixture(scope="module")
def long(spark, texts):
    assert len(texts[0].encode()) > SLICE_BYTES
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_lines(long, texts):
    assert [r.n_dropped for r in line_dedup.drop_lines(long).orderBy("doc_id").collect()] == [0, 0, 0]
    lines = [{x.strip().lower() for x in t.split("\n") if len(x.strip()) >= 40} for t in texts]
    rows = line_dedup.drop_lines(long, min_docs=2).orderBy("doc_id").collect()
    assert len(rows[0].text.split("\n")) == sum(x.strip().lower() not in lines[1] for x in texts[0].split("\n")) and rows[1].text == texts[1]


def test_spans(long, texts):
    rows = span_dedup.drop_repeats(long).orderBy("doc_id").collect()
    assert len(rows[1].text.split()) < 300 and "different" in rows[1].text and len(rows[0].text) > 0.99 * len(texts[0])


def test_suffixes(long, texts):
    rows = suffix_dedup.drop_substrings(long).orderBy("doc_id").collect()
    at = next(k for k in range(len(texts[0].encode())) if texts[0].encode()[k] != texts[1].encode()[k])
    assert [r.n_spans for r in rows] == [2, 2, 0] and 0 < rows[1].n_bytes - rows[1].n_removed < 20 and abs(rows[0].n_removed - len(texts[0].encode())) < 20 and at > SLICE_BYTES // 2
    assert rows[2].n_removed == brute([texts[2].encode()], 400)[0][1]


def test_others(spark, long, texts):
    assert [(r.component_id, r.kept) for r in minhash.near_duplicates(long).orderBy("doc_id").collect()] == [(0, True), (0, False), (2, True)]
    passage = " ".join(texts[1].split(" ")[len(texts[1].split(" ")) // 2 - 15 :][:30])
    bench = spark.createDataFrame([(5, passage)], "item_id long, text string")
    assert [r.doc_id for r in decontaminate.mark(long, bench).where("size(matches) > 0").orderBy("doc_id").collect()] == [0, 1]
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1), (3, 0)], "doc_id long, quality int")
    assert [0 <= r.score <= 1 for r in quality.classify(long, labels).collect()] == [True] * 3
    ids = packing.Ids()
    rows = packing.pack(long).collect()
    for k, t in enumerate(texts):
        assert sum(r.length for r in rows if r.doc_id == k) == len(ids.of(t)) // 4 + 1
    turns = long.selectExpr("1L AS conv_id", "doc_id AS turn", "IF(doc_id = 1, 'assistant', 'user') AS role", "text")
    (row,) = chat.digest(chat.format_turns(turns)).collect()
    assert row.loss_chars == len(texts[1]) and row.n_turns == 3
    url = url_filter.filter_urls(long.selectExpr("doc_id AS page_id", "concat('http://a.b/', text) AS url"), [("block", "b/")]).collect()
    assert {r.verdict for r in url} == {"block"} and all(np.isfinite(r.p_block) for r in url)


def test_repair_and_collocations(long, texts):
    roles = ["user", "user", "assistant"]
    turns = long.selectExpr("1L AS conv_id", "CAST(doc_id AS INT) AS turn", "IF(doc_id = 2, 'assistant', 'user') AS role", "text")
    (row,) = repair.repair(turns).collect()
    assert tuple(row)[1:] == test_repair.plain(1, [(k, r, t) for k, (r, t) in enumerate(zip(roles, texts))])[0]
    got = collocations.mine(long.selectExpr("'en' AS lang", "text"), 40).collect()
    assert sorted(map(tuple, got)) == test_collocations.plain([("en", t) for t in texts], 40)
