"""Extra columns whose names Spark only reads in quotes are kept by all that keep columns."""

import pytest

import corpus_pipeline
from tests.llm.conftest import prose
from tripmart.llm import decontaminate, line_dedup, minhash, quality, span_dedup, suffix_dedup

ODD = ["a.b", "doc_id.text", "tick`y", "odd_1", "two words"]


@pytest.fixture(scope="module")
def odd(spark):
    import random

    rng = random.Random(11)
    line = prose(rng, 12).replace("\n", " ")
    rows = [(k, f"{prose(rng, 60)}\n{line}\n{prose(rng, 20)}", "en", "s", 5, k, f"x{k}", [k], k, None) for k in range(8)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, `a.b` long, `doc_id.text` string, `tick``y` array<long>, odd_1 long, `two words` int"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def side(spark):
    return spark.createDataFrame([(1, "some item of the benchmark that is in no text")], "item_id long, text string"), spark.createDataFrame([(k, k % 2, 0) for k in range(8)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", ["lines", "spans", "suffixes", "mark", "clean", "minhash", "quality"])
def test_operators(odd, side, name):
    benchmark, labels = side
    run = {
        "lines": lambda: line_dedup.drop_lines(odd), "spans": lambda: span_dedup.drop_repeats(odd), "suffixes": lambda: suffix_dedup.drop_substrings(odd), "mark": lambda: decontaminate.mark(odd, benchmark),
        "clean": lambda: decontaminate.clean(odd, benchmark), "minhash": lambda: minhash.keep_one(odd), "quality": lambda: quality.keep_good(odd, labels, 0.0),
    }
    out = run[name]()
    assert out.columns[: len(odd.columns)] == odd.columns
    want = {tuple(map(str, (r.doc_id, *[r[c] for c in ODD]))) for r in odd.collect()}
    assert {tuple(map(str, (r.doc_id, *[r[c] for c in ODD]))) for r in out.collect()} == want


def test_stages(odd, side, spark, tmp_path):
    for name, t in zip(("benchmark", "labels"), side):
        t.write.parquet(str(tmp_path / f"{name}.parquet"))
    docs = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == odd.columns
    assert docs.count() <= 8
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()
