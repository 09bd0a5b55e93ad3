import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tripmart.llm import quality


def test_held_out_accuracy(spark):
    sf = SF.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    out = quality.classify(docs, labels)
    rows = out.join(labels, "doc_id").where("held_out").select("quality", "predicted", "score").collect()
    assert out.count() == docs.count() and len(rows) > 50
    assert sum(r.quality == r.predicted for r in rows) / len(rows) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)
    same = quality.classify(docs.repartition(3), labels.where(~quality.held_out(F.col("doc_id"))))  # held-out labels change nothing
    a, b = ({r.doc_id: r.score for r in t.collect()} for t in (out, same))
    assert a == pytest.approx(b, abs=1e-9)
    kept = {r.doc_id for r in quality.keep_good(docs, labels).collect()}
    assert kept == {r.doc_id for r in out.where("predicted = 1").collect()}


def test_messy_rows(docs, rows, none, spark):
    labels = spark.createDataFrame([(k, int(k < 200), 0) for k in (0, 1, 2, 3, 4, 5, 100, 101, 200, 201, 202, 301, 302, 501, 502)] + [(None, 1, 0), (3, None, 0), (4, 7, 0)], "doc_id long, quality int, toxic int")
    out = quality.classify(docs, labels).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert quality.classify(none, labels).count() == 0
    for some in (labels.limit(0), labels.where("quality = 1")):
        assert len({r.score for r in quality.classify(docs, some).collect()}) == 1
        assert quality.keep_good(docs, some).count() == len(rows)  # nothing learnt, nothing dropped
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_learning_from_a_bounded_sample(spark):
    labels = spark.range(4000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    some, every = quality.learning_labels(labels, 500).count(), quality.learning_labels(labels).count()
    assert 350 < some < 650 and every == labels.where(~quality.held_out(F.col("doc_id"))).count()


def plain_statistics(text):
    """The statistics of one text by plain Python."""
    from tripmart.llm.quality import PRIOR_BYTES as PB
    from tripmart.llm.quality import PRIOR_WORDS as PW

    body = (text or "").encode()
    words = body.split()
    lower = lambda w: bytes(b + 32 if 65 <= b <= 90 else b for b in w)
    upper = lambda w: sum(65 <= b <= 90 for b in w)
    n, size = len(words), len(body)
    letters = sum(chr(b).isalpha() and b < 128 or b > 127 for b in body)
    symbols, marks = set(b"#$%&*+/<=>@[\\]^_`{|}~"), set(b"!\"'(),-.:;?")
    rate = lambda count, usual, prior, total: ((count + prior * usual) / (total + prior)) ** 0.5
    low = [lower(w) for w in words]
    return [
        np.log((sum(map(len, words)) + 5 * PW) / (n + PW)), ((upper(body) + 0.02 * PB) / (letters + PB)) ** 0.5,
        rate(sum(b in symbols for b in body), 0, PB, size), rate(sum(b in marks for b in body), 0.02, PB, size), rate(sum(48 <= b <= 57 for b in body), 0, PB, size),
        rate(sum(a == b for a, b in zip(low, low[1:], strict=False)), 0.01, PW, n), np.log((len(set(low)) + PW) / (n + PW)) / np.log(n + PW),
        rate(sum(len(w) <= 3 for w in words), 0.4, PW, n), rate(sum(len(w) > 12 for w in words), 0.05, PW, n),
        rate(sum(w[-1:] in (b".", b"!", b"?") for w in words), 0.1, PW, n), rate(sum(2 * upper(w) > len(w) for w in words), 0, PW, n),
        rate(sum(a == b and a in symbols | marks for a, b in zip(body, body[1:], strict=False)), 0, PB, size),
    ]


def test_statistics_and_scores_against_a_plain_version(spark):
    sf = SF
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    x = np.array([plain_statistics(t) for _, t in rows])
    assert np.allclose(x, quality.statistics(pa.array([t for _, t in rows], pa.string())))
    label = {r.doc_id: r.quality for r in labels.collect()}
    known = np.array([label.get(i, -1) if zlib.crc32(str(i).encode()) % 4 != 2 else -1 for i, _ in rows])
    log = []
    pooled = sum((known == c).sum() * np.cov(x[known == c].T, bias=True) for c in (0, 1)) / (known >= 0).sum()
    for c in (0, 1):
        s = 0.9 * np.cov(x[known == c].T, bias=True) + 0.1 * pooled
        s = 0.95 * s + np.diag(0.05 * np.diag(s) + 1e-6)
        d = x - x[known == c].mean(0)
        log.append(np.log((known == c).sum()) - 0.5 * (np.linalg.slogdet(s)[1] + np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d)))
    want = dict(zip([i for i, _ in rows], 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500))), strict=True))
    for r in quality.classify(docs, labels).collect():
        assert abs(r.score - want[r.doc_id]) < 1e-6 and r.predicted == int(r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_statistics_do_not_depend_on_neighbours(rows):
    texts = [t for _, t in rows]
    whole = quality.statistics(pa.array(texts))
    each = np.concatenate([quality.statistics(pa.array([t], pa.string())) for t in texts])
    assert np.isfinite(whole).all() and np.allclose(whole, each)
