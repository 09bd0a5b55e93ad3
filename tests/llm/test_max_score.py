import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tripmart.llm import max_score
from tripmart.llm.max_score import Shard, top_k

SCHEMA = "vec_id long, embedding array<double>, w int, `a.b` int, query string"


def plain(rows, k=20, every=20):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (query, q) in enumerate(kept):
        if query is None or query % every:
            continue
        scored = [(-sum(x * y for x, y in zip(q, w)), i is None, i) for b, (i, w) in enumerate(kept) if b != a]
        out += [(query, n + 1, i, -s) for n, (s, _, i) in enumerate(sorted(scored, key=lambda r: (r[0], r[1], r[2] or 0))[:k])]
    return sorted(out, key=str)


def made(seed: int, n: int = 400):
    rng = random.Random(seed)
    groups = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(8)]
    rows = []
    for k in range(n):
        v = [x + rng.gauss(0, 0.4) for x in rng.choice(groups)]
        if k % 3 == 0:  # most components are zero
            v = [x if rng.random() < 0.2 else 0.0 for x in v]
        rows.append((k, v))
    copy = [abs(x) for x in groups[0]]
    rows += [(1000 + k, copy) for k in range(130)]  # a third of all rows are one vector
    rows += [(2000, None), (2020, [1.0, None]), (2040, [float("nan")] * 12), (2060, [float("inf"), 1.0]), (2080, []), (2100, [0.0] * 12), (2120, [5.0] * 3), (2140, [-0.001] * 30)]
    rows += [(None, copy), (None, [3.0] * 12), rows[20], rows[20], rows[21], (40, [2.0, -2.0])]
    rng.shuffle(rows)
    return [(*r, 1, 2, "q") for r in rows]


def found(spark, rows, **options):
    return sorted((tuple(r) for r in top_k(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("vec_id") % 20 == 0, **options).collect()), key=str)


@pytest.mark.parametrize("components,block", [(1 << 20, 1 << 16), (1500, 7), (150, 1 << 16)])
def test_against_brute_force(spark, components, block, monkeypatch):
    monkeypatch.setattr(max_score, "SHARD_COMPONENTS", components)
    monkeypatch.setattr(max_score, "BLOCK", block)
    monkeypatch.setattr(max_score, "WAVE", 3)
    rows = made(components)
    assert found(spark, rows) == plain(rows)
    assert found(spark, rows, k=3) == plain(rows, 3)


def test_few_and_none(spark):
    rows = made(1)[:0]
    assert found(spark, rows) == []
    rows = [(0, [1.0, 2.0], 1, 1, None), (1, [1.0], 1, 1, None)]
    assert found(spark, rows) == [(0, 1, 1, 4096)]
    assert found(spark, rows[:1]) == []
    assert top_k(spark.createDataFrame(rows, SCHEMA), F.lit(True)).columns == ["query_id", "rank", "vec_id", "score"]


def table(vectors):
    return pa.table({"row_id": pa.array(range(len(vectors)), pa.int64()), "vec_id": pa.array(range(len(vectors)), pa.int64()), "w": pa.array([list(map(int, v)) for v in vectors], pa.list_(pa.int64()))})


@pytest.mark.parametrize("large", [1, 1 << 22])
def test_pruned_search_of_a_shard_is_exact(large):
    """With a score to beat only rows of that score or more come back, whatever is left unprobed; sums beyond 53 bits stay exact."""
    rng = np.random.default_rng(2)
    vectors = (rng.normal(0, 20, (500, 24)) * (rng.random((500, 24)) < np.linspace(0.05, 1, 24))).astype(np.int64) * large
    shard = Shard(table(vectors))
    assert len(shard.common) and len(shard.rare)
    queries = [vectors[k] for k in range(40)]
    scores = [[sum(int(x) * int(y) for x, y in zip(q, v)) for v in vectors] for q in queries]
    least = [None if k % 5 == 0 else sorted(s)[-30 if k % 2 else -3] for k, s in enumerate(scores)]
    for i, rows, got in shard.search(np.arange(40), queries, least, 20):
        want = sorted((-s, r) for r, s in enumerate(scores[i]) if r != i and (least[i] is None or s >= least[i]))[:20]
        assert list(zip((-got).tolist(), rows.tolist())) == want


def test_scores_beyond_64_bits():
    shard = Shard(table([[1 << 40], [3]]))
    with pytest.raises(OverflowError):
        list(shard.search(np.array([1]), [np.array([1 << 40])], [None], 20))
