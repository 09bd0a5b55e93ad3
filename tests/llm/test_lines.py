import collections
import hashlib

import numpy as np
import pytest

from tripmart.llm import line_dedup
from tripmart.llm.line_dedup import PerfectHash, Shard, pack_shard

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_chars, min_docs):
    where = collections.defaultdict(set)
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars and i is not None:
                where[key(line)].add(i)
    gone = {k: max(v) for k, v in where.items() if len(v) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if gone.get(key(x), i) == i or (key(x) not in gone)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("min_chars,min_docs", [(40, 5), (3, 2), (10, 3)])
def test_against_brute_force(spark, docs, rows, min_chars, min_docs):
    out = line_dedup.drop_lines(docs, min_chars, min_docs)
    assert out.columns == [c for c in docs.columns if c != "n_lines"] + ["n_lines", "n_dropped"]
    got = [(r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in out.collect()]
    assert collections.Counter(got) == collections.Counter(brute(rows, min_chars, min_docs))


def test_hot_line_and_keeper(spark):
    line = "  THE same line that every document carries in it\t"
    rows = [(k, f"{line}\nown {k}\n{line.lower()}") for k in range(400)]
    t = spark.createDataFrame(rows, "doc_id int, text string").repartition(6)
    for shard_keys, task_probes in ((line_dedup.SHARD_KEYS, line_dedup.TASK_PROBES), (1, 30)):
        got = {r.doc_id: (r.n_dropped, r.text) for r in line_dedup.drop_lines(t, shard_keys=shard_keys, task_probes=task_probes).collect()}
        assert got[399] == (0, rows[399][1]) and all(got[k] == (2, f"own {k}") for k in range(399))
    _, loads, _ = line_dedup.index(line_dedup.line_keys(t), task_probes=30)
    assert [r.salts for r in loads.collect()] == [14]  # 400 probes of one line


def test_empty(spark, none):
    assert line_dedup.drop_lines(none).count() == 0


def test_perfect_hash_is_minimal():
    keys = np.random.default_rng(1).integers(0, 2**64, 5000, dtype=np.uint64)
    mph = PerfectHash(keys).ready()
    assert mph.base == len(keys)
    row = pack_shard(keys, keys[::-1], np.arange(5000), -np.arange(5000))
    shard = Shard(row)
    count, keeper = shard.probe(keys, keys[::-1].copy())
    assert (count == np.arange(5000)).all() and (keeper == -np.arange(5000)).all()
    count, _ = shard.probe(keys + np.uint64(1), ~keys)
    assert (count == 0).all()
    twice = np.array([5, 5, 9], np.uint64)
    count, _ = Shard(pack_shard(twice, np.array([1, 2, 3], np.uint64), np.array([7, 8, 9]), np.zeros(3, int))).probe(twice, np.array([1, 2, 3], np.uint64))
    assert count.tolist() == [7, 8, 9]
