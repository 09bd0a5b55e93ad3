import collections
import hashlib

import numpy as np
import pytest

from tripmart.llm import suffix_dedup
from tripmart.llm.suffix_dedup import suffix_order


def brute(texts, length):
    seen = collections.Counter()
    for b in texts:
        seen.update(b[k : k + length] for k in range(len(b) - length + 1))
    out = []
    for b in texts:
        cover = np.zeros(len(b) + 1, int)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                cover[k] += 1
                cover[k + length] -= 1
        gone = np.cumsum(cover)[:-1] > 0
        rest = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(rest).hexdigest()))
    return out


@pytest.mark.parametrize("length,large,seeds", [(400, 4096, suffix_dedup.SEEDS), (60, 4096, (20, 40, 60)), (60, 1, (20, 40, 60)), (400, 1, (32, 390, 400))])
def test_against_brute_force(docs, rows, length, large, seeds):
    out = suffix_dedup.drop_substrings(docs, length=length, seeds=seeds, large=large)
    assert out.columns == [*docs.columns, "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out.collect())
    want = brute([(t or "").encode() for _, t in rows], length)
    assert got == collections.Counter((i, *w) for (i, _), w in zip(rows, want, strict=True))


def test_suffix_order():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 4, 5, 8, 50, 301):
        for top in (1, 2, 40):
            s = rng.integers(1, top + 1, n).astype(np.int32)
            assert suffix_order(s, top, 5000).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())
    s = np.tile(rng.integers(1, 4, 50), 40).astype(np.int32)  # equal suffixes stand together when comparison is cut off
    order = suffix_order(s, 3, 100)
    parts = [s[i : i + 100].tobytes() for i in order if i + 100 <= len(s)]
    assert sorted(order.tolist()) == list(range(len(s)))
    assert 1 + sum(a != b for a, b in zip(parts, parts[1:], strict=False)) == len(set(parts))


def test_empty(none):
    assert suffix_dedup.drop_substrings(none).count() == 0
