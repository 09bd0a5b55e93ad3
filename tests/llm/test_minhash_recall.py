import numpy as np

from tripmart.llm import minhash


def missed(pairs, common, own, seed):
    """How many planted pairs of sets with ``common`` shared and ``own`` own members each share no table key."""
    rng, out = np.random.default_rng(seed), 0
    for _ in range(pairs // 1000):
        both = rng.integers(0, 2**63, (1000, common), dtype=np.uint64)
        sets = [np.concatenate([both, rng.integers(0, 2**63, (1000, own), dtype=np.uint64)], 1) for _ in range(2)]
        bounds = np.arange(1000) * (common + own)
        a, b = (minhash.sub_keys(s.ravel(), bounds) for s in sets)
        out += int((~(a == b).reshape(1000, 2, -1).any(2).all(1)).sum())
    return out


def test_pairs_at_the_threshold_share_a_key():
    assert missed(20_000, 80, 10, 3) < 40  # a similarity of 80 / 100; 128 by formula with eight sub-keys, 7 with twelve
