import numpy as np

from tripmart.llm.embedding_dedup import Quantizer, centroids, near_vectors


def brute(rows, threshold):
    ok = {i: (np.array(v, float) / np.linalg.norm(v), lab) for i, v, lab in rows if v is not None and lab is not None and i is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = sorted(ok)
    links = {i: {j for j in ids if j != i and ok[i][1] == ok[j][1] and ok[i][0] @ ok[j][0] >= threshold} for i in ids}
    comp = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i in ids:
            low = min([comp[i], *(comp[j] for j in links[i])])
            if low < comp[i]:
                comp[i], changed = low, True
    return {i: (len(links[i]), comp[i]) for i in ids}


def test_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(300):
        rows.append((k, rng.normal(size=16).tolist(), k % 3))
    for k in range(200):  # one large group of near copies, some equal
        rows.append((1000 + k, (np.array(rows[0][1]) + rng.normal(size=16) * (0.12 if k % 5 else 0)).tolist(), 0))
    rows += [(2000, rows[0][1], 1), (2001, rows[0][1], None), (2002, None, 0), (2003, [0.0] * 16, 0), (2004, [float("nan")] + [1.0] * 15, 0), (2005, [None] + [1.0] * 15, 0), (2006, [float("inf")] + [1.0] * 15, 0), (2007, [], 0), (2008, [3 * x for x in rows[5][1]], 2)]
    t = spark.createDataFrame([(*r, 1.0) for r in rows], "vec_id long, embedding array<float>, label int, n double")
    rows = [(r.vec_id, r.embedding, r.label) for r in t.collect()]
    for block in (4096, 32):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(t, block=block).collect()}
        want = brute(rows, 0.93)
        assert len(got) == len(rows)
        assert sum(v[0] for v in got.values()) >= 0.99 * sum(v[0] for v in want.values())
        for i, (n, c) in want.items():
            assert got[i][0] <= n and got[i][1] == c and got[i][2] == (c == i)
        assert all(got[i][:2] == (0, i) for i in range(2001, 2008))


def test_nothing_to_compare(spark):
    t = spark.createDataFrame([(1, None, 0), (2, [0.0, 0.0], 0)], "vec_id long, embedding array<float>, label int")
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors(t).collect()} == {(1, 0, 1, True), (2, 0, 2, True)}
    assert near_vectors(t.limit(0)).count() == 0
    one = spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0)], "vec_id long, embedding array<float>, label int")
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in near_vectors(one).collect()) == [(1, 1, 1), (1, 1, 1), (2, 1, 1)]


def test_lengths_and_repeated_ids(spark):
    """Equal vectors of any length are linked; different vectors of one id are different vectors; components don't run into one another."""
    rng = np.random.default_rng(9)
    rows, want = [], []

    def add(i, v, label, links, component):
        rows.append((i, [float(x) for x in v], label))
        want.append((i, links, component))

    for k in range(5):
        add(10 + k, [1.0 + k, 2.0, -5.0 * k * k], 0, None, None)
    add(20, [1.0, 1.0], 0, 1, 20)
    add(21, [2.0, 2.0], 0, 1, 20)
    add(22, [2.0, 2.0], 1, 0, 22)
    add(23, [1.0, 1.0, 0.0], 0, None, None)  # its zero is a component: no link to those of two
    add(30, [1.0], 0, 1, 30)
    add(31, [7.0], 0, 1, 30)
    add(32, [-1.0], 0, 0, 32)
    long = rng.normal(size=40)
    add(40, long, 2, 2, 40)
    add(41, long + rng.normal(size=40) * 0.01, 2, 2, 40)
    add(42, 3 * long, 2, 2, 40)
    add(43, long[:33], 2, 0, 43)
    a, b = np.eye(6)[0], np.eye(6)[1]
    add(1, a, 3, 1, 1)  # one id, two vectors, each with a partner of its own
    add(1, b, 3, 1, 1)
    add(50, 2 * a, 3, 1, 1)
    add(51, 2 * b, 3, 1, 1)
    add(60, np.eye(6)[3], 3, 1, 60)
    add(61, np.eye(6)[3], 3, 1, 60)
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in near_vectors(t).collect())
    asked = {i for i, n, _ in want if n is not None}
    assert [g for g in got if g[0] in asked] == sorted(w for w in want if w[1] is not None)
    few = brute([r for r in rows if r[0] in (10, 11, 12, 13, 14, 23)], 0.93)
    assert {g[0]: g[1:] for g in got if g[0] in few} == few


def test_two_levels_of_lists():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = centroids(x, 200, rng, direct=50)
    assert 180 <= len(c) <= 220
    q = Quantizer(x, 64)
    codes, miss = q.encode(x, home := q.homes(x))
    one = np.flatnonzero(home == home[0])
    exact = np.linalg.norm(x[:40, None] - x[None, one], axis=2)
    assert (np.abs(np.sqrt(np.maximum(q.distances(x[:40], home[0], codes[one]), 0)) - exact) <= miss[one] + 1e-9).all()
