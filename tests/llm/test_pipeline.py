import collections
import zlib

import numpy as np
import pyarrow as pa

import corpus_pipeline
from tests.conftest import SF
from tests.llm.test_lines import LOWER
from tests.llm.test_minhash import brute as components_of
from tripmart.llm import decontaminate, minhash, packing, quality


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "line_dedup", "near_dedup", "decontaminate", "packing"]
    sizes = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns
        sizes[name] = docs.count()
    assert before > sizes["quality"] == sizes["line_dedup"] >= sizes["near_dedup"] >= sizes["decontaminate"] > before / 2
    assert minhash.near_duplicates(docs).where("NOT kept").count() == 0
    assert decontaminate.mark(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).where("size(matches) > 0").count() == 0


def test_stages_on_messy_rows(spark, docs, rows, none):
    long = "word " * 300_000 + "end"
    more = spark.createDataFrame([(900, long, 1), (900, long, 1), (901, None, 2)], "doc_id long, text string, n_lines int")
    t = docs.unionByName(more, allowMissingColumns=True)
    copies = 0
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, t, SF)
        assert out.columns == t.columns, name
        got = collections.Counter(r.doc_id for r in out.select("doc_id").collect())
        assert not got - collections.Counter([i for i, _ in rows] + [900, 900, 901]), name
        copies += got[900]
        assert stage(spark, none, SF).count() == 0 and stage(spark, none, SF).columns == none.columns
        if name == "near_dedup":
            assert all(got[i] for i in (400, 401, 403, None))
        if name == "line_dedup":
            assert sum(got.values()) == len(rows) + 3 and {r.n_lines for r in out.where("doc_id = 901").collect()} == {2}
    assert copies >= 6  # rows of one document go or stay together
    packed = corpus_pipeline.packing_stage(spark, t, SF)
    assert packed.where("doc_id = 900").agg({"length": "sum"}).first()[0] == 2 * packed.where("doc_id = 900").first().doc_tokens
    assert corpus_pipeline.packing_stage(spark, none, SF).count() == 0


def plain_quality(docs, labels):
    """The discriminant over all rows at once."""
    x = quality.statistics(pa.array([t for _, t in docs], pa.string()))
    learn = np.array([labels.get(i, -1) if zlib.crc32(str(i).encode()) % 4 != 2 else -1 for i, _ in docs])
    n = [(learn == c).sum() for c in (0, 1)]
    mean = [x[learn == c].mean(0) for c in (0, 1)]
    cov = [np.cov(x[learn == c].T, bias=True) for c in (0, 1)]
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / sum(n)
    log = []
    for c in (0, 1):
        s = (1 - quality.SHRINK_POOLED) * cov[c] + quality.SHRINK_POOLED * pooled
        s = (1 - quality.SHRINK_DIAGONAL) * s + np.diag(quality.SHRINK_DIAGONAL * np.diag(s) + 1e-6)
        d = x - mean[c]
        log.append(-0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d) + np.linalg.slogdet(s)[1]) + np.log(n[c]))
    good = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500))) >= quality.THRESHOLD
    return [d for d, g in zip(docs, good, strict=True) if g]


def plain_lines(docs):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    where = collections.defaultdict(set)
    for i, t in docs:
        for line in t.split("\n"):
            if len(key(line)) >= 40:
                where[key(line)].add(i)
    gone = {k: max(v) for k, v in where.items() if len(v) >= 5}
    return [(i, "\n".join(x for x in t.split("\n") if gone.get(key(x), i) == i)) for i, t in docs]


def plain_contaminated(docs, items):
    def words(text):
        return "".join(c if c.isalnum() or ord(c) > 126 else " " for c in text.lower()).split()

    known: dict[str, int] = {}
    code = lambda text: np.array([known.setdefault(w, len(known) + 2) for w in words(text)], np.uint64)
    items = [w for w in map(code, items) if len(w) >= decontaminate.N]
    out = []
    for i, t in docs:
        w = code(t)
        if not len(w) or max(decontaminate.align(items, [w] * len(items))) < decontaminate.THRESHOLD:
            out.append((i, t))
    return out


def test_against_a_plain_version(spark):
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = plain_lines(plain_quality(rows, labels))
    kept = {i for i, (_, c) in components_of(rows, 5).items() if i == c}
    rows = plain_contaminated([r for r in rows if r[0] in kept], items)
    ids, closing, want = packing.known_ids(None), np.array([1], "<u4").tobytes(), collections.Counter()
    for i, t in rows:
        body = np.array(ids.tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() + closing
        for at in range(0, len(body) // 4, packing.LENGTH):
            piece = body[4 * at : 4 * (at + packing.LENGTH)]
            want[i, at, len(piece) // 4, zlib.crc32(piece), len(body) // 4] += 1
    got = corpus_pipeline.run(spark, SF).collect()
    assert collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
