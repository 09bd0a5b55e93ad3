"""Quality classifier: regularised quadratic discriminant over document statistics.

Statistics of the whole text are transformed to be roughly normal. For each
class a mean and a covariance, shrunk towards the pooled one and towards its
diagonal, are estimated from sums that Spark adds up over the labelled rows, or
over about ``SAMPLE`` of them picked by a hash where there are more; a row's score is the logistic function of the difference of the two log
densities (Mahalanobis terms through cached inverse Cholesky factors) and the
log prior ratio.

Defined results: null and empty texts have the statistics of an empty text and
a score; a null doc_id is not held out and never labelled; repeated rows are
scored each; a doc_id labelled more than once counts with its lowest quality;
labels other than 0 and 1 are ignored; where a class has no labelled row, every
score is the share of label 1 with one row added to either class, and
``keep_good`` keeps all, since nothing was learnt; extra columns are ignored by
``classify`` and kept by ``keep_good``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, record
from .text import slices, word_hashes, words

THRESHOLD, SHRINK_POOLED, SHRINK_DIAGONAL, SAMPLE = 0.7, 0.1, 0.05, 1 << 16

#: Counts of bytes and words that every text has besides its own, at usual rates, so that a short text is not judged by a few words.
PRIOR_BYTES, PRIOR_WORDS = 100, 20

STATISTICS = (
    "word_bytes", "capitals", "symbols", "marks", "digits", "stutter", "variety",
    "short_words", "long_words", "sentence_ends", "shouting", "doubled_marks",
)


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_UPPER, _DIGIT = _class(bytes(range(65, 91))), _class(b"0123456789")
_LETTER = _class(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))
_SYMBOL, _MARK, _END = _class(b"#$%&*+/<=>@[\\]^_`{|}~"), _class(b"!\"'(),-.:;?"), _class(b".!?")


def statistics(column: pa.Array) -> np.ndarray:
    """A row of transformed statistics per text."""
    parts = [np.empty((0, len(STATISTICS)))]
    for lo, hi, buf, offsets in slices(column):
        rows = hi - lo
        starts, ends, first = words(buf, offsets)
        n = np.diff(first)
        doc = np.repeat(np.arange(rows), n)
        size = np.diff(offsets)
        counts = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offsets])  # noqa: E731, B023
        of_words = lambda flags: np.bincount(doc, flags, minlength=rows)  # noqa: E731, B023
        upper, letters = counts(_UPPER[buf]), counts(_LETTER[buf])
        same_mark = np.zeros(len(buf), bool)
        if len(buf) > 1:
            same_mark[1:] = (buf[1:] == buf[:-1]) & (_MARK | _SYMBOL)[buf[1:]]
        length = ends - starts
        if len(starts):
            h = word_hashes(buf, starts, ends)
            again = np.zeros(len(h), bool)
            again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
            order = np.lexsort((h, doc))
            new = np.ones(len(h), bool)
            new[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
            distinct = np.bincount(doc[order], new, minlength=rows)
            capitals = np.concatenate([[0], np.cumsum(_UPPER[buf], dtype=np.int64)])
            shout = (capitals[ends] - capitals[starts]) * 2 > length
            ended = _END[buf[ends - 1]]
        else:
            again = shout = ended = np.zeros(0, bool)
            distinct = np.zeros(rows)
        in_bytes = lambda flags, usual: np.sqrt((flags + PRIOR_BYTES * usual) / (size + PRIOR_BYTES))  # noqa: E731, B023
        in_words = lambda flags, usual: np.sqrt((of_words(flags) + PRIOR_WORDS * usual) / (n + PRIOR_WORDS))  # noqa: E731, B023
        parts.append(np.column_stack([
            np.log((of_words(length) + PRIOR_WORDS * 5) / (n + PRIOR_WORDS)), np.sqrt((upper + PRIOR_BYTES * 0.02) / (letters + PRIOR_BYTES)),
            in_bytes(counts(_SYMBOL[buf]), 0), in_bytes(counts(_MARK[buf]), 0.02), in_bytes(counts(_DIGIT[buf]), 0), in_words(again, 0.01),
            np.log((distinct + PRIOR_WORDS) / (n + PRIOR_WORDS)) / np.log(n + PRIOR_WORDS), in_words(length <= 3, 0.4), in_words(length > 12, 0.05),
            in_words(ended, 0.1), in_words(shout, 0), in_bytes(counts(same_mark), 0),
        ]))
    return np.concatenate(parts)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every document."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = statistics(batch.column("text"))
        return record(doc_id=batch.column("doc_id"), **{k: x[:, i] for i, k in enumerate(STATISTICS)})

    kind = dict(docs.dtypes)["doc_id"]
    return arrow_map(docs.select("doc_id", F.col("text").cast("string")), run, f"doc_id {kind}, " + ", ".join(f"{k} double" for k in STATISTICS))


class Discriminant:
    """Means, inverse Cholesky factors and log determinants of two classes."""

    def __init__(self, sums: dict[int, tuple[int, np.ndarray, np.ndarray]]):
        """sums: by class, the number of rows, the sum of x and the sum of x x'."""
        self.n = [sums[c][0] if c in sums else 0 for c in (0, 1)]
        self.share = (self.n[1] + 1) / (sum(self.n) + 2)
        self.ready = min(self.n) > 0
        if not self.ready:
            return
        mean = [sums[c][1] / self.n[c] for c in (0, 1)]
        cov = [sums[c][2] / self.n[c] - np.outer(mean[c], mean[c]) for c in (0, 1)]
        pooled = (self.n[0] * cov[0] + self.n[1] * cov[1]) / sum(self.n)
        self.mean, self.root, self.log_det = mean, [], []
        for c in (0, 1):
            s = (1 - SHRINK_POOLED) * cov[c] + SHRINK_POOLED * pooled
            s = (1 - SHRINK_DIAGONAL) * s + np.diag(SHRINK_DIAGONAL * np.diag(s) + 1e-6)
            low = np.linalg.cholesky(s)
            self.root.append(np.linalg.inv(low))
            self.log_det.append(2 * np.log(np.diag(low)).sum())

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.ready:
            return np.full(len(x), self.share)
        density = [-0.5 * (np.square((x - self.mean[c]) @ self.root[c].T).sum(1) + self.log_det[c]) for c in (0, 1)]
        gap = density[1] - density[0] + np.log(self.n[1] / self.n[0])
        return 1 / (1 + np.exp(-np.clip(gap, -500, 500)))


def learning_labels(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id and quality of the labelled rows to learn from: none held out, and about ``sample`` at most."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    share = min(1.0, sample / max(known.count(), 1))
    return known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Discriminant:
    """Fit on the labelled rows that are not held out; Spark adds up the moments."""
    known = F.broadcast(learning_labels(labels, sample))  # about SAMPLE rows of two numbers
    stats = with_statistics(docs.select("doc_id", "text").join(known.select("doc_id"), "doc_id", "left_semi"))
    k = len(STATISTICS)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    rows = stats.join(known, "doc_id").groupBy("quality").agg(
        F.count(F.lit(1)),
        *[F.sum(c) for c in STATISTICS],
        *[F.sum(F.col(STATISTICS[i]) * F.col(STATISTICS[j])) for i, j in pairs],
    )
    sums = {}
    for quality, n, *rest in rows.collect():  # two rows
        square = np.zeros((k, k))
        for (i, j), v in zip(pairs, rest[k:], strict=True):
            square[i, j] = square[j, i] = v
        sums[int(quality)] = (n, np.array(rest[:k]), square)
    return Discriminant(sums)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return record(doc_id=batch.column("doc_id"), score=model.value.score(statistics(batch.column("text"))))

    scored = arrow_map(docs.select("doc_id", F.col("text").cast("string")), run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with a score of ``threshold`` or more; scored in the same pass that filters them."""
    learnt = fit(docs, labels)
    if not learnt.ready:
        return docs
    model = docs.sparkSession.sparkContext.broadcast(learnt)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        good = model.value.score(statistics(batch.column("text"))) >= threshold
        return pa.RecordBatch.from_arrays([pc.filter(c, pa.array(good)) for c in batch.columns], schema=batch.schema)

    return arrow_map(docs, run, docs.schema)
