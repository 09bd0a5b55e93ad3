"""Substring dedup by sliding sentence spans.

A text is taken as sentences: they end at a word with a closing ``.``, ``!`` or
``?``, at a line end, and behind each ideographic full stop and full-width ``!``
or ``?`` (U+3002, U+FF01, U+FF1F), which end a word too, since no space follows them. Those of more than 16 words are several pieces, which
end behind every word whose hash is a multiple of eight, so that a word put in
or left out moves no other border. From every piece a run goes over three
consecutive ones and on until it has ``min_words`` (8), or ``min_bytes`` (96) of
words for texts without spaces; it is hashed (words compared with A-Z lower-cased).
With ``min_words=0`` every run of three is hashed as it is, and "Yes. No. Yes."
goes wherever it is repeated.

Runs of whole pieces can miss a passage that stands inside long sentences. So
the run of 26 words with the smallest hash among 26 neighbouring ones is hashed
too, unless a run of whole sentences lies inside it: every passage of 51 words
or more has a run of either kind, wherever it stands and however it is pointed.

Runs are grouped over all documents; the first is the one with the smallest
(doc_id, hash of the text, place), and the words of every other are removed. The
hash is 0 where no other row has the doc_id, so that it takes no room. Equal runs
of words that overlap in one text are one record, removed or kept together.

The span hash has 128 bits. Half of them tell which runs are candidates: a count
with partial sums on the map side, and a join that drops all others. What is left
is grouped by the whole hash. Finding the first is an aggregate with partial
minima, and joins are ordinary equi-joins that adaptive execution can split, so a
passage found in a third of all documents does not meet in one task.

Defined results: null text is empty and stays empty; texts with fewer than
three sentences and fewer than 51 words lose nothing; n_removed counts the
pieces that are removed whole; rows of one doc_id and text are one document, whose runs at the
same place are the same run, rows of one doc_id (or none) and different texts
are different documents; null doc_id sorts first; extra columns are kept,
but for n_sentences and n_removed, which are replaced; an empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, cut, fresh, widened
from .text import mix, powers, slices, word_hashes, words

RUN, MIN_WORDS, LONGEST, EVERY = 3, 8, 16, 8
MIN_BYTES, GRAM = 96, 26
_OTHER = np.uint64(0xC2B2AE3D27D4EB4F)
_END = np.zeros(256, bool)
_END[list(b".!?")] = True


def _wide_ends(buf: np.ndarray) -> np.ndarray:
    """Places behind U+3002, U+FF01 and U+FF1F."""
    a, b, c = buf[:-2], buf[1:-1], buf[2:]
    stop = (a == 0xE3) & (b == 0x80) & (c == 0x82) | (a == 0xEF) & (b == 0xBC) & ((c == 0x81) | (c == 0x9F))
    return np.flatnonzero(stop) + 3


class Pieces:
    """Words of a slice of rows and the pieces they make; indices of words and pieces run over all rows."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, min_words: int = MIN_WORDS, min_bytes: int = MIN_BYTES):
        self.starts, ends, self.first = words(buf, offsets)
        wide = _wide_ends(buf)
        if len(wide):
            self.starts = np.union1d(self.starts, wide[~np.isin(wide, ends)])
            ends = np.union1d(ends, wide)
            self.first = np.searchsorted(self.starts, offsets)
        n = len(self.starts)
        if not n:
            self.hashes, self.edges, self.real, self.own, self.stop = np.empty(0, np.uint64), np.zeros(1, np.int64), np.zeros(1, bool), np.zeros(len(offsets), np.int64), np.empty(0, np.int64)
            return
        self.hashes = word_hashes(buf, self.starts, ends)
        lines = np.concatenate([[0], np.cumsum(buf == 10)])
        opens = np.zeros(n, bool)
        opens[0] = True
        opens[1:] = _END[buf[ends[:-1] - 1]] | np.isin(ends[:-1], wide) | (lines[self.starts[1:]] > lines[ends[:-1]])
        opens[self.first[:-1][np.diff(self.first) > 0]] = True
        size = np.diff(np.append(np.flatnonzero(opens), n))
        long = np.repeat(size > LONGEST, size)
        real = np.append(opens, True)
        opens[1:] |= long[:-1] & (self.hashes[:-1] % np.uint64(EVERY) == 0)
        at = np.flatnonzero(opens)
        #: First words of the pieces and the end of the last; which of them open sentences; rows' first pieces.
        self.edges = np.append(at, n)
        self.real = real[self.edges]
        self.own = np.searchsorted(at, self.first)
        #: The piece behind the run from each piece, or -1 where the row ends before.
        size = np.concatenate([[0], np.cumsum(ends - self.starts)])[self.edges]
        enough = np.minimum(np.searchsorted(self.edges, at + min_words), np.searchsorted(size, size[:-1] + min_bytes))
        stop = np.maximum(np.arange(len(at)) + RUN, enough)
        self.stop = np.where(stop <= np.repeat(self.own[1:], np.diff(self.own)), stop, -1)

    def grams(self, sums: np.ndarray, down: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First words of the runs of GRAM words that are the smallest of GRAM neighbours and hold no run of whole sentences.

        Of equal ones that overlap the first is given, with the distance to the last.
        """
        n = len(self.starts) - 2 * GRAM + 2
        if n < 1:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        values = mix((sums[GRAM:] - sums[:-GRAM]) * down[: len(sums) - GRAM]) | np.uint64(1)
        least = _sliding(np.minimum, values)
        left = np.repeat(self.first[1:], np.diff(self.first)) - np.arange(len(self.starts))
        least[left[:n] < 2 * GRAM - 1] = 0
        pad = np.zeros(GRAM - 1, np.uint64)
        at = np.flatnonzero(_sliding(np.maximum, np.concatenate([pad, least, pad])) == values)
        sentence = np.flatnonzero(self.real)
        piece = sentence[np.searchsorted(self.edges[sentence], at, "right")]
        stop = np.append(self.stop, -1)[piece]
        at = at[(stop < 0) | ~self.real[stop] | (self.edges[stop] >= at + GRAM)]
        row = np.searchsorted(self.first, at, "right")
        order = np.lexsort((at, values[at], row))
        at, row, values = at[order], row[order], values[at[order]]
        far, keep = np.zeros(len(at), np.int64), np.ones(len(at), bool)
        base, last = 0, -1
        for k in (np.flatnonzero((values[1:] == values[:-1]) & (row[1:] == row[:-1]) & (np.diff(at) < GRAM)) + 1).tolist():
            base = base if last == k - 1 else k - 1
            if at[k] - at[base] < GRAM:
                keep[k], far[base] = False, at[k] - at[base]
            else:
                base = k
            last = k
        return at[keep], far[keep]


def _sliding(best: np.ufunc, values: np.ndarray) -> np.ndarray:
    """The best of each GRAM neighbouring values."""
    wide = 1
    while 2 * wide <= GRAM:
        values = best(values[:-wide], values[wide:])
        wide *= 2
    return best(values[: len(values) - (GRAM - wide)], values[GRAM - wide :])


def keyed(docs: DataFrame, name: str) -> DataFrame:
    """With a column ``name``, which tells rows of one doc_id, or of none, apart: the hash of their texts, else 0."""
    often, n = fresh(docs, "often", "n")
    shared = cut(docs.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias(often)).agg(F.count(F.lit(1)).alias(n)).where(F.col(n) > 1).select(often), "shared-ids")
    apart = F.col("doc_id").isNull() | F.col(often).isNotNull()
    text = F.when(apart, F.xxhash64(F.col("text").cast("string"))).otherwise(F.lit(0).cast("long"))
    return docs.join(shared, F.col("doc_id") == F.col(often), "left").withColumn(name, text).drop(often)


def spans(docs: DataFrame, second: bool = True, min_words: int = MIN_WORDS, min_bytes: int = MIN_BYTES) -> DataFrame:
    """doc_id, text_hash, the place a run starts at, and its hash, or two; places are 64 times a piece's number, or a word's with its ties and a 1."""
    hashes = ("span", "span2")[: 1 + second]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        none = np.empty(0, np.int64)
        rows, places, found = [none], [none], [[none] for _ in hashes]
        for lo, _, buf, offsets in slices(batch.column("text")):
            p = Pieces(buf, offsets, min_words, min_bytes)
            h = p.hashes
            up, down = powers(len(h) + 1)
            sums = np.zeros((len(hashes), len(h) + 1), np.uint64)
            for s, words_ in zip(sums, (h, mix(h ^ _OTHER)) if second else (h,), strict=True):
                np.cumsum(words_ * up[: len(h)], out=s[1:])
            begin = np.flatnonzero(p.stop >= 0)
            gram, far = p.grams(sums[0], down)
            doc = np.searchsorted(p.own, begin, "right") - 1
            own = np.searchsorted(p.first, gram, "right") - 1
            rows += [doc + lo, own + lo]
            places += [begin - p.own[doc] << 6, (gram - p.first[own] << 6) + 2 * far + 1]
            for kind, a, b in ((0, p.edges[begin], p.edges[p.stop[begin]]), (1 << 40, gram, gram + GRAM)):
                for out, s in zip(found, sums, strict=True):
                    out.append(mix((s[b] - s[a]) * down[a] + (b - a + kind).astype(np.uint64)).view(np.int64))
        at = pa.array(np.concatenate(rows))
        columns = [pa.array(np.concatenate(c)) for c in (places, *found)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("text_hash").take(at), *columns], names=["doc_id", "text_hash", "place", *hashes])

    return arrow_map(docs.select("doc_id", F.col("text").cast("string"), "text_hash"), run, f"doc_id {dict(docs.dtypes)['doc_id']}, text_hash long, place long, " + ", ".join(f"{c} long" for c in hashes))


def repeated(docs: DataFrame, min_words: int = MIN_WORDS, min_bytes: int = MIN_BYTES) -> DataFrame:
    """doc_id, text_hash, and the places (``runs``) of its non-first runs."""
    often = spans(docs, False, min_words, min_bytes).groupBy("span").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("span")
    found = cut(spans(docs, True, min_words, min_bytes).join(often, "span", "left_semi"), "repeated-runs")
    span = ["span", "span2"]
    heads = found.groupBy(*span).agg(F.min(F.struct("doc_id", "text_hash", "place")).alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").select(*span, "head")
    first = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("text_hash") == F.col("head.text_hash")) & (F.col("place") == F.col("head.place"))
    return found.join(heads, span).where(~first).groupBy("doc_id", "text_hash").agg(F.collect_set("place").alias("runs"))


def drop_repeats(docs: DataFrame, min_words: int = MIN_WORDS, min_bytes: int = MIN_BYTES) -> DataFrame:
    """All columns of ``docs`` with the kept text, and n_sentences and n_removed.

    Runs go on until they have ``min_words`` words or ``min_bytes`` bytes of them; 0 of either sets no least length.
    """
    docs = docs.drop("n_sentences", "n_removed")
    own_hash, gone_id, gone_hash, gone_runs = fresh(docs, "own_hash", "gone_id", "gone_hash", "gone_runs")
    names, rows = docs.columns, keyed(docs, own_hash)
    gone = repeated(rows.select("doc_id", "text", F.col(own_hash).alias("text_hash")), min_words, min_bytes).toDF(gone_id, gone_hash, gone_runs)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept, total, removed = [], np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
        runs = batch.column(gone_runs).to_pylist()
        for lo, hi, buf, offsets in slices(batch.column("text")):
            p = Pieces(buf, offsets, min_words, min_bytes)
            total[lo:hi] = np.diff(p.own)
            for row in range(lo, hi):
                a, b = offsets[row - lo], offsets[row - lo + 1]
                if not runs[row]:
                    kept.append(buf[a:b].tobytes().decode())
                    continue
                places = np.array(runs[row])
                w0, w1, s0, s1 = *p.first[row - lo : row - lo + 2], *p.own[row - lo : row - lo + 2]
                kind, places, far = places & 1, places >> 6, places % 64 >> 1
                piece, gram, far = places[kind == 0] + s0, places[kind == 1], far[kind == 1]
                cover = np.zeros(w1 - w0 + 1, np.int64)
                np.add.at(cover, np.concatenate([p.edges[piece] - w0, gram]), 1)
                np.add.at(cover, np.concatenate([p.edges[p.stop[piece]] - w0, gram + far + GRAM]), -1)
                away = np.cumsum(cover)[:-1] > 0
                removed[row] = np.logical_and.reduceat(away, p.edges[s0:s1] - w0).sum()
                edges = np.append(p.starts[w0:w1], b)
                flags = np.ones(b - a, bool)
                flags[edges[0] - a :] = ~np.repeat(away, np.diff(edges))
                kept.append(buf[a:b][flags].tobytes().decode())
        own_cols = [pa.array(kept, pa.string()) if c == "text" else batch.column(c) for c in names]
        return pa.RecordBatch.from_arrays([*own_cols, pa.array(total), pa.array(removed)], names=[*names, "n_sentences", "n_removed"])

    same = F.col("doc_id").eqNullSafe(F.col(gone_id)) & (F.col(own_hash) == F.col(gone_hash))
    joined = rows.join(gone, same, "left").drop(gone_id, gone_hash, own_hash)
    return arrow_map(joined, run, widened(docs, "n_sentences long, n_removed long"))
