"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are compared in lower case and without punctuation. Runs of four words of
each test item, and any three words within five, in order, are seeds where they
are rare: where the product of their words' shares of the whole corpus is at
most ``RARE``; the eight rarest of each shape always are. Three words are looked
for in the document at any of the gaps, so a copy is found whose edits leave no
longer run, or whose words were put in or left out; an item of fewer than four words has
itself as its seed, if rare. Words are counted over all documents, and
the product tells common phrases from a leak that itself is frequent. A seed
found in a document places a test item there; the words around it are aligned
with the item (match 2, mismatch and gap -1), and the best score, as a share of
the full one, decides. Edited and paraphrased copies keep most of their score.

Test items go to the tasks in parts of at most ``PART_WORDS`` words, one part at
a time, so what is broadcast does not grow with the benchmark; the marks of one
part are written before the next is sent. Documents are never shuffled.

Defined results: null or empty texts and items match nothing, nor do items of
fewer than four words that are not rare; repeated items are found each, repeated rows marked
each; ties of the best item go to the smallest item_id; null item_ids are
ignored; extra columns are kept, but for matches, which is
replaced; with an empty benchmark nothing is marked.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, cut, fresh, record
from .text import IS_SPACE, mix, slices, word_hashes
from .text import words as split_words

N, RARE, AT_LEAST, THRESHOLD, MARGIN, PART_WORDS = 4, 1e-8, 8, 0.5, 8, 1_000_000
MATCH, MISMATCH, GAP = 2, -1, -1
_BITS = 20
#: Shapes of seeds, as places of their words; the last two are for items of one and two words.
SHAPES = [(0, 1, 2, 3), (0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 1, 4), (0, 2, 4), (0, 3, 4), (0, 1), (0,)]
#: White space and ASCII punctuation part words.
_GAPS = IS_SPACE.copy()
_GAPS[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return split_words(buf, offsets, _GAPS)


def lowered(column: pa.Array):
    """Slices of the texts in lower case, letters beyond ASCII included."""
    return slices(pc.utf8_lower(column))


def shaped(hashes: np.ndarray, first: np.ndarray, shape: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words at all places of one shape within rows, and their first words.

    Equal words in equal order have equal hashes in every shape of their number,
    so words that were put in or left out between them do not matter.
    """
    places = SHAPES[shape]
    n = len(hashes) - places[-1]
    if n < 1:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    values = np.full(n, len(places), np.uint64)
    for t in places:
        values = (values + hashes[t : t + n]) * np.uint64(0xD1342543DE82EF95)
        values ^= values >> np.uint64(29)
    left = np.repeat(first[1:], np.diff(first))[:n] - np.arange(n)
    at = np.flatnonzero(left > places[-1])
    return mix(values[at]), at


class Items:
    """Test items as word hashes, and their seeds in hash order."""

    def __init__(self, ids: list[int], texts: list[str], share: dict[int, float]):
        self.ids, self.words, sizes = [], [], set()
        seeds, places = [], []
        for item, text in zip(ids, texts, strict=True):
            for _, _, buf, offsets in lowered(pa.array([text])):
                starts, ends, first = words(buf, offsets)
                h = word_hashes(buf, starts, ends)
                if not len(h):
                    continue
                p = np.array([share.get(int(x), 0.0) for x in h])
                for k, shape in enumerate(SHAPES):
                    if len(h) < N and shape != tuple(range(len(h))) or len(h) >= N and len(shape) < 3:
                        continue
                    values, at = shaped(h, first, k)
                    chance = np.prod([p[at + t] for t in shape], axis=0)
                    rare = chance <= RARE
                    if len(h) >= N:
                        rare |= np.argsort(np.argsort(chance, kind="stable"), kind="stable") < AT_LEAST
                    if rare.any():
                        sizes.add(len(shape))
                        seeds.append(values[rare])
                        places.append(np.column_stack([np.full(rare.sum(), len(self.ids)), at[rare]]))
                self.ids.append(item)
                self.words.append(h)
        self.shapes = [k for k, shape in enumerate(SHAPES) if len(shape) in sizes]
        seeds_ = np.concatenate(seeds) if seeds else np.empty(0, np.uint64)
        order = np.argsort(seeds_, kind="stable")
        self.places = np.concatenate(places)[order] if seeds else np.empty((0, 2), np.int64)
        self.seeds, self.begin = np.unique(seeds_[order], return_index=True)
        self.stop = np.append(self.begin[1:], len(seeds_))
        self.maybe = np.zeros(1 << _BITS, bool)
        self.maybe[(self.seeds >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def hits(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of value, item, word in item) of every seed among the values."""
        none = np.empty(0, np.int64)
        if not len(self.seeds):
            return none, none, none
        at = np.flatnonzero(self.maybe[(values >> np.uint64(64 - _BITS)).astype(np.int64)])
        where = np.minimum(np.searchsorted(self.seeds, values[at]), len(self.seeds) - 1)
        found = self.seeds[where] == values[at]
        at, where = at[found], where[found]
        n = self.stop[where] - self.begin[where]
        each = np.repeat(np.arange(len(at)), n)
        pick = np.repeat(self.begin[where] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return at[each], self.places[pick, 0], self.places[pick, 1]


def align(items: list[np.ndarray], windows: list[np.ndarray]) -> np.ndarray:
    """Best local alignment score of each item with its window, as a share of the item's full score."""
    out = np.zeros(len(items))
    order = sorted(range(len(items)), key=lambda k: (len(items[k]), len(windows[k])))
    at = 0
    while at < len(order):
        size = max(1, 60_000 // (len(windows[order[at]]) + 2 * MARGIN))
        part = order[at : at + size]
        at += size
        rows, wide = max(len(items[k]) for k in part), max(len(windows[k]) for k in part)
        item, window = np.zeros((len(part), rows), np.uint64), np.ones((len(part), wide), np.uint64)
        for r, k in enumerate(part):
            item[r, : len(items[k])] = items[k]
            window[r, : len(windows[k])] = windows[k]
        steps = np.arange(wide, dtype=np.int32) * -GAP
        before = np.zeros((len(part), wide), np.int32)
        best = np.zeros(len(part), np.int32)
        for i in range(rows):
            diagonal = np.where(item[:, i, None] == window, MATCH, MISMATCH).astype(np.int32)
            diagonal[:, 1:] += before[:, :-1]
            now = np.maximum(np.maximum(diagonal, before + GAP), 0)
            now = np.maximum.accumulate(now + steps, 1) - steps  # gaps along the window
            np.maximum(best, now.max(1), out=best)
            before = now
        for r, k in enumerate(part):
            out[k] = best[r] / (MATCH * len(items[k]))
    return out


def matches(column: pa.Array, items: Items) -> list[dict[int, float]]:
    """For each text the items that seeds place there, with their best alignment scores."""
    out: list[dict[int, float]] = [{} for _ in range(len(column))]
    for lo, _, buf, offsets in lowered(column):
        starts, ends, first = words(buf, offsets)
        if not len(starts):
            continue
        h = word_hashes(buf, starts, ends)
        found = []
        for shape in items.shapes:
            values, at = shaped(h, first, shape)
            where, item, place = items.hits(values)
            found.append((at[where], item, place))
        if not any(len(f[0]) for f in found):
            continue
        word, item, place = (np.concatenate(c) for c in zip(*found, strict=True))
        doc = np.searchsorted(first, word, "right") - 1
        order = np.lexsort((word, item, doc))
        doc, item, place, word = doc[order], item[order], place[order], word[order]
        size = np.array([len(w) for w in items.words])[item]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (word[1:] - word[:-1] > size[1:] + MARGIN)
        heads = np.flatnonzero(new)
        begin = np.maximum(np.minimum.reduceat(word - place - MARGIN, heads), first[doc[heads]])
        stop = np.minimum(np.maximum.reduceat(word - place + size + MARGIN, heads), first[doc[heads] + 1])
        scores = align([items.words[k] for k in item[heads]], [h[a:b] for a, b in zip(begin, stop, strict=True)])
        for d, k, score in zip(doc[heads].tolist(), item[heads].tolist(), scores.tolist(), strict=True):
            own = out[lo + d]
            own[items.ids[k]] = max(own.get(items.ids[k], 0.0), score)
    return out


def word_shares(docs: DataFrame, wanted: np.ndarray) -> dict[int, float]:
    """Shares of the wanted words (hashes, in order) among all words of all documents."""
    sent = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        known, total = sent.value, 0
        counts = np.zeros(len(known) + 1, np.int64)
        maybe = np.zeros(1 << _BITS, bool)
        maybe[(known >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        for _, _, buf, offsets in lowered(batch.column("text")):
            starts, ends, _ = words(buf, offsets)
            h = word_hashes(buf, starts, ends)
            total += len(h)
            h = h[maybe[(h >> np.uint64(64 - _BITS)).astype(np.int64)]]
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            counts += np.bincount(at[known[at] == h], minlength=len(counts))
        counts[-1] = total
        some = np.flatnonzero(counts)
        return record(word=pa.array(some), n=pa.array(counts[some]))

    rows = arrow_map(docs.select(F.col("text").cast("string").alias("text")), run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {r["word"]: r["n"] for r in rows}  # no more than the words of one part of the benchmark
    total = max(1, counts.pop(len(wanted), 0))
    return {int(wanted[k]): n / total for k, n in counts.items()}


def mark(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, part_words: int = PART_WORDS, column: str = "matches") -> DataFrame:
    """All columns of ``docs`` and ``column``, the items (item, score) that score ``threshold`` or more, best first."""
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    length = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, math.ceil(length / (part_words * 4)))
    kind = "array<struct<item: long, score: double>>"
    out = docs.withColumn(column, F.array().cast(kind))
    names, schema = out.columns, out.schema
    sent = None
    for k in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k).orderBy("item_id", "text").collect()  # a bounded part
        if not rows:
            continue
        texts = [r["text"] for r in rows]
        seen = [np.empty(0, np.uint64)]
        for _, _, buf, offsets in lowered(pa.array(texts)):
            starts, ends, _ = words(buf, offsets)
            seen.append(word_hashes(buf, starts, ends))
        wanted = np.unique(np.concatenate(seen))
        if not len(wanted):
            continue
        if sent is not None:  # one part in memory at a time
            out = cut(out, "marked")
            sent.unpersist()
        sent = docs.sparkSession.sparkContext.broadcast(Items([r["item_id"] for r in rows], texts, word_shares(docs, wanted)))

        def run(batch: pa.RecordBatch, sent=sent) -> pa.RecordBatch:
            found = matches(batch.column("text").cast(pa.string()), sent.value)
            before = batch.column(column).to_pylist()
            lists = []
            for old, new in zip(before, found, strict=True):
                both = [(m["item"], m["score"]) for m in old] + [(i, s) for i, s in new.items() if s >= threshold]
                lists.append([{"item": i, "score": s} for i, s in sorted(both, key=lambda m: (-m[1], m[0]))])
            cols = [pa.array(lists, batch.schema.field(column).type) if c == column else batch.column(c) for c in names]
            return pa.RecordBatch.from_arrays(cols, names=names)

        out = arrow_map(out, run, schema)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents without a test item, with all their columns."""
    (column,) = fresh(docs, "matches")
    return mark(docs, benchmark, threshold, column=column).where(F.size(column) == 0).drop(column)
