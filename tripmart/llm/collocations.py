"""Phrase collocations from a weighted de Bruijn graph.

Nodes are runs of three words inside a piece of text, edges are runs of four,
weighted by how often they occur. Every word of a piece starts one row: its
run of four words, or what is left of the piece, which is the correction that
ends there. Counts of shorter phrases are the flow out of their node and the
ends in it; nothing shorter is counted by itself.

A phrase that occurs ``min_count`` times has only word pairs and triples that do.
Words and pairs, and then the triples of pairs that are left, are counted
before in buckets of hashes, so that a run stops where a bucket stays below:
whatever can be a candidate, or a part of one, keeps its exact count, and most
of the text makes no rows. The bits of the buckets are what tasks get sent: one
for each 16 bytes of text, at most ``MOST_BITS`` (128 MB), twice. Beyond some 16
GB of text more rare runs pass, which costs time and changes no result.

Edges of ``min_count`` and more are compacted: where one edge alone enters a
node and one alone leaves it, both with all its flow, they are one path. A
phrase of three words inside a path always has a longer one of the same count,
so only the ends of paths are candidates.

Defined results: null text is empty, null language is ``und``, and so is the
language of that name; texts without words give nothing; repeated rows count
each; an empty table gives no rows; other columns are ignored, whatever their
names. Texts are taken whole, one or more at a time; a task holds some hundred
bytes a word of the texts of one slice (1 MB, or a longer text alone).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, forget
from .text import LOWER, mix, ngrams, slices, word_hashes, words

BREAKS, GAPS = b".,;:!?\n\x0b\x0c\r", b" \t"
LONGEST = 4
SLICE = 1 << 20
HELD = 1 << 21
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 30
SHARD = 1 << 16
PIECE = 4096

_BREAK = np.zeros(256, bool)
_BREAK[list(BREAKS)] = True
_OUTSIDE = _BREAK.copy()
_OUTSIDE[list(GAPS)] = True


class Bits:
    """Packed bits, which hashes are looked up in."""

    def __init__(self, n: int):
        self.n, self.packed = n, np.zeros(n // 8, np.uint8)

    def test(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & np.uint64(self.n - 1)
        return (self.packed[at >> np.uint64(3)] >> (7 - (at & np.uint64(7))).astype(np.uint8)) & 1 > 0


class _Words:
    """The words of a slice of texts: where they lie, hashes that know their language, and which end a piece."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, seeds: np.ndarray):
        self.buf = buf
        self.starts, self.ends, first = words(buf, offsets, _OUTSIDE)
        n = len(self.starts)
        self.row = np.repeat(np.arange(len(seeds)), np.diff(first))
        self.hashes = word_hashes(buf, self.starts, self.ends) ^ seeds[self.row]
        breaks = np.zeros(len(buf) + 1, np.int64)
        np.cumsum(_BREAK[buf], out=breaks[1:])
        self.last = np.ones(n, bool)
        self.last[:-1] = (breaks[self.starts[1:]] > breaks[self.ends[:-1]]) | (self.row[1:] != self.row[:-1])

    def runs(self, n: int) -> np.ndarray:
        """A hash of the n words from each word on, whatever pieces they are in; a word near the end has none and gets 0."""
        out = np.zeros(len(self.hashes), np.uint64)
        if len(out) >= n:
            out[: len(out) - n + 1] = ngrams(self.hashes, np.array([0, len(out)]), n, short=False)[0]
        return out

    def words(self) -> np.ndarray:
        """Hashes of single words that are unlike those of runs."""
        return mix(self.hashes ^ np.uint64(0x5851F42D4C957F2D))

    def linked(self, flags: Bits) -> np.ndarray:
        """Which words go on to a next one of the same piece, the pair being frequent enough."""
        return flags.test(self.runs(2)) & ~self.last

    def text(self, at: np.ndarray, size: np.ndarray) -> pa.Array:
        """The lower-cased words of runs, joined by spaces."""
        lead = np.cumsum(size) - size
        word = np.repeat(at - lead, size) + np.arange(size.sum())
        length = self.ends[word] - self.starts[word] + 1  # and a space
        total = np.cumsum(length)
        place = np.repeat(self.starts[word] - (total - length), length) + np.arange(total[-1] if len(total) else 0)
        body = LOWER[self.buf[np.minimum(place, len(self.buf) - 1)]]
        body[total - 1] = 32
        stops = total[lead + size - 1]
        kept = np.ones(len(body), bool)
        kept[stops - 1] = False  # the space behind the last word
        offsets = np.zeros(len(at) + 1, np.int64)
        offsets[1:] = stops - np.arange(1, len(at) + 1)
        return pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(body[kept])]).cast(pa.string())


def _read(batch: pa.RecordBatch) -> Iterator[tuple[_Words, list[str]]]:
    """The words of a batch slice by slice, with the languages of their rows."""
    langs = batch.column("lang").to_pylist()
    known = {lang: int.from_bytes(hashlib.md5(lang.encode()).digest()[:8], "little") for lang in set(langs)}
    seeds = np.array([known[lang] for lang in langs], np.uint64)
    for a, b, buf, offsets in slices(batch.column("text"), SLICE):
        pa.default_memory_pool().release_unused()
        found = _Words(buf, offsets, seeds[a:b])
        if len(found.starts):
            yield found, langs[a:b]


def _frequent(texts: DataFrame, hashes: Callable[[_Words], list[np.ndarray]], min_count: int, n: int) -> Bits:
    """Bits of the buckets that ``min_count`` of the hashes fall into.

    Tasks send counts of buckets as bytes in shards of 65,536 buckets, which
    are added up as a stream. The bits, not the counts, come to the driver.
    """
    most = min_count if min_count < 256 else 1 << 31
    kind = np.uint8 if min_count < 256 else np.uint32

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            at, times = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            times = np.minimum(times, most).astype(kind)
            shard, edge = np.unique(at // SHARD, return_index=True)
            low = (at % SHARD).astype(np.uint16)
            spans = zip(edge.tolist(), [*edge[1:].tolist(), len(at)], strict=True)
            return pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array([low[a:b].tobytes() + times[a:b].tobytes() for a, b in spans], pa.binary())], names=["shard", "body"])

        for batch in batches:
            for found, _ in _read(batch):
                held += [(h & np.uint64(n - 1)).astype(np.uint32) for h in hashes(found)]
                if sum(map(len, held)) > HELD:
                    yield flush()
        if sum(map(len, held)):
            yield flush()
        pa.default_memory_pool().release_unused()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(total >= min_count).tobytes()], pa.binary())], names=["shard", "body"])

        for batch in batches:
            for shard, body in zip(batch.column("shard").to_pylist(), batch.column("body").to_pylist(), strict=True):
                if shard != now:
                    if now is not None:
                        yield done()
                    now, total = shard, np.zeros(SHARD, np.int64)
                size = len(body) // (2 + np.dtype(kind).itemsize)
                total[np.frombuffer(body, np.uint16, size)] += np.frombuffer(body, kind, offset=2 * size)
        if now is not None:
            yield done()

    rows = texts.mapInArrow(count, "shard int, body binary").repartition("shard").sortWithinPartitions("shard").mapInArrow(add, "shard int, body binary")
    out = Bits(n)
    for row in rows.toLocalIterator():
        out.packed[row.shard * SHARD // 8 :][: SHARD // 8] = np.frombuffer(row.body, np.uint8)
    return out


def _plain(docs: DataFrame, lang: str, text: str) -> DataFrame:
    c = lambda name: F.col("`" + name.replace("`", "``") + "`")
    return docs.select(F.coalesce(c(lang), F.lit("und")).alias("lang"), c(text).alias("text"))


def runs(docs: DataFrame, min_count: int = 30, lang: str = "lang", text: str = "text") -> DataFrame:
    """Edges of four words, and the shorter ends of runs: lang, gram, size and how often they occur.

    Runs stop at the end of a piece, and at pairs of which no candidate can
    be made. A row of size 0 has all word occurrences of the language.
    """
    texts = _plain(docs, lang, text)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << max(0, size // 16 - 1).bit_length()))
    send = docs.sparkSession.sparkContext.broadcast
    pairs = send(_frequent(texts, lambda w: [w.words(), w.runs(2)[~w.last]], min_count, bits))

    def triples(w: _Words) -> list[np.ndarray]:
        on = w.linked(pairs.value)
        on[:-1] &= on[1:]
        return [w.runs(3)[:-1][on[:-1]]]

    more = send(_frequent(texts, triples, min_count, bits))

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found, langs in _read(batch):
                size = len(found.hashes)
                two, three = np.zeros(size + 1, bool), np.zeros(size + 1, bool)
                two[:size] = found.linked(pairs.value)
                three[:size] = two[:-1] & two[1:] & more.value.test(found.runs(3))
                length = pairs.value.test(found.words()).astype(np.int64)
                length[two[:-1]] = 2
                length[three[:-1]] = 3
                length[three[:-1] & three[1:]] = 4
                keys = found.hashes.copy()
                for n in range(2, LONGEST + 1):
                    keys[length == n] = found.runs(n)[length == n]
                n = np.bincount(found.row, minlength=len(langs))
                yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array([""] * len(n)), pa.array(np.zeros(len(n), np.int32)), pa.array(n)], names=["lang", "gram", "size", "f"])
                at = np.flatnonzero(length)
                _, first, n = np.unique(mix(keys[at] + length[at].astype(np.uint64)), return_index=True, return_counts=True)
                at = at[first]
                for a in range(0, len(at), 5000):
                    some = at[a : a + 5000]
                    code = pa.DictionaryArray.from_arrays(pa.array(found.row[some].astype(np.int32)), pa.array(langs, pa.string()))
                    yield pa.RecordBatch.from_arrays([code.cast(pa.string()), found.text(some, length[some]), pa.array(length[some].astype(np.int32)), pa.array(n[a : a + 5000])], names=["lang", "gram", "size", "f"])

    return texts.mapInArrow(cut_up, "lang string, gram string, size int, f long").groupBy("lang", "gram", "size").agg(F.sum("f").alias("f"))


def _first(gram: Column | str, n: int) -> Column:
    return F.substring_index(gram, " ", n)


def flows(edges: DataFrame) -> dict[int, DataFrame]:
    """Counts of phrases of each length: what flows out of them to longer ones, and what ends in them."""
    out = {LONGEST: edges.where(F.col("size") == LONGEST).select("lang", "gram", "f")}
    for n in range(LONGEST - 1, 0, -1):
        ends = edges.where(F.col("size") == n).select("lang", "gram", "f")
        leaving = out[n + 1].select("lang", _first("gram", n).alias("gram"), "f")
        out[n] = cut(leaving.unionByName(ends).groupBy("lang", "gram").agg(F.sum("f").alias("f")), f"phrases-{n}")
    return out


def compact(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Paths of edges: lang, path (its words), the count of each of its edges, and how many there are.

    ``edges`` and ``nodes`` are frequent phrases of four and three words. An
    edge follows another if it has all the flow of the node between, and so has
    the other. Each edge finds the head of its path by doubling the distance
    it looks back; paths of over ``PIECE`` edges are cut into pieces of that many.
    """
    node = nodes.select("lang", F.col("gram").alias("node"), F.col("f").alias("flow"))
    into = edges.select("lang", F.col("gram").alias("head"), F.substring_index("gram", " ", 1 - LONGEST).alias("node"), "f").join(node, ["lang", "node"]).where("f = flow")
    out = edges.select("lang", "gram", _first("gram", LONGEST - 1).alias("node"), "f")
    followed = out.join(into.select("lang", "node", "head", "flow"), ["lang", "node"]).where("f = flow").select("lang", "gram", "head")
    at = cut(edges.join(followed, ["lang", "gram"], "left").select("lang", "gram", "f", F.coalesce("head", "gram").alias("head"), F.col("head").isNotNull().cast("long").alias("place")), "path-heads")
    while True:
        back = at.select("lang", F.col("gram").alias("head"), F.col("head").alias("further"), F.col("place").alias("more"))
        step = cut(at.join(back, ["lang", "head"]).select("lang", "gram", "f", F.col("further").alias("head"), (F.col("place") + F.col("more")).alias("place"), "more"), "path-heads")
        forget(at)
        moved = not step.where("more > 0").isEmpty()
        at = step.drop("more")
        at.cut_path = step.cut_path
        if not moved:
            break
    rows = at.groupBy("lang", "head", F.floor(F.col("place") / PIECE).alias("piece")).agg(F.sort_array(F.collect_list(F.struct("place", "gram"))).alias("edge"), F.min("f").alias("f"))
    further = F.transform(F.slice("edge", 2, PIECE), lambda e: F.substring_index(e["gram"], " ", -1))
    return rows.select("lang", F.concat_ws(" ", F.col("edge")[0]["gram"], further).alias("path"), "f", F.size("edge").alias("n_edges"))


def _windows(path: Column, n: int, skip: int = 0) -> Column:
    """Runs of n words of a path, but for ``skip`` at either end."""
    word = F.split(path, " ")
    last = F.size(word) - n + 1 - skip
    return F.when(last > skip, F.transform(F.sequence(F.lit(skip + 1), last), lambda k: F.concat_ws(" ", F.slice(word, k, n)))).otherwise(F.array().cast("array<string>"))


def candidates(frequent: dict[int, DataFrame], paths: DataFrame) -> DataFrame:
    """Phrases of two words and more that may not lie inside a longer one of the same count: lang, gram, size, f."""
    longest = paths.select("lang", F.explode(_windows(F.col("path"), LONGEST)).alias("gram"), "f")
    inside = paths.where("n_edges > 1").select("lang", F.explode(_windows(F.col("path"), LONGEST - 1, skip=1)).alias("gram"))
    sized = [longest.withColumn("size", F.lit(LONGEST)), frequent[3].join(inside, ["lang", "gram"], "left_anti").withColumn("size", F.lit(3)), frequent[2].withColumn("size", F.lit(2))]
    return sized[0].unionByName(sized[1]).unionByName(sized[2])


def _wide(value: Column) -> Column:
    return value.cast("decimal(38,0)")


def scored(found: DataFrame, counts: DataFrame) -> DataFrame:
    """Candidates with the cut of lowest score: a, l, r and score."""
    cuts = found.select("lang", "gram", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"), "size")
    halves = cuts.withColumns({"left": F.expr("substring_index(gram, ' ', k)"), "right": F.expr("substring_index(gram, ' ', k - size)")})
    part = lambda side, name: counts.select("lang", F.col("gram").alias(side), F.col("f").alias(name))
    both = halves.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    score = F.expr("CAST(2000000 AS DECIMAL(8,0)) * CAST(a AS DECIMAL(19,0)) DIV (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0)))").cast("long")
    best = F.min(F.struct(score.alias("score"), "k", "l", "r"))
    return both.groupBy("lang", "gram").agg(F.first("a").alias("a"), best.alias("best")).select("lang", "gram", "a", "best.l", "best.r", "best.score")


def unnested(found: DataFrame, share: int = 80) -> DataFrame:
    """``found`` without phrases inside longer ones that have ``share`` percent of their count or more."""
    inner = F.flatten(F.array(*[F.when(F.col("size") > n, _windows(F.col("gram"), n)).otherwise(F.array().cast("array<string>")) for n in range(2, LONGEST)]))
    around = found.where("size > 2").select("lang", F.explode(inner).alias("gram"), F.col("f").alias("outer")).groupBy("lang", "gram").agg(F.max("outer").alias("outer"))
    nested = _wide(F.col("outer")) * 100 >= _wide(F.col("f")) * share
    return found.join(around, ["lang", "gram"], "left").where(~F.coalesce(nested, F.lit(False))).drop("outer")


def mine(docs: DataFrame, min_count: int = 30, top: int = 2000, share: int = 80, lang: str = "lang", text: str = "text") -> DataFrame:
    """The first ``top`` collocations of each language: lang, rank, phrase, a, l, r, n and score."""
    edges = cut(runs(docs, min_count, lang, text), "edges")
    frequent = {n: f.where(F.col("f") >= min_count) for n, f in flows(edges).items()}
    found = cut(candidates(frequent, compact(frequent[4], frequent[3])), "phrases")
    counts = frequent[1].unionByName(frequent[2]).unionByName(frequent[3])
    kept = scored(unnested(found, share), counts)
    order = [F.desc("score"), F.desc("a"), F.asc("gram")]
    dealt = kept.withColumn("part", F.pmod(F.xxhash64("gram"), F.lit(64)))  # a first choice in parts of each language
    some = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    total = edges.where("size = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(total, "lang").select("lang", "rank", F.col("gram").alias("phrase"), "a", "l", "r", "n", "score")
