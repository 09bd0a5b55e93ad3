"""Exact top-k search by MaxScore over integer vectors.

A dimension is a term, its posting list holds the rows whose component is not
zero, and a row's score is the inner product with the query. A term can add at
most a bound: the query's component times the largest or smallest of the
list's. With the terms in falling order of their bounds, those at the end that
together stay below the score to beat are not essential: a row on no other
list can't win. Lists of essential terms are traversed; rows that the rest can
still lift to the score to beat are probed in the other terms, a few at a
time, and leave as soon as they can't reach it.

Rows are dealt into shards by their place, so no id, label or group of copies
makes a shard large, and each shard gets the queries in blocks. Shards are
searched in waves, each eight times as many as all before, and the winners of a
wave set the score to beat in the next: a query keeps ``k`` rows, and gets ``k``
a shard of a wave at most. A list that a quarter of a shard's rows are on is
kept as a column, and the columns are traversed for many queries at once.

Defined results: vectors that are null, or hold null or non-finite components,
take no part; components are floor(``scale`` * x), x in double precision.
Components that a vector lacks, because others are longer, are zero, so an
empty vector scores 0 with all. Repeated rows each count, as query and as
candidate; a row is only kept from itself. Of equal scores the smaller id comes
first, null last; a null id is no query unless the condition says so. With fewer
than ``k`` other rows all are returned; an empty table gives no rows. Other
columns are ignored, whatever their names. Ids are integers. Scores have to fit
64 bits, or the job fails with an OverflowError.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SHARD_COMPONENTS = 1 << 20
BLOCK = 65_536
WAVE = 8
BATCH = 64
PROBES = 8
#: Terms are essential until the others stay below this part of the score to beat; 1 would do, less spares probes.
SLACK = 0.5


def weights(vectors: DataFrame, is_query: Column, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 64) -> DataFrame:
    """The vectors that take part, as integers: row_id, vec_id, asks and w."""
    name = lambda c: F.col("`" + c.replace("`", "``") + "`")
    v = name(embedding).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
    ints = F.transform(v, lambda x: F.floor(x * scale))
    rows = vectors.where(v.isNotNull() & fine)
    return rows.select(F.monotonically_increasing_id().alias("row_id"), name(vec_id).cast("long").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("asks"), ints.alias("w"))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Components of all vectors, and where each begins (and the last ends)."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], (offsets - offsets[0]).astype(np.int64)


class Shard:
    """Posting lists by dimension, and the vectors themselves for probes."""

    def __init__(self, rows: pa.Table):
        rows = rows.combine_chunks()
        self.rid = rows["row_id"].to_numpy()
        self.ids = rows["vec_id"].combine_chunks()
        self.flat, at = _lists(rows["w"].combine_chunks())
        self.start, self.length = at[:-1], np.diff(at)
        self.n, self.width = len(self.rid), int(self.length.max(initial=0))
        row = np.repeat(np.arange(self.n), self.length)
        term = np.arange(len(self.flat)) - np.repeat(self.start, self.length)
        some = np.flatnonzero(self.flat)
        order = some[np.argsort(term[some], kind="stable")]
        self.docs, self.values = row[order], self.flat[order]
        self.edges = np.searchsorted(term[order], np.arange(self.width + 1))
        self.high, self.low = np.zeros(self.width, np.int64), np.zeros(self.width, np.int64)
        np.maximum.at(self.high, term[some], self.flat[some])
        np.minimum.at(self.low, term[some], self.flat[some])
        self.largest = np.maximum(self.high.astype(float), -self.low.astype(float))
        size = np.diff(self.edges)
        self.common = np.flatnonzero(4 * size >= max(1, self.n))
        self.columns = np.zeros((self.n, len(self.common)), np.int64)
        for k, t in enumerate(self.common.tolist()):
            self.columns[self.docs[self.edges[t] : self.edges[t + 1]], k] = self.values[self.edges[t] : self.edges[t + 1]]
        self.exact = self.columns.astype(float)
        sparse = np.ones(self.width, bool)
        sparse[self.common] = False
        self.rare = np.flatnonzero(sparse & (size > 0))
        order = np.lexsort((self.ids.fill_null(0).to_numpy(zero_copy_only=False), self.ids.is_null().to_numpy(zero_copy_only=False)))
        self.place = np.empty(self.n, np.int64)  # of each row by id, null last
        self.place[order] = np.arange(self.n)

    def probe(self, rows: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """Components of rows in some dimensions."""
        at = self.start[rows][:, None] + terms
        inside = terms < self.length[rows][:, None]
        return np.where(inside, self.flat[np.minimum(at, len(self.flat) - 1)], 0)

    def search(self, rid: np.ndarray, queries: list[np.ndarray], least: list[int | None], k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query its number, the rows that may be among its first ``k``, best first, and their scores."""
        wide = np.zeros((len(queries), self.width), np.int64)
        for i, q in enumerate(queries):
            wide[i, : min(len(q), self.width)] = q[: self.width]
        reach = (np.abs(wide.astype(float)) * self.largest).sum(axis=1)
        if reach.max(initial=0) >= 2.0**62:
            raise OverflowError("inner products don't fit 64 bits")
        bounds = np.maximum(wide * self.high, wide * self.low)  # at least 0, as low <= 0 <= high
        order = np.argsort(-bounds, axis=1, kind="stable")
        falling = np.take_along_axis(bounds, order, axis=1)
        rest = np.concatenate([np.cumsum(falling[:, ::-1], axis=1)[:, ::-1], np.zeros((len(queries), 1), np.int64)], axis=1)
        first = np.full(len(queries), self.width)
        for i, score in enumerate(least):
            if score is not None and score > 0:
                first[i] = int(np.argmax(rest[i] < max(1, score * SLACK)))
        essential = np.zeros(wide.shape, bool)
        np.put_along_axis(essential, order, np.arange(self.width) < first[:, None], axis=1)
        asked = np.where(essential, wide, 0)
        if reach.max(initial=0) < 2.0**53:
            sums = (asked[:, self.common].astype(float) @ self.exact.T).astype(np.int64)
        else:
            sums = asked[:, self.common] @ self.columns.T
        for i in range(len(queries)):
            total = sums[i]
            for t in self.rare[asked[i, self.rare] != 0].tolist():
                a, b = self.edges[t], self.edges[t + 1]
                total[self.docs[a:b]] += asked[i, t] * self.values[a:b]
            left = int(rest[i, first[i]])
            score = least[i]
            rows = np.flatnonzero((total + left >= score) if score is not None else np.ones(self.n, bool))
            rows = rows[self.rid[rows] != rid[i]]
            found = total[rows]
            for a in range(int(first[i]), self.width, PROBES):
                if not len(rows) or not left:
                    break
                terms = order[i, a : a + PROBES]
                found = found + self.probe(rows, terms) @ wide[i, terms]
                left = int(rest[i, min(a + PROBES, self.width)])
                going = found + left >= score
                rows, found = rows[going], found[going]
            if left == 0 and len(rows):  # bounds of 0: what is left can only lower a score
                terms = order[i, min(self.width, self._done(rest[i], first[i])) :]
                terms = terms[wide[i, terms] != 0]
                for a in range(0, len(terms), PROBES):
                    found = found + self.probe(rows, terms[a : a + PROBES]) @ wide[i, terms[a : a + PROBES]]
                if score is not None:
                    rows, found = rows[found >= score], found[found >= score]
            best = np.lexsort((self.place[rows], -found))[:k]
            yield i, rows[best], found[best]

    def _done(self, rest: np.ndarray, first: int) -> int:
        """Up to which term the probes went: blocks from ``first`` until nothing was left to gain."""
        at = int(first)
        while at < self.width and rest[at] > 0:
            at += PROBES
        return at


def _search(rows: DataFrame, queries: DataFrame, shards: tuple[int, int], n_shards: int, blocks: int, k: int) -> DataFrame:
    """The first ``k`` rows of each query in each of some shards, but for rows below its score to beat: query, query_id, vec_id, score."""
    shard, block = F.pmod("row_id", F.lit(n_shards)), F.pmod("row_id", F.lit(blocks))
    kept = rows.withColumn("shard", shard).where((F.col("shard") >= shards[0]) & (F.col("shard") < shards[1]))
    spread = kept.select(F.explode(F.sequence(F.col("shard") * blocks, F.col("shard") * blocks + (blocks - 1))).alias("pair"), F.lit(0).alias("asks"), "row_id", "vec_id", "w", F.lit(None).cast("long").alias("least"))
    pairs = F.transform(F.sequence(F.lit(shards[0]).cast("long"), F.lit(shards[1] - 1).cast("long")), lambda s: s * blocks + block)
    asked = queries.select(F.explode(pairs).alias("pair"), F.lit(1).alias("asks"), "row_id", "vec_id", "w", "least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now, shard = None, None
        for batch in batches:
            pairs, asks = batch.column("pair").to_numpy(), batch.column("asks").to_numpy()
            if not len(pairs):
                continue
            edges = [0, *(np.flatnonzero((pairs[1:] != pairs[:-1]) | (asks[1:] != asks[:-1])) + 1).tolist(), len(pairs)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if pairs[a] != now:
                    now, shard = pairs[a], None
                    held.clear()
                part = batch.slice(a, b - a)
                if not asks[a]:
                    held.append(part)
                    continue
                if shard is None and held:
                    shard = Shard(pa.Table.from_batches(held))
                    held.clear()
                if shard is None:
                    continue
                for at in range(0, part.num_rows, BATCH):
                    some = part.slice(at, BATCH)
                    flat, starts = _lists(some.column("w"))
                    vectors = [flat[x:y] for x, y in zip(starts[:-1], starts[1:], strict=True)]
                    numbers, ids, scores = [], [], []
                    for i, hits, found in shard.search(some.column("row_id").to_numpy(), vectors, some.column("least").to_pylist(), k):
                        numbers.append(np.full(len(hits), i))
                        ids.append(hits)
                        scores.append(found)
                    who = pa.array(np.concatenate(numbers))
                    yield pa.RecordBatch.from_arrays([some.column("row_id").take(who), some.column("vec_id").take(who), shard.ids.take(pa.array(np.concatenate(ids))), pa.array(np.concatenate(scores))], names=["query", "query_id", "vec_id", "score"])

    both = spread.unionByName(asked).repartition("pair").sortWithinPartitions("pair", "asks")
    return both.mapInArrow(run, "query long, query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 64) -> DataFrame:
    """The ``k`` best other rows of each row that ``is_query`` holds for: query_id, rank, vec_id and score."""
    rows = cut(weights(vectors, is_query, vec_id, embedding, scale), "weights")
    size = rows.agg(F.sum(F.size("w") + 1).alias("components"), F.count_if("asks").alias("queries")).first()
    n_shards = max(1, math.ceil((size["components"] or 0) / SHARD_COMPONENTS))
    blocks = max(1, math.ceil(size["queries"] / BLOCK))
    queries = rows.where("asks").select("row_id", "vec_id", "w")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    best, low, high = None, 0, 1
    while low < n_shards:
        if best is None:
            asking = queries.withColumn("least", F.lit(None).cast("long"))
        else:
            least = best.groupBy("query").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k)
            asking = queries.join(least.select(F.col("query").alias("row_id"), "least"), "row_id", "left")
        found = _search(rows, asking, (low, min(high, n_shards)), n_shards, blocks, k)
        best = ranked(found if best is None else best.drop("rank").unionByName(found))
        low, high = high, high * WAVE
        if low < n_shards:
            best = cut(best, "best")
    return best.select("query_id", "rank", "vec_id", "score")
