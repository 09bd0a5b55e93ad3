"""Removing every byte of a string of 400 bytes that starts anywhere else, by suffix sorting.

A suffix array over all bytes of a corpus costs some tens of bytes of shuffle a
byte, so the text is sieved first, without loss. The 400 bytes at a position
have an anchor: the 128-byte substring among them with the smallest hash, the
leftmost if several. Equal strings have equal anchors at the same place.
Neighbouring positions mostly share theirs; such a run of
positions with the bytes they look at is a context. A context whose anchor
occurs once in the corpus has no twin. Equal contexts are all twins of each
other and are settled by counting. What is left are different contexts of one
anchor; they are brought together, and their suffixes are sorted with the
difference cover {1, 2} modulo 3: sampled triples are sorted and named, names
are sorted recursively until they stand for 400 bytes and more, the suffixes at
multiples of three are merged in, and the first 400 bytes of adjacent suffixes
are compared.

Groups of contexts go through the suffix sort in blocks of about a megabyte. An
anchor with more than ``LARGE`` different contexts is not brought to one task:
its contexts are sieved again by themselves with the next longer anchor of
``SEEDS``, which parts them into smaller groups that go the same way. The
longest anchor is the whole string, whose contexts are all equal.

Defined results: null text is empty; matches never cross documents; texts of
fewer than 400 bytes lose nothing and match nothing; repeated rows are copies
of each other, so their long strings go from all of them; a null doc_id is a
document like others; extra columns are kept, but for the four of the
result, which are replaced; an empty table gives an empty result. Where the bytes that stay are not valid UTF-8, their hash and counts are
still those of the bytes; only the text shown replaces the damaged characters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, cut, fresh, widened
from .text import _CODES, mix, powers, slices

LENGTH, SEEDS, LARGE, BLOCK_BYTES = 400, (128, 320, 400), 4096, 1 << 20
#: What tells pieces of texts apart.
PIECE = ("doc_id", "text_hash", "offset")
_MOST, _UPPER = np.iinfo(np.uint64).max, np.uint64(0xFFFFFFFF00000000)


def _window_hashes(buf: np.ndarray, length: int, codes: np.ndarray = _CODES) -> np.ndarray:
    """Hashes of all substrings of ``length`` bytes."""
    up, down = powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(codes[buf] * up[:-1], out=sums[1:])
    return mix((sums[length:] - sums[:-length]) * down[: len(buf) - length + 1])


def _sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    rows = -(-len(h) // width)
    padded = np.full(rows * width, _MOST, np.uint64)
    padded[: len(h)] = h
    table = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(table[:, ::-1], 1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(table, 1).ravel()
    return np.minimum(ahead[: len(h) - width + 1], behind[width - 1 : len(h)])


_OTHER_CODES = mix(_CODES + np.uint64(5)) | np.uint64(1)


def contexts(docs: DataFrame, length: int, seed: int) -> DataFrame:
    """A row per context: doc_id, text_hash, offset, start, run (its number of positions), anchor, and two hashes of its bytes."""
    names = (*PIECE, "start", "run", "anchor", "x1", "x2")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, parts = [], []
        for lo, hi, buf, offsets in slices(batch.column("text")):
            if len(buf) < length:
                continue
            n = len(buf) - length + 1
            h = _window_hashes(buf, seed)
            least = _sliding_min((h & _UPPER) | np.arange(len(h), dtype=np.uint64), length - seed + 1)  # of equal ones the leftmost
            doc = np.repeat(np.arange(hi - lo), np.diff(offsets))[:n]
            whole = offsets[doc + 1] - np.arange(n) >= length
            new = np.ones(n, bool)
            new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1]) | (whole[1:] != whole[:-1])
            begin = np.flatnonzero(new)
            stop = np.append(begin[1:], n)
            fine = whole[begin]
            begin, stop = begin[fine], stop[fine]
            up, down = powers(len(buf) + 1)
            hashes = []
            for codes in (_CODES, _OTHER_CODES):
                sums = np.zeros(len(buf) + 1, np.uint64)
                np.cumsum(codes[buf] * up[:-1], out=sums[1:])
                hashes.append(mix((sums[stop - 1 + length] - sums[begin]) * down[begin] + (stop - begin).astype(np.uint64)))
            rows.append(doc[begin] + lo)
            parts.append((begin - offsets[doc[begin]], stop - begin, h[(least[begin] & ~_UPPER).astype(np.int64)].view(np.int64), *(x.view(np.int64) for x in hashes)))
        at = pa.array(np.concatenate(rows) if rows else np.empty(0, np.int64))
        cols = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.empty(0, np.int64)] * 5
        return pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in PIECE), *(pa.array(c.astype(np.int64)) for c in cols)], names=list(names))

    kind = dict(docs.dtypes)["doc_id"]
    return arrow_map(docs, run, f"doc_id {kind}, text_hash long, offset long, start long, run long, anchor long, x1 long, x2 long")


def suffix_order(s: np.ndarray, top: int, depth: int) -> np.ndarray:
    """Positions of ``s`` (values from 1 to top) in the order of their suffixes, compared up to ``depth`` values or more.

    Suffixes that are equal that far stand together, in any order.
    """
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int32)
    padded = np.zeros(n + 4, np.int32)
    padded[:n] = s
    del s
    sampled = np.concatenate([np.arange(1, n + (n % 3 == 1), 3, dtype=np.int32), np.arange(2, n, 3, dtype=np.int32)])
    base = top + 1
    wide = lambda at: padded[at].astype(np.int64)
    key = wide(sampled) * base + padded[sampled + 1]
    if base**3 >= 2**62:
        key = np.unique(key, return_inverse=True)[1]
    key = key * base + padded[sampled + 2]
    order = np.argsort(key, kind="stable").astype(np.int32)
    key = key[order]
    names = np.empty(len(order), np.int32)
    names[order] = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]]), dtype=np.int32)
    del key
    most = int(names[order[-1]])
    if most < len(order) and depth > 3:
        del order
        order = suffix_order(names, most, -(-depth // 3))
    del names
    rank = np.zeros(n + 4, np.int32)
    rank[sampled[order]] = np.arange(1, len(order) + 1, dtype=np.int32)
    order = sampled[order]
    order = order[order < n]
    many = len(sampled) + 2
    del sampled
    zeros = np.arange(0, n, 3, dtype=np.int32)
    key = wide(zeros) * many + rank[zeros + 1]
    by = np.argsort(key, kind="stable")
    zeros, key = zeros[by], key[by]
    del by
    first, second = order[order % 3 == 1], order[order % 3 == 2]
    # where comparison was cut off, keys of equal suffixes may not rise: their running maximum does
    less = np.searchsorted(np.maximum.accumulate(wide(first) * many + rank[first + 1]), key)
    del key, first
    mine, theirs = wide(second) * base + padded[second + 1], wide(zeros) * base + padded[zeros + 1]
    if base * base >= 2**62 // many:  # pairs of values get names first, so that a key fits 63 bits
        pairs = np.unique(np.concatenate([mine, theirs]), return_inverse=True)[1]
        mine, theirs = pairs[: len(second)], pairs[len(second) :]
    less += np.searchsorted(np.maximum.accumulate(mine * many + rank[second + 2]), theirs * many + rank[zeros + 2])
    del mine, theirs, second, rank, padded
    less = np.maximum.accumulate(less)
    out = np.empty(n, np.int32)
    out[np.arange(len(zeros)) + less] = zeros
    out[np.arange(len(order)) + np.searchsorted(less, np.arange(len(order)), "right")] = order
    return out


def twins(texts: list[bytes], runs: np.ndarray, length: int) -> np.ndarray:
    """For the positions of all contexts in turn, whether their ``length`` bytes start at another of them too."""
    buf = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    opens = np.cumsum(sizes) - sizes
    total = int(runs.sum())
    starts = np.repeat(opens - (np.cumsum(runs) - runs), runs) + np.arange(total)
    place = np.full(len(buf), -1, np.int64)
    place[starts] = np.arange(total)
    order = suffix_order(buf.astype(np.int32) + 1, 256, length)
    order = order[place[order] >= 0]
    h = _window_hashes(buf, length)[order]
    same = h[1:] == h[:-1]
    out = np.zeros(total, bool)
    out[place[order[1:][same]]] = True
    out[place[order[:-1][same]]] = True
    return out


def _intervals(flags: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the bytes that flagged positions cover, a pair for each run of flags."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edges[::2], edges[1::2] - 1 + length


FIELDS = ("doc_id", "text_hash", "begin", "stop")


def _spans(batch: pa.Table, held: list[tuple[int, np.ndarray]], starts: np.ndarray, length: int) -> pa.RecordBatch:
    rows, begin, stop = [], [], []
    for row, flags in held:
        a, b = _intervals(flags, length)
        rows += [row] * len(a)
        begin += (a + starts[row]).tolist()
        stop += (b + starts[row]).tolist()
    at = pa.array(rows, pa.int64())
    own = [batch[c].combine_chunks().take(at) if isinstance(batch[c], pa.ChunkedArray) else batch[c].take(at) for c in FIELDS[:2]]
    return pa.RecordBatch.from_arrays([*own, pa.array(begin, pa.int64()), pa.array(stop, pa.int64())], names=list(FIELDS))


def sorted_twins(rows: DataFrame, length: int) -> DataFrame:
    """Covered bytes of contexts (doc_id, text_hash, start, run, anchor, x, bytes) of anchors with a bounded number x of them."""
    kind = dict(rows.dtypes)["doc_id"]

    def solve(table: pa.Table) -> pa.RecordBatch:
        runs = table["run"].to_numpy()
        flags = twins(table["bytes"].to_pylist(), runs, length)
        ends = np.cumsum(runs)
        hit = np.flatnonzero(np.add.reduceat(flags, ends - runs, dtype=np.int64))
        return _spans(table, [(int(r), flags[ends[r] - runs[r] : ends[r]]) for r in hit], table["start"].to_numpy(), length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for batch in batches:
            anchors, known = batch.column("anchor").to_numpy(), batch.column("x").to_numpy()
            edges = [0, *(np.flatnonzero(anchors[1:] != anchors[:-1]) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if held and anchors[a] != last and size + known[a] * 3 * length // 2 > BLOCK_BYTES:  # the group's bytes, about
                    yield solve(pa.Table.from_batches(held))
                    held, size = [], 0
                last = anchors[a]
                held.append(batch.slice(a, b - a))
                size += int(np.sum(held[-1].column("run").to_numpy())) + (length - 1) * (b - a)
        if held:
            yield solve(pa.Table.from_batches(held))

    return rows.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, f"doc_id {kind}, text_hash long, begin long, stop long")


def fetched(pieces: DataFrame, asked: DataFrame, length: int) -> DataFrame:
    """Contexts (doc_id, text_hash, offset, start, run, anchor, x) with their bytes; ``start`` now counts from the text's begin."""
    kind = dict(pieces.dtypes)["doc_id"]
    own = [f"own_{c}" for c in PIECE]
    per_piece = asked.groupBy(*(F.col(c).alias(o) for c, o in zip(PIECE, own, strict=True))).agg(F.collect_list(F.struct("start", "run", "anchor", "x")).alias("asked"))
    same = F.col("doc_id").eqNullSafe(F.col(own[0])) & (F.col("text_hash") == F.col(own[1])) & (F.col("offset") == F.col(own[2]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, fields, parts = [], [], []
        for row, (body, base, wanted) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("text", "offset", "asked")), strict=True)):
            for w in wanted:
                at.append(row)
                fields.append((base + w["start"], w["run"], w["anchor"], w["x"]))
                parts.append(body[w["start"] : w["start"] + w["run"] + length - 1])
        rows = pa.array(at, pa.int64())
        numbers = [pa.array(c, pa.int64()) for c in (zip(*fields, strict=True) if fields else ([],) * 4)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), batch.column("text_hash").take(rows), *numbers, pa.array(parts, pa.binary())], names=["doc_id", "text_hash", "start", "run", "anchor", "x", "bytes"])

    joined = pieces.join(per_piece, same).select(*PIECE, "text", "asked")
    return cut(arrow_map(joined, run, f"doc_id {kind}, text_hash long, start long, run long, anchor long, x long, bytes binary"), "context-bytes")


def covered(pieces: DataFrame, length: int = LENGTH, seeds: tuple[int, ...] = SEEDS, large: int = LARGE) -> DataFrame:
    """doc_id, text_hash, begin and stop of byte ranges that together cover what is to go.

    ``pieces`` has doc_id, text_hash, the bytes ``text`` of a part of the text,
    and the ``offset`` where that part begins in it.
    """
    seed, *longer = seeds
    rows = cut(contexts(pieces, length, seed), "contexts")
    place = F.struct(*PIECE, "start", "run")
    same = cut(rows.groupBy("anchor", "x1", "x2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("head")), "distinct-contexts")
    equal = rows.join(same.where("n > 1").select("anchor", "x1", "x2"), ["anchor", "x1", "x2"])
    begin = F.col("offset") + F.col("start")
    out = equal.select("doc_id", "text_hash", begin.alias("begin"), (begin + F.col("run") + (length - 1)).alias("stop"))
    groups = same.groupBy("anchor").agg(F.count(F.lit(1)).alias("x")).where("x > 1")
    left = fetched(pieces, same.join(groups, "anchor").select("head.*", "anchor", "x"), length)
    out = out.unionByName(sorted_twins(left.where(F.col("x") <= large), length))
    huge = left.where(F.col("x") > large)
    if huge.isEmpty():
        return out
    return out.unionByName(covered(huge.select("doc_id", "text_hash", F.col("start").alias("offset"), F.col("bytes").alias("text")), length, tuple(longer), large))


def drop_substrings(docs: DataFrame, length: int = LENGTH, seeds: tuple[int, ...] = SEEDS, large: int = LARGE) -> DataFrame:
    """All columns of ``docs`` with the kept text, and n_bytes, n_removed, n_spans and kept_sha256."""
    docs = docs.drop("n_bytes", "n_removed", "n_spans", "kept_sha256")
    columns = docs.columns
    own_id, own_hash, own_ranges = fresh(docs, "own_id", "own_hash", "own_ranges")
    text_hash = F.xxhash64(F.col("text").cast("string"))
    pieces = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text"), text_hash.alias("text_hash"), F.lit(0).cast("long").alias("offset"))
    ranges = covered(pieces, length, tuple(min(s, length) for s in seeds), large)
    found = ranges.groupBy(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash)).agg(F.collect_list(F.struct("begin", "stop")).alias(own_ranges))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept, size, removed, spans, digests = [], [], [], [], []
        for text, ranges in zip(batch.column("text").to_pylist(), batch.column(own_ranges), strict=True):
            body = (text or "").encode()
            size.append(len(body))
            n = gone = at = 0
            if (ranges := ranges.as_py()) is not None:
                out = []
                stop = -1
                for r in sorted((r["begin"], r["stop"]) for r in ranges):
                    if r[0] > stop:
                        n += 1
                        out.append(body[at : r[0]])
                    stop = at = max(stop, r[1])
                out.append(body[at:])
                rest = b"".join(out)
                gone = len(body) - len(rest)
            else:
                rest = body
            removed.append(gone)
            spans.append(n)
            digests.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest.decode("utf-8", "replace") if gone else text or "")
        own = [pa.array(kept, pa.string()) if c == "text" else batch.column(c) for c in columns]
        long = lambda v: pa.array(v, pa.int64())
        return pa.RecordBatch.from_arrays([*own, long(size), long(removed), long(spans), pa.array(digests, pa.string())], names=[*columns, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    joined = docs.join(found, F.col("doc_id").eqNullSafe(F.col(own_id)) & (text_hash == F.col(own_hash)), "left").drop(own_id, own_hash)
    return arrow_map(joined, run, widened(docs, "n_bytes long, n_removed long, n_spans long, kept_sha256 string"))
