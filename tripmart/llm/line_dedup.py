"""Line dedup with a sharded minimal perfect hash.

The distinct keys of long lines are dealt by hash into shards of about 65,536
keys. Each shard gets a minimal perfect hash, and behind it arrays of
fingerprints, document counts and keepers (the largest doc_id). Documents do
not join lines: their key hashes stream past the arrays of their shard. A shard
has as many salted partitions as its measured number of probes asks for, about
a million each, so that a line found in a third of all documents does not meet
in one task. Only hits go back to the documents.

A key is known by 128 bits of hash: the lower half drives the perfect hash, the
upper half is the fingerprint. Keys of one document alone are not indexed; the
fingerprint turns their probes away.

Defined results: null and empty text is one empty line; rows of one doc_id are
one document for the counts, and lose the same lines; a null doc_id counts as
no document and is never a keeper, and such rows are told apart by their texts; extra columns are kept as they are, but for
n_lines and n_dropped, which are replaced; an empty table gives an empty result. A doc_id that is no
integer raises an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .common import arrow_map, cut, fresh, widened
from .text import SPACES, mix

MIN_CHARS, MIN_DOCS, SHARD_KEYS, TASK_PROBES = 40, 5, 1 << 16, 1 << 20
_MASK = (1 << 64) - 1


def line_hash(line: bytes, min_chars: int) -> int | None:
    """128 bits of a line's key; None where the key is shorter than ``min_chars`` code points."""
    key = line.strip(SPACES)
    if len(key) < min_chars:
        return None
    if not key.isascii() and len(key.decode()) < min_chars:
        return None
    return xxhash.xxh3_128_intdigest(key.lower())  # bytes: A-Z only


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: in each level, keys alone at their bit settle there."""

    GAMMA, LEVELS = 2, 40

    def __init__(self, keys: np.ndarray):
        self.bits: list[np.ndarray] = []
        rest = keys
        for level in range(self.LEVELS):
            if not len(rest):
                break
            size = max(8, self.GAMMA * len(rest))
            at = self.place(rest, level, size)
            alone = np.bincount(at, minlength=size) == 1
            self.bits.append(np.packbits(alone))
            rest = rest[~alone[at]]
        self.rest = np.sort(rest)  # equal halves of different keys only

    @staticmethod
    def place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return ((mix(keys + np.uint64(0x9E3779B97F4A7C15 * (level + 1) & _MASK)) >> np.uint64(11)) % np.uint64(size)).astype(np.int64)

    def ready(self) -> "PerfectHash":
        """Unpack the bits and add up ranks, once for many probes."""
        self.flat, self.rank, base = [], [], 0
        for packed in self.bits:
            flags = np.unpackbits(packed).astype(bool)
            ranks = np.cumsum(flags) - 1 + base
            base += int(flags.sum())
            self.flat.append(flags)
            self.rank.append(ranks)
        self.base = base
        return self

    def find(self, keys: np.ndarray, sizes: list[int]) -> np.ndarray:
        """The index of each key; -1 for some that are not in the set, any index for others."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, (flags, ranks) in enumerate(zip(self.flat, self.rank, strict=True)):
            at = self.place(keys[open_], level, sizes[level])
            hit = flags[at]
            out[open_[hit]] = ranks[at[hit]]
            open_ = open_[~hit]
        return out


def pack_shard(lo: np.ndarray, hi: np.ndarray, count: np.ndarray, keeper: np.ndarray) -> dict[str, bytes]:
    """The arrays of one shard, in the order of its perfect hash."""
    lo, hi = lo.astype(np.uint64), hi.astype(np.uint64)
    mph = PerfectHash(lo).ready()
    sizes, rest = [], len(lo)
    for flags in mph.flat:
        sizes.append(max(8, PerfectHash.GAMMA * rest))
        rest -= int(flags.sum())
    at = mph.find(lo, sizes)
    left = at < 0  # keys whose lower halves are equal: kept apart and compared in full
    order = np.argsort(at[~left], kind="stable")
    take = np.flatnonzero(~left)[order]
    return {
        "levels": b"".join(b.tobytes() for b in mph.bits), "sizes": np.array(sizes, np.int64).tobytes(),
        "fingerprints": hi[take].tobytes(), "counts": np.minimum(count[take], 2**32 - 1).astype(np.uint32).tobytes(), "keepers": keeper[take].astype(np.int64).tobytes(),
        "apart": np.column_stack([lo[left], hi[left], count[left].astype(np.uint64), keeper[left].astype(np.int64).view(np.uint64)]).tobytes(),
    }


class Shard:
    """A shard's arrays, ready for probes."""

    def __init__(self, row: dict[str, bytes]):
        self.sizes = np.frombuffer(row["sizes"], np.int64).tolist()
        self.mph = PerfectHash(np.empty(0, np.uint64))
        at = 0
        for size in self.sizes:
            n = (size + 7) // 8
            self.mph.bits.append(np.frombuffer(row["levels"][at : at + n], np.uint8))
            at += n
        self.mph.ready()
        self.fingerprints = np.frombuffer(row["fingerprints"], np.uint64)
        self.counts = np.frombuffer(row["counts"], np.uint32)
        self.keepers = np.frombuffer(row["keepers"], np.int64)
        self.apart = {(int(a), int(b)): (int(c), int(np.uint64(d).astype(np.int64))) for a, b, c, d in np.frombuffer(row["apart"], np.uint64).reshape(-1, 4)}

    def probe(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document count (0: not indexed) and keeper of each key."""
        count, keeper = np.zeros(len(lo), np.int64), np.zeros(len(lo), np.int64)
        at = self.mph.find(lo, self.sizes)
        if len(self.fingerprints):
            hit = (at >= 0) & (self.fingerprints[at] == hi)
            count[hit], keeper[hit] = self.counts[at[hit]], self.keepers[at[hit]]
        if self.apart:
            for k, key in enumerate(zip(lo.tolist(), hi.tolist(), strict=True)):
                if key in self.apart:
                    count[k], keeper[k] = self.apart[key]
        return count, keeper


def _row_hash() -> Column:
    return F.when(F.col("doc_id").isNull(), F.xxhash64(F.col("text").cast("string"))).otherwise(F.lit(0).cast("long"))


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, text_hash (of rows without a doc_id, else 0) and the two hash halves of each distinct long line of each row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, lo, hi = [], [], []
        for row, text in enumerate(batch.column("text").to_pylist()):
            if text and len(text) >= min_chars:
                for h in {h for line in text.encode().split(b"\n") if (h := line_hash(line, min_chars)) is not None}:
                    rows.append(row)
                    lo.append(h & _MASK)
                    hi.append(h >> 64)
        signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
        at = pa.array(rows, pa.int64())
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("text_hash").take(at), signed(lo), signed(hi)], names=["doc_id", "text_hash", "lo", "hi"])

    return arrow_map(docs.select("doc_id", _row_hash().alias("text_hash"), F.col("text").cast("string")), run, f"doc_id {dict(docs.dtypes)['doc_id']}, text_hash long, lo long, hi long")


def index(keys: DataFrame, shard_keys: int = SHARD_KEYS, task_probes: int = TASK_PROBES) -> tuple[DataFrame, DataFrame, int]:
    """A row of arrays per shard over the keys of two documents or more; the number of partitions (salts) of each shard; the number of shards."""
    seen = Observation()
    counted = keys.observe(seen, F.count(F.lit(1)).alias("probes")).groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("probes"), F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("keeper"))
    distinct = cut(counted.where("n > 1"), "line-keys")
    size = distinct.agg(F.count(F.lit(1)), F.coalesce(F.sum("probes"), F.lit(0))).first()
    shards = max(1, math.ceil(size[0] / shard_keys))
    others = max(0, seen.get["probes"] - size[1]) / shards if size[0] else 0  # spread evenly by their hashes
    names = ("levels", "sizes", "fingerprints", "counts", "keepers", "apart")

    def build(part: pd.DataFrame) -> pd.DataFrame:
        cols = [part[c].to_numpy() for c in ("lo", "hi", "n", "keeper")]
        packed = pack_shard(cols[0].view(np.uint64), cols[1].view(np.uint64), cols[2], cols[3])
        return pd.DataFrame({"shard": [part["shard"].iloc[0]], **{k: [packed[k]] for k in names}})

    dealt = distinct.withColumn("shard", F.pmod(F.col("hi"), F.lit(shards)))
    loads = dealt.groupBy("shard").agg(F.ceil((F.sum("probes") + F.lit(others)) / task_probes).cast("int").alias("salts"))
    arrays = dealt.drop("probes").groupBy("shard").applyInPandas(build, "shard long, " + ", ".join(f"{k} binary" for k in names))
    return arrays, cut(loads, "shard-loads"), shards


def hits(keys: DataFrame, arrays: DataFrame, loads: DataFrame, shards: int, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, text_hash, lo and hi of the lines to drop: keys stream past the arrays of their shard."""
    names = [c for c in arrays.columns if c != "shard"]
    kind = dict(keys.dtypes)["doc_id"]
    none = F.lit(None)
    fields = ("doc_id", "text_hash", "lo", "hi")
    empty = [none.cast(kind).alias("doc_id"), *(none.cast("long").alias(c) for c in fields[1:])]
    tables = arrays.join(loads, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), *empty, *names)
    probes = keys.withColumn("shard", F.pmod("hi", F.lit(shards))).join(loads, "shard")
    probes = probes.select("shard", F.pmod(F.xxhash64("doc_id", "text_hash"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("kind"), *fields, *[none.cast("binary").alias(c) for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, loaded = None, None
        for batch in batches:
            kinds, owner = batch.column("kind").to_numpy(), batch.column("shard").to_numpy()
            lo, hi = (batch.column(c).fill_null(0).to_numpy().view(np.uint64) for c in ("lo", "hi"))
            ids = batch.column("doc_id")
            drop = np.zeros(batch.num_rows, bool)
            cuts = np.flatnonzero((owner[1:] != owner[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if kinds[a] == 0:
                    now, loaded = owner[a], Shard({c: batch.column(c)[a].as_py() for c in names})
                elif now == owner[a]:
                    count, keeper = loaded.probe(lo[a:b], hi[a:b])
                    own = ids.slice(a, b - a)
                    same = np.asarray(own.fill_null(0)) == keeper
                    drop[a:b] = (count >= min_docs) & ~(same & np.asarray(own.is_valid()))
            at = pa.array(np.flatnonzero(drop))
            yield pa.RecordBatch.from_arrays([batch.column(c).take(at) for c in fields], names=list(fields))

    both = tables.unionByName(probes).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")
    return both.mapInArrow(run, f"doc_id {kind}, text_hash long, lo long, hi long")


def drop_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, shard_keys: int = SHARD_KEYS, task_probes: int = TASK_PROBES) -> DataFrame:
    """All columns of ``docs`` with the kept text, and n_lines and n_dropped."""
    docs = docs.drop("n_lines", "n_dropped")
    keys = line_keys(docs, min_chars)
    own_id, own_hash, drop = fresh(docs, "own_id", "own_hash", "drop")
    per_doc = hits(keys, *index(keys, shard_keys, task_probes), min_docs).groupBy(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash)).agg(F.collect_set(F.struct("lo", "hi")).alias(drop))
    names = docs.columns

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept, lines, dropped = [], [], []
        for text, gone in zip(batch.column("text").to_pylist(), batch.column(drop).to_pylist(), strict=True):
            parts = (text or "").encode().split(b"\n")
            lines.append(len(parts))
            if gone:
                gone = {(g["lo"] & _MASK) | (g["hi"] & _MASK) << 64 for g in gone}
                parts = [p for p in parts if (h := line_hash(p, min_chars)) is None or h not in gone]
            dropped.append(lines[-1] - len(parts))
            kept.append(b"\n".join(parts).decode())
        own = [pa.array(kept, pa.string()) if c == "text" else batch.column(c) for c in names]
        return pa.RecordBatch.from_arrays([*own, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], names=[*names, "n_lines", "n_dropped"])

    same = F.col("doc_id").eqNullSafe(F.col(own_id)) & (_row_hash() == F.col(own_hash))
    joined = docs.join(per_doc, same, "left").drop(own_id, own_hash)
    return arrow_map(joined, run, widened(docs, "n_lines long, n_dropped long"))
