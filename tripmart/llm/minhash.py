"""MinHash near-dedup with tensored banding, every link confirmed on full sets.

Two collections of twelve sub-keys are drawn, each of three minhashes. A table
key is a pair of sub-keys, one of each collection: 72 minhashes give 144 tables
of six rows, where plain banding would need 864. A pair at a similarity of 0.8
shares a key with a probability of 0.9996, at 0.85 of 0.99998.

Documents with equal sets form a class and are searched once. Sub-keys that one
class alone has are left out before the pairs are made. Classes that share a table key with a bucket's smallest member form a candidate group; links
are then confirmed inside the group, on full shingle sets and in blocks of
bounded size: first every block in itself, then, where a group has several
blocks, the members outside its largest component against all its blocks.
Members that are connected already need no further comparison, so copies are
never expanded into all pairs, and components are those of the whole graph.

Groups are transitive, so chance candidates could chain many of them. In a group
of more than ``WIDE`` blocks only members that share a table key are compared:
the second step then goes over its buckets, those that hold several components,
instead of over the group.

Defined results: a text with fewer words than a shingle is one shingle; without
words, or null, the set is empty and linked with nothing; a null doc_id has no
component and is kept; rows of one doc_id are one document, but each row is
placed, and kept or not, by its own text; extra columns are ignored by
``near_duplicates`` and kept by ``keep_one``; an empty table gives an empty result.
A doc_id that is no integer raises an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, cut, fresh, grouped, record
from .components import components
from .text import mix, ngrams, slices, word_hashes, words

COLLECTION, ROWS, BLOCK, WIDE = 12, 3, 256, 64
_RNG = np.random.default_rng(8)
_A = _RNG.integers(1, 2**63, 2 * COLLECTION * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, 2 * COLLECTION * ROWS, dtype=np.uint64)


def shingle_sets(column: pa.Array, k: int):
    """(row, sorted distinct shingle hashes) of every text."""
    for lo, hi, buf, offsets in slices(column):
        starts, ends, first = words(buf, offsets)
        values, _, bounds = ngrams(word_hashes(buf, starts, ends), first, k)
        for row in range(lo, hi):
            yield row, np.unique(values[bounds[row - lo] : bounds[row - lo + 1]])


def set_digest(values: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(values.tobytes())


def sub_keys(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of 2 x COLLECTION sub-keys for each non-empty run of shingle hashes."""
    out = np.empty((len(bounds), 2 * COLLECTION), np.uint64)
    for key in range(2 * COLLECTION):
        folded = np.full(len(bounds), key + 1, np.uint64)
        for r in range(ROWS):
            at = key * ROWS + r
            folded = mix(folded * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(values * _A[at] + _B[at], bounds))
        out[:, key] = folded
    return out


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, digest of the set, and its sub-keys (null for an empty set)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, digests, keys = np.zeros(batch.num_rows, np.int64), [], []
        held, at, total = [], [], 0

        def flush() -> None:
            nonlocal held, at, total
            if held:
                keys.append(sub_keys(np.concatenate(held), np.array(at)))
            held, at, total = [], [], 0

        for row, values in shingle_sets(batch.column("text"), k):
            sizes[row] = len(values)
            digests.append(set_digest(values))
            if len(values):
                at.append(total)
                held.append(values)
                total += len(values)
                if total > 1 << 18:
                    flush()
        flush()
        some = sizes > 0
        flat = np.concatenate(keys).view(np.int64).ravel() if keys else np.empty(0, np.int64)
        offsets = np.concatenate([[0], np.cumsum(some * 2 * COLLECTION)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
        return record(doc_id=batch.column("doc_id"), text_hash=batch.column("text_hash"), n_shingles=sizes, digest=pa.array(digests, pa.binary()), keys=lists)

    hashed = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    return arrow_map(hashed, run, f"doc_id {dict(docs.dtypes)['doc_id']}, text_hash long, n_shingles long, digest binary, keys array<long>")


def _shared(classes: DataFrame) -> DataFrame:
    """cid and those sub-keys of either collection (``left``, ``right``) that another class has too: only they can meet in a table."""
    subs = classes.select("cid", F.posexplode("keys").alias("place", "sub"))
    common = subs.groupBy("sub").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("sub")
    side = lambda of, name: F.collect_list(F.when(of, F.col("sub"))).alias(name)
    first = F.col("place") < COLLECTION
    return subs.join(common.hint("merge"), "sub").groupBy("cid").agg(side(first, "left"), side(~first, "right"))


def _tables(classes: DataFrame, *more: str) -> DataFrame:
    """cid, further columns, and the table keys: every pair of a sub-key of either collection."""
    pairs = classes.select("cid", *more, F.explode("left").alias("a"), "right").select("cid", *more, "a", F.explode("right").alias("b"))
    return pairs.select("cid", *more, F.xxhash64("a", "b").alias("key"))


def link_sets(sets: list[np.ndarray], labels: np.ndarray, query: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs (i, j) that join different labels, tested with at least one of them a query; labels are merged on the way."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    bounds = np.concatenate([[0], np.cumsum(size)])
    flat = np.concatenate(sets)
    labels = labels.copy()
    found = []
    for i in np.flatnonzero(query):
        other = np.flatnonzero((labels != labels[i]) & (100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i])))
        other = other[(other > i) | ~query[other]]
        if not len(other):
            continue
        if 4 * len(other) > n:
            at = np.searchsorted(sets[i], flat)
            same = sets[i][np.minimum(at, size[i] - 1)] == flat
            both = np.add.reduceat(same, bounds[:-1], dtype=np.int64)[other]
        else:
            part = np.concatenate([sets[j] for j in other])
            at = np.searchsorted(sets[i], part)
            same = sets[i][np.minimum(at, size[i] - 1)] == part
            both = np.add.reduceat(same, np.concatenate([[0], np.cumsum(size[other])[:-1]]), dtype=np.int64)
        for j in other[100 * both >= percent * (size[other] + size[i] - both)]:
            if labels[j] != labels[i]:
                labels[labels == labels[j]] = labels[i]
                found.append((int(i), int(j)))
    return found


def _rest(members: DataFrame, block: int) -> DataFrame:
    """Members (grp, blocks, block, cid, label, shingles) of groups with several labels, laid out so that everything outside a group's most frequent label meets all of the group, in parts of bounded size."""
    per_label = members.groupBy("grp", "label").agg(F.count(F.lit(1)).alias("n"))
    main = per_label.groupBy("grp").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"))
    main = main.withColumn("chunks", F.ceil((F.col("all") - F.col("most")) / block).cast("int")).where("chunks > 0").select("grp", "main", "chunks")
    named = members.join(main, "grp")
    data = named.select("grp", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "block", "cid", "label", F.lit(False).alias("query"), "shingles")
    asked = named.where("label != main").select("grp", F.pmod(F.xxhash64("cid", F.lit(1)), F.col("chunks")).cast("int").alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "cid", "label", F.lit(True).alias("query"), "shingles")
    return data.unionByName(asked)


def confirmed_links(docs: DataFrame, classes: DataFrame, groups: DataFrame, k: int, percent: int, block: int = BLOCK, wide: int = WIDE) -> DataFrame:
    """Links (u, v) between classes of one candidate group that connect all that is linked on full sets."""
    sized = groups.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    members = groups.join(sized, "component").join(classes.select(F.col("cid").alias("id"), "digest"), "id")
    members = members.select(F.col("id").alias("cid"), F.col("component").alias("grp"), "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), "digest")
    texts = docs.select(F.col("doc_id").alias("cid"), F.col("text").cast("string")).join(members, "cid")

    def to_sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets, keep = [], np.zeros(batch.num_rows, bool)
        for row, values in shingle_sets(batch.column("text"), k):
            keep[row] = set_digest(values) == batch.column("digest")[row].as_py()
            sets.append(values.tobytes() if keep[row] else b"")
        at = pa.array(np.flatnonzero(keep))
        return record(**{c: batch.column(c).take(at) for c in ("grp", "blocks", "block", "cid")}, shingles=pa.array(sets, pa.binary()).take(at))

    with_sets = cut(arrow_map(texts, to_sets, "grp long, blocks int, block int, cid long, shingles binary"), "shingle-sets")

    def links(part: pa.Table) -> pa.RecordBatch | None:
        cid = part["cid"].to_numpy()
        labels = part["label"].to_numpy()
        query = part["query"].to_numpy(zero_copy_only=False).astype(bool)
        if part.num_rows < 2 or not query.any():
            return None
        sets = [np.frombuffer(s.as_py(), np.uint64) for s in part["shingles"]]
        pairs = link_sets(sets, labels, query, percent)
        return record(u=pa.array([int(cid[i]) for i, _ in pairs], pa.int64()), v=pa.array([int(cid[j]) for _, j in pairs], pa.int64()))

    first = with_sets.select("grp", "block", "cid", F.col("cid").alias("label"), F.lit(True).alias("query"), "shingles")
    out = cut(grouped(first, ["grp", "block"], ["cid"], links, "u long, v long"), "block-links")
    large = with_sets.where("blocks > 1")
    if large.isEmpty():
        return out
    named = cut(large.join(components(out), F.col("cid") == F.col("id"), "left").select("grp", "blocks", "block", "cid", F.coalesce("component", "cid").alias("label"), "shingles"), "labelled-sets")
    keys = ["grp", "chunk", "block"]
    out = out.unionByName(grouped(_rest(named.where(F.col("blocks") <= wide), block), keys, ["cid", "query"], links, "u long, v long"))
    huge = named.where(F.col("blocks") > wide)
    if huge.isEmpty():
        return out
    # their buckets take the place of the groups
    left, right = F.slice("keys", 1, COLLECTION), F.slice("keys", COLLECTION + 1, COLLECTION)
    placed = cut(_tables(classes.join(huge.select("cid", "label"), "cid").select("cid", "label", left.alias("left"), right.alias("right")), "label"), "bucket-members")
    mixed = placed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("a"), F.max("label").alias("b")).where("a != b").select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    within = placed.join(mixed, "key").select(F.col("key").alias("grp"), "blocks", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int").alias("block"), "cid")
    within = cut(within.join(huge.select("cid", "label", "shingles"), "cid").select("grp", "blocks", "block", "cid", "label", "shingles"), "bucket-sets")
    return out.unionByName(grouped(_rest(within, block), keys, ["cid", "query"], links, "u long, v long"))


def _placed(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id and kept of every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = cut(sketches(docs, k), "sketches")
    usable = own.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = cut(usable.groupBy("digest").agg(F.min("doc_id").alias("cid"), F.first("keys").alias("keys")), "set-classes")
    tables = _tables(_shared(classes))
    buckets = tables.groupBy("key").agg(F.min("cid").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "rep")
    stars = tables.join(buckets.hint("merge"), "key").where("cid != rep").select(F.col("cid").alias("u"), F.col("rep").alias("v")).distinct()
    groups = cut(components(stars), "candidate-groups")
    found = components(confirmed_links(docs, classes, groups, k, percent))
    placed = classes.select("digest", "cid").join(found, F.col("cid") == F.col("id"), "left").select("digest", F.coalesce("component", "cid").alias("component_id"))
    out = own.select("doc_id", "text_hash", "n_shingles", "digest").join(placed, "digest", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    return _placed(docs, k, percent).drop("text_hash")


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that are kept, one document of each group; all columns stay."""
    gone_id, gone_hash = fresh(docs, "gone_id", "gone_hash")
    gone = _placed(docs, k, percent).where("NOT kept").select(F.col("doc_id").alias(gone_id), F.col("text_hash").alias(gone_hash)).distinct()
    same = (F.col("doc_id").cast("long") == F.col(gone_id)) & (F.xxhash64(F.col("text").cast("string")) == F.col(gone_hash))
    return docs.join(gone, same, "left_anti")
