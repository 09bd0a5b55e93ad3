"""Embedding near-dedup: inverted lists, product-quantised residuals, exact rerank.

A coarse codebook and residual codebooks are trained on about ``SAMPLE`` rows, or
16 a list where that is more (262,144 at most); every row is indexed. The number of
lists grows with the square root of the table, up to ``MOST_LISTS``. A vector lives in the list of its best centroid as eight
subspace codes and the length of its quantisation error. It is a query in every
list whose centroid scores within ``MARGIN`` of its best, but for those whose
farthest row is too far away to reach the threshold, and for lists behind its own:
two vectors of different lists meet once, in the first of them. Inside a list,
distances come from per-query tables looked up by code; since the error's
length is kept, the triangle inequality tells which rows cannot reach the
threshold, and only the others are scored by the exact cosine in double
precision. Lists and their queries are cut into blocks, so a list with a third
of all rows is many tasks; tasks return counts and a spanning forest of links,
never pairs.

Equal vectors of one label are one class, searched once and counted with its
number of vectors. Vectors of different lengths are never compared; lengths of
one power of two share a model, the shorter ones filled up with zeros.

Defined results: vectors that are null or zero, hold null or non-finite
components, or have a null label or vec_id, link with nothing; rows of one vec_id
with the same label and vector are one vector, with others they are different
vectors, each with its own links, and a component is named by the smallest vec_id
in it; an empty table gives an empty result; extra columns are ignored. Vectors are
held by the thousand in a task, whatever their length.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, cut, grouped, record
from .components import components

SAMPLE, MARGIN, PARTS, CODES, BLOCK, MOST_LISTS = 16_384, 0.25, 8, 16, 4096, 16_384


def unit(flat: np.ndarray, dim: int) -> np.ndarray:
    x = flat.reshape(-1, dim).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # squares can't overflow
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def nearest(x: np.ndarray, c: np.ndarray, rows: int = 8192) -> np.ndarray:
    """The index of the nearest centroid of each row."""
    half = 0.5 * (c * c).sum(1)
    return np.concatenate([np.argmax(x[a : a + rows] @ c.T - half, 1) for a in range(0, len(x), rows)])


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        own = nearest(x, c)
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
        c[n == 0] = x[rng.choice(len(x), int((n == 0).sum()))]
    return c


def centroids(x: np.ndarray, k: int, rng: np.random.Generator, direct: int = 1024) -> np.ndarray:
    """k centroids, or about as many; beyond ``direct`` of them in two levels."""
    if k <= direct:
        return k_means(x, k, rng)
    top = math.isqrt(k)
    own = nearest(x, k_means(x, top, rng))
    groups = [x[own == g] for g in range(top)]
    return np.concatenate([k_means(g, max(1, round(k * len(g) / len(x))), rng) for g in groups if len(g)])


class Quantizer:
    """Coarse centroids of unit length, and a codebook of residuals for each part of the dimensions."""

    def __init__(self, x: np.ndarray, lists: int, seed: int = 6):
        rng = np.random.default_rng(seed)
        c = centroids(x, lists, rng)
        norm = np.linalg.norm(c, axis=1, keepdims=True)
        self.coarse = c / np.where(norm > 0, norm, 1)
        self.cuts = np.linspace(0, x.shape[1], min(PARTS, x.shape[1]) + 1).astype(int)
        rest = x - self.coarse[self.homes(x)]
        self.books = [k_means(rest[:, a:b], CODES, rng) for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True)]

    def homes(self, x: np.ndarray) -> np.ndarray:
        return np.argmax(x @ self.coarse.T, 1)

    def probes(self, x: np.ndarray, margin: float, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of all lists that score within ``margin`` of a row's best, and ``least`` of the list at least."""
        s = x @ self.coarse.T
        return np.nonzero((s >= s.max(1, keepdims=True) - margin) & (s >= least))

    def encode(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals and the lengths of what they miss."""
        rest = x - self.coarse[home]
        codes, miss = np.empty((len(x), len(self.books)), np.uint8), np.zeros(len(x))
        for m, book in enumerate(self.books):
            part = rest[:, self.cuts[m] : self.cuts[m + 1]]
            codes[:, m] = np.argmax(part @ book.T - 0.5 * (book * book).sum(1), 1)
            miss += np.square(part - book[codes[:, m]]).sum(1)
        return codes, np.sqrt(miss)

    def distances(self, q: np.ndarray, home: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of queries to the coded rows of one list, by table lookup."""
        rest = q - self.coarse[home]
        out = np.zeros((len(q), len(codes)))
        for m, book in enumerate(self.books):
            part = rest[:, self.cuts[m] : self.cuts[m + 1]]
            table = np.square(part).sum(1)[:, None] - 2 * part @ book.T + np.square(book).sum(1)
            out += table[:, codes[:, m]]
        return out


def _usable(vectors: DataFrame) -> DataFrame:
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    return vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(fine)


def forest(linked: np.ndarray, q: np.ndarray, d: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what the block's links connect: at most one a vector."""
    ids = np.unique(np.concatenate([q, d]))
    label = np.arange(len(ids))
    q_at, d_at = np.searchsorted(ids, q), np.searchsorted(ids, d)
    out = []
    for row in np.flatnonzero(linked.any(1)):
        near = d_at[np.flatnonzero(linked[row])]
        roots, first = np.unique(label[near], return_index=True)
        for root, at in zip(roots.tolist(), first.tolist(), strict=True):
            if root != label[q_at[row]]:
                label[label == root] = label[q_at[row]]
                out.append((int(ids[q_at[row]]), int(ids[near[at]])))
    return out


def near_vectors(vectors: DataFrame, threshold: float = 0.93, margin: float = MARGIN, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    usable = _usable(vectors)
    grown = usable.groupBy("label", "embedding").agg(F.min("vec_id").alias("least_id"), F.count_distinct("vec_id").alias("copies"))
    span = F.ceil(F.log2(F.size("embedding"))).cast("int")  # lengths of one power of two are searched together
    classes = cut(grown.select(F.monotonically_increasing_id().alias("cid"), "label", "embedding", F.size("embedding").alias("size"), span.alias("span"), "least_id", "copies"), "vector-classes")
    found = [_links(classes.where(F.col("span") == r["span"]), r["dim"], r["n"], threshold, margin, sample, block) for r in classes.groupBy("span").agg(F.max("size").alias("dim"), F.count(F.lit(1)).alias("n")).orderBy("span").collect()]  # a row a power of two
    if not found:
        return vectors.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    links = reduce(DataFrame.unionByName, found)
    counts = links.where("cid IS NOT NULL").groupBy("cid").agg(F.sum("n").alias("n"))
    placed = cut(components(links.where("u IS NOT NULL").select("u", "v")), "vector-components")
    named = classes.join(counts, "cid", "left").join(placed, F.col("cid") == F.col("id"), "left").withColumn("component", F.coalesce("component", "cid"))
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = named.join(least, "component").select(F.col("label").alias("__label"), F.col("embedding").alias("__embedding"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("__n"), F.col("component_id").alias("__component"))
    out = vectors.join(named, (F.col("label") == F.col("__label")) & (F.col("embedding") == F.col("__embedding")), "left")
    component = F.coalesce("__component", "vec_id")
    return out.select("vec_id", F.coalesce("__n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _links(classes: DataFrame, dim: int, total: int, threshold: float, margin: float, sample: int, block: int) -> DataFrame:
    """What each class is linked to (cid, n), and links that connect them (u, v); vectors shorter than ``dim`` end in zeros.

    Vectors of different lengths are in different lists, as those of different labels are.
    """
    spark = classes.sparkSession
    kind = dict(classes.dtypes)["embedding"]
    padded = F.when(F.col("size") < dim, F.concat("embedding", F.array_repeat(F.lit(0.0), F.lit(dim) - F.col("size")).cast(kind))).otherwise(F.col("embedding"))
    classes = classes.select("cid", "label", "size", "copies", padded.alias("embedding"))
    lists = int(min(MOST_LISTS, max(1, 2 ** round(math.log2(max(1.0, math.sqrt(total) / 3))))))
    sample = max(sample, 16 * lists)
    picked = classes.where(F.pmod(F.xxhash64("cid"), F.lit(1 << 30)) < F.lit(int(min(1.0, sample / max(total, 1)) * (1 << 30)))).select("embedding").limit(2 * sample).toPandas()["embedding"]
    if not len(picked):
        picked = classes.select("embedding").limit(1).toPandas()["embedding"]
    model = spark.sparkContext.broadcast(Quantizer(unit(np.concatenate(picked.tolist()), dim), lists))
    label, element = dict(classes.dtypes)["label"], kind
    reach = math.sqrt(2 - 2 * threshold) + 1e-9

    def flat(column: pa.Array) -> np.ndarray:
        return unit(column.flatten().to_numpy(zero_copy_only=False), dim)

    def homes(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, own = flat(batch.column("embedding")), model.value
        home = own.homes(x)
        codes, miss = own.encode(x, home)
        score = np.einsum("ij,ij->i", x, own.coarse[home])
        names = ("label", "size", "cid", "copies", "embedding")
        return record(**{c: batch.column(c) for c in names}, list=pa.array(home.astype(np.int32)), codes=pa.array([c.tobytes() for c in codes], pa.binary()), miss=pa.array(miss), score=pa.array(score))

    def asks(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = flat(batch.column("embedding"))
        own = model.value.homes(x)
        row, home = model.value.probes(x, margin, floor.value)
        once = home <= own[row]
        row, home = row[once], home[once]
        at = pa.array(row)
        return record(**{c: batch.column(c).take(at) for c in ("label", "size", "cid", "copies", "embedding")}, list=pa.array(home.astype(np.int32)), own=pa.array(home == own[row]))

    data = cut(arrow_map(classes.select("label", "size", "cid", "copies", "embedding"), homes, f"label {label}, size int, cid long, copies long, embedding {element}, list int, codes binary, miss double, score double"), "inverted-lists")
    # a row at most arccos(lowest score) from its centroid is within reach only of vectors that far and the threshold's angle more
    lowest = np.full(len(model.value.coarse), 2.0)
    for r in data.groupBy("list").agg(F.min("score").alias("least")).collect():  # a number a list
        lowest[r["list"]] = math.cos(min(math.pi, math.acos(max(-1.0, min(1.0, r["least"]))) + math.acos(threshold) + 1e-6))
    floor = spark.sparkContext.broadcast(lowest)
    queries = cut(arrow_map(classes.select("label", "size", "cid", "copies", "embedding"), asks, f"label {label}, size int, cid long, copies long, embedding {element}, list int, own boolean"), "probes")
    count = lambda t, name: t.groupBy("label", "size", "list").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))
    shape = count(data, "blocks").join(count(queries, "chunks"), ["label", "size", "list"])
    part = lambda n, seed: F.pmod(F.xxhash64("cid", F.lit(seed)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    d = data.join(shape, ["label", "size", "list"]).select("label", "size", "list", part("blocks", 1).alias("block"), each("chunks").alias("chunk"), F.lit(0).alias("asks"), "cid", "copies", F.lit(True).alias("own"), "embedding", "codes", "miss")
    q = queries.join(shape, ["label", "size", "list"]).select("label", "size", "list", each("blocks").alias("block"), part("chunks", 2).alias("chunk"), F.lit(1).alias("asks"), "cid", "copies", "own", "embedding", F.lit(None).cast("binary").alias("codes"), F.lit(0.0).alias("miss"))

    def search(table: pa.Table) -> pa.RecordBatch | None:
        asks_ = table["asks"].to_numpy()
        n = int(np.searchsorted(asks_, 1))
        if n == 0 or n == len(asks_):
            return None
        rows, ask = table.slice(0, n).combine_chunks(), table.slice(n).combine_chunks()
        y, x = (flat(t["embedding"].combine_chunks()) for t in (rows, ask))
        codes = np.frombuffer(b"".join(rows["codes"].to_pylist()), np.uint8).reshape(n, -1)
        y_id, x_id = rows["cid"].to_numpy(), ask["cid"].to_numpy()
        linked = np.zeros((len(x), len(y)), bool)
        bound, home = np.square(reach + rows["miss"].to_numpy()), int(table["list"][0].as_py())
        for part in range(0, len(x), 256):
            near = model.value.distances(x[part : part + 256], home, codes) <= bound
            near &= x_id[part : part + 256, None] != y_id[None, :]
            at_q, at_d = np.nonzero(near)
            for a in range(0, len(at_q), 1 << 16):
                i, j = at_q[a : a + (1 << 16)] + part, at_d[a : a + (1 << 16)]
                linked[i, j] = np.einsum("ij,ij->i", x[i], y[j]) >= threshold
        ids = np.concatenate([x_id, y_id])  # those of one list ask each other, so only links between lists count for the rows too
        other = ~ask["own"].to_numpy(zero_copy_only=False).astype(bool)
        found = np.concatenate([linked @ rows["copies"].to_numpy(), ask["copies"].to_numpy()[other] @ linked[other]])
        has = np.flatnonzero(found)
        pairs = forest(linked, x_id, y_id)
        none = [None] * len(pairs)
        return record(cid=pa.array([*ids[has].tolist(), *none], pa.int64()), n=pa.array([*found[has].tolist(), *none], pa.int64()), u=pa.array([None] * len(has) + [u for u, _ in pairs], pa.int64()), v=pa.array([None] * len(has) + [v for _, v in pairs], pa.int64()))

    return cut(grouped(d.unionByName(q), ["label", "size", "list", "block", "chunk"], ["asks", "cid"], search, "cid long, n long, u long, v long"), "vector-links")
