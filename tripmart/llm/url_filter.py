"""URL filter: host and path rules, then logistic regression on hashed character n-grams.

The model is trained on the driver from the small labelled table below; only its
weights (2**14 doubles, 128 KB whatever the input) go to the tasks.

Defined results: a null url, or one without ``://``, has an empty host and
path and is scored as such. Repeated rows are judged alike. Extra columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, record
from .text import mix, slices

BITS, SIZES = 14, (3, 4, 5)

#: Labelled URLs (fixed values): 1 to block, 0 to allow.
LABELLED = [
    ("the-spam-farm.biz/en/1", 1), ("spam-farms.info/de/2.html", 1), ("farm-of-spam.net/offers", 1),
    ("www.spam-harvest.org/de/12", 1), ("m.spam-mill.com/es/7", 1), ("blog.spam-factory.org/fr/31.html", 1), ("the-spam-farmers.org/en/8", 1),
    ("spam-shop.example.org/fr/buy", 1), ("all-spam.example.com/en/list", 1), ("farmed-spam.example.net/de/top", 1),
    ("www.spam-links.biz/buy-now", 1), ("spam-site.info/cheap", 1), ("best-spam-deals.net/page/1", 1),
    ("link-farm.biz/out.php", 1), ("linkfarm.info/index", 1), ("content-farm.net/article-9", 1),
    ("cheap-pills.biz/viagra-online", 1), ("online-pharmacy-rx.info/buy/cialis", 1), ("free-casino-bonus.com/slots", 1),
    ("casino-royal.biz/poker/play-now", 1), ("best-betting.info/odds/free-bet", 1), ("xxx-videos.biz/free-porn", 1),
    ("hot-adult-cams.net/live/xxx", 1), ("sexy-girls.info/gallery", 1), ("win-free-iphone.biz/claim", 1),
    ("fast-payday-loans.info/apply-now", 1), ("click-tracker.biz/ads/banner", 1), ("ads.popunder.net/click", 1),
    ("seo-backlinks.biz/cheap-links", 1), ("replica-watches.info/rolex", 1), ("free-download-crack.biz/keygen", 1),
    ("warez-torrent.info/crack/serial", 1), ("make-money-fast.biz/work-from-home", 1), ("crypto-doubler.info/invest", 1),
    ("cheap-followers.biz/buy-likes", 1), ("parked-domain.info/?ref=spam", 1), ("doorway-pages.biz/kw/12", 1),
    ("news.example.com/en/100", 0), ("blog.example.net/fr/2024/entry.html", 0), ("www.example.org/de/about", 0),
    ("m.harbour-news.com/es/330", 0), ("northern-herald.com/en/676", 0), ("otherwise.org/en/685", 0),
    ("stations.net/es/533/", 0), ("blog.gathering.net/en/960", 0), ("www.thunder-bay.com/en/78", 0),
    ("m.engineering.org/fr/9120.html", 0), ("monthly.com/de/51", 0), ("earthen.net/en/4/", 0),
    ("zeitung.org/de/12", 0), ("canciones.com/es/99", 0), ("nouvelle.net/fr/77.html", 0),
    ("docs.project.org/guide/install", 0), ("wiki.university.edu/history/europe", 0), ("library.org/catalog/item/55", 0),
    ("city-council.gov/services/parks", 0), ("museum.org/collection/painting", 0), ("journal.org/article/2021/44", 0),
    ("openscience.net/paper/881", 0), ("recipes.home.net/soup/lentil", 0), ("travel.example.org/fr/paris", 0),
    ("school.edu/course/math/101", 0), ("weather.gov/forecast/today", 0), ("code.example.com/repo/readme", 0),
    ("forum.example.net/thread/7", 0), ("gardening.example.org/en/roses", 0), ("sports.example.com/en/results", 0),
    ("example.com", 0), ("example.org/", 0), ("example.net/fr", 0), ("www.example.com", 0), ("site.net", 0), ("a.org/b", 0),
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty where it is null or lacks ``://``."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(url)), r"^[^?#]*", 0)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(has, lower).otherwise(F.lit("")), F.when(has, path).otherwise(F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest of (verdict, host/path) rules that fits, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _buckets(column: pa.Array, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every n-gram of the texts between two boundary bytes."""
    rows, found = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for lo, hi, buf, offsets in slices(column):
        n = hi - lo
        size = np.diff(offsets) + 2
        start = np.concatenate([[0], np.cumsum(size)])
        framed = np.full(start[-1], 1, np.uint64)
        owner = np.repeat(np.arange(n), size)
        place = np.arange(start[-1]) - start[owner]
        inner = (place > 0) & (place < size[owner] - 1)
        framed[inner] = buf
        for k in SIZES:
            if len(framed) < k:
                continue
            h = np.zeros(len(framed) - k + 1, np.uint64)
            for t in range(k):
                h = h * np.uint64(0x100000001B3) + framed[t : len(framed) - k + 1 + t] + np.uint64(seed + k)
            keep = np.flatnonzero(owner[: len(h)] == owner[k - 1 :])
            rows.append(owner[keep] + lo)
            found.append((mix(h[keep]) >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(found)


def _sums(host: pa.Array, path: pa.Array, weights: np.ndarray | None) -> np.ndarray:
    """Scaled n-gram counts of each row, as a matrix without weights, or their weighted sums."""
    n = len(host)
    parts = [_buckets(host, 1), _buckets(path, 1001)]
    rows = np.concatenate([p[0] for p in parts])
    ids = np.concatenate([p[1] for p in parts])
    scale = 1 / np.sqrt(np.maximum(np.bincount(rows, minlength=n), 1))
    if weights is None:
        counts = np.zeros((n, 1 << BITS))
        np.add.at(counts, (rows, ids), 1)
        return counts * scale[:, None]
    return np.bincount(rows, weights[ids], minlength=n) * scale


def train(labelled: list[tuple[str, int]] = LABELLED, rounds: int = 400, rate: float = 2.0, penalty: float = 1e-3) -> np.ndarray:
    """Weights by gradient descent with an L2 penalty; the last is the bias."""
    pairs = [u.partition("/") for u, _ in labelled]
    x = _sums(pa.array([p[0] for p in pairs]), pa.array([p[1] + p[2] for p in pairs]), None)
    y = np.array([v for _, v in labelled], float)
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(rounds):
        gap = 1 / (1 + np.exp(-(x @ w + b))) - y
        w -= rate * (x.T @ gap / len(y) + penalty * w)
        b -= rate * gap.mean()
    return np.append(w, b)


def score(pages: DataFrame, weights: np.ndarray, *keep: str) -> DataFrame:
    """Columns ``keep`` and ``p_block``, the probability that a page with ``host`` and ``path`` is to be blocked."""
    sent = pages.sparkSession.sparkContext.broadcast(weights)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = sent.value
        z = _sums(batch.column("host"), batch.column("path"), w[:-1]) + w[-1]
        return record(**{k: batch.column(k) for k in keep}, p_block=1 / (1 + np.exp(-z)))

    kinds = dict(pages.dtypes)
    return arrow_map(pages.select(*keep), run, ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", p_block double")


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], threshold: float = 0.5, weights: np.ndarray | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and p_block of every page."""
    host, path = host_and_path(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    scored = score(parts, train() if weights is None else weights, "page_id", "host", "path")
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    learnt = F.when(F.col("p_block") >= threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, learnt).alias("verdict"), "p_block")
