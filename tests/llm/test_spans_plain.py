"""op3 as built, in plain Python: pieces, runs with their least length, runs of 26 words, the first of each, and the text that is left."""

import collections
import random
import re

import numpy as np
import pytest
import xxhash

from tests.llm.conftest import WORDS, prose
from tripmart.llm import span_dedup
from tripmart.llm.text import mix, powers, word_hashes

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
RUN, MIN_WORDS, LONGEST, EVERY, MIN_BYTES, GRAM = 3, 8, 16, 8, 96, 26
WIDE = ("\u3002".encode(), "\uff01".encode(), "\uff1f".encode())
WORD = re.compile(rb"[^\x20\x09-\x0d]+?(?:(?<=\xe3\x80\x82)|(?<=\xef\xbc\x81)|(?<=\xef\xbc\x9f)|(?![^\x20\x09-\x0d]))")


def hashed(word: bytes) -> int:
    return int(word_hashes(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))[0])


class Plain:
    """One text: its words, pieces, and both kinds of runs as (key, place, first word, last word + 1)."""

    def __init__(self, text, min_words=MIN_WORDS):
        self.body = (text or "").encode()
        found = list(WORD.finditer(self.body))
        self.starts = [m.start() for m in found]
        self.words = [m[0].translate(LOWER) for m in found]
        n = len(found)
        h = [hashed(w) for w in self.words]
        sentence = [k == 0 or found[k - 1][0].endswith((b".", b"!", b"?", *WIDE)) or b"\n" in self.body[found[k - 1].end() : found[k].start()] for k in range(n)]
        opens = list(sentence)
        at = [k for k in range(n) if sentence[k]] + [n]
        for a, b in zip(at, at[1:]):
            for k in range(a, b):
                if b - a > LONGEST and h[k] % EVERY == 0 and k + 1 < n:
                    opens[k + 1] = True
        self.edges = [k for k in range(n) if opens[k]] + [n]
        real = [sentence[k] for k in self.edges[:-1]] + [True]
        pieces = len(self.edges) - 1 if n else 0
        self.runs, stops = [], {}
        for p in range(pieces):
            a = self.edges[p]
            for q in range(p + 1, pieces + 1):
                b = self.edges[q]
                if q >= p + RUN and (b - a >= min_words or sum(map(len, self.words[a:b])) >= MIN_BYTES):
                    stops[p] = q
                    self.runs.append((("pieces", *self.words[a:b]), p << 6, a, b))
                    break
        values = self._values(h)
        chosen = sorted({j for w in range(n - 2 * GRAM + 2) for j in range(w, w + GRAM) if values[j] == min(values[w : w + GRAM])})
        kept = []
        for j in chosen:
            later = next((p for p in range(pieces) if real[p] and self.edges[p] > j), None)
            q = stops.get(later)
            if q is None or not real[q] or self.edges[q] >= j + GRAM:
                kept.append(j)
        groups = collections.defaultdict(list)
        for j in kept:
            groups[values[j]].append(j)
        for js in groups.values():
            base, far = js[0], 0
            for before, j in zip([None, *js], js):
                if before is not None and j - before < GRAM and j - base < GRAM:
                    far = j - base
                elif before is not None:
                    self._gram(base, far)
                    base, far = j, 0
            self._gram(base, far)

    def _gram(self, a: int, far: int) -> None:
        self.runs.append((("gram", *self.words[a : a + GRAM]), (a << 6) + 2 * far + 1, a, a + far + GRAM))

    def _values(self, h: list[int]) -> list[int]:
        """Hashes of 26 words as the library draws them: which runs are the smallest is part of the definition."""
        if len(h) < GRAM:
            return []
        up, down = powers(len(h) + 1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(np.array(h, np.uint64) * up[: len(h)])])
        return [int(mix((sums[j + GRAM : j + GRAM + 1] - sums[j : j + 1]) * down[j : j + 1])[0]) | 1 for j in range(len(h) - GRAM + 1)]

    def without(self, spans: list[tuple[int, int]]) -> tuple[int, str]:
        away = [any(a <= k < b for a, b in spans) for k in range(len(self.words))]
        removed = sum(all(away[a:b]) for a, b in zip(self.edges, self.edges[1:])) if self.words else 0
        edges = [*self.starts, len(self.body)]
        body = self.body[: edges[0]] + b"".join(self.body[edges[k] : edges[k + 1]] for k in range(len(away)) if not away[k])
        return removed, body.decode()


def plain(rows, min_words=MIN_WORDS):
    often = collections.Counter(i for i, _ in rows)
    texts = {t: Plain(t, min_words) for _, t in rows}
    own = lambda i, t: 0 if i is not None and often[i] == 1 else None if t is None else (xxhash.xxh64(t.encode(), 42).intdigest() + 2**63) % 2**64 - 2**63
    order = lambda p: (p[0] is not None, p[0] or 0, -(2**64) if p[1] is None else p[1], p[2])
    first, n = {}, collections.Counter()
    for i, t in rows:
        for key, place, *_ in texts[t].runs:
            first[key] = min(first.get(key, (i, own(i, t), place)), (i, own(i, t), place), key=order)
            n[key] += 1
    out = collections.Counter()
    for i, t in rows:
        gone = [(a, b) for key, place, a, b in texts[t].runs if n[key] > 1 and first[key] != (i, own(i, t), place)]
        removed, left = texts[t].without(gone) if gone else (0, t or "")
        out[i, len(texts[t].edges) - 1 if texts[t].words else 0, removed, left] += 1
    return out


def got(docs, **least):
    return collections.Counter((r.doc_id, r.n_sentences, r.n_removed, r.text) for r in span_dedup.drop_repeats(docs, **least).collect())


def test_constants():
    assert (RUN, MIN_WORDS, LONGEST, EVERY, MIN_BYTES, GRAM) == tuple(getattr(span_dedup, n) for n in ("RUN", "MIN_WORDS", "LONGEST", "EVERY", "MIN_BYTES", "GRAM"))


def test_messy_rows(docs, rows):
    """Null ids and texts, repeated rows and rows of one id included."""
    assert got(docs) == plain(rows)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_rows(spark, seed):
    rng = random.Random(seed)
    shared = [prose(rng, n) for n in (5, 12, 30, 60, 90)] + [" ".join(rng.choice(WORDS) for _ in range(n)) for n in (30, 60, 120)] + ["\n".join(rng.choice(WORDS) * 9 for _ in range(6))]
    rows = []
    for k in range(60):
        parts = [prose(rng, rng.randint(0, 30)) if rng.random() < 0.5 else rng.choice(shared) for _ in range(rng.randint(0, 5))]
        rows.append((rng.choice([k, k, k, 7, None]), rng.choice([" ", "\n", ". "]).join(parts)))
    rows += rows[:5] + [(900, "la " * 130), (901, "la " * 131), (902, "a b " * 70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = plain(rows)
    assert got(docs) == want and sum(r[2] > 0 for r in want) > 5


def test_without_a_least_length_every_repeated_run_goes(spark, rng):
    head = "Alpha beta. Gamma delta. Eps zeta."
    rows = [(k, f"{head} {prose(rng, 30)}") for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(docs) == plain(rows) and all(text.startswith(head) for *_, text in got(docs))
    out = got(docs, min_words=0)
    assert out == plain(rows, 0)
    assert sorted((i, n) for i, _, n, text in out if not text.startswith(head)) == [(1, 3), (2, 3), (3, 3)]


def test_texts_without_spaces(spark):
    """Sentences end at ideographic and full-width stops, alone, doubled, at a line's end and beside spaces."""
    rng = random.Random(4)
    han = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n))
    body = "".join(han(rng.randint(8, 30)) + rng.choice("\u3002\uff01\uff1f") for _ in range(20))
    rows = [(k, body + c) for k, c in enumerate("abcd")]
    rows += [(10 + k, "".join(han(9) + "\u3002" for _ in range(20))) for k in range(3)]
    rows += [(20, "\u3002"), (21, "\u3002\u3002 \uff01\n\uff1f"), (22, body[:200] + " Plain words. " + body[200:]), (23, body.replace("\u3002", "\u3002\n")), (24, None), (25, "\uff01" * 60), (26, "\uff01" * 61)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = got(docs)
    assert out == plain(rows)
    left = {i: text for i, _, _, text in out}
    assert left[0] == rows[0][1] and all(len(left[k]) < 40 for k in (1, 2, 3))
    assert all(left[10 + k] == rows[4 + k][1] for k in range(3))
