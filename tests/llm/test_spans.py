import collections
import re

import numpy as np

from tests.llm.conftest import prose
from tripmart.llm import span_dedup
from tripmart.llm.text import word_hashes

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sentences(text):
    """Lists of words, by plain Python."""
    out, now, last = [], [], None
    for m in re.finditer(r"[^\x20\x09-\x0d]+", text or ""):
        if now and (now[-1][-1] in ".!?" or "\n" in text[last : m.start()]):
            out.append(now)
            now = []
        now.append(m[0])
        last = m.end()
    parts = []
    for s in out + [now] if now else out:
        parts.append([])
        for w in s:
            parts[-1].append(w)
            buf = np.frombuffer(w.encode(), np.uint8)
            if len(s) > span_dedup.LONGEST and int(word_hashes(buf, np.array([0]), np.array([len(buf)]))[0]) % span_dedup.EVERY == 0:
                parts.append([])
        if not parts[-1]:
            parts.pop()
    return parts


def brute(rows):
    first, every = {}, collections.defaultdict(set)
    order = lambda p: (p[0] is not None, p[0] or 0, p[1])
    for i, t in rows:
        s = sentences(t)
        for k in range(len(s) - span_dedup.RUN + 1):
            run = tuple(w.translate(LOWER) for x in s[k : k + span_dedup.RUN] for w in x)
            if len(run) >= span_dedup.MIN_WORDS:
                first[run] = min(first.get(run, (i, k)), (i, k), key=order)
                every[run].add((i, k))
    gone = collections.defaultdict(set)
    for run, places in every.items():
        for i, k in places - {first[run]}:
            gone[i].update(range(k, k + span_dedup.RUN))
    return collections.Counter((i, len(sentences(t)), len({k for k in gone[i] if k < len(sentences(t))})) for i, t in rows)


def test_against_brute_force(docs, rows):
    unique = [r for k, r in enumerate(rows) if r not in rows[:k] and r[0] is not None]
    t = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"])
    got = collections.Counter((r.doc_id, r.n_sentences, r.n_removed) for r in span_dedup.drop_repeats(t).collect())
    assert got == brute(unique)


def test_passage_goes_from_all_but_one_and_clean_text_stays(spark, rng):
    passage = prose(rng, 70)
    clean = [prose(rng, 80) for _ in range(5)]
    rows = [(k, f"{prose(rng, 25)}.\n{passage}\n{prose(rng, 25)}") for k in range(6)] + [(50 + k, t) for k, t in enumerate(clean)]
    out = {r.doc_id: r.text for r in span_dedup.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    middle = " ".join(passage.split()[20:50])
    assert sum(middle in " ".join(out[k].split()) for k in range(6)) == 1 and middle in " ".join(out[0].split())
    assert all(out[50 + k] == t for k, t in enumerate(clean))


def test_all_rows_stay(docs, none, rows):
    out = span_dedup.drop_repeats(docs)
    assert out.count() == len(rows) and "n_removed" in out.columns
    assert span_dedup.drop_repeats(none).count() == 0
