import random

import numpy as np

from tripmart.llm import decontaminate
from tripmart.llm.text import word_hashes


def hashed(text):
    buf = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = decontaminate.words(buf, np.array([0, len(buf)]))
    return word_hashes(buf, starts, ends)


def test_edited_copies_against_alignment_without_seeds(spark):
    rng = random.Random(12)
    some = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    items, rows = [], []
    for share in (0.1, 0.2, 0.25, 0.3):
        for size in (16, 20, 36):
            for _ in range(60):
                item = some(size)
                copy = [w if rng.random() > share else some(1)[0] for w in item]
                rows.append((len(items), " ".join(some(60) + copy + some(60))))
                items.append((len(items), " ".join(item)))
    item = some(20)  # every fourth word replaced
    rows.append((len(items), " ".join(some(9) + [w if k % 4 != 3 else "other" for k, w in enumerate(item)] + some(9))))
    items.append((len(items), " ".join(item)))
    rows += [(9000, "before one two three after"), (9001, "one two")]
    items.append((9000, "one two three"))
    filler = [(10_000 + k, " ".join(some(500) + ["one", "two"] * (k == 0))) for k in range(40)]
    scores = decontaminate.align([hashed(t) for _, t in items], [hashed(t) for _, t in rows[: len(items)]])
    want = {i for (i, _), score in zip(items, scores, strict=True) if score >= decontaminate.THRESHOLD}
    t = spark.createDataFrame(rows + filler, "doc_id long, text string")
    found = decontaminate.mark(t, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id for r in found if r.doc_id in {m["item"] for m in r.matches}} == want and 9000 in want and len(want) > 600
