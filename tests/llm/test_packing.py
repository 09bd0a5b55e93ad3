import collections
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tests.llm.conftest import prose
from tripmart.llm import packing


def test_ids_are_those_of_the_whole_text(rows):
    ids = packing.Ids()
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    odd = ["a <|startoftext|> <|endoftext|> b", "x<|endoftext|>\ny <|ENDOFTEXT|> <|endoftext |>", "don't I'm WE'LL x--y 3,5% a1b2", "<|endoftext|> é\u0301 İ ΑΣ \u1e9e \x1c\x85\xa0 b", "ÿŸ œ Straße!'s 'tis", "".join(chr(c) for c in range(32, 700))]
    for text in [t or "" for _, t in rows] + odd:
        whole = plain.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids.of(text), "<u4").tolist() == whole


def test_pieces(spark, docs, rows, none):
    got = packing.pack(docs, length=64, group=8).collect()
    ids = packing.Ids()
    closing = np.array([1], "<u4").tobytes()
    want = collections.Counter()
    for i, t in rows:
        body = ids.of(t) + closing
        for at in range(0, len(body) // 4, 64):
            piece = body[4 * at : 4 * (at + 64)]
            want[i, at, len(piece) // 4, zlib.crc32(piece), len(body) // 4] += 1
    assert collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(none).count() == 0


def test_first_fit_decreasing():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 7, 300):
        sizes = np.sort(rng.integers(1, 101, n))[::-1]
        bins, offsets = packing.first_fit_decreasing(sizes, 100)
        room, want = [], []
        for s in sizes:
            k = next((k for k, free in enumerate(room) if free >= s), len(room))
            if k == len(room):
                room.append(100)
            want.append((k, 100 - room[k]))
            room[k] -= s
        assert list(zip(bins.tolist(), offsets.tolist(), strict=True)) == want


def test_little_padding(spark):
    rng = random.Random(1)
    t = spark.createDataFrame([(k, prose(rng, rng.randint(5, 900))) for k in range(400)], "doc_id long, text string")
    rows = packing.pack(t).collect()
    assert sum(r.length for r in rows) / (len({r.sequence_id for r in rows}) * packing.LENGTH) > 0.97


def test_copies_of_one_row_and_pieces_of_one_text_are_spread(spark):
    rows = [(1, "one two three")] * 400 + [(2, " ".join(f"w{k}" for k in range(4000)))]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), length=64, group=50).collect()
    most = collections.Counter(r.sequence_id >> 32 for r in out).most_common(1)[0][1]
    assert most < 150 and sum(r.doc_id == 1 for r in out) == 400
