"""Packing token sequences: first-fit decreasing over a tournament tree of bin capacities.

Pieces of documents are dealt by a hash of their row's number into randomised
groups of a few thousand; each group is packed on its own, so the work is linear
in the number of pieces and no group grows with the input, with the copies of a
row, or with the length of a document.

A document longer than a sequence is cut into full sequences and a rest. Full
pieces fill sequences of their own; rests are placed longest first, each into
the first open sequence with room, which a tree over capacities finds in
log(n) steps.

Defined results: null or empty text is the closing id alone; repeated rows are
packed each for itself; ties are ordered by doc_id and then by content; which
sequence a piece goes to follows from how the rows are partitioned; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small

LENGTH, GROUP, CLOSING_ID, CACHE_WORDS = 2048, 4096, 1, 400_000


@functools.cache
def _tokenizer(path: str | None):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path or public_tokenizers.path("word_bpe_49k.json"))


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: printable Latin-1 for itself, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


_LETTERS = _byte_letters()
_WORD = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\[-`{-~]*)")


class Ids(dict):
    """Little-endian 32-bit ids of words; remembers the first ``CACHE_WORDS`` of them.

    The vocabulary's pre-tokenizer drops white space and never joins across it,
    so a text's ids are the ids of its words in turn. Words of Latin letters
    with punctuation behind them are two pieces for the merges; all others go
    through the whole tokenizer, and so do texts that hold the string of one of
    its added tokens, which may reach over white space.
    """

    def __init__(self, path: str | None = None):
        super().__init__()
        self.tok, self.pieces = _tokenizer(path), {}
        self.merge = self.tok.model.tokenize
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]

    def piece(self, text: str) -> bytes:
        if (found := self.pieces.get(text)) is None:
            letters = text if text.isascii() else "".join(_LETTERS[b] for b in text.encode())
            found = np.array([t.id for t in self.merge(letters)], "<u4").tobytes()
            if len(self.pieces) < CACHE_WORDS:
                self.pieces[text] = found
        return found

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        if parts := _WORD.fullmatch(text):
            ids = self.piece(parts[1].lower()) + (self.piece(parts[2]) if parts[2] else b"")
        else:
            ids = self.whole(text)
        if len(self) < CACHE_WORDS:  # the frequent words come first
            self[word] = ids
        return ids

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def of(self, text: str | None) -> bytes:
        if text and any(a in text for a in self.added):
            return self.whole(text)
        return b"".join(map(self.__getitem__, (text or "").encode().split()))  # bytes: splits at ASCII white space only


@functools.cache
def known_ids(path: str | None) -> Ids:
    """One table a Python worker, kept from task to task."""
    return Ids(path)


def tokenize(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH) -> DataFrame:
    """A row per piece of a document: doc_id, start, length, ids_crc32, doc_tokens and ``doc_crc32``."""
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "doc_crc32")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = known_ids(tokenizer)
        closing = np.array([CLOSING_ID], "<u4").tobytes()
        for batch in small(batches):
            rows, starts, sizes, crcs, totals, wholes = [], [], [], [], [], []
            for row, body in enumerate(map(ids.of, batch.column("text").to_pylist())):
                body += closing
                total, whole = len(body) // 4, zlib.crc32(body)
                for at in range(0, total, length):
                    piece = body[4 * at : 4 * (at + length)]
                    rows.append(row)
                    starts.append(at)
                    sizes.append(len(piece) // 4)
                    crcs.append(zlib.crc32(piece))
                    totals.append(total)
                    wholes.append(whole)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (starts, sizes, crcs, totals, wholes))], names=list(names))

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, doc_crc32 long")


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size, given in falling order.

    ``tree`` is a tournament over the bins' free room: a node holds the larger
    of its children, and the leftmost leaf with room is found from the root.
    """
    leaves = 1 << max(0, math.ceil(math.log2(max(1, len(sizes)))))
    tree = [capacity] * (2 * leaves)
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for k, size in enumerate(sizes.tolist()):
        node = 1
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        bins[k], offsets[k] = node - leaves, capacity - tree[node]
        tree[node] -= size
        while node > 1:
            node //= 2
            left, right = tree[2 * node], tree[2 * node + 1]
            most = left if left > right else right
            if tree[node] == most:
                break
            tree[node] = most
    return bins, offsets


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, group: int = GROUP, seed: int = 11) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    pieces = cut(tokenize(docs, tokenizer, length).withColumn("dealt", F.xxhash64(F.monotonically_increasing_id(), F.lit(seed))), "pieces")
    groups = max(1, math.ceil(pieces.count() / group))
    dealt = pieces.withColumn("pack_group", F.pmod("dealt", F.lit(groups)))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "doc_id", "start", "doc_crc32", "dealt"], ascending=[False, True, True, True, True], kind="stable")
        bins, offsets = first_fit_decreasing(part["length"].to_numpy(), length)
        part["sequence_id"] = (part["pack_group"].to_numpy(np.int64) << 32) + bins
        part["offset"] = offsets
        return part[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    kind = dict(docs.dtypes)["doc_id"]
    return dealt.groupBy("pack_group").applyInPandas(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
