"""Chat formatting by token-level assembly.

Each turn becomes ``<turn>role<says>text</turn>``. Role and text are encoded on
their own; the three control strings are never encoded but spliced in as
reserved ids, so no merge crosses a border. Where a control string or the
escape character occurs inside a role or text, it gets the escape character in
front, which ``unescape`` takes off again. The loss mask is the prefix sum of
+1 at the first id of an assistant's text and -1 behind its last.

Defined results: null text or role is empty; rows of one conversation are
ordered by turn (null first), then role, then a hash of their ids, so ties and
repeated rows all stay, equal ones side by side, in the same order on any cluster; null conv_id is a conversation of its own; an empty
table gives no rows; extra columns are ignored. Turns are encoded and decoded
wherever they lie; only their bytes are sorted by conversation and pass one at a
time through running hashes, so its length is not bounded by memory.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, record, small

OPEN, SAYS, CLOSE, ESCAPE = "<turn>", "<says>", "</turn>", "\\"
CONTROLS = (OPEN, SAYS, CLOSE)
_RISKY = re.compile("|".join(map(re.escape, (ESCAPE, *CONTROLS))))
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return _RISKY.sub(lambda m: ESCAPE + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


@functools.cache
def encoding(path: str | None = None):
    """A byte-level encoding without specials; ``path`` names a file of ranks."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def reserved(enc) -> dict[str, int]:
    """Ids behind the vocabulary for the control strings."""
    return {text: enc.max_token_value + 1 + k for k, text in enumerate(CONTROLS)}


def encode_turn(role: str, text: str, enc) -> tuple[np.ndarray, np.ndarray]:
    """Ids and loss mask of a turn."""
    own = reserved(enc)
    name, said = enc.encode_ordinary(escape(role)), enc.encode_ordinary(escape(text))
    ids = np.array([own[OPEN], *name, own[SAYS], *said, own[CLOSE]], np.uint32)
    steps = np.zeros(len(ids) + 1, np.int8)
    if role == "assistant":
        steps[len(name) + 2] += 1
        steps[len(name) + 2 + len(said)] -= 1
    return ids, np.cumsum(steps)[:-1].astype(bool)


def decode(ids: np.ndarray, enc) -> str:
    """The formatted text of ids, reserved ones included."""
    own = {v: k.encode() for k, v in reserved(enc).items()}
    out, at = [], 0
    for k in np.flatnonzero(ids > enc.max_token_value).tolist():
        out += [enc.decode_bytes(ids[at:k].tolist()), own[int(ids[k])]]
        at = k + 1
    return b"".join([*out, enc.decode_bytes(ids[at:].tolist())]).decode()


def read_turn(ids: np.ndarray, enc) -> tuple[str, str]:
    """Role and text of a turn's ids."""
    own = reserved(enc)
    says = int(np.flatnonzero(ids == own[SAYS])[0])
    return unescape(decode(ids[1:says], enc)), unescape(decode(ids[says + 1 : -1], enc))


def format_turns(conversations: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """A row per turn: conv_id, turn, ids and mask as binary (32-bit ids, bytes of 0 and 1), and an order key."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoding(tokenizer)
        ids, masks = [], []
        for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
            i, m = encode_turn(role or "", text or "", enc)
            ids.append(i.tobytes())
            masks.append(m.tobytes())
        keys = [hashlib.md5(i).digest() for i in ids]
        return record(conv_id=batch.column("conv_id"), turn=batch.column("turn"), role=batch.column("role"), tie=pa.array(keys, pa.binary()), ids=pa.array(ids, pa.binary()), mask=pa.array(masks, pa.binary()))

    wanted = conversations.select("conv_id", F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return arrow_map(wanted, run, f"conv_id {dict(wanted.dtypes)['conv_id']}, turn long, role string, tie binary, ids binary, mask binary")


READ = ("said", "learnt", "loss_chars", "chars", "tokens", "loss_tokens")


class _Digest:
    """What one conversation's output reads back as, fed a turn at a time."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.turns, self.loss = conv_id, hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = self.tokens = self.loss_tokens = 0

    def feed(self, said: bytes, learnt: bytes, loss_chars: int, chars: int, tokens: int, loss_tokens: int) -> None:
        self.turns.update(said)
        self.loss.update(learnt)
        self.n += 1
        self.loss_chars += loss_chars
        self.chars += chars
        self.tokens += tokens
        self.loss_tokens += loss_tokens

    def row(self) -> tuple:
        return self.conv_id, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.tokens, self.loss_tokens


FIELDS = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "n_loss_tokens")


def read_back(turns: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """The texts of turns, decoded from their ids: ``said`` (role and text, a line end behind each), ``learnt`` under the mask, and lengths."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoding(tokenizer)
        rows = []
        for ids, mask in zip(batch.column("ids").to_pylist(), batch.column("mask").to_pylist(), strict=True):
            tokens, counted = np.frombuffer(ids, np.uint32), np.frombuffer(mask, bool)
            role, text = read_turn(tokens, enc)
            learnt = unescape(decode(tokens[counted], enc))
            rows.append((f"{role}\n{text}\n".encode(), learnt.encode(), len(learnt), len(decode(tokens, enc)), len(tokens), int(counted.sum())))
        cols = list(zip(*rows, strict=True)) or [()] * 6
        kinds = [pa.binary(), pa.binary(), *[pa.int64()] * 4]
        return record(**{c: batch.column(c) for c in ("conv_id", "turn", "role", "tie")}, **{name: pa.array(c, kind) for name, c, kind in zip(READ, cols, kinds, strict=True)})

    return arrow_map(turns, run, f"conv_id {dict(turns.dtypes)['conv_id']}, turn long, role string, tie binary, said binary, learnt binary, " + ", ".join(f"{c} long" for c in READ[2:]))


def digest(turns: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """A row per conversation, read back from the ids and masks of ``format_turns``."""
    kind = dict(turns.dtypes)["conv_id"]
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        kinds = None

        def out() -> pa.RecordBatch:
            cols = list(zip(*done, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], kinds), *map(pa.array, cols[1:])], names=list(FIELDS))

        for batch in small(batches):
            kinds = batch.column("conv_id").type
            for conv, *turn in zip(*(batch.column(c).to_pylist() for c in ("conv_id", *READ)), strict=True):
                if now is None or now.conv_id != conv:
                    if now is not None:
                        done.append(now.row())
                    now = _Digest(conv)
                now.feed(*turn)
            if len(done) >= 1000:
                yield out()
                done = []
        if now is not None:
            done.append(now.row())
            yield out()

    order = read_back(turns, tokenizer).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "tie")
    return order.select("conv_id", *READ).mapInArrow(run, schema)
