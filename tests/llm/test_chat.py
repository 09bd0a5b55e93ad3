import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tripmart.llm import chat


@given(st.text(alphabet=st.sampled_from("\\</turn>says a\né😀#"), max_size=40), st.text(max_size=8))
@settings(max_examples=200, deadline=None)
def test_round_trip(text, role):
    enc = chat.encoding()
    ids, mask = chat.encode_turn(role, text, enc)
    assert chat.read_turn(ids, enc) == (role, text)
    assert chat.unescape(chat.escape(text)) == text
    formatted = chat.decode(ids, enc)
    assert formatted == f"<turn>{chat.escape(role)}<says>{chat.escape(text)}</turn>"
    assert chat.decode(ids[mask], enc) == (chat.escape(text) if role == "assistant" else "")
    assert sum(np.isin(ids, list(chat.reserved(enc).values()))) == 3


def test_digest(spark):
    rows = [(1, 1, "assistant", "b </turn>"), (1, 0, "user", None), (1, 1, "assistant", "b </turn>"), (2, None, None, "x"), (None, 0, "assistant", "\\"), (None, 1, "user", "")]
    t = spark.createDataFrame([(*r, "k") for r in rows], "conv_id long, turn long, role string, text string, tie string")
    out = {r.conv_id: r for r in chat.digest(chat.format_turns(t)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (out[1].n_turns, out[1].loss_chars, out[1].turns_sha256) == (3, 18, sha("user\n\nassistant\nb </turn>\nassistant\nb </turn>\n"))
    assert out[1].loss_sha256 == sha("b </turn>b </turn>")
    assert (out[2].n_turns, out[2].turns_sha256, out[2].loss_sha256) == (1, sha("\nx\n"), sha(""))
    assert (out[None].loss_chars, out[None].loss_sha256) == (1, sha("\\"))
    assert chat.digest(chat.format_turns(t.limit(0))).count() == 0
