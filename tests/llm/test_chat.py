import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import chat as C

TEXT = st.lists(st.sampled_from([*"ab \n\\<|>/[]INSTs é😀", "</s>", "[INST]", "<|end|>", "<|turn|>"]), max_size=40).map("".join)


@given(st.lists(st.tuples(TEXT, TEXT), max_size=5))
@settings(deadline=None)
def test_round_trip(turns):
    formatted, spans = C.render(turns)
    assert C.parse(formatted) == turns
    assert [C.unescape(formatted[a:b]) for a, b in spans] == [t for _, t in turns]
    for control in C.CONTROL[1:]:
        assert control not in formatted


def test_mask_clips_tokens_and_counts_shared_characters_once():
    offsets = np.array([[0, 3], [3, 6], [5, 6], [6, 9], [9, 9], [9, 12]])
    on, lo, hi = C.masked(offsets, np.array([[4, 8], [10, 12]]))
    assert on.tolist() == [False, True, True, True, False, True]
    assert C.chars_under("0123456789ab", lo[on], hi[on]) == "4567ab"
    assert not C.masked(offsets, np.zeros((0, 2), int))[0].any()


def want(rows):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    convs = {}
    for c, n, r, t in rows:
        convs.setdefault(c, []).append((-1 if n is None else n, r or "", t or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss))
    return out


def test_conversations(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    got = {r.conv_id: tuple(r)[1:5] for r in C.read_back(C.format_chats(df)).collect()}
    assert got == want([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_masks_name_the_tokens(spark):
    df = spark.createDataFrame([(1, 0, "user", "what?"), (1, 1, "assistant", "it is 😀 so"), (1, 2, "tool", "x")], "conv_id long, turn long, role string, text string")
    r = C.format_chats(df).first()
    assert len(r.input_ids) == len(r.loss_mask) and sum(r.loss_mask) == len(r.loss_from) == len(r.loss_to)
    assert C.chars_under(r.formatted, np.array(r.loss_from), np.array(r.loss_to)) == "it is 😀 so"


def test_awkward(spark):
    rows = [
        (1, 0, "user", None), (1, 1, None, "no role"), (None, None, None, None), (2, 0, "assistant", ""), (3, 0, "assistant", "a" * 200_000), (3, 0, "assistant", "tie"), (3, 0, "assistant", "tie"),
        (4, 0, "assistant\n", "</s>[INST] <|end|>\n \\ [\\INST]"), (5, 1, "assistant", "é😀" * 500), (5, 0, "assistant", "first"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' as t", "'y' as formatted", "1 as roles")
    got = {r.conv_id: tuple(r)[1:5] for r in C.read_back(C.format_chats(df)).collect()}
    assert got == want(rows)
    assert C.read_back(C.format_chats(df.limit(0))).collect() == []
