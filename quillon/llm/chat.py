"""Chat formatting with offset-aligned loss masks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|turn|>", "<|end|>"
#: Control strings of common templates; in texts and roles each is broken by a backslash after its first character.
CONTROL = ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_control = re.compile("|".join(map(re.escape, CONTROL)))
_escaped = re.compile(r"\\(.)", re.DOTALL)
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Bytes of a tokenizer file that is sent to the executors at most.
MOST_SENT = 64 << 20
LEARNT = "assistant"


def escape(text: str) -> str:
    """Reversible: backslashes are doubled, and control strings get one after their first character."""
    return _control.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _escaped.sub(r"\1", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\\n")


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The whole conversation, and where the text of each turn lies in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape_role(role)}\n", escape(text)
        parts += [head, body, f"{CLOSE}\n"]
        spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(CLOSE) + 1
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation: the inverse of render()."""
    out = []
    for part in formatted.split(OPEN)[1:]:
        body = part[: part.rindex(CLOSE)]
        cut = 0
        while body[cut] != "\n":
            cut += 2 if body[cut] == "\\" else 1
        out.append((unescape(body[:cut]), unescape(body[cut + 1 :])))
    return out


def masked(offsets: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted token offsets and sorted learnt spans: the mask of the tokens, and the part of each that lies in a span.

    A token may reach over the end of a span; the part says which of its characters count. Both lists are sorted, so the
    span of a token is found by binary search. A token that reaches into more than one span is an error.
    """
    spans = spans[spans[:, 0] < spans[:, 1]]
    if not len(spans) or not len(offsets):
        none = np.zeros(len(offsets), np.int64)
        return none.astype(bool), none, none
    at = np.searchsorted(spans[:, 1], offsets[:, 0], side="right")
    own = spans[np.minimum(at, len(spans) - 1)]
    if (spans[np.minimum(at + 1, len(spans) - 1), 0] < offsets[:, 1])[at + 1 < len(spans)].any():
        raise ValueError("a token reaches into two learnt texts")
    lo, hi = np.maximum(offsets[:, 0], own[:, 0]), np.minimum(offsets[:, 1], own[:, 1])
    on = (at < len(spans)) & (lo < hi)
    return on, np.where(on, lo, 0), np.where(on, hi, 0)


def chars_under(formatted: str, lo: np.ndarray, hi: np.ndarray) -> str:
    """The text under the mask; tokens that share a character (parts of its bytes) count it once."""
    if not len(lo):
        return ""
    lo = np.maximum(lo, np.r_[0, np.maximum.accumulate(hi)[:-1]])
    start = np.flatnonzero(np.r_[True, lo[1:] != hi[:-1]])
    return "".join(formatted[a:b] for a, b in zip(lo[start].tolist(), hi[np.r_[start[1:] - 1, len(hi) - 1]].tolist(), strict=True) if a < b)


def format_chats(turns: DataFrame, tokenizer: str = TOKENIZER, learnt: str = LEARNT, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, formatted, input_ids, loss_mask, loss_from, loss_to) of every conversation.

    A conversation is rendered as a whole and encoded once, with offsets; the mask marks the tokens that lie in a text
    of the learnt role, loss_from and loss_to which characters of them. A conversation is one row of the result, so its
    turns meet in one task; that's bounded by the longest conversation, not by how many share a text.

    Null roles and texts are empty; null conversation ids are one conversation. Ties of a turn go by role, then text;
    repeated rows are repeated turns. Empty table: no rows. Other columns are ignored. The tokenizer file is read on the
    driver and sent to the executors.
    """
    with open(tokenizer, encoding="utf-8") as f:
        vocabulary = f.read(MOST_SENT + 1)
    if len(vocabulary) > MOST_SENT:
        raise ValueError(f"{tokenizer} is larger than {MOST_SENT} bytes")
    sent = turns.sparkSession.sparkContext.broadcast(vocabulary)
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    one = turns.select(F.col(conv_col).alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), empty(role_col), empty(text_col)).alias("t"))
    whole = one.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t")).select("conv_id", F.col(f"t.{role_col}").alias("roles"), F.col(f"t.{text_col}").alias("texts"))
    kind = turns.schema[conv_col].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(sent.value)
        t.encode_special_tokens = True
        for b in batches:
            got = [render(list(zip(r, x, strict=True))) for r, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            ids, masks, starts, ends = [], [], [], []
            for (formatted, spans), roles in zip(got, b.column(1).to_pylist(), strict=True):
                encoded = t.encode(formatted, add_special_tokens=False)
                own = np.array([s for s, r in zip(spans, roles, strict=True) if r == learnt and s[0] < s[1]], np.int64).reshape(-1, 2)
                on, lo, hi = masked(np.array(encoded.offsets, np.int64).reshape(-1, 2), own)
                ids.append(np.array(encoded.ids, np.int32))
                masks.append(on.astype(np.int8))
                starts.append(lo[on].astype(np.int32))
                ends.append(hi[on].astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([f for f, _ in got], pa.string()), pa.array(ids, pa.list_(pa.int32())), pa.array(masks, pa.list_(pa.int8())), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32()))],
                ["conv_id", "formatted", "input_ids", "loss_mask", "loss_from", "loss_to"],
            )

    return whole.mapInArrow(encode, f"conv_id {kind}, formatted string, input_ids array<int>, loss_mask array<tinyint>, loss_from array<int>, loss_to array<int>")


def read_back(chats: DataFrame) -> DataFrame:
    """Digests of formatted chats, from the output alone: the turns that parse() finds and the text under the mask."""
    import hashlib

    kind = chats.schema["conv_id"].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for b in batches:
            out = []
            for f, lo, hi in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                turns, loss = parse(f), unescape(chars_under(f, np.array(lo, np.int64), np.array(hi, np.int64)))
                out.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(f)))
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

    return chats.select("conv_id", "formatted", "loss_from", "loss_to").mapInArrow(digest, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
