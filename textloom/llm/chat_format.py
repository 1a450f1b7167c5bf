"""Chat formatting: conversations as token ids with masks, assembled from separately encoded segments.

Each turn becomes start, role, content, end.  Start, end and the known roles are reserved ids, spliced
between the encoded segments, so no merge crosses a border and no text can make a reserved id.
Control strings that occur in content are escaped by a backslash after their '<' (a backslash
that is there already gets company, so it can be undone), and the tokenizer treats special
strings as text.  The loss mask is the prefix sum of +1 where an assistant's content begins
and -1 after its end mark.

Each turn is encoded to one segment of bytes, which is all that is shuffled; a batch of conversations is put together by
array operations over their segments laid end to end.

Defined results: turns in order of turn (null first), role (null first), then the segment's bytes; repeated turns all stay; null text is
empty content; a null or unknown role is encoded as text after the start mark; a turn without conv_id is a conversation
of its own; an empty table gives no rows; very long texts are encoded whole.  A conversation whose turns are numbered from `SPAN` on is given in parts, a row for each
`SPAN` numbers (column part), each like a conversation of its own, so no row grows without bound
unless one number itself repeats; extra columns are ignored; the tokenizer's path is a parameter.  conv_id and turn must be numbers or texts of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tokens import bytes_of
from ._util import own

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
ROLES = ("system", "user", "assistant")
SPAN = 1 << 16
RESERVED = {"begin": 50257, "start": 50258, "end": 50259, "system": 50260, "user": 50261, "assistant": 50262}
_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


@lru_cache(2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def segments(turns: DataFrame, path: str = TOKENIZER, reserved: dict[str, int] = RESERVED) -> DataFrame:
    """conv_id, turn, role, segment (little-endian int32 ids), head (ids before the content) of each turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        heads: dict[str | None, list[int]] = {r: [reserved["start"], reserved[r]] for r in ROLES}
        heads[None] = [reserved["start"]]
        for b in batches:
            role, text = b.column("role").to_pylist(), b.column("text").to_pylist()
            for r in set(role) - heads.keys():
                heads[r] = [reserved["start"], *t.encode(escape(r) + "\n", add_special_tokens=False).ids]
            out = []
            for i in range(0, len(text), 256):
                done = t.encode_batch([escape(x) if x else "" for x in text[i : i + 256]], add_special_tokens=False)
                out += [np.array([*heads[r], *e.ids, reserved["end"]], "<i4").tobytes() for r, e in zip(role[i : i + 256], done)]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("turn"), b.column("role"), pa.array(out, pa.binary()), pa.array([len(heads[r]) for r in role], pa.int32())], names=["conv_id", "turn", "role", "segment", "head"])

    base = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return base.mapInArrow(run, "conv_id long, turn long, role string, segment binary, head int")


def assemble(size: np.ndarray, head: np.ndarray, trained: np.ndarray, flat: np.ndarray, of: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, loss mask and offsets of conversations of[c]:of[c + 1] of the turns whose segments, of these sizes, flat holds end to end."""
    at = np.concatenate([[0], np.cumsum(size)])
    offsets = at[of] + np.arange(len(of))  # each conversation has its begin mark in front
    ids = np.empty(offsets[-1], np.int32)
    first = np.zeros(len(ids), bool)
    first[offsets[:-1]] = True
    ids[first], ids[~first] = begin, flat
    step = np.zeros(len(ids) + 1, np.int8)
    shift = np.repeat(np.arange(1, len(of)), np.diff(of))  # begin marks up to each turn
    start = at[:-1] + shift
    step[(start + head)[trained]] += 1
    step[(start + size)[trained]] -= 1
    return ids, np.cumsum(step[:-1], dtype=np.int8), offsets


def chats(conversations: DataFrame, path: str = TOKENIZER, reserved: dict[str, int] = RESERVED, span: int = SPAN) -> DataFrame:
    """conv_id, part, input_ids, loss_mask, n_turns, n_tokens, n_trained of every conversation."""
    rows = segments(own(conversations, "conv_id", "turn", "role", "text"), path, reserved)
    lone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    part = F.coalesce(F.floor(F.col("turn") / span), F.lit(0)).cast("int")
    keyed = rows.select("conv_id", part.alias("part"), lone.alias("lone"), F.struct("turn", "role", "segment", "head").alias("t"))
    grouped = keyed.groupBy("conv_id", "part", "lone").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    slim = grouped.select("conv_id", "part", F.col("turns.segment").alias("segments"), F.col("turns.head").alias("heads"), F.transform("turns.role", lambda r: F.coalesce(r == "assistant", F.lit(False))).alias("trained"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seg = b.column("segments")
            each = seg.flatten()
            of = seg.offsets.to_numpy().astype(np.int64)
            flat, size = bytes_of(each)
            head, trained = (b.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("heads", "trained"))
            ids, mask, offsets = assemble(np.diff(size) // 4, head, trained.astype(bool), flat.view("<i4"), of - of[0], reserved["begin"])
            cuts = pa.array(offsets, pa.int32())
            total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[offsets]
            yield pa.RecordBatch.from_arrays(
                [b.column("conv_id"), b.column("part"), pa.ListArray.from_arrays(cuts, pa.array(ids)), pa.ListArray.from_arrays(cuts, pa.array(mask)), pa.array(np.diff(of), pa.int32()), pa.array(np.diff(offsets), pa.int32()), pa.array(np.diff(total), pa.int32())],
                names=["conv_id", "part", "input_ids", "loss_mask", "n_turns", "n_tokens", "n_trained"],
            )

    return slim.mapInArrow(run, "conv_id long, part int, input_ids array<int>, loss_mask array<byte>, n_turns int, n_tokens int, n_trained int")


def brute_force(turns: list[tuple], path: str = TOKENIZER, reserved: dict[str, int] = RESERVED) -> list[tuple[list[int], list[int]]]:
    """Ids and mask of one conversation's (turn, role, text), a token at a time; for tests."""
    t, out = tokenizer(path), [(reserved["begin"], 0)]
    encode = lambda s: t.encode(s, add_special_tokens=False).ids
    listed = []
    for n, role, text in turns:
        head = [reserved["start"]] + ([reserved[role]] if role in ROLES else encode(escape(role) + "\n") if role is not None else [])
        listed.append(((n is not None, n or 0), (role is not None, role or ""), head, [*encode(escape(text or "")), reserved["end"]]))
    for _, role, head, body in sorted(listed, key=lambda x: (x[0], x[1], np.array([*x[2], *x[3]], "<i4").tobytes())):
        out += [(i, 0) for i in head] + [(i, int(role == (True, "assistant"))) for i in body]
    return [i for i, _ in out], [m for _, m in out]
