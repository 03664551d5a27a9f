"""Chat formatting by columnar byte assembly.

A turn becomes ``<|im_start|>role``, a line break, its text, ``<|im_end|>`` and a line break. Control strings inside roles and
texts are made harmless by a backslash and come back when it is taken out. For a slice of turns, the lengths
of all segments give their offsets in one preallocated Arrow buffer; numpy scatters headers and contents to them.

Turns stay rows: a conversation, whose length nothing bounds, is the concatenation of its rows in order, and a
reader streams over them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.frames import slices

START, END = "<|im_start|>", "<|im_end|>"
LEARNT = "assistant"
"""The role whose texts are under the loss mask."""

_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.DOTALL)
_ESCAPED = re.compile(r"<\\(\\*)\|")
_ROLE = re.compile(r"\\(\\|n)")


def _escaped(column: pa.Array) -> pa.Array:
    """``<|`` to ``<\\|``, and one more backslash where some are there already."""
    return pc.replace_substring_regex(column, pattern=r"<(\\*)\|", replacement=r"<\\\1|")


def _plain(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text) if "<" in text else text


def _role_escaped(role: str) -> str:
    """A role on one line, without control strings."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role_plain(role: str) -> str:
    return _ROLE.sub(lambda m: "\n" if m[1] == "n" else "\\", _plain(role))


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column without nulls, and the length of each value."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, np.diff(ends)


def assemble(role: pa.Array, text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Formatted turns, and the first character and number of characters of each turn's text inside them."""
    coded = role.dictionary_encode()
    heads = [f"{START}{_role_escaped(r)}\n" for r in coded.dictionary.to_pylist()]
    which = coded.indices.to_numpy(zero_copy_only=False)
    content = _escaped(text)
    parts = [
        _bytes(pa.array(heads, pa.string()).take(coded.indices)),
        _bytes(content),
        _bytes(pa.array([f"{END}\n"] * len(text), pa.string())),
    ]
    lengths = np.stack([n for _, n in parts], axis=1)
    ends = np.cumsum(lengths.ravel())
    starts = (ends - lengths.ravel()).reshape(lengths.shape)
    total = int(ends[-1]) if len(ends) else 0
    buffer = pa.allocate_buffer(total)
    out = np.frombuffer(buffer, dtype=np.uint8)
    for k, (source, n) in enumerate(parts):
        own = np.cumsum(n) - n
        place = np.arange(len(source)) + np.repeat(starts[:, k] - own, n)
        out[place] = source
    offsets = np.append(starts[:, 0], total).astype(np.int64)
    formatted = pa.LargeStringArray.from_buffers(len(text), pa.py_buffer(offsets), buffer).cast(pa.string())
    first = np.array([len(h) for h in heads], dtype=np.int64)[which] if len(text) else np.zeros(0, np.int64)
    return formatted, first, pc.utf8_length(content).to_numpy(zero_copy_only=False).astype(np.int64)


def format_turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``formatted`` turn, and ``mask_start`` and ``mask_length``, the characters of it that are learnt.

    Turns of the assistant are learnt, others have length 0. The rows of a conversation lie in one partition in order of
    turn, role and text (nulls first), so that they can be read one after another. Null roles and texts are empty; rows
    with a null conversation are one conversation; repeated rows are repeated turns. Other columns are not read.
    """
    rows = df.select(
        F.col(f"`{conv}`").alias("conv_id"),
        F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    )
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1_000_000):
                formatted, first, length = assemble(part.column("role"), part.column("text"))
                learnt = pc.equal(part.column("role"), LEARNT).to_numpy(zero_copy_only=False)
                columns = [*(part.column(c) for c in ("conv_id", "turn", "role")), formatted]
                columns += [pa.array(first), pa.array(np.where(learnt, length, 0))]
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["conv_id", "turn", "role", "formatted", "mask_start", "mask_length"]
    schema = f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, formatted string, mask_start long, mask_length long"
    return rows.mapInArrow(run, schema)


def read_turn(formatted: str) -> tuple[str, str]:
    """Role and text of a formatted turn, as they were."""
    m = _TURN.fullmatch(formatted)
    if m is None:
        raise ValueError("not a formatted turn")
    return _role_plain(m[1]), _plain(m[2])


def digests(turns: DataFrame) -> DataFrame:
    """What formatted turns read back as: a row for each conversation, from one pass over rows in order.

    Columns: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars. A digest runs along its conversation, whose rows
    one task therefore reads, a batch at a time and holding none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, out = None, []
        for batch in batches:
            for conv, formatted, first, length in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if open_ is None or conv != open_[0]:
                    if open_ is not None:
                        out.append(open_)
                    open_ = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = read_turn(formatted)
                learnt = _plain(formatted[first : first + length])
                open_[1] += 1
                open_[2].update(f"{role}\n{text}\n".encode())
                open_[3] += len(learnt)
                open_[4].update(learnt.encode())
                open_[5] += len(formatted)
            if out:
                yield told(out)
                out = []
        if open_ is not None:
            yield told([open_])

    def told(rows: list[list]) -> pa.RecordBatch:
        conv, n, all_, chars, loss, length = zip(*rows, strict=True)
        columns = [pa.array(conv, kind), pa.array(n, pa.int64()), pa.array([h.hexdigest() for h in all_]), pa.array(chars, pa.int64())]
        columns += [pa.array([h.hexdigest() for h in loss]), pa.array(length, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names)

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(turns.schema["conv_id"].dataType)
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    own = turns.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {own}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return turns.select("conv_id", "formatted", "mask_start", "mask_length").mapInArrow(run, schema)
