"""Chat formatting by columnar byte assembly, and its reader.

Turns are sorted by conversation and turn on the executors; ``format_chats`` then takes them block by
block. The lengths of all segments of a block (start mark, role, newline, text, end mark) give
cumulative offsets; one byte array is allocated for the block, and headers and contents are copied
into it through scatter indices, without a Python string per turn. The array becomes the data buffer
of the Arrow column; rows are parts of conversations, cut at turns.

A turn reads ``<|im_start|>role\\ntext<|im_end|>\\n``. Control strings inside a text cannot be taken
for marks: each ``<``, backslashes, ``|`` gains one backslash, which the reader takes away again. In a
role, backslash, newline and ``<`` are written as ``\\\\``, ``\\n`` and ``\\l``. The loss spans cover
the texts of assistant turns, as byte offsets into the part.

A conversation of any length stays bounded in memory: it comes out as parts of about ``part_bytes``
(a single turn is never cut), each with its number, and the reader carries digests from part to part.

Defined results: null text or role counts as empty; turns sort by turn, then role, then text, a null
turn first; repeated rows are repeated turns; a null conversation id is a conversation of its own; an
empty table gives no rows; other columns are not read.
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

from ._common import blocks

START, END = "<|im_start|>", "<|im_end|>\n"
PART_BYTES = 4 << 20
FORMATTED = "conv_id long, part long, formatted string, n_turns long, loss_starts array<long>, loss_ends array<long>"


def escape_texts(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, r"<(\\*)\|", r"<\\\1|")


def unescape_text(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_roles(roles: pa.Array) -> pa.Array:
    out = pc.replace_substring(roles, "\\", "\\\\")
    out = pc.replace_substring(out, "\n", "\\n")
    return pc.replace_substring(out, "<", "\\l")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"\\": "\\", "n": "\n", "l": "<"}[m[1]], role)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The data of a string column and the offsets of its rows."""
    column = pa.concat_arrays([column.cast(pa.large_string())])
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def _scatter(out: np.ndarray, at: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
    """Copy row i of a column to ``out[at[i]:]`` for all rows at once."""
    lengths = np.diff(offsets)
    if total := int(lengths.sum()):
        first = np.repeat(at - (offsets[:-1] - offsets[0]), lengths)
        out[first + np.arange(total)] = data[offsets[0] : offsets[-1]]


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The formatted bytes of a block of turns; offsets of turns; starts and ends of their texts."""
    role_data, role_at = _bytes(escape_roles(roles))
    text_data, text_at = _bytes(escape_texts(texts))
    start, end = np.frombuffer(START.encode(), np.uint8), np.frombuffer(END.encode(), np.uint8)
    role_n, text_n = np.diff(role_at), np.diff(text_at)
    offsets = np.zeros(len(role_n) + 1, np.int64)
    np.cumsum(len(start) + role_n + 1 + text_n + len(end), out=offsets[1:])
    out = np.empty(int(offsets[-1]), np.uint8)
    turn = offsets[:-1]
    out[turn[:, None] + np.arange(len(start))] = start
    _scatter(out, turn + len(start), role_data, role_at)
    text_from = turn + len(start) + role_n + 1
    out[text_from - 1] = 10
    _scatter(out, text_from, text_data, text_at)
    text_to = text_from + text_n
    out[text_to[:, None] + np.arange(len(end))] = end
    return out, offsets, text_from, text_to


def _format(batches: Iterator[pa.RecordBatch], part_bytes: int) -> Iterator[pa.RecordBatch]:
    last, part = None, 0
    for batch in batches:
        roles, texts = batch.column("role"), batch.column("text")
        sizes = pc.add(pc.binary_length(roles), pc.binary_length(texts)).to_numpy(zero_copy_only=False)
        ids = batch.column("conv_id").to_pylist()
        for a, b in blocks(sizes, part_bytes):
            out, offsets, text_from, text_to = assemble(roles.slice(a, b - a), texts.slice(a, b - a))
            assistant = pc.equal(roles.slice(a, b - a), "assistant").to_numpy(zero_copy_only=False)
            cuts = [0, *[i for i in range(1, b - a) if ids[a + i] != ids[a + i - 1]], b - a]
            first = offsets[cuts]
            loss_from, loss_to, parts = [], [], []
            for k in range(len(cuts) - 1):
                conv = ids[a + cuts[k]]
                part = part + 1 if last is not None and last[0] == conv else 0
                last = (conv,)
                parts.append(part)
                mine = np.flatnonzero(assistant[cuts[k] : cuts[k + 1]]) + cuts[k]
                loss_from.append(text_from[mine] - first[k])
                loss_to.append(text_to[mine] - first[k])
            text = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(first.astype(np.int64)), pa.py_buffer(out))
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[a + c] for c in cuts[:-1]], pa.int64()), pa.array(parts, pa.int64()), text.cast(pa.string()), pa.array(np.diff(cuts), pa.int64()), pa.array(loss_from, pa.list_(pa.int64())), pa.array(loss_to, pa.list_(pa.int64()))],
                names=["conv_id", "part", "formatted", "n_turns", "loss_starts", "loss_ends"],
            )


def format_chats(turns: DataFrame, *, part_bytes: int = PART_BYTES) -> DataFrame:
    """Formatted parts, in order inside each partition; all parts of a conversation lie in one."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.mapInArrow(lambda it: _format(it, part_bytes), FORMATTED)


_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END), re.S)
READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def parse_chat(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted string."""
    found, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError(f"no turn at {at}")
        found.append((unescape_role(m[1]), unescape_text(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"no turn at {at}")
    return found


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    open_id, state = None, None
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def close():
        return {"conv_id": open_id[0], "n_turns": state[0], "turns_sha256": state[1].hexdigest(), "loss_chars": state[2], "loss_sha256": state[3].hexdigest(), "formatted_chars": state[4]}

    for batch in batches:
        done = []
        for conv, formatted, starts, ends in zip(*[batch.column(c) for c in ("conv_id", "formatted", "loss_starts", "loss_ends")], strict=True):
            conv, formatted = conv.as_py(), formatted.as_py()
            if open_id is None or open_id[0] != conv:
                if open_id is not None:
                    done.append(close())
                open_id, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in parse_chat(formatted):
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
            raw = formatted.encode()
            for a, b in zip(starts.as_py(), ends.as_py(), strict=True):
                text = unescape_text(raw[a:b].decode())
                state[2] += len(text)
                state[3].update(text.encode())
            state[4] += len(formatted)
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)
    if open_id is not None:
        yield pa.RecordBatch.from_pylist([close()], schema)


def read_chats(formatted: DataFrame) -> DataFrame:
    """Turns, texts and loss mask read back from ``format_chats``'s parts, as digests per conversation."""
    return formatted.mapInArrow(_digest, READ)
