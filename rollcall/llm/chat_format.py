"""Chat formatting by columnar byte assembly.

A conversation's rows, by turn, become one text

    <|im_start|>role\\ntext<|im_end|>\\n ... for each turn

with the byte spans of the assistant texts as loss mask. Control strings inside
texts are escaped reversibly: ``<``, any number of backslashes, ``|`` gets one
backslash more, so no text holds ``<|``. A role is one line: its backslashes
are doubled and its newlines written ``\\n`` before that.

Rows are dealt by conversation and sorted in their partition. Each task reads
Arrow batches as a stream, takes the conversations that are complete, computes
the lengths of all segments, their cumulative offsets and the scatter indices
in numpy, and copies headers and contents into one preallocated buffer that
becomes the Arrow column. What waits for its end is one conversation, which is
one output row in any case.

Null texts and roles are empty. Equal turns stand by role, then text (nulls
first); repeated rows are repeated turns. Rows with a null conversation are one
conversation with a null id. Without rows there is no output.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = b"<|im_start|>", b"<|im_end|>\n"
ASSISTANT = "assistant"
#: Bytes of contents that are assembled at once, about.
BATCH_BYTES = 4 << 20
_TURN = re.compile(rb"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)
_GUARDED = re.compile(rb"<\\(\\*)\|")


def _guard(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, pattern=r"<(\\*)\|", replacement=r"<\\\1|")


def _one_line(roles: pa.Array) -> pa.Array:
    return _guard(pc.replace_substring(pc.replace_substring(roles, "\\", "\\\\"), "\n", "\\n"))


def unguard(text: bytes) -> bytes:
    return _GUARDED.sub(rb"<\1|", text)


def read_role(role: bytes) -> bytes:
    return re.sub(rb"\\(.)", lambda m: b"\n" if m[1] == b"n" else m[1], unguard(role))


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The values' bytes, and where each begins and how long it is."""
    texts = texts.cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), ends[:-1], np.diff(ends)


def _copy(out: np.ndarray, to: np.ndarray, source: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
    """Scatter segment i, ``size[i]`` bytes of ``source`` from ``start[i]``, to ``out`` from ``to[i]``."""
    inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(to, size) + inside] = source[np.repeat(start, size) + inside]


def assemble(t: pa.Table) -> pa.RecordBatch:
    """Whole conversations (columns conv, role, text; their rows stand together) as one row each."""
    conv = t.column("conv").combine_chunks()
    ids = conv.to_pylist()
    first = np.array([i for i in range(len(ids)) if not i or ids[i] != ids[i - 1]], np.int64)
    raw = t.column("role").combine_chunks().fill_null("")
    role, r_start, r_size = _bytes_of(_one_line(raw))
    text, t_start, t_size = _bytes_of(_guard(t.column("text").combine_chunks().fill_null("")))
    head, tail, line = (np.frombuffer(x, np.uint8) for x in (OPEN, CLOSE, b"\n"))
    n = len(ids)
    size = np.stack([np.full(n, len(head)), r_size, np.ones(n, np.int64), t_size, np.full(n, len(tail))], axis=1)
    ends = np.cumsum(size).reshape(n, 5)
    to = ends - size
    out = np.empty(int(ends[-1, -1]), np.uint8)
    none = np.zeros(n, np.int64)
    for i, (source, start) in enumerate(((head, none), (role, r_start), (line, none), (text, t_start), (tail, none))):
        _copy(out, to[:, i], source, start, size[:, i])
    begin = to[first, 0]
    learn = np.flatnonzero(pc.equal(raw, ASSISTANT).to_numpy(zero_copy_only=False))
    owner = np.searchsorted(first, learn, side="right") - 1
    bounds = pa.array(np.searchsorted(owner, np.arange(len(first) + 1)).astype(np.int32))
    spans = [pa.ListArray.from_arrays(bounds, pa.array(x[learn, 3] - begin[owner])) for x in (to, ends)]
    offsets = pa.py_buffer(np.append(begin, len(out)).astype(np.int32))
    formatted = pa.Array.from_buffers(pa.string(), len(first), [None, offsets, pa.py_buffer(out)])
    turns = pa.array(np.diff(np.append(first, n)))
    return pa.RecordBatch.from_arrays([conv.take(pa.array(first)), turns, formatted, *spans],
                                      ["conv", "n_turns", "formatted", "loss_from", "loss_to"])


def _assembled(batches):
    waiting: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        step = max(1, int(batch.num_rows * BATCH_BYTES / max(1, batch.nbytes)))
        for i in range(0, batch.num_rows, step):
            some = t.slice(i, step)
            ids = some.column("conv").to_pylist()
            last = len(ids) - 1
            while last and ids[last - 1] == ids[last]:
                last -= 1
            if waiting and (last or ids[0] != waiting[-1].column("conv")[-1].as_py()):
                yield assemble(pa.concat_tables([*waiting, some.slice(0, last)]))
                waiting = [some.slice(last)]
            elif last:
                yield assemble(some.slice(0, last))
                waiting = [some.slice(last)]
            else:
                waiting.append(some)
    if waiting:
        yield assemble(pa.concat_tables(waiting))


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """``conv_col``, n_turns, ``formatted`` and the byte spans ``loss_from``
    (inclusive) to ``loss_to`` (exclusive) of the assistant texts."""
    kind = turns.schema[conv_col].dataType.simpleString()
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    return (rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").select("conv", "role", "text")
            .mapInArrow(_assembled, f"conv {kind}, n_turns long, formatted string, loss_from array<long>, loss_to array<long>")
            .withColumnRenamed("conv", conv_col))


def parse(formatted: bytes) -> list[tuple[bytes, bytes]]:
    """The (role, text) turns of a formatted conversation."""
    return [(read_role(r), unguard(t)) for r, t in _TURN.findall(formatted)]


def _digests(batches):
    for batch in batches:
        out = []
        formatted = batch.column("formatted")
        for text, a, b in zip(formatted.cast(pa.binary()).to_pylist(), batch.column("loss_from").to_pylist(), batch.column("loss_to").to_pylist()):
            turns = parse(text)
            loss = b"".join(unguard(text[x:y]) for x, y in zip(a, b))
            out.append((len(turns), hashlib.sha256(b"".join(r + b"\n" + t + b"\n" for r, t in turns)).hexdigest(),
                        len(loss.decode()), hashlib.sha256(loss).hexdigest()))
        n, turns_, chars, loss_ = zip(*out) if out else ([], [], [], [])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(turns_, pa.string()), pa.array(chars, pa.int64()), pa.array(loss_, pa.string()),
             pc.utf8_length(formatted).cast(pa.int64())],
            [batch.schema.names[0], "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def read_back(chats: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Digests of the turns and of the text under the loss mask, parsed from
    the formatted text alone."""
    kind = chats.schema[conv_col].dataType.simpleString()
    return chats.select(conv_col, "formatted", "loss_from", "loss_to").mapInArrow(
        _digests, f"`{conv_col}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
