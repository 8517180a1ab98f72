"""Chat formatting by columnar byte assembly.

Turns of a conversation become ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside texts and roles, ``<``, any
backslashes and ``|`` get one more backslash, so no control string can stand there, and taking one away restores the
text. Segment lengths, cumulative offsets and scatter indices come from numpy; headers and contents are copied into
one preallocated buffer, which Arrow then holds as the output column.
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

from gridloom.cluster import ship
from gridloom.llm.bytewords import column

START, END = b"<|im_start|>", b"<|im_end|>\n"
_CONTROL = re.compile(rb"<\\*\|")
_ESCAPED = re.compile(rb"<\\(\\*\|)")
_PART = 1 << 20
#: Bytes of text that are formatted into one buffer, and what an Arrow string column can hold.
_BUFFER, _LARGEST = 256 << 20, (1 << 31) - 1
SCHEMA = "conv_id long, n_turns long, formatted string, loss_start array<long>, loss_end array<long>"


def escape(text: bytes) -> bytes:
    return _CONTROL.sub(lambda m: b"<\\" + m[0][1:], text)


def unescape(text: bytes) -> bytes:
    return _ESCAPED.sub(rb"<\1", text)


def _role(role: str | None) -> bytes:
    """A role as it stands in a header, on one line."""
    return escape((role or "").replace("\\", "\\\\").replace("\n", "\\n").encode())


def _role_back(raw: bytes) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(raw).decode())


def _insertions(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Positions in ``data`` before which a backslash goes: the byte after each ``<`` of a control string."""
    pipes = at[0] + np.flatnonzero(data[at[0] : at[-1]] == 0x7C)
    found = []
    for p in pipes.tolist():
        begin = p - 1
        low = int(at[np.searchsorted(at, p, "right") - 1])
        while begin >= low and data[begin] == 0x5C:
            begin -= 1
        if begin >= low and data[begin] == 0x3C:
            found.append(begin + 1)
    return np.array(found, np.int64)


def assemble(texts, roles: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all turns formatted, one after another; where each turn begins and, last, ends; where its content begins and ends)."""
    data, at = column(texts)
    extra = _insertions(data, at)
    names, code = np.unique(np.array(roles, object), return_inverse=True) if roles else (np.array([], object), np.zeros(0, int))
    heads = [START + name + b"\n" for name in names]
    head = np.array([len(x) for x in heads], np.int64)[code] if len(heads) else np.zeros(0, np.int64)
    grown = np.diff(at) + np.diff(np.searchsorted(extra, at))
    ends = np.cumsum(head + grown + len(END))
    begins = ends - head - grown - len(END)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k, x in enumerate(heads):
        rows = begins[code == k]
        out[rows[:, None] + np.arange(len(x))] = np.frombuffer(x, np.uint8)
    content = begins + head
    out[(content + grown)[:, None] + np.arange(len(END))] = np.frombuffer(END, np.uint8)
    shift = content - at[:-1] - np.searchsorted(extra, at[:-1])
    for low in range(int(at[0]), int(at[-1]), _PART):  # scatter indices of a bounded part at a time
        place = np.arange(low, min(low + _PART, int(at[-1])), dtype=np.int64)
        row = np.searchsorted(at, place, "right") - 1
        out[place + shift[row] + np.searchsorted(extra, place, "right")] = data[low : low + len(place)]
    if len(extra):
        row = np.searchsorted(at, extra, "right") - 1
        out[extra + shift[row] + np.arange(len(extra))] = 0x5C
    return out, np.concatenate([begins, ends[-1:]]) if len(ends) else np.zeros(1, np.int64), np.stack([content, content + grown])


def _formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ordered by conversation and turn to one row a conversation; one that crosses batches is carried on."""
    held: list[pa.Table] = []

    def emit(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        conv = t["conv_id"].combine_chunks() if t["conv_id"].num_chunks != 1 else t["conv_id"].chunk(0)
        ids = conv.to_pylist()
        roles = [_role(x) for x in t["role"].to_pylist()]
        out, turn, span = assemble(t["text"], roles)
        if len(out) > _LARGEST:
            raise ValueError(f"conversation {ids[0]} takes {len(out)} bytes when formatted; a string column holds {_LARGEST}")
        first = np.array([0] + [i for i in range(1, len(ids)) if ids[i] != ids[i - 1]] + [len(ids)], np.int64)
        offsets = turn[first]
        loss = np.array([x == b"assistant" for x in roles], bool)
        at = np.searchsorted(np.flatnonzero(loss), first)
        base = np.repeat(offsets[:-1], np.diff(first))
        kind = lambda x: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array((x - base)[loss], pa.int64()))
        text = pa.Array.from_buffers(pa.string(), len(first) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out)])
        return pa.RecordBatch.from_arrays(
            [conv.take(pa.array(first[:-1])).cast(pa.int64()), pa.array(np.diff(first), pa.int64()), text, kind(span[0]), kind(span[1])],
            names=["conv_id", "n_turns", "formatted", "loss_start", "loss_end"],
        )

    def parts(t: pa.Table) -> Iterator[pa.RecordBatch]:
        """Whole conversations of about _BUFFER bytes of text at a time."""
        ids = t["conv_id"].to_pylist()
        size = np.cumsum(pc.fill_null(pc.binary_length(t["text"]), 0).to_numpy())
        low, before = 0, 0
        for i in range(1, len(ids) + 1):
            if i == len(ids) or (ids[i] != ids[i - 1] and size[i - 1] - before >= _BUFFER):
                yield emit(t.slice(low, i - low))
                low, before = i, size[i - 1]

    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        ids = t["conv_id"].to_pylist()
        cut = len(ids)
        while cut and ids[cut - 1] == ids[-1]:
            cut -= 1
        if cut:  # the last conversation may go on in the next batch
            yield from parts(pa.concat_tables([*held, t.slice(0, cut)]))
            held = [t.slice(cut)]
        elif held and held[0]["conv_id"][0].as_py() != ids[0]:
            yield from parts(pa.concat_tables(held))
            held = [t]
        else:
            held.append(t)
    if held:
        yield from parts(pa.concat_tables(held))


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, formatted, loss_start, loss_end: one row a conversation.

    The loss mask holds the texts of assistant turns, as byte spans of ``formatted`` (end exclusive). Rows are
    ordered by turn, then role, then text, nulls first, so repeated rows and ties have one order. Null text and null role
    are empty; rows of null conv_id make one conversation. An empty table has no rows; other columns are ignored.
    One conversation is one output value, so its turns meet in one task, whatever the partitioning; one that takes 2 GiB or more when
    formatted fails the job.
    """
    ship(conversations.sparkSession)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("_turn"), "role", "text")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "_turn", "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(_formatted, SCHEMA)


_TURN = re.compile(re.escape(START) + rb"([^\n]*)\n(.*?)" + re.escape(END), re.S)


def parse(formatted: bytes) -> list[tuple[str, str]]:
    """The turns of a formatted conversation: (role, text)."""
    turns, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError("not a formatted conversation")
        at = m.end()
        turns.append((_role_back(m[1]), unescape(m[2]).decode()))
    if at != len(formatted):
        raise ValueError("not a formatted conversation")
    return turns


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for conv, text, starts, ends in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "formatted", "loss_start", "loss_end")), strict=True):
            raw = text.encode()
            turns = parse(raw)
            loss = b"".join(unescape(raw[a:b]) for a, b in zip(starts, ends, strict=True))
            whole = hashlib.sha256()
            for role, said in turns:
                whole.update(f"{role}\n{said}\n".encode())
            rows.append((conv, len(turns), whole.hexdigest(), len(loss.decode()), hashlib.sha256(loss).hexdigest(), len(text)))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        columns = list(zip(*rows, strict=True)) or [()] * 6
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        )


def read_back(formatted: DataFrame) -> DataFrame:
    """What ``format_chats`` wrote, parsed again: turns and loss text by digest."""
    ship(formatted.sparkSession)
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(_read_back, schema)
