"""Chat formatting by columnar byte assembly.

Every turn becomes ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n``. The lengths of all segments of a batch give cumulative
offsets; scatter indices copy the fixed strings, roles and texts into one preallocated buffer, which is the Arrow
column of formatted conversations. Control strings inside texts and roles are broken by a backslash behind their first
character and backslashes are doubled, so no control string is left in them and ``read_back`` restores them exactly.
The loss mask has the code points of assistant texts, as spans within the formatted string.

Conversations come together by a shuffle on their id, sorted by turn within partitions; a task streams them and holds
one conversation and a batch of rows, as long as the string it makes of it.

Results for odd rows: null text and role count as empty; null turns come first; ties go by role, then text; repeated
rows are repeated turns; a row with a null conv_id is a conversation of its own (such rows are dealt by their contents); an empty
table gives no rows; texts are whole, however long (a formatted conversation has up to 2 GB, as every string); other columns
are not read."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat_gather, ship, tidy, utf8

HEAD, END = "<|im_start|>", "<|im_end|>\n"
#: Strings that some chat template gives a meaning.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def escape(column: pa.Array, role: bool = False) -> pa.Array:
    """Doubles backslashes and puts one behind the first character of control strings (and a role's line breaks)."""
    column = pc.replace_substring(column, "\\", "\\\\")
    for c in CONTROL:
        column = pc.replace_substring(column, c, f"{c[0]}\\{c[1:]}")
    return pc.replace_substring(column, "\n", "\\n") if role else column


_ROLE, _TEXT = re.compile(r"\\(\\|n)?"), re.compile(r"\\(\\)?")


def unescape(text: str, role: bool = False) -> str:
    if "\\" not in text:
        return text
    if role:
        return _ROLE.sub(lambda m: {"\\": "\\", "n": "\n", None: ""}[m[1]], text)
    return _TEXT.sub(lambda m: m[1] or "", text)


def assemble(conv: np.ndarray, roles: pa.Array, texts: pa.Array):
    """Rows in order, ``conv`` the number of each row's conversation (0, 1, ... ascending) -> (formatted, spans).

    spans: for each conversation the starts and ends of assistant texts in code points."""
    n = len(conv)
    parts = [(np.frombuffer(HEAD.encode(), np.uint8), None), utf8(escape(roles, True)), (np.frombuffer(b"\n", np.uint8), None), utf8(escape(texts)), (np.frombuffer(END.encode(), np.uint8), None)]
    size = np.stack([np.full(n, len(d)) if o is None else np.diff(o) for d, o in parts], 1)
    flat = size.ravel()
    at = (np.cumsum(flat) - flat).reshape(n, 5)
    buffer = np.empty(int(flat.sum()), np.uint8)
    for k, (data, offs) in enumerate(parts):
        source = flat_gather(np.zeros(n, np.int64) if offs is None else offs[:-1], size[:, k])
        buffer[flat_gather(at[:, k], size[:, k])] = data[source]
    rows_end = np.append(at[1:, 0], len(buffer))
    convs = int(conv[-1]) + 1
    ends = np.zeros(convs, np.int64)
    np.maximum.at(ends, conv, rows_end)
    offs = np.concatenate(([0], ends))
    formatted = pa.LargeStringArray.from_buffers(convs, pa.py_buffer(offs.tobytes()), pa.py_buffer(buffer.tobytes()))
    chars = np.concatenate(([0], np.cumsum((buffer & 0xC0) != 0x80)))
    lossy = np.flatnonzero(pc.equal(pc.fill_null(roles, ""), "assistant").to_numpy(zero_copy_only=False))
    base = chars[offs[conv[lossy]]]
    cut = np.searchsorted(conv[lossy], np.arange(convs + 1))
    lists = [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(chars[x] - base)) for x in (at[lossy, 3], at[lossy, 3] + size[lossy, 3])]
    return formatted, lists, np.bincount(conv, minlength=convs)


FORMATTED = "conv_id long, n_turns long, formatted string, loss_start array<long>, loss_end array<long>"


#: Conversations of about this many bytes are assembled at once (a longer one alone).
_AT_ONCE = 32 << 20


def _starts(batch: pa.RecordBatch) -> np.ndarray:
    """Where conversations start in a sorted batch: at other ids, and at each null."""
    key, nul = batch.column(0).fill_null(0).to_numpy(), batch.column(0).is_null().to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | nul[1:] | nul[:-1])))


def _formatted(batches):
    held: list[pa.RecordBatch] = []  # rows of the last conversation

    def out(parts):
        t = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        start = _starts(t)
        size = np.bincount(np.searchsorted(start, np.arange(t.num_rows), side="right") - 1, np.diff(utf8(t.column(2))[1]) + 64)
        cut = np.append(np.flatnonzero(np.diff(np.cumsum(size) // _AT_ONCE, prepend=-1)), len(start))
        for a, b in zip(cut, cut[1:]):
            piece = t.slice(start[a], (start[b] if b < len(start) else t.num_rows) - start[a])
            own = start[a:b] - start[a]
            conv = np.searchsorted(own, np.arange(piece.num_rows), side="right") - 1
            text, lists, turns = assemble(conv, piece.column(1).cast(pa.large_string()), piece.column(2).cast(pa.large_string()))
            yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(own)), pa.array(turns), text.cast(pa.string()), *lists], names=["conv_id", "n_turns", "formatted", "loss_start", "loss_end"])

    for batch in batches:
        if not batch.num_rows:
            continue
        start = _starts(batch)
        first = batch.column(0)[0]
        goes_on = bool(held) and first.is_valid and first.equals(held[-1].column(0)[0])
        if goes_on and len(start) == 1:
            held.append(batch)
            continue
        if held and not goes_on:
            yield from out(held)
            held = []
        if start[-1]:
            yield from out([*held, batch.slice(0, start[-1])])
        held = [*([] if start[-1] else held), batch.slice(start[-1])]
    if held:
        yield from out(held)


def format_chats(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text) -> one row for each conversation: FORMATTED."""
    ship(turns.sparkSession)
    plain = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    alone = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text"))
    return plain.repartition(F.col("conv_id"), alone).sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(tidy(_formatted), FORMATTED)


_TURN = re.compile(re.escape(HEAD) + "(.*?)\n(.*?)" + re.escape(END), re.S)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    out, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError("not a formatted conversation")
        out.append((unescape(m[1], True), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError("not a formatted conversation")
    return out


def _digests(batches):
    for batch in batches:
        rows = []
        for conv, _, text, starts, ends in zip(*(c.to_pylist() for c in batch.columns)):
            turns = read_back(text)
            whole, loss, n = hashlib.sha256(), hashlib.sha256(), 0
            for role, said in turns:
                whole.update(f"{role}\n{said}\n".encode())
            for a, b in zip(starts, ends):
                said = unescape(text[a:b])
                loss.update(said.encode())
                n += len(said)
            rows.append((conv, len(turns), whole.hexdigest(), n, loss.hexdigest(), len(text)))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def digests(formatted: DataFrame) -> DataFrame:
    """What reading the formatted conversations back gives."""
    return formatted.mapInArrow(tidy(_digests), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
