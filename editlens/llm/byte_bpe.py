"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A rank file becomes a vocabulary and merges in the characters of the byte table (every byte has a printable
character). By the rank rule (of all neighbours that form a token, those of the smallest rank merge first, the leftmost of
equals) a token always comes from the same two parts, whatever stands around it: until it is whole, no merge crosses its
ends, and those within it go on as if it stood alone. So one merge for each token, in the order of ranks, makes the library
give the ids of the rank rule.

Texts are cut at blanks that follow other characters, where no match of the pattern can span. Different cuts (hashed, then
compared byte by byte) are put together to long texts, which the library splits by the pattern and encodes; the byte offsets
of its tokens give each cut its ids, and a worker remembers a bounded number of them by their bytes.
Decoding maps ids back through the reversed byte table by offsets; characters split over tokens come together in the
bytes, and ``decode_texts`` replaces only bytes that form no character.

Results for odd rows: a null or empty text has no ids and decodes to no bytes; an empty table gives no rows; texts are
whole, however long; rows that repeat, and ties in doc_id, are encoded alike, each for itself; a null doc_id stays null.
Other columns stay as they are, unless they have the names of the output."""

from __future__ import annotations

import base64
import functools
import hashlib
import os

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_kinds, flat_gather, list_slices, ship, slices, span_hash, spell, spelled, tidy, utf8

#: Different cuts that a worker remembers.
CACHE = 250_000
#: Bytes of cuts that are encoded together.
_TOGETHER = 1 << 14
_NEVER = 1 << 62
_BLANKS = b" \t\n\x0b\x0c\r"


@functools.lru_cache(1)
def byte_characters() -> tuple[str, ...]:
    """The printable character of each byte: itself where printable, else the next one from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return tuple(chr(b if b in printable else next(others)) for b in range(256))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Speller:
    """Bytes of ids, by the byte table reversed."""

    def __init__(self, path: str):
        chars = byte_characters()
        names = {r: "".join(chars[b] for b in t) for t, r in read_ranks(path).items()}
        size = max(names) + 1
        back = {c: b for b, c in enumerate(chars)}
        self.token_bytes, self.token_at = spelled([bytes(back[x] for x in names.get(i, "")) for i in range(size)])
        self.digit_bytes, self.digit_at = spelled([b"%d," % i for i in range(size)])

    def decode(self, ids: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of consecutive lists of ids, and offsets."""
        return spell(ids, offs, self.token_bytes, self.token_at)

    def digits(self, ids: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Decimal ids, each with a comma behind it."""
        return spell(ids, offs, self.digit_bytes, self.digit_at)


def last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts that the rank rule merges to this token; None if it doesn't come to it."""
    parts = [token[i : i + 1] for i in range(len(token))]
    if any(p not in ranks for p in parts):
        return None
    while len(parts) > 2:
        found = [ranks.get(a + b, _NEVER) for a, b in zip(parts, parts[1:])]
        least = min(found)
        if least == _NEVER:
            return None
        i = found.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return tuple(parts) if len(parts) == 2 else None


class Coder:
    """Encodes by one rank file."""

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks = read_ranks(path)
        chars = byte_characters()
        name = {t: "".join(chars[b] for b in t) for t in ranks}
        merges = [(name[m[0]], name[m[1]]) for t in sorted(ranks, key=ranks.get) if (m := last_merge(t, ranks))]
        self.model = Tokenizer(models.BPE(vocab={name[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), level])
        self.size = np.zeros(max(ranks.values(), default=-1) + 1, np.int64)
        for t, r in ranks.items():
            self.size[r] = len(t)
        self.known: dict[bytes, np.ndarray] = {}

    def _new(self, cuts: list[bytes]) -> list[np.ndarray]:
        """Ids of different cuts."""
        out: list = [None] * len(cuts)
        groups, group, size = [], [], 0
        for i, c in enumerate(cuts):
            if c[0] not in _BLANKS or c[-1] in _BLANKS or c[-1] >= 0x80 and c[-3:].decode("utf-8", "ignore")[-1:].isspace():
                groups.append([i])  # it can't be told from what would stand before or behind it
            else:
                group.append(i)
                size += len(c)
                if size > _TOGETHER:
                    groups.append(group)
                    group, size = [], 0
        groups += [group] if group else []
        for at in range(0, len(groups), 64):  # the library's results are large
            part = groups[at : at + 64]
            texts = [b"".join(cuts[i] for i in g) for g in part]
            for g, t, e in zip(part, texts, self.model.encode_batch_fast([t.decode("utf-8") for t in texts], add_special_tokens=False)):
                ids = np.array(e.ids, np.int32)
                ends = np.cumsum(self.size[ids])
                wanted = np.cumsum([len(cuts[i]) for i in g])
                upto = np.searchsorted(ends, wanted)
                if not len(ends) or (ends[upto] != wanted).any():
                    raise ValueError("the library's tokens don't end where the cuts do")
                for i, a, b in zip(g, [0, *(upto[:-1] + 1)], upto + 1):
                    out[i] = ids[a:b]
        return out

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of consecutive texts, and offsets."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(offs), np.int64)
        start = _cuts(data, offs)
        size = np.diff(np.append(start, n))
        raw = data.tobytes()
        code, seen = pd.factorize(span_hash(data, start, start + size))
        first = np.full(len(seen), -1, np.int64)
        first[code[::-1]] = np.arange(len(code))[::-1]
        like = first[code]
        if (size != size[like]).any() or (data != data[flat_gather(start[like], size)]).any():  # a hash stands for two cuts
            code, seen = pd.factorize(np.array([raw[a : a + k] for a, k in zip(start.tolist(), size.tolist())], object))
            first = np.full(len(seen), -1, np.int64)
            first[code[::-1]] = np.arange(len(code))[::-1]
        keys = [raw[a : a + k] for a, k in zip(start[first].tolist(), size[first].tolist())]
        if len(self.known) + len(keys) > CACHE:
            self.known.clear()
        fresh = [k for k in keys if k not in self.known]
        self.known.update(zip(fresh, self._new(fresh)))
        each = [self.known[k] for k in keys]
        sizes = np.array([len(x) for x in each])
        flat = np.concatenate(each)
        at = np.cumsum(sizes) - sizes
        counts = sizes[code]
        ids = flat[flat_gather(at[code], counts)]
        total = np.concatenate(([0], np.cumsum(counts)))
        return ids, total[np.searchsorted(start, offs)]


def _cuts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Starts of the cuts: texts' starts, and blanks (ASCII white space) behind a character that isn't white space."""
    blank = byte_kinds("exact")[1][data]
    cut = blank.copy()
    cut[0] = False
    cut[1:] &= ~blank[:-1]
    for i in np.flatnonzero(cut[1:] & (data[:-1] >= 0x80)) + 1:
        # U+0085, U+00A0, U+1680, U+2000-205F and U+3000 are or may be white space: no cut behind them
        two, three = bytes(data[max(i - 2, 0) : i]), bytes(data[max(i - 3, 0) : i])
        if two in (b"\xc2\x85", b"\xc2\xa0") or three[:2] in (b"\xe1\x9a", b"\xe2\x80", b"\xe2\x81", b"\xe3\x80"):
            cut[i] = False
    cut[offs[:-1][offs[:-1] < offs[1:]]] = True
    return np.flatnonzero(cut)


@functools.lru_cache(1)
def coder(path: str, pattern: str) -> Coder:
    return Coder(path, pattern)


@functools.lru_cache(1)
def speller(path: str) -> Speller:
    return Speller(path)


def _encoded(path: str, pattern: str, text: str):
    def run(batches):
        own = coder(path, pattern)
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for part in slices(batch, text):
                ids, offs = own.encode(*utf8(part.column(at)))
                lists = pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(np.diff(offs))], names=[*part.schema.names, "ids", "n_tokens"])
        own.known.clear()

    return run


def encode_texts(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """docs with ``ids`` (array of int) and ``n_tokens`` for the whole text; special tokens are ordinary text."""
    ship(docs.sparkSession)
    docs = docs.drop("ids", "n_tokens")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(tidy(_encoded(path, pattern, text)), f"{fields}, ids array<int>, n_tokens long")


def _decoded(path: str, pattern: str):
    def run(batches):
        own = speller(path)
        for batch in batches:
            at = batch.schema.get_field_index("ids")
            for part in list_slices(batch, at):
                lists = part.column(at).fill_null([]) if part.column(at).null_count else part.column(at)
                cut = lists.offsets.to_numpy()
                data, offs = own.decode(lists.flatten().to_numpy(zero_copy_only=False), (cut - cut[0]).astype(np.int64))
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(offs.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])
                yield pa.RecordBatch.from_arrays([*part.columns, raw.cast(pa.binary())], names=[*part.schema.names, "decoded"])

    return run


def decode_ids(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """tokens(ids, ...) with ``decoded`` (binary)."""
    ship(tokens.sparkSession)
    tokens = tokens.drop("decoded")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema)
    return tokens.mapInArrow(tidy(_decoded(path, pattern)), f"{fields}, decoded binary")


def decode_texts(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """As ``decode_ids``, with ``decoded`` as text; bytes that form no character become U+FFFD."""
    return decode_ids(tokens, path, pattern).withColumn("decoded", F.make_valid_utf8(F.col("decoded").cast("string")))


def _both(path: str, pattern: str, digests: bool):
    """Encodes, and decodes the ids again, in one pass: digests of both, or the ids and whether the text came back."""

    def run(batches):
        own, back = coder(path, pattern), speller(path)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for part in slices(batch, "text"):
                data, starts = utf8(part.column(at))
                ids, offs = own.encode(data, starts)
                decoded, ends = back.decode(ids, offs)
                others = [c for i, c in enumerate(part.columns) if i != at]
                names = [n for i, n in enumerate(part.schema.names) if i != at]
                count = pa.array(np.diff(offs))
                if digests:
                    numbers, cut = back.digits(ids, offs)
                    sha = lambda b, a, z: hashlib.sha256(b[a:z]).hexdigest()
                    new = [pa.array([sha(numbers, a, max(a, z - 1)) for a, z in zip(cut, cut[1:])], pa.string()), pa.array([sha(decoded, a, z) for a, z in zip(ends, ends[1:])], pa.string())]
                    yield pa.RecordBatch.from_arrays([*others, count, *new], names=[*names, "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    lists = pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(ids))
                    same = [bool(np.array_equal(decoded[a:z], data[x:y])) for a, z, x, y in zip(ends, ends[1:], starts, starts[1:])]
                    yield pa.RecordBatch.from_arrays([*others, lists, count, pa.array(same, pa.bool_())], names=[*names, "ids", "n_tokens", "restored"])
        own.known.clear()

    return run


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of the ids and of what they decode to."""
    ship(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(tidy(_both(path, pattern, True)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokens_of(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs with ``ids``, ``n_tokens`` and ``restored`` (whether the ids decode to the text) in place of ``text``."""
    ship(docs.sparkSession)
    docs = docs.drop("ids", "n_tokens", "restored")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(tidy(_both(path, pattern, False)), f"{fields}, ids array<int>, n_tokens long, restored boolean")
