"""SentencePiece encoding and decoding of merge-type (BPE) vocabularies by a score-ordered agenda of adjacent symbol pairs.

A text gets a blank before it, and blanks count as U+2581. Its symbols are at first its characters. Of all neighbours that
together are a piece, the agenda gives the pair of the highest score, of equal ones the leftmost; it becomes one symbol, and its
new neighbours join the agenda. What is no piece in the end becomes its UTF-8 bytes.

No piece can span two neighbouring characters that stand side by side in none, so texts are cut there and the parts
merge apart: with the usual vocabularies before each word. Different parts (hashed, then compared byte by byte) go through the
agenda once, and a worker remembers a bounded number of them. In each Arrow batch the sentencepiece library encodes what the
agenda encoded, put together with a character between that is part of no piece; if any id differs the job ends with an error.
Decoding spells pieces by offsets, drops the blank before the text and decodes bytes; bytes that form no character become
U+FFFD, each for itself.

Vocabularies with normalization of characters, with pieces that the user defined, with unused ones or without bytes are refused.

Results for odd rows: a null or empty text has no ids and decodes to an empty text; an empty table gives no rows; texts are whole,
however long; rows that repeat, and ties in doc_id, are encoded alike, each for itself; a null doc_id stays null; U+2581 in a
text decodes as a blank, as in the library; null ids decode to an empty text. Other columns stay as they are, unless they have the
names of the output."""

from __future__ import annotations

import functools
import hashlib
import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat_gather, list_slices, ship, slices, span_hash, spell, spelled, tidy, utf8

#: Different parts after which a worker forgets those that it hasn't met since it last forgot, and the bytes of the longest.
CACHE, LONGEST = 200_000, 256
#: Symbols up to which the agenda is a list.
SHORT = 48
_NEVER = 1 << 30
_SPACE = "▁"


class Pieces:
    """A vocabulary: ids and scores of pieces, bytes, and which characters stand side by side in a piece."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = lib = SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        names = [lib.id_to_piece(i) for i in range(n)]
        self.byte_id = np.full(256, -1, np.int32)
        self.piece_id: dict[str, int] = {}
        spelling = [b""] * n
        for i, name in enumerate(names):
            if lib.is_byte(i):
                self.byte_id[int(name[3:5], 16)] = i
                spelling[i] = bytes([int(name[3:5], 16)])
            elif lib.is_unknown(i):
                spelling[i] = lib.decode([i]).encode()
            elif not lib.is_control(i):
                self.piece_id[name.replace(_SPACE, " ")] = i
                spelling[i] = name.replace(_SPACE, " ").encode()
        if (self.byte_id < 0).any() or any(lib.is_unused(i) for i in range(n)) or lib.normalize(" ÅＡ ") != f"{_SPACE * 2}ÅＡ{_SPACE}":
            raise ValueError("not a plain merge-type vocabulary with bytes")
        #: The agenda's order: the higher the score, the smaller; equal scores are equal.
        score = {p: lib.get_score(i) for p, i in self.piece_id.items()}
        place = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}
        self.order = {p: place[s] for p, s in score.items()}
        within = {(a, b) for p in self.piece_id for a, b in zip(p, p[1:])}
        codes = np.array([(ord(a) << 21) | ord(b) for a, b in within], np.int64)
        self.side_by_side = np.sort(codes)
        self.ascii_pairs = np.zeros((128, 128), bool)
        low = codes[((codes >> 21) < 128) & ((codes & 0x1FFFFF) < 128)]
        self.ascii_pairs[low >> 21, low & 0x1FFFFF] = True
        inner = {c for p in self.piece_id if len(p) > 1 for c in p}
        self.between = next((c for c in "\n\t\x00\x01\x02" if c not in inner), None)
        if self.between is None or " " not in self.piece_id:
            raise ValueError("a vocabulary in which every character is part of a piece can't be checked part by part")
        self.spelling_bytes, self.spelling_at = spelled(spelling)
        self.digit_bytes, self.digit_at = spelled([b"%d," % i for i in range(n)])
        self.is_byte = np.array([lib.is_byte(i) for i in range(n)])
        self.is_control = np.array([lib.is_control(i) for i in range(n)])
        self.blank_first = np.array([s[:1] == b" " for s in spelling]) & ~self.is_byte & ~np.array([lib.is_unknown(i) for i in range(n)])
        #: Ids of parts met lately, and before.
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def agenda(self, text: str) -> list[int]:
        """Ids of a text that is encoded apart from its surroundings; blanks stand for U+2581."""
        out = []
        for s in self._merged(list(text)) if len(text) <= SHORT else self._merged_by_heap(list(text)):
            i = self.piece_id.get(s)
            out += [i] if i is not None else self.byte_id[list(s.encode())].tolist()
        return out

    def _merged(self, symbol: list[str]) -> list[str]:
        """Few symbols: the agenda is a list with a place for each pair of neighbours, which is searched."""
        order = self.order
        pairs = [order.get(a + b, _NEVER) for a, b in zip(symbol, symbol[1:])]
        while pairs and (least := min(pairs)) != _NEVER:
            i = pairs.index(least)
            symbol[i : i + 2] = [symbol[i] + symbol[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = order.get(symbol[i - 1] + symbol[i], _NEVER)
            if i < len(pairs):
                pairs[i] = order.get(symbol[i] + symbol[i + 1], _NEVER)
        return symbol

    def _merged_by_heap(self, symbol: list[str]) -> list[str]:
        """Many symbols: the agenda is a heap, in which pairs stay that are gone; symbols are linked with their neighbours."""
        n, order = len(symbol), self.order
        behind, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs = [(k, i, i + 1, 2) for i in range(n - 1) if (k := order.get(symbol[i] + symbol[i + 1])) is not None]
        heapq.heapify(pairs)
        while pairs:
            _, i, j, size = heapq.heappop(pairs)
            a, b = symbol[i], symbol[j]
            if not a or not b or behind[i] != j or len(a) + len(b) != size:
                continue  # one of both has merged with another since
            symbol[i], symbol[j] = a + b, ""
            behind[i] = z = behind[j]
            if z < n:
                before[z] = i
                if (k := order.get(symbol[i] + symbol[z])) is not None:
                    heapq.heappush(pairs, (k, i, z, size + len(symbol[z])))
            if (y := before[i]) >= 0 and (k := order.get(symbol[y] + symbol[i])) is not None:
                heapq.heappush(pairs, (k, y, i, len(symbol[y]) + size))
        return [s for s in symbol if s]

    def _new(self, parts: list[bytes]) -> list[bytes]:
        """Ids (of four bytes each) of different parts by the agenda, held against the library's."""
        out = [np.array(self.agenda(p.decode()), np.int32).tobytes() for p in parts]
        apart = self.between.encode()
        own, head = (np.array(self.agenda(x), np.int32).tobytes() for x in (self.between, " "))
        for at in range(0, len(parts), 4096):
            told = self.library.encode((apart + apart.join(parts[at : at + 4096])).decode())
            if np.array(told, np.int32).tobytes() != head + own + own.join(out[at : at + 4096]):
                raise ValueError("the agenda's ids aren't the library's")
        return out

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of consecutive texts, and offsets."""
        data, offs = self._prefixed(data, offs)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offs), np.int64)
        start = self._cuts(data, offs)
        size = np.diff(np.append(start, len(data)))
        raw = data.tobytes()
        code, seen = pd.factorize(span_hash(data, start, start + size))
        first = _first(code, len(seen))
        like = first[code]
        if (size != size[like]).any() or (data != data[flat_gather(start[like], size)]).any():  # a hash stands for two parts
            code, seen = pd.factorize(np.array([raw[a : a + k] for a, k in zip(start.tolist(), size.tolist())], object))
            first = _first(code, len(seen))
        keys = [raw[a : a + k] for a, k in zip(start[first].tolist(), size[first].tolist())]
        now = {k: v for k in keys if (v := self.known.get(k) or self.older.get(k)) is not None}
        fresh = [k for k in keys if k not in now]
        now.update(zip(fresh, self._new(fresh)))
        each = [now[k] for k in keys]
        if len(self.known) > CACHE:  # what is met again moves on to the new ones
            self.known, self.older = {}, self.known
        self.known.update((k, v) for k, v in now.items() if len(k) <= LONGEST)
        sizes = np.array([len(x) // 4 for x in each])
        flat = np.frombuffer(b"".join(each), np.int32)
        at = np.cumsum(sizes) - sizes
        counts = sizes[code]
        total = np.concatenate(([0], np.cumsum(counts)))
        return flat[flat_gather(at[code], counts)], total[np.searchsorted(start, offs)]

    def _prefixed(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts with a blank before each that isn't empty, and blanks for U+2581."""
        raw, mark = data.tobytes(), _SPACE.encode()
        if mark in raw:
            texts = [raw[a:b].replace(mark, b" ") for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
            data, offs = np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        full = (np.diff(offs) > 0).astype(np.int64)
        moved = offs + np.concatenate(([0], np.cumsum(full)))
        out = np.full(moved[-1], 32, np.uint8)
        out[np.arange(len(data)) + np.repeat(moved[:-1] - offs[:-1] + full, np.diff(offs))] = data
        return out, moved

    def _cuts(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Starts of the parts: texts' starts, and where no piece spans the characters on either side."""
        chars = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        place = np.flatnonzero((data & 0xC0) != 0x80)  # where characters start
        a, b = chars[:-1], chars[1:]
        joined = self.ascii_pairs[np.minimum(a, 127), np.minimum(b, 127)] & (a < 128) & (b < 128)
        if len(wide := np.flatnonzero((a >= 128) | (b >= 128))) and len(self.side_by_side):
            pair = (a[wide].astype(np.int64) << 21) | b[wide]
            found = np.minimum(np.searchsorted(self.side_by_side, pair), len(self.side_by_side) - 1)
            joined[wide] = self.side_by_side[found] == pair
        cut = np.zeros(len(data), bool)
        cut[place[1:][~joined]] = True
        cut[offs[:-1][offs[:-1] < offs[1:]]] = True
        return np.flatnonzero(cut)

    def decode(self, ids: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 of consecutive lists of ids, and offsets."""
        data, out = spell(ids, offs, self.spelling_bytes, self.spelling_at)
        full = offs[:-1] < offs[1:]
        head = np.flatnonzero(full)
        first = ids[offs[:-1][head]]
        odd = np.zeros(len(full), bool)
        odd[head] = self.is_control[first]
        try:
            data.tobytes().decode()
        except UnicodeDecodeError:
            odd |= full
        if odd.any():
            raw = data.tobytes()
            texts = [self._decode_one(ids[a:b]) if o else raw[x + bool(a < b and self.blank_first[ids[a]]) : y] for o, a, b, x, y in zip(odd.tolist(), offs[:-1].tolist(), offs[1:].tolist(), out[:-1].tolist(), out[1:].tolist())]
            return spelled(texts)
        drop = np.zeros(len(full), np.int64)
        drop[head] = self.blank_first[first]
        keep = np.ones(len(data), bool)
        keep[out[:-1][drop > 0]] = False
        return data[keep], out - np.concatenate(([0], np.cumsum(drop)))

    def _decode_one(self, ids: np.ndarray) -> bytes:
        out, loose, started = [], b"", False
        at, text = self.spelling_at, self.spelling_bytes
        for i in [*ids.tolist(), None]:
            if i is not None and self.is_byte[i]:
                loose += text[at[i] : at[i + 1]].tobytes()
                continue
            if loose:
                out.append(_characters(loose))
                loose, started = b"", True
            if i is None or self.is_control[i]:
                continue
            piece = text[at[i] : at[i + 1]].tobytes()
            out.append(piece[1:] if not started and self.blank_first[i] else piece)
            started = True
        return b"".join(out)

    def digits(self, ids: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Decimal ids, each with a comma behind it."""
        return spell(ids, offs, self.digit_bytes, self.digit_at)


def _characters(raw: bytes) -> bytes:
    """UTF-8 in which each byte that is part of no character is U+FFFD."""
    out = []
    while raw:
        try:
            return b"".join([*out, raw.decode().encode()])
        except UnicodeDecodeError as e:
            out += [raw[: e.start], "�".encode()]
            raw = raw[e.start + 1 :]
    return b"".join(out)


def _first(code: np.ndarray, n: int) -> np.ndarray:
    """Where each code stands first."""
    first = np.full(n, -1, np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]
    return first


@functools.lru_cache(1)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _fields(frame: DataFrame) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in frame.schema)


def encode_texts(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """docs with ``ids`` (array of int) and ``n_tokens`` for the whole text, without begin and end ids."""
    ship(docs.sparkSession)
    docs = docs.drop("ids", "n_tokens")

    def run(batches):
        own = pieces(path)
        for batch in batches:
            for part in slices(batch, text):
                ids, offs = own.encode(*utf8(part.column(part.schema.get_field_index(text))))
                lists = pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(np.diff(offs))], names=[*part.schema.names, "ids", "n_tokens"])

    return docs.mapInArrow(tidy(run), _fields(docs) + "ids array<int>, n_tokens long")


def decode_ids(tokens: DataFrame, path: str) -> DataFrame:
    """tokens(ids, ...) with ``decoded`` (string)."""
    ship(tokens.sparkSession)
    tokens = tokens.drop("decoded")

    def run(batches):
        own = pieces(path)
        for batch in batches:
            at = batch.schema.get_field_index("ids")
            for part in list_slices(batch, at):
                lists = part.column(at).fill_null([]) if part.column(at).null_count else part.column(at)
                cut = lists.offsets.to_numpy()
                data, offs = own.decode(lists.flatten().to_numpy(zero_copy_only=False), (cut - cut[0]).astype(np.int64))
                text = pa.LargeStringArray.from_buffers(part.num_rows, pa.py_buffer(offs.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes()))
                yield pa.RecordBatch.from_arrays([*part.columns, text.cast(pa.string())], names=[*part.schema.names, "decoded"])

    return tokens.mapInArrow(tidy(run), _fields(tokens) + "decoded string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of the ids and of the text that they decode to."""
    ship(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches):
        own = pieces(path)
        sha = lambda b, a, z: hashlib.sha256(b[a:z]).hexdigest()
        for batch in batches:
            for part in slices(batch, "text"):
                ids, offs = own.encode(*utf8(part.column(1)))
                decoded, ends = own.decode(ids, offs)
                numbers, cut = own.digits(ids, offs)
                of_ids = [sha(numbers, a, max(a, z - 1)) for a, z in zip(cut, cut[1:])]
                of_texts = [sha(decoded, a, z) for a, z in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offs)), pa.array(of_ids, pa.string()), pa.array(of_texts, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return plain.mapInArrow(tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
