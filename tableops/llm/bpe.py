"""Byte-level BPE by prefix dynamic programming: encoding, decoding, appends and edits.

The ids of a byte string end in a token that is the last one of exactly one sequence of merges, so each prefix of a
piece (a match of the split pattern) has one valid last token. It is found from shorter prefixes: a token that ends
there is valid if merging the bytes of it and of the last token before it gives just these two. An automaton
over the vocabulary names the tokens that end at each byte. The ids are read off backwards. The table of a
prefix never changes when bytes follow, so an append only adds to it, and an edit computes anew what lies between its
place and the first piece that starts where one started before.

Defined results: null text counts as empty and has no ids; rows, repeated ones and null keys too, are encoded
each for itself, and other columns are not read. A piece that is a token as a whole is that token, as in tiktoken.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache, partial

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tableops.llm.common import frugal, texts_of

#: Pieces of at most so many characters are remembered by a task, and so many of them and of the pairs judged.
REMEMBERED_CHARS, REMEMBERED = 64, 1 << 19
#: Rows whose ids a task holds at a time.
ROWS = 256
#: A match of the pattern is decided by its first characters, and by those up to so many after its end (white space leaves its last one to a word).
LOOKAHEAD, BEYOND = 3, 2


class PrefixTable:
    """Last tokens of the prefixes of byte strings, for one vocabulary (bytes -> rank, every single byte among them)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self.size_of = [len(self.bytes_of.get(rank, b"")) for rank in range(max(self.bytes_of) + 1)]
        self.ending = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.judged: dict[int, bool] = {}
        self.spines: tuple[dict, dict] = ({}, {})
        # A token that its own bytes don't merge to ends no prefix.
        for token, rank in ranks.items():
            if self.merge(token) == [token]:
                self.ending.add_word(token.decode("latin-1"), rank)
        self.ending.make_automaton()

    def merge(self, data: bytes, below: float = float("inf")) -> list[bytes]:
        """Parts of a few bytes after the merges of rank under `below`, the lowest rank first."""
        parts = [data[k : k + 1] for k in range(len(data))]
        while len(parts) > 1:
            found = [self.ranks.get(a + b, below) for a, b in zip(parts, parts[1:], strict=False)]
            rank = min(found)
            if rank >= below:
                break
            k = found.index(rank)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def spine(self, token: int, side: int) -> list[tuple[bytes, float]]:
        """The token, the part on this side (0 left, 1 right) of its last merge, that of this part, and so on, with the rank at which each is made."""
        known = self.spines[side].get(token)
        if known is None:
            data = self.bytes_of[token]
            made = token if len(data) > 1 else -1
            known = [(data, made)] + (self.spine(self.ranks[self.merge(data, token)[-side]], side) if made >= 0 else [])
            self.spines[side][token] = known
        return known

    def follows(self, before: int, token: int) -> bool:
        """Whether merging the bytes of both tokens gives them again: no merge ever joins the parts beside the place where they meet."""
        left, right, ranks = self.spine(before, 1), self.spine(token, 0), self.ranks
        i = j = 0
        next_left = next_right = float("inf")  # ranks at which the parts beside the place go on into larger ones
        while True:
            (a, made_a), (b, made_b) = left[i], right[j]
            rank = ranks.get(a + b)
            # Of merges of one rank the leftmost comes first.
            if rank is not None and rank < next_left and rank <= next_right:
                return False
            if made_a > made_b:
                next_left, i = made_a, i + 1
            elif made_b >= 0:
                next_right, j = made_b, j + 1
            else:
                return True

    def extend(self, last: list[int], data: bytes) -> list[int]:
        """last, right for the prefixes of data that it covers, made to cover all: last[k] ends data[: k + 1]."""
        n, judged, size_of = len(last), self.judged, self.size_of
        if len(judged) > REMEMBERED:
            judged.clear()
        for end, token in self.ending.iter(data.decode("latin-1"), max(0, n - self.longest + 1)):
            if end != n:  # the prefix has its token
                continue
            size = size_of[token]
            if size <= end:
                before = last[end - size]
                pair = before << 32 | token
                valid = judged.get(pair)
                if valid is None:
                    valid = judged[pair] = self.follows(before, token)
                if not valid:
                    continue
            last.append(token)
            n += 1
        return last

    def read(self, last: list[int], data: bytes) -> list[int]:
        """Ids of data from its table."""
        if data in self.ranks:
            return [self.ranks[data]]
        ids, k = [], len(data)
        while k:
            ids.append(last[k - 1])
            k -= self.size_of[last[k - 1]]
        return ids[::-1]


class _Pieces(dict):
    """Ids, as little-endian bytes, of the pieces met so far; what is too long or too much isn't kept."""

    def __init__(self, table: PrefixTable):
        self.table = table

    def __missing__(self, piece: str) -> bytes:
        data = piece.encode()
        ids = array("I", self.table.read([] if data in self.table.ranks else self.table.extend([], data), data)).tobytes()
        if len(piece) <= REMEMBERED_CHARS:
            if len(self) > REMEMBERED:
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """Encodes texts with one vocabulary and one split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.table, self.pattern = PrefixTable(ranks), regex.compile(pattern)
        self.pieces = _Pieces(self.table)

    def ids_bytes(self, text: str) -> bytes:
        """Ids of text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.ids_bytes(text), "<u4").tolist()

    def open(self, text: str = "") -> EditedText:
        return EditedText(self, text)


class EditedText:
    """A text with the prefix tables of its pieces, which stay exact through appends and replacements."""

    def __init__(self, encoder: Encoder, text: str):
        self.encoder, self.text = encoder, ""
        self.starts: list[int] = []  # of the pieces, in characters
        self.tables: list[list[int]] = []
        self.computed = 0  # prefixes whose last token was computed, not taken over
        self.replace(0, 0, text)

    def _piece(self, k: int) -> str:
        return self.text[self.starts[k] : self.starts[k + 1] if k + 1 < len(self.starts) else len(self.text)]

    def ids(self) -> list[int]:
        out: list[int] = []
        for k, table in enumerate(self.tables):
            out += self.encoder.table.read(table, self._piece(k).encode())
        return out

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, new: str) -> None:
        """Puts new in the place of text[start:end]."""
        ends = [*self.starts[1:], len(self.text)]
        # Pieces before the edit stay if nothing that ended their match lies in it.
        first = next((k for k, s in enumerate(self.starts) if max(s + LOOKAHEAD, ends[k] + BEYOND) > start), len(self.starts))
        shift = len(new) - (end - start)
        later = {s + shift: k for k, s in enumerate(self.starts) if s >= end}
        old = [self._piece(k).encode() for k in range(first, len(self.starts))]
        old_tables, old_starts = self.tables[first:], self.starts[first:]
        self.text = self.text[:start] + new + self.text[end:]
        at = old_starts[0] if old_starts else (ends[-1] if self.starts else 0)
        del self.starts[first:], self.tables[first:]
        place = 0
        for match in self.encoder.pattern.finditer(self.text, at):
            same = later.get(match.start())
            if same is not None and match.start() >= start + len(new):  # from here on all is as it was
                self.starts += [s + shift for s in old_starts[same - first :]]
                self.tables += old_tables[same - first :]
                return
            data = match.group().encode()
            common = _common(data, old[place]) if place < len(old) else 0
            table = old_tables[place][:common] if common else []
            self.computed += len(data) - common
            self.starts.append(match.start())
            self.tables.append(self.encoder.table.extend(table, data))
            place += 1


def _common(a: bytes, b: bytes) -> int:
    """Bytes that a and b begin with alike."""
    n = min(len(a), len(b))
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    differs = x != y
    return int(differs.argmax()) if differs.any() else n


def read_ranks(path: str) -> dict[bytes, int]:
    """A file of ranks: a token in base64 and its rank on each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


@lru_cache(maxsize=2)
def encoder(ranks_path: str, pattern: str) -> Encoder:
    return Encoder(read_ranks(ranks_path), pattern)


@lru_cache(maxsize=2)
def _spelling(ranks_path: str) -> np.ndarray:
    ranks = read_ranks(ranks_path)
    spelt = np.full(max(ranks.values()) + 1, b"", dtype=object)
    for token, rank in ranks.items():
        spelt[rank] = token
    return spelt


def decode_ids(ids_bytes: bytes, ranks_path: str) -> bytes:
    return b"".join(_spelling(ranks_path)[np.frombuffer(ids_bytes, "<u4")].tolist())


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and ids (binary: little-endian unsigned 32-bit integers) of every row of docs; the file lies on every worker."""
    kept = docs.select(key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_bytes = encoder(ranks_path, pattern).ids_bytes
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(ids_bytes, texts_of(part.column(1))), pa.binary())], names=[key, "ids"])

    return kept.mapInArrow(frugal(run), f"`{key}` {dict(kept.dtypes)[key]}, ids binary")


def decode_documents(encoded: DataFrame, ranks_path: str, key: str = "doc_id") -> DataFrame:
    """encoded (key, ids) with the bytes that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = partial(decode_ids, ranks_path=ranks_path)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(map(decode, part.column(1).to_pylist()), pa.binary())], names=[key, "ids", "decoded"])

    return encoded.select(key, "ids").mapInArrow(frugal(run), f"`{key}` {dict(encoded.dtypes)[key]}, ids binary, decoded binary")
