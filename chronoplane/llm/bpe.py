"""Byte-level BPE encoding and decoding as monoid tree reductions.

Encoding: a piece of text (one match of the pattern) is halved until the parts are single bytes; two neighbouring
encodings are joined by re-encoding a window around their border. The window grows on a side until the token left
outside and the token now at the window's edge stay two tokens when encoded together. That suffices: if every two
neighbours of a token sequence encode, taken alone, to just themselves, the first merge over any border in a run over
the whole text would be the first such merge for the two tokens at that border, too, and there is none. The result of
a join is therefore the encoding of the whole, whatever the shape of the tree.

Decoding: ids map to byte strings, which are concatenated pairwise up a tree.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import Memo, plain_word, rarer_collection, sole_holder, split_chunks
from .common import modest_batches


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class TreeEncoder:
    """Encode and decode by the ranks of a vocabulary. Memos are emptied at ``limit`` entries."""

    WINDOW_MEMO = 24  # bytes; longer windows are encoded anew

    def __init__(self, ranks: dict[bytes, int], pattern: str, limit: int = 400_000):
        import regex

        self.ranks, self.limit = ranks, limit
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.find = regex.compile(pattern).findall
        self.small: dict[bytes, tuple[int, ...]] = {}
        self.windows: dict[bytes, tuple[int, ...]] = {}
        self.borders: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, bytes] = {}
        self.memo = Memo(self.encode_chunks, limit=limit)

    def merge(self, data: bytes) -> tuple[int, ...]:
        """Plain rank merging, leftmost lowest first: the definition, used on windows."""
        ranks = self.ranks
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            pairs = [ranks.get(a + b, 1 << 62) for a, b in zip(parts, parts[1:])]
            best = min(pairs)
            if best == 1 << 62:
                break
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return tuple(ranks[p] for p in parts)

    def window(self, data: bytes) -> tuple[int, ...]:
        got = self.windows.get(data)
        if got is None:
            got = self.merge(data)
            if len(data) <= self.WINDOW_MEMO:
                if len(self.windows) > self.limit:
                    self.windows.clear()
                self.windows[data] = got
        return got

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The monoid's product: the encoding of two texts' concatenation from their encodings."""
        if not left or not right:
            return left or right
        of, border = self.bytes_of, (left[-1], right[0])
        stable = self.borders.get(border)
        if stable is None:
            stable = self.window(of[border[0]] + of[border[1]]) == border
            if len(self.borders) > self.limit:
                self.borders.clear()
            self.borders[border] = stable
        if stable:
            return left + right
        i, j = len(left) - 1, 1
        while True:
            middle = self.window(b"".join(of[t] for t in left[i:] + right[:j]))
            grown = False
            if i and self.window(of[left[i - 1]] + of[middle[0]]) != (left[i - 1], middle[0]):
                i, grown = max(0, i - max(1, len(left) - i)), True
            if j < len(right) and self.window(of[middle[-1]] + of[right[j]]) != (middle[-1], right[j]):
                j, grown = min(len(right), 2 * j), True
            if not grown:
                return left[:i] + middle + right[j:]

    def tree(self, data: bytes) -> tuple[int, ...]:
        if len(data) <= 1:
            return (self.ranks[data],) if data else ()
        if len(data) <= 8:
            got = self.small.get(data)
            if got is None:
                half = len(data) // 2
                got = self.join(self.tree(data[:half]), self.tree(data[half:]))
                if len(self.small) > self.limit:
                    self.small.clear()
                self.small[data] = got
            return got
        half = len(data) // 2
        return self.join(self.tree(data[:half]), self.tree(data[half:]))

    def piece(self, data: bytes) -> tuple[int, ...]:
        """One match of the pattern: a token of the vocabulary as it is, anything else by the tree."""
        rank = self.ranks.get(data)
        return self.tree(data) if rank is None else (rank,)

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        find, known, out = self.find, self.pieces, []
        if len(known) > self.limit:
            known.clear()
        for chunk in chunks:
            parts = []
            for match in (chunk,) if plain_word(chunk) else find(chunk):
                packed = known.get(match)
                if packed is None:
                    ids = self.piece(match.encode())
                    packed = struct.pack(f"<{len(ids)}I", *ids)
                    if len(match) <= self.memo.longest:
                        known[match] = packed
                parts.append(packed)
            out.append(parts[0] if len(parts) == 1 else b"".join(parts))
        return out

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        return self.memo.joined(map(split_chunks, texts))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_many([text])[0], dtype="<u4").tolist()

    def decode(self, ids: list[int], fan: int = 256) -> bytes:
        """Concatenate the tokens' bytes up a tree whose nodes have ``fan`` children."""
        parts = list(map(self.bytes_of.__getitem__, ids))
        while len(parts) > 1:
            parts = [b"".join(parts[i : i + fan]) for i in range(0, len(parts), fan)]
        return parts[0] if parts else b""


_encoders: dict[tuple[str, str], TreeEncoder] = {}


def encoder(path: str, pattern: str) -> TreeEncoder:
    """One encoder per worker process, so that its memos live as long as the worker."""
    sole_holder("encoders", _encoders.clear)
    if (path, pattern) not in _encoders:
        rarer_collection()
        _encoders[path, pattern] = TreeEncoder(read_ranks(path), pattern)
    return _encoders[path, pattern]


def by_size(texts: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, list[str]]]:
    """Consecutive parts of a batch of texts with about ``most`` bytes each; null counts as empty."""
    start, part, held = 0, [], 0
    for i, text in enumerate(texts):
        part.append(text.as_py() or "")
        held += len(part[-1])
        if held >= most:
            yield start, part
            start, part, held = i + 1, [], 0
    if part:
        yield start, part


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text's ids: (id, ids binary of little-endian unsigned 32-bit integers).

    Null and empty texts have no ids. Repeated rows give repeated rows, an empty table gives an empty one, other
    columns are ignored whatever their names. A very long run of one character class costs time n log n, and its
    memory is that of the text and its ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, pattern)
        for batch in batches:
            for start, texts in by_size(batch.column(1)):
                ids = batch.column(0).slice(start, len(texts))
                yield pa.RecordBatch.from_arrays([ids, pa.array(enc.encode_many(texts), pa.binary())], names=["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return modest_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids binary")


def decode_documents(encoded: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(id, ids) -> (id, decoded binary); null ids decode to nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, pattern)
        for batch in batches:
            out = [enc.decode(np.frombuffer(x.as_py() or b"", dtype="<u4").tolist()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "decoded"])

    return encoded.mapInArrow(run, f"id {encoded.schema['id'].dataType.simpleString()}, decoded binary")


def round_trip_digests(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document's encoding and of its decoding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, pattern)
        for batch in batches:
            for start, texts in by_size(batch.column(1)):
                rows = enc.encode_many(texts)
                back = (enc.decode(np.frombuffer(r, dtype="<u4").tolist()) for r in rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, len(texts)),
                        pa.array([len(r) // 4 for r in rows], pa.int64()),
                        pa.array([hashlib.sha256(r).hexdigest() for r in rows], pa.string()),
                        pa.array([hashlib.sha256(b).hexdigest() for b in back], pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return modest_batches(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
