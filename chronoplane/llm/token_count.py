"""Token counts by rank-synchronous array merging.

All pre-tokens of a batch are held in one ragged numpy array of symbols. In each round every sequence finds the
lowest rank among its adjacent pairs, all its pairs of that rank are merged at once (left to right, not overlapping),
and the array is compacted. Sequences without a pair to merge are finished. The symbols that survive are the tokens.
Merging all occurrences of the lowest rank together equals merging them one by one: a merge makes only symbols that
did not exist before in that place, and pairs with them rank higher than the pair that made them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import by_size
from .chunks import Memo, plain_word, rarer_collection, sole_holder, split_chunks
from .common import modest_batches

NONE = np.iinfo(np.int64).max
MARKS = ",.!?;:"  # marks that are a match and a symbol by themselves after a letter


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 as itself, others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ArrayMerger:
    """Encode batches of byte-level pre-tokens with a ``tokenizers`` BPE file by rank-synchronous merging."""

    def __init__(self, path: str, pattern: str, limit: int = 800_000):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        letters = byte_letters()
        self.first = np.zeros(256, dtype=np.int64)
        for letter, byte in letters.items():
            self.first[byte] = vocab[letter]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.size = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], dtype=np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self._table(keys)
        self.find = regex.compile(pattern).findall
        self.mark = {m: int(self.first[ord(m)]).to_bytes(4, "little") for m in MARKS}
        self.memo = Memo(self.encode_chunks, limit=limit)

    def _table(self, keys: np.ndarray, bits: int = 20) -> None:
        """Open addressing over 2**bits slots, probed a fixed number of times; slot -> key and rank."""
        self.bits = bits
        self.slot_key = np.full(1 << bits, -1, dtype=np.int64)
        self.slot_rank = np.full(1 << bits, NONE, dtype=np.int64)
        self.probes, left, shift = 0, np.arange(len(keys)), 0
        while len(left):
            at = (self._slot(keys[left]) + shift) & ((1 << bits) - 1)
            free = self.slot_key[at] < 0
            at, mine = at[free], left[free]
            at, first = np.unique(at, return_index=True)
            self.slot_key[at], self.slot_rank[at] = keys[mine[first]], mine[first]
            left = np.setdiff1d(left, mine[first])
            shift += 1
            self.probes = shift

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * self.size + right
        at, mask = self._slot(keys), (1 << self.bits) - 1
        out = np.full(len(keys), NONE, dtype=np.int64)
        todo = np.arange(len(keys))
        for shift in range(self.probes):
            slot = (at[todo] + shift) & mask
            held = self.slot_key[slot]
            hit = held == keys[todo]
            out[todo[hit]] = self.slot_rank[slot[hit]]
            todo = todo[~hit & (held >= 0)]
            if not len(todo):
                break
        return out

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces in one array, and each piece's number of ids."""
        data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        owner = np.repeat(np.arange(len(pieces)), np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)))
        symbols, active = self.first[data], np.ones(len(data), dtype=bool)
        ranks = self._pair_ranks(symbols, owner)
        done_symbols, done_owner = [], []
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lengths = np.diff(np.r_[starts, len(owner)])
            low = np.minimum.reduceat(ranks, starts)
            over = low == NONE
            if over.any():
                gone = np.repeat(over, lengths)
                done_symbols.append(symbols[gone])
                done_owner.append(owner[gone])
                symbols, owner, ranks = symbols[~gone], owner[~gone], ranks[~gone]
                low, lengths = low[~over], lengths[~over]
                if not len(symbols):
                    break
            hit = ranks == np.repeat(low, lengths)
            chosen = self._alternate(hit)
            symbols[chosen] = self.made[ranks[chosen]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[chosen + 1] = False
            new = np.cumsum(keep) - 1
            symbols, owner, ranks = symbols[keep], owner[keep], ranks[keep]
            changed = np.zeros(len(symbols) + 1, dtype=bool)
            changed[new[chosen]] = changed[new[chosen] - 1] = True
            self._refresh(symbols, owner, ranks, np.flatnonzero(changed[:-1]))
        if not done_owner:
            return np.zeros(0, dtype=np.int64), np.zeros(len(pieces), dtype=np.int64)
        all_owner, all_symbols = np.concatenate(done_owner), np.concatenate(done_symbols)
        order = np.argsort(all_owner, kind="stable")
        return all_symbols[order], np.bincount(all_owner, minlength=len(pieces))

    def _pair_ranks(self, symbols: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """The rank of each symbol with its right neighbour; NONE at the end of a sequence."""
        ranks = np.full(len(symbols), NONE, dtype=np.int64)
        self._refresh(symbols, owner, ranks, np.arange(len(symbols)))
        return ranks

    def _refresh(self, symbols: np.ndarray, owner: np.ndarray, ranks: np.ndarray, at: np.ndarray) -> None:
        ranks[at] = NONE
        at = at[at + 1 < len(symbols)]
        at = at[owner[at] == owner[at + 1]]
        ranks[at] = self.ranks_of(symbols[at], symbols[at + 1])

    @staticmethod
    def _alternate(hit: np.ndarray) -> np.ndarray:
        """Positions of hits without overlap: every other one of a run of adjacent hits."""
        at = np.flatnonzero(hit)
        if not len(at):
            return at
        breaks = np.r_[True, np.diff(at) != 1]
        first = np.maximum.accumulate(np.where(breaks, np.arange(len(at)), 0))
        return at[(np.arange(len(at)) - first) % 2 == 0]

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """Each chunk's ids as little-endian unsigned 32-bit integers.

        A word with one mark after it shares the word's ids, whether those are in the memo or made here.
        """
        if not chunks:
            return []
        own: dict[str, list[str]] = {}
        for c in chunks:
            if plain_word(c):
                own[c] = [c]
            elif c[-1] in MARKS and plain_word(c[:-1]):
                if c[:-1] not in self.memo:
                    own[c[:-1]] = [c[:-1]]
            else:
                own[c] = self.find(c)
        ids, lengths = self.merge([p.encode() for f in own.values() for p in f])
        bounds = np.r_[0, np.cumsum(lengths)]
        ends = (bounds[np.cumsum([len(f) for f in own.values()])] * 4).tolist() if own else []
        data = ids.astype("<u4").tobytes()
        made = dict(zip(own, (data[a:b] for a, b in zip([0, *ends], ends)), strict=True))
        out = []
        for c in chunks:
            packed = made.get(c)
            if packed is None:
                word = c[:-1]
                packed = (made.get(word) or self.memo[word]) + self.mark[c[-1]]
            out.append(packed)
        return out

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """For each text its ids; special strings in a text become their special ids, as the library does by default."""
        special = [i for i, t in enumerate(texts) if self.special_split is not None and "<" in t and self.special_split.search(t)]
        if not special:
            return self.memo.joined(map(split_chunks, texts))
        cut = set(special)
        parts = [self.special_split.split(t) if i in cut else [t] for i, t in enumerate(texts)]
        plain = iter(self.memo.joined(split_chunks(p) for ps in parts for p in ps[::2]))
        return [b"".join(next(plain) if k % 2 == 0 else np.array([self.specials[p]], dtype="<u4").tobytes() for k, p in enumerate(ps)) for ps in parts]


_mergers: dict[tuple[str, str], ArrayMerger] = {}


def merger(path: str, pattern: str) -> ArrayMerger:
    sole_holder("mergers", _mergers.clear)
    if (path, pattern) not in _mergers:
        rarer_collection()
        _mergers[path, pattern] = ArrayMerger(path, pattern)
    return _mergers[path, pattern]


def count_tokens(docs: DataFrame, vocabulary: str, pattern: str, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every whole text; null and empty texts have no bytes and no tokens.

    Repeated rows are counted each, an empty table gives an empty one, other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(vocabulary, pattern)
        for batch in batches:
            for start, texts in by_size(batch.column(1)):
                n = np.array([len(x) // 4 for x in m.encode_many(texts)], dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(texts)), pa.array(n)], names=["doc_id", "n_tokens"]
                )

    counted = modest_batches(docs).select("doc_id", "text").mapInArrow(
        lambda batches: _with_bytes(batches, run), "doc_id long, n_bytes long, n_tokens long"
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))


def _with_bytes(batches: Iterator[pa.RecordBatch], run) -> Iterator[pa.RecordBatch]:
    import pyarrow.compute as pc

    for batch in batches:
        sizes, at = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64()), 0
        for out in run(iter([batch])):
            n = out.num_rows
            yield pa.RecordBatch.from_arrays([out.column(0), sizes.slice(at, n), out.column(1)], names=["doc_id", "n_bytes", "n_tokens"])
            at += n
