"""Cutting text into independently encodable chunks, and a bounded memo of their encodings.

With the byte-level pattern, a match that ends in a non-space character never goes on into white space, and no match
looks back. So a run of white space followed by a run of other characters can be split and encoded on its own, and
equal chunks have equal encodings.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Callable, Iterable

import pyarrow as pa

# The characters of the Unicode property White_Space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
CHUNK = re.compile(f"[{WHITE_SPACE}]*[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+")

split_chunks = CHUNK.findall


def rarer_collection() -> None:
    """For worker processes that hold large memos without cycles: look for cycles less often."""
    gc.set_threshold(500_000, 50, 100)


_held: dict[str, Callable[[], None]] = {}


def sole_holder(name: str, clear: Callable[[], None]) -> None:
    """Worker processes outlive their tasks: keep the memos of one operator at a time, those of the one that runs now."""
    others = [n for n in _held if n != name]
    for other in others:
        _held.pop(other)()
    if others:
        gc.collect()
        pa.default_memory_pool().release_unused()
    _held[name] = clear


def plain_word(chunk: str) -> bool:
    """Whether a chunk is one match of the pattern: letters, perhaps after one space."""
    return (chunk[1:] if chunk[:1] == " " else chunk).isalpha()


class Memo(dict):
    """chunk -> value, filled by batches; emptied when it holds ``limit`` entries, so memory stays bounded."""

    def __init__(self, encode_many: Callable[[list[str]], list], limit: int = 800_000, longest: int = 64):
        super().__init__()
        self.encode_many, self.limit, self.longest = encode_many, limit, longest

    def joined(self, texts: Iterable[list[str]]) -> list[bytes]:
        """The values of each list of chunks, joined; long chunks, which hardly ever repeat, are not kept.

        Lists may come from a generator: each is looked up while it is still in the processor's caches.
        """
        if len(self) > self.limit:
            self.clear()
        get, out, holes = self.get, [], []
        new: dict[str, bytes | None] = {}
        for chunks in texts:
            values = list(map(get, chunks))
            if None in values:
                holes.append((len(out), chunks, values))
                new.update((c, None) for c, v in zip(chunks, values, strict=True) if v is None)
                out.append(b"")
            else:
                out.append(b"".join(values))
        new = dict(zip(new, self.encode_many(list(new)), strict=True))
        for i, chunks, values in holes:
            out[i] = b"".join([new[c] if v is None else v for c, v in zip(chunks, values, strict=True)])
        self.update((c, v) for c, v in new.items() if len(c) <= self.longest)
        return out
