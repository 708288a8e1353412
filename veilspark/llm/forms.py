"""Plain form of a text and hashed character windows of many texts at once."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache

import numpy as np

MIX = np.uint64(0x9E3779B97F4A7C15)
MIX2 = np.uint64(0xD6E8FEB86659FD93)
BASE = np.uint64(0x5851F42D4C957F2D)
#: Width in characters of the substrings that likeness compares, and the shortest plain form compared.
WIDTH, SHORTEST = 5, 40


@cache
def _format_characters() -> re.Pattern:
    spans, start = [], None
    for i in range(sys.maxunicode + 2):
        inside = i <= sys.maxunicode and unicodedata.category(chr(i)) == "Cf"
        if inside and start is None:
            start = i
        elif not inside and start is not None:
            spans.append(f"{re.escape(chr(start))}-{re.escape(chr(i - 1))}")
            start = None
    return re.compile("[" + "".join(spans) + "]+")


def plain(text: str) -> str:
    """NFKC, format characters dropped, lower case, runs of white space as one space, trimmed."""
    if not text.isascii():
        text = _format_characters().sub("", unicodedata.normalize("NFKC", text))
    return " ".join(text.lower().split())


def fingerprint(text: str) -> int:
    """Signed 64-bit fingerprint of a text, for the class of its exact copies."""
    import xxhash

    value = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
    return value - (1 << 64) if value >> 63 else value


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that all bits depend on all bits."""
    h = h ^ (h >> np.uint64(32))
    h *= MIX2
    h ^= h >> np.uint64(29)
    h *= MIX
    h ^= h >> np.uint64(32)
    return h


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    with np.errstate(over="ignore"):
        up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, BASE, np.uint64)]))
        down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, inverse, np.uint64)]))
    return up, down


class Windows:
    """Rolling hashes over the concatenated code points of a block of texts."""

    def __init__(self, texts: list[str]):
        joined = "".join(texts)
        self.points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        self.lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        n = len(self.points)
        self.up, self.down = _powers(max(16, int(n + 1).bit_length()))
        total = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((self.points + np.uint64(1)) * self.up[:n], out=total[1:])
        self.total = total

    def hashes(self, at: np.ndarray, width: int) -> np.ndarray:
        """Hash of the ``width`` code points from each position of ``at``."""
        with np.errstate(over="ignore"):
            return mix((self.total[at + width] - self.total[at]) * self.down[at])

    def hashes_to(self, at: np.ndarray, widths: np.ndarray) -> np.ndarray:
        """As :meth:`hashes`, with a width for each position."""
        with np.errstate(over="ignore"):
            return mix((self.total[at + widths] - self.total[at]) * self.down[at])

    def positions(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of all windows that lie inside one text, and the number of windows of each text."""
        counts = np.maximum(self.lengths - width + 1, 0)
        ends = np.cumsum(counts)
        first = np.repeat(self.starts - (ends - counts), counts)
        return first + np.arange(ends[-1] if len(ends) else 0), counts


def shingle_set(text: str, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the substrings of a plain form."""
    w = Windows([text])
    at, _ = w.positions(width)
    return np.unique(w.hashes(at, width))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Intersection over union of two sorted distinct arrays."""
    both = len(a) + len(b) - len(np.union1d(a, b))
    return both / max(1, len(a) + len(b) - both)


def blocks(batches, characters: int = 1 << 21):
    """Arrow batches regrouped so that a block has a bounded number of characters, or one longer text.

    Keeps memory in proportion to a block, not to a partition or to the number of rows in a batch.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        cut = 0
        while cut < batch.num_rows:
            base = sizes[cut - 1] if cut else 0
            end = max(cut + 1, int(np.searchsorted(sizes, base + characters, "right")))
            yield pa.RecordBatch.from_arrays([c.slice(cut, end - cut) for c in batch.columns], schema=batch.schema)
            cut = end
