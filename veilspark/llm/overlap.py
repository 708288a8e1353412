"""Problem 1: records of one split that occur, exactly or almost, in another.

A suffix array over the plain forms of both splits, partitioned by ranges of the suffixes' own text. Suffixes start at
minimizers (the place of the least 5-character hash among neighbours), so equal stretches have equal starts wherever they stand.
The bounds of the ranges come from a bounded sample of suffixes; a part is sorted where it arrives, the lengths of the common
prefixes of adjacent suffixes are taken, and a run of neighbours with DEPTH bytes or more in common that has suffixes of both
splits is a stretch that they share.

Most shared stretches are frames that very many records have. Runs are therefore ordered from rare to common, and a record
pairs only in its rarest runs, up to the point where what is left of its suffixes is less than a given share of them. Two records
that have that share of the suffixes of each in common share a run before that point in both, so nothing is lost by it, however common a run is (the
prefix filter of set joins). A run with very many records is paired in blocks of BLOCK by BLOCK, each a unit of its own.
The pairs of common runs grow as the square of the input; those that the numbers of substrings rule out are never formed, and the
others take a few operations on whole words each.
Pairs that can reach the likeness by the suffixes left and by a sketch are then compared exactly, whole text
against whole text, and the shared stretches of what is found are merged into covered characters per record.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.classes import REF, class_filter, class_rows, likenesses, pack, plain_block, unpack
from veilspark.llm.forms import MIX, WIDTH, Windows, blocks, fingerprint, mix
from veilspark.session import checkpoint, spread

LEAST = 0.6


@dataclass(frozen=True)
class Level:
    """One array: plain forms of ``shortest`` to ``longest`` characters, minimizers among ``window`` places, runs from ``depth`` bytes.

    ``coverage``: share of the suffixes of either record that a pair must have in common to be compared. Of the pairs of the scale
    0.1 tables the least share is 0.30.
    """

    shortest: int
    longest: int
    window: int
    depth: int
    coverage: float


#: Short texts have finer starts and shorter runs. Lengths of a pair differ by 1 / LEAST at most, so every pair is whole in one array.
LEVELS = (Level(120, 1 << 60, 26, 16, 0.22), Level(0, 201, 5, 16, 0.12))
#: Bytes of a suffix that travel and are sorted.
CARRY = 16
#: Suffix rows of a part, about; texts sampled for the bounds; records of a side of a unit of pairs.
PART, SAMPLE, BLOCK = 250_000, 6000, 16384
#: Bins of the sketch, a bit each. Long texts have a bit of the least hash of each bin: agreement is (1 + likeness) / 2 per bin. Short ones
#: have whether the number of substrings in the bin is odd: bits differ by the substrings that one text alone has. A pair is dropped 3.5
#: standard deviations beyond what LEAST gives, which loses a pair right at it with probability 0.0002.
BINS = 224
SPREAD = 3.5
#: Steps in which the number of a record's different substrings travels, in one byte, rounded down.
STEP = 1.05
#: Pairs of a rectangle of rows from which it is compared as a whole, and pairs compared at once.
WHOLE, AT_ONCE = 512, 1 << 18


# ---- packing ---------------------------------------------------------------------------------------------------------

#: What travels: suffixes to their part of the array; records with the number of their suffixes, of their substrings and their
#: sketches; shared suffixes to their record; kept ones to their unit. Whole numbers that are small cost few bytes.
SUFFIX = ((np.uint64, 1),)
RECORD = ((np.uint64, 1), (np.uint32, 2), (np.uint8, BINS // 8))
SHARED = ((np.uint64, 1), (np.uint32, 1), (np.uint8, 2))
KEPT = ((np.uint32, 1), (np.uint64, 1), (np.uint32, 2), (np.uint8, 1), (np.uint8, BINS // 8))
SHORT_NAME = np.uint64((1 << 40) - 1)
#: Names of units within a part. Two units of one name cost comparisons, no pairs.
SHORT_UNIT = np.uint64((1 << 24) - 1)
ROWS = "part int, kind int, side int, n int, text binary, data binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in cols[:4]), *(pa.array(c, pa.binary()) for c in cols[4:])], ["part", "kind", "side", "n", "text", "data"])


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """The pieces (kind, side, n, text, data) of each part."""
    held: dict[int, list[tuple]] = {}
    for b in batches:
        for part, *row in zip(*(b.column(c).to_pylist() for c in b.schema.names), strict=True):
            held.setdefault(part, []).append(tuple(row))
    for part in sorted(held):
        yield part, held.pop(part)


def _read(pieces: list[tuple], kind: int, side: int | None, kinds: tuple) -> list[np.ndarray]:
    """The columns of all pieces of a kind, of one side or both; none if there are no such pieces."""
    read = [unpack(p[4], p[2], kinds) for p in pieces if p[0] == kind and side in (None, p[1])]
    return [np.concatenate(c) for c in zip(*read, strict=True)]


def _split(bucket: np.ndarray, kind: int, side: int, columns: list[np.ndarray], text: np.ndarray | None = None) -> list[tuple]:
    """Rows by bucket. ``text`` is sorted and compresses best row by row."""
    import zstandard

    if not len(bucket):
        return []
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.nonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))[0]
    tight = zstandard.ZstdCompressor(3)
    return [
        (int(bucket[a]), kind, side, int(b - a), None if text is None else tight.compress(text[order[a:b]].tobytes()), pack(*(c[order[a:b]] for c in columns)))
        for a, b in zip(cuts, [*cuts[1:], len(bucket)], strict=True)
    ]


# ---- suffixes --------------------------------------------------------------------------------------------------------


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """Least or greatest of every ``width`` neighbours, in about log2(width) passes."""
    done, out = 1, x
    while done * 2 <= width:
        out = best(out[: len(out) - done], out[done:])
        done *= 2
    rest = width - done
    return best(out[: len(out) - rest], out[rest:]) if rest else out.copy()


def suffixes(forms: list[str], level: Level) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, first CARRY bytes, number of different suffixes of the text, and place, of each suffix; sorted by bytes."""
    none = np.zeros(0, np.int64)
    w = Windows(forms)
    at, counts = w.positions(WIDTH)
    n = len(at)
    if n < level.window:
        return none, np.zeros((0, CARRY), np.uint8), none, none
    h = (w.hashes(at, WIDTH) >> np.uint64(33)).astype(np.uint32) + np.uint32(1)
    text = np.repeat(np.arange(len(forms)), counts)
    least = _sliding(h, level.window, np.minimum)
    least[text[: n - level.window + 1] != text[level.window - 1 :]] = 0  # a window across two texts names no start
    padded = np.zeros(n + level.window - 1, np.uint32)
    padded[level.window - 1 : n] = least
    chosen = np.nonzero(_sliding(padded, level.window, np.maximum)[:n] == h)[0]
    place, text = at[chosen], text[chosen]
    width = 1 + (w.points >= 0x80) + (w.points >= 0x800) + (w.points >= 0x10000)
    to_byte = np.concatenate([[0], np.cumsum(width)])
    first, left = to_byte[place], to_byte[w.starts[text] + w.lengths[text]] - to_byte[place]
    inside = left >= level.depth
    place, text, first, left = place[inside], text[inside], first[inside], left[inside]
    raw = np.frombuffer("".join(forms).encode("utf-8", "surrogatepass") + bytes(CARRY), np.uint8)
    head = np.lib.stride_tricks.sliding_window_view(raw, CARRY)[first]
    last = np.nonzero(left < CARRY)[0]
    head[last] = np.where(np.arange(CARRY) < left[last, None], head[last], 0)
    keys = np.ascontiguousarray(head).view(">u8").astype(np.uint64)
    # a stretch that a text repeats is one suffix
    with np.errstate(over="ignore"):
        name = mix(sum((keys[:, k] * (MIX + np.uint64(2 * k))) ^ (keys[:, k] >> np.uint64(31 - k)) for k in range(level.depth // 8)) + text.astype(np.uint64) * MIX)
    _, once = np.unique(name, return_index=True)
    once = once[np.lexsort(tuple(keys[once, k] for k in range(keys.shape[1] - 1, -1, -1)))]
    text, place = text[once], place[once] - w.starts[text[once]]
    return text, head[once], np.bincount(text, minlength=len(forms))[text], place


def _sketches(forms: list[str], odd: bool) -> tuple[np.ndarray, np.ndarray]:
    """Number of different 5-character substrings and sketch of each form, of the kind of short texts (``odd``) or of long ones."""
    w = Windows(forms)
    at, counts = w.positions(WIDTH)
    h = w.hashes(at, WIDTH)
    text = np.repeat(np.arange(len(forms), dtype=np.uint64), counts)
    name = np.sort(text << np.uint64(40) | h >> np.uint64(24))
    new = np.ones(len(name), bool)
    new[1:] = name[1:] != name[:-1]
    name = name[new]
    of = name >> np.uint64(40)
    grams = np.bincount(of.astype(np.int64), minlength=len(forms)).astype(np.uint32)
    if odd:
        bin_ = (name & SHORT_NAME) * np.uint64(BINS) >> np.uint64(40)
        times = np.bincount((of * np.uint64(BINS) + bin_).astype(np.int64), minlength=len(forms) * BINS)
        return grams, np.packbits((times & 1).astype(np.uint8).reshape(len(forms), BINS), axis=1)
    bin_ = (h >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)
    value = (h * MIX) >> np.uint64(1)
    cell = (text * np.uint64(BINS) + bin_).astype(np.int64)
    least = np.full(len(forms) * BINS, 1 << 63, np.uint64)
    np.minimum.at(least, cell, value)
    least = least.reshape(len(forms), BINS)
    empty = least == np.uint64(1 << 63)
    bits = (mix(least) & np.uint64(1)).astype(np.uint8)
    # an empty bin takes the bit of the next one that is not, so that equal sets agree throughout
    places = np.where(empty, 2 * BINS, np.arange(BINS))
    nearest = np.minimum.accumulate(np.concatenate([places, places + BINS], 1)[:, ::-1], 1)[:, ::-1][:, :BINS] % BINS
    return grams, np.packbits(np.take_along_axis(bits, nearest, 1), axis=1)


def _distinct(batch: pa.RecordBatch) -> tuple[list[str], np.ndarray]:
    forms = list(dict.fromkeys(plain_block(batch)[1]))
    return forms, np.array([fingerprint(f) for f in forms], np.int64).view(np.uint64) & REF


def _levels(forms: list[str], ref: np.ndarray) -> Iterator[tuple[int, Level, list[str], np.ndarray]]:
    """The forms of each level; a record is named by its class and its level."""
    for k, level in enumerate(LEVELS):
        pick = [i for i, f in enumerate(forms) if level.shortest <= len(f) < level.longest]
        if pick:
            yield k, level, [forms[i] for i in pick], ref[pick] << np.uint64(1) | np.uint64(k)


@dataclass
class Bounds:
    """Ranges of each level by bytes; a suffix that takes several whole ranges by itself (``wide``) is spread over as many parts."""

    cuts: list[np.ndarray]
    wide: list[dict[bytes, int]]
    parts: int
    tasks: int

    def place(self, k: int, head: np.ndarray, rec: np.ndarray) -> np.ndarray:
        depth = LEVELS[k].depth
        text = np.ascontiguousarray(head[:, :depth]).view(f"S{depth}").reshape(-1)
        part = np.searchsorted(self.cuts[k], text, "right") * len(LEVELS) + k
        for name, many in self.wide[k].items():
            a, b = np.searchsorted(text, np.bytes_(name), "left"), np.searchsorted(text, np.bytes_(name), "right")
            part[a:b] = (fingerprint(name.hex()) + (mix(rec[a:b].copy()) % np.uint64(many)).astype(np.int64) * 7919) % self.parts + self.parts
        return part


def bounds(both: DataFrame) -> Bounds:
    """Ranges of about PART suffixes from a bounded sample of texts. It decides where a suffix goes, never what is found."""
    rows = both.count()
    share = min(1.0, SAMPLE / max(1, rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            for k, level, forms, _ in _levels(*_distinct(b)):
                head = suffixes(forms, level)[1][:, : level.depth]
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([head.tobytes()], pa.binary())], ["k", "heads"])

    taken = both.sample(False, share, 1) if share < 1 else both
    found = taken.mapInArrow(run, "k bigint, heads binary").collect()  # the suffixes of at most SAMPLE texts, about
    cuts, wide, parts = [], [], 1
    for k, level in enumerate(LEVELS):
        heads = np.sort(np.frombuffer(b"".join(r["heads"] for r in found if r["k"] == k), f"S{level.depth}"))
        many = int(max(1, len(heads) / share // PART))
        at = heads[(np.arange(1, many) * len(heads)) // many] if len(heads) else heads
        names, times = np.unique(at, return_counts=True)
        cuts.append(names)
        wide.append({bytes(x): int(t) for x, t in zip(names, times, strict=True) if t > 1})
        parts += many
    return Bounds(cuts, wide, len(LEVELS) * parts, max(12, parts))


def _suffix_rows(df: DataFrame, side: int, at: Bounds) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            rows = []
            for k, level, forms, rec in _levels(*_distinct(b)):
                text, head, many, _ = suffixes(forms, level)
                if not len(text):
                    continue
                rows += _split(at.place(k, head, rec[text]), 0, side, [rec[text]], head)
                has, first = np.unique(text, return_index=True)
                grams, sketch = _sketches([forms[i] for i in has.tolist()], k == 1)
                rows += _split((mix(rec[has]) % np.uint64(at.parts)).astype(np.int64), 1, side, [rec[has], np.stack([many[first].astype(np.uint32), grams], 1), sketch])
            yield _batch(rows)

    return df.mapInArrow(run, ROWS)


# ---- runs ------------------------------------------------------------------------------------------------------------


def _code(n: np.ndarray) -> np.ndarray:
    """A number of records in one byte, rounded up in steps of 12 %."""
    return np.ceil(np.log(np.maximum(n, 1)) / np.log(1.12) - 1e-9).astype(np.uint8)


def common_prefixes(keys: np.ndarray) -> np.ndarray:
    """Bytes that each row of big-endian words and the row before it have in common, from the second row on."""
    common, so_far = np.zeros(max(0, len(keys) - 1), np.int64), np.ones(max(0, len(keys) - 1), bool)
    for j in range(keys.shape[1]):
        apart = keys[1:, j] ^ keys[:-1, j]
        common += so_far * sum((apart < np.uint64(1 << 8 * b)).astype(np.int64) for b in range(8))
        so_far &= apart == 0
    return common


def shared_suffixes(rows: DataFrame, at: Bounds) -> DataFrame:
    """Of each part, sorted: the suffixes in runs of both sides, on the way to their records. Records pass through."""
    import zstandard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, pieces in _by_part(batches):
            yield _batch([(part, *p) for p in pieces if p[0] == 1])
            own = [p for p in pieces if p[0] == 0]
            if not own or len({p[1] for p in own}) < 2 and not any(at.wide):
                continue
            opened = zstandard.ZstdDecompressor()
            head = np.frombuffer(b"".join(opened.decompress(p[3]) for p in own), np.uint8).reshape(-1, CARRY)
            rec = _read(own, 0, None, SUFFIX)[0]
            side = np.repeat(np.array([p[1] for p in own], np.uint8), [p[2] for p in own])
            keys = head.view(">u8").astype(np.uint64)
            order = np.lexsort((*(keys[:, k] for k in range(keys.shape[1] - 1, -1, -1)), (rec & np.uint64(1)).astype(np.uint8)))
            head, rec, side, keys = head[order], rec[order], side[order], keys[order]
            k = (rec & np.uint64(1)).astype(np.int64)
            depth = np.array([level.depth for level in LEVELS])[k]
            new = np.concatenate([[True], (common_prefixes(keys) < depth[1:]) | (k[1:] != k[:-1])])
            group, first = np.cumsum(new) - 1, np.nonzero(new)[0]
            with np.errstate(over="ignore"):
                name = mix(sum(np.where(depth[first] > 8 * j, keys[first, j], 0).astype(np.uint64) * (MIX + np.uint64(2 * j)) ^ (keys[first, j] >> np.uint64(29)) * (depth[first] > 8 * j) for j in range(keys.shape[1])) + k[first].astype(np.uint64))
            # seen in part only: of the size that the sample says, the same in all of its parts
            sampled = {}
            for j, wide in enumerate(at.wide):
                for text, times in wide.items():
                    for hit in np.nonzero((k[first] == j) & (np.ascontiguousarray(head[first, : LEVELS[j].depth]).view(f"S{LEVELS[j].depth}").reshape(-1) == text))[0].tolist():
                        sampled[hit] = times * PART
            kept = np.logical_and(*(np.bincount(group[side == s], minlength=len(first)) > 0 for s in (0, 1)))
            kept[list(sampled)] = True
            on = kept[group]
            group, side, rec = group[on], side[on], rec[on]
            order = np.lexsort((rec, side, group))
            group, side, rec = group[order], side[order], rec[order]
            once = np.ones(len(group), bool)
            once[1:] = (group[1:] != group[:-1]) | (side[1:] != side[:-1]) | (rec[1:] != rec[:-1])
            group, side, rec = group[once], side[once], rec[once]
            n = np.stack([np.bincount(group[side == s], minlength=len(first)) for s in (0, 1)], 1)
            sizes = _code(n)
            for hit, many in sampled.items():
                sizes[hit] = _code(np.array([many]))
            for s in (0, 1):
                on = np.nonzero(side == s)[0]
                on = on[np.argsort(rec[on])]  # names in order cost less
                yield _batch(_split((mix(rec[on]) % np.uint64(at.parts)).astype(np.int64), 2, s, [rec[on], (name[group[on]] >> np.uint64(32)).astype(np.uint32), sizes[group[on]]]))

    return rows.repartition(at.tasks, "part").mapInArrow(run, ROWS)


def _coverage(rec: np.ndarray) -> np.ndarray:
    return np.array([level.coverage for level in LEVELS])[(rec & np.uint64(1)).astype(np.int64)]


def rare_suffixes(rows: DataFrame, at: Bounds) -> DataFrame:
    """Of each record the rarest runs, on the way to the units in which they are paired."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, pieces in _by_part(batches):
            for s in (0, 1):
                own = _read(pieces, 2, s, SHARED)
                if not own:
                    continue
                of, numbers, sketch = _read(pieces, 1, s, RECORD)
                of, first = np.unique(of, return_index=True)
                numbers, sketch = numbers[first], sketch[first]
                rec, name, sizes = own[0], own[1].astype(np.uint64), own[2]
                order = np.lexsort((name, sizes.astype(np.uint16).sum(1), rec))
                rec, name, sizes = rec[order], name[order], sizes[order]
                mine = np.searchsorted(of, rec)
                many = numbers[mine, 0]
                new = np.concatenate([[True], rec[1:] != rec[:-1]])
                count = np.diff(np.append(np.nonzero(new)[0], len(rec)))
                number = np.arange(len(rec)) - np.repeat(np.nonzero(new)[0], count)
                before = many - np.repeat(count, count) + number  # suffixes that nobody shares come first
                need = np.maximum(1, np.ceil(_coverage(rec) * many - 1e-9))
                keep = before < many - need + 1
                rec, name, mine, sizes, left = rec[keep], name[keep], mine[keep], sizes[keep], (many - before)[keep].astype(np.uint32)
                # blocks of this side and of the other; a row goes to the unit of its block with each block of the other side
                cut = np.maximum(1, np.ceil(1.12 ** sizes.astype(float) / BLOCK)).astype(np.int64)
                block = (mix(rec * MIX) % cut[:, s].astype(np.uint64)).astype(np.int64)
                copies = cut[:, 1 - s]
                row = np.repeat(np.arange(len(rec)), copies)
                other = np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)
                i, j = (block[row], other) if s == 0 else (other, block[row])
                with np.errstate(over="ignore"):
                    unit = mix(name[row] + i.astype(np.uint64) * MIX + mix(j.astype(np.uint64) + np.uint64(77)) * np.uint64(3))
                both = np.stack([numbers[mine[row], 0], left[row]], 1)
                grams = _steps(numbers[mine[row], 1])
                part, unit = (unit % np.uint64(at.parts)).astype(np.int64), (unit // np.uint64(at.parts) & SHORT_UNIT).astype(np.uint32)
                order = np.argsort(unit)  # names in order cost less
                part, unit, row, both, grams = part[order], unit[order], row[order], both[order], grams[order]
                yield _batch(_split(part, 3, s, [unit, rec[row], both, grams, sketch[mine[row]]]))

    return rows.repartition(at.tasks, "part").mapInArrow(run, ROWS)


def _steps(n: np.ndarray) -> np.ndarray:
    """A number of substrings in one byte, rounded down in steps of STEP; what is larger counts as the largest."""
    return np.minimum(255, np.floor(np.log(np.maximum(n, 1)) / np.log(STEP) + 1e-9)).astype(np.uint8)


def _apart(least: float) -> np.ndarray:
    """The most bits by which the sketches of a pair may differ: of long and of short texts, by the steps of either side."""
    sample = np.clip(np.floor(STEP ** np.arange(256.0)), 1, BINS)
    long = BINS * (1 - (1 + least) / 2 + SPREAD * 0.5 * np.sqrt((1 - least**2) / sample))
    k = np.arange(256)
    most = STEP ** (k + 1.0)
    alone = np.minimum(1e6, np.ceil((1 - least) / (1 + least) * (most[:, None] + most)))  # substrings that one of the two has
    two, four = (1 - 2 / BINS) ** alone, (1 - 4 / BINS) ** alone
    short = BINS / 2 * (1 - two) + SPREAD * np.sqrt(np.maximum(0, BINS / 4 * (1 - four) + BINS * (BINS - 1) / 4 * (four - two**2))) + 1
    return np.minimum(BINS, np.floor(np.stack([long[np.minimum(k[:, None], k)], short]) + 1e-9)).astype(np.int64)


def _bits_apart(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Bits by which sketches differ, given word by word."""
    apart = np.bitwise_count(x[0] ^ y[0])
    for a, b in zip(x[1:], y[1:], strict=True):
        apart += np.bitwise_count(a ^ b)
    return apart


def _met(level: np.ndarray, unit: np.ndarray, grams: np.ndarray, words: list[np.ndarray], unit2: np.ndarray, grams2: np.ndarray, words2: list[np.ndarray], least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of the rows of each side that meet in a unit, in pieces: all pairs whose sketches may be near enough and whose numbers of
    substrings are near enough for the likeness at all. Both sides in order of unit and grams."""
    apart = _apart(least)

    def near(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fit = _bits_apart([w[x] for w in words], [w[y] for w in words2]) <= apart[level[x], grams[x], grams2[y]]
        return x[fit], y[fit]

    reach = 255 if least <= 0 else min(255, int(1 + np.log(1 / least) / np.log(STEP) + 1e-9))
    key, key2 = (u.astype(np.uint64) << np.uint64(8) | g.astype(np.uint64) for u, g in ((unit, grams), (unit2, grams2)))
    new = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0]  # rows of one unit and number of substrings meet the same rows
    rows = np.diff(np.append(new, len(key)))
    g = grams[new].astype(np.int64)
    first = np.searchsorted(key2, key[new] >> np.uint64(8) << np.uint64(8) | np.maximum(0, g - reach).astype(np.uint64), "left")
    last = np.searchsorted(key2, key[new] >> np.uint64(8) << np.uint64(8) | np.minimum(255, g + reach).astype(np.uint64), "right")
    large = rows * (last - first) >= WHOLE
    for a, n, lo, hi in zip(*(c[large].tolist() for c in (new, rows, first, last)), strict=True):
        most = apart[level[a], grams[a], grams2[lo:hi]].max()
        while lo < hi:
            wide = min(hi - lo, AT_ONCE)
            own = [w[lo : lo + wide] for w in words2]
            high = max(1, AT_ONCE // wide)
            for cut in range(a, a + n, high):
                hits = np.flatnonzero(_bits_apart([w[cut : min(cut + high, a + n), None] for w in words], own) <= most)
                if len(hits):
                    x, y = np.divmod(hits, wide)
                    yield near(x + cut, y + lo)
            lo += wide
    count = np.repeat(np.where(large, 0, last - first), rows)
    first = np.repeat(first, rows)
    ends, cut = np.cumsum(count), 0
    while cut < len(key):
        base = ends[cut - 1] if cut else 0
        end = max(cut + 1, int(np.searchsorted(ends, base + AT_ONCE, "right")))
        c = count[cut:end]
        yield near(np.repeat(np.arange(cut, end), c), np.repeat(first[cut:end] - (np.cumsum(c) - c), c) + np.arange(c.sum()))
        cut = end


def paired(rows: DataFrame, at: Bounds, least: float) -> DataFrame:
    """Distinct ``a, b``: records that share a rare run and may reach the likeness."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, pieces in _by_part(batches):
            sides = [_read(pieces, 3, s, KEPT) for s in (0, 1)]
            if not all(sides):
                continue
            (unit, rec, number, grams, sketch), (unit2, rec2, number2, grams2, sketch2) = ([c[order] for c in cols] for cols in sides for order in [np.lexsort((cols[3], cols[0]))])
            words, words2 = ([np.ascontiguousarray(w) for w in np.ascontiguousarray(k).view(np.uint32).T] for k in (sketch, sketch2))
            held, some = [], 0
            for x, y in _met((rec & np.uint64(1)).astype(np.int64), unit, grams, words, unit2, grams2, words2, least):
                a, b = number[x], number2[y]
                fit = np.minimum(a[:, 1], b[:, 1]) >= _coverage(rec[x]) * np.maximum(a[:, 0], b[:, 0]) - 1e-6
                held.append(np.stack([rec[x[fit]] >> np.uint64(1), rec2[y[fit]] >> np.uint64(1)], 1).astype(np.int64))
                some += len(held[-1])
                if some > 1_000_000:
                    yield _pairs(held)
                    held, some = [], 0
            if held:
                yield _pairs(held)

    return rows.repartition(at.tasks, "part").mapInArrow(run, "a bigint, b bigint").distinct()


def _pairs(held: list[np.ndarray]) -> pa.RecordBatch:
    rows = np.unique(np.concatenate(held), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(rows[:, 0].copy()), pa.array(rows[:, 1].copy())], ["a", "b"])


def candidates(left: DataFrame, right: DataFrame, least: float = LEAST) -> DataFrame:
    """Distinct ``a, b``: class names of ``left`` and ``right`` whose texts are to be compared."""
    left, right = (spread(df.select("text").where(F.col("text").isNotNull())) for df in (left, right))
    at = bounds(left.unionByName(right))
    rows = _suffix_rows(left, 0, at).unionByName(_suffix_rows(right, 1, at))
    return paired(rare_suffixes(shared_suffixes(rows, at), at), at, least)


# ---- comparison ------------------------------------------------------------------------------------------------------


def covered(x: str, y: str) -> tuple[int, int]:
    """Characters of each of two plain forms that lie in stretches of a run's depth or more that both have, merged."""
    wide = next((lv.depth for lv in LEVELS if min(len(x), len(y)) >= lv.shortest), LEVELS[-1].depth)
    out = []
    for a, b in ((x, y), (y, x)):
        there = {b[i : i + wide] for i in range(len(b) - wide + 1)}
        out.append(_union([(i, i + wide) for i in range(len(a) - wide + 1) if a[i : i + wide] in there]))
    return tuple(out)


def _union(spans: list[tuple[int, int]]) -> int:
    total, upto = 0, 0
    for a, b in sorted(spans):
        total += max(0, b - max(a, upto))
        upto = max(upto, b)
    return total


def overlaps(held_out: DataFrame, training: DataFrame, least: float = LEAST) -> DataFrame:
    """``holdout_id, es_1_id, likeness, covered, es_1_covered``: every pair of ids whose texts reach ``least``, with the characters of
    the plain form of each that stand in stretches both share.

    Null texts and plain forms under 40 characters belong to no pair, null ids are left out, redelivered rows count once.
    """
    pairs = checkpoint(candidates(held_out, training, least))
    rows = [class_rows(df, class_filter(pairs, (c,))) for df, c in ((held_out, "a"), (training, "b"))]
    named = [r.select(F.col("cls").bitwiseAND(F.lit(int(REF))).alias("ref"), F.lit(s).alias("side"), "cls", "id", "plain") for s, r in enumerate(rows)]
    rows = checkpoint(named[0].unionByName(named[1]))
    texts = rows.select("ref", "side", "cls", "plain").distinct()
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("ref"), F.lit(0).alias("side")), F.struct(F.col("b").alias("ref"), F.lit(1).alias("side")))).alias("e"), "a", "b")
    halves = ends.select("e.*", "a", "b").join(texts, ["ref", "side"])
    one = F.struct("cls", "plain")
    # a name is 39 bits of a class; where two classes have the same one, both are compared
    whole = halves.groupBy("a", "b").agg(F.collect_set(F.when(F.col("side") == 0, one)).alias("x"), F.collect_set(F.when(F.col("side") == 1, one)).alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in range(0, batch.num_rows, 2000):
                part = batch.slice(cut, 2000)
                met = [(x, y) for xs, ys in zip(part.column("x").to_pylist(), part.column("y").to_pylist(), strict=True) for x in xs for y in ys]
                score = likenesses([x["plain"] for x, _ in met], [y["plain"] for _, y in met], least=least)
                keep = [k for k in range(len(met)) if score[k] >= least - 1e-12]
                cover = [covered(met[k][0]["plain"], met[k][1]["plain"]) for k in keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([met[k][s]["cls"] for k in keep], pa.int64()) for s in (0, 1)] + [pa.array(score[keep], pa.float64())] + [pa.array([c[s] for c in cover], pa.int64()) for s in (0, 1)],
                    ["a", "b", "likeness", "covered", "es_1_covered"],
                )

    scored = whole.mapInArrow(run, "a bigint, b bigint, likeness double, covered bigint, es_1_covered bigint")
    ids = [rows.where(F.col("side") == s).select(F.col("cls").alias(c), F.col("id").alias(i)).distinct() for s, c, i in ((0, "a", "holdout_id"), (1, "b", "es_1_id"))]
    pairs = scored.join(ids[0], "a").join(ids[1], "b")
    return pairs.groupBy("holdout_id", "es_1_id").agg(*(F.max(c).alias(c) for c in ("likeness", "covered", "es_1_covered")))


def found(held_out: DataFrame, training: DataFrame, least: float = LEAST) -> DataFrame:
    """``holdout_id, es_1_id`` of :func:`overlaps`."""
    return overlaps(held_out, training, least).select("holdout_id", "es_1_id")


def report(held_out: DataFrame, training: DataFrame, least: float = LEAST) -> DataFrame:
    """``split, source, pairs, records, of_records, covered``: overlaps by the held-out record's split and source; ``covered`` is the sum
    over its records of the most characters that one training record covers."""
    where = held_out.where(F.col("id").isNotNull()).groupBy("id").agg(F.min("split").alias("split"), F.min("source").alias("source"))
    per = overlaps(held_out, training, least).groupBy(F.col("holdout_id").alias("id")).agg(F.count("*").alias("pairs"), F.max("covered").alias("covered"))
    return where.join(per, "id", "left").groupBy("split", "source").agg(
        F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.count("pairs").alias("records"), F.count("*").alias("of_records"), F.coalesce(F.sum("covered"), F.lit(0)).alias("covered"),
    )
