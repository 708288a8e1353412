"""Problem 4: near-duplicate texts by tensored minhash banding.

Likeness is the Jaccard similarity of the sets of 5-character substrings of plain forms. Two collections of half keys, LEFTS
left ones of LEFT minhashes and RIGHTS right ones of RIGHT, stand for LEFTS * RIGHTS tables: a table's key is a pair of half
keys, so LEFTS * LEFT + RIGHTS * RIGHT minhashes do what LEFTS * RIGHTS * (LEFT + RIGHT) would. A text travels once per left
half key and carries its right half keys along; the pairing of the two happens where it arrives, so the tensor is never
shuffled. A hash function gives eight minhashes: the substrings fall into four bins, and each bin has a least and a greatest
value. Every pair left is compared exactly, whole text against whole text.

With (LEFT, LEFTS, RIGHT, RIGHTS) = (2, 11, 4, 36) a pair of likeness s is a candidate with probability
(1 - (1 - s**2)**11) * (1 - (1 - s**4)**36): 0.986 at 0.6, 0.997 at 0.65, 0.9994 at 0.7, 1 - 1e-5 at 0.8. Of the 144 carried
minhashes, 4 bits each, at least AGREE must agree before the exact comparison; at likeness 0.6 each agrees with probability
0.625, and fewer than 66 do with probability 0.00003.

A left half key that very many texts have (seen in a bounded sample of texts) is not one task: its texts go to a task for each
of their right half keys instead. A run of texts with an equal pair of half keys is cut into blocks, of which each two meet in
a task. Both decide where pairs are made, never which.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.classes import class_filter, class_rows, distinct_block, pack, unpack, verified
from veilspark.llm.forms import MIX, WIDTH, Windows, blocks, mix
from veilspark.session import checkpoint, spread

LEAST, LEFT, LEFTS, RIGHT, RIGHTS = 0.6, 2, 11, 4, 36
AGREE, BITS, BINS = 66, 4, 4
#: Runs of equal keys longer than this are cut into blocks of this size, and each two blocks are compared in a task of their own.
LONG_RUN = 1024
#: Rows of a part, about; texts in the sample; of these, how many make a left half key one that is split.
PART, SAMPLE, COMMON = 150_000, 6000, 8
#: A text as it travels: its class and right half keys, once per part; and the left half keys that point to it.
TEXTS, KEYS = ((np.int64, 1), (np.uint16, RIGHTS)), ((np.uint64, 1), (np.uint32, 1))


def half_keys(forms: list[str], seed: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """64-bit left and 16-bit right half keys of each plain form, of shapes (texts, LEFTS) and (texts, RIGHTS)."""
    w = Windows(forms)
    at, counts = w.positions(WIDTH)
    whole = w.hashes(at, WIDTH)
    text, bin_ = np.repeat(np.arange(len(forms)), counts), whole & np.uint64(BINS - 1)
    draw = np.random.default_rng(seed)
    parts = []
    for k in range(BINS):
        pick = np.nonzero(bin_ == k)[0]
        n = np.bincount(text[pick], minlength=len(forms))
        has = np.nonzero(n)[0]
        parts.append(((whole[pick] >> np.uint64(32)).astype(np.uint32), has, (np.cumsum(n) - n)[has]))

    def minhashes() -> Iterator[np.ndarray]:
        while True:
            a, c = (np.uint32(x) for x in (int(draw.integers(1 << 31)) * 2 + 1, int(draw.integers(1 << 32))))
            mixed = []
            for h, _, _ in parts:
                x = h ^ c
                x *= a
                x ^= x >> np.uint32(15)
                mixed.append(x)
            for best, none in ((np.minimum, 0xFFFFFFFF), (np.maximum, 0)):
                for x, (_, has, starts) in zip(mixed, parts, strict=True):
                    out = np.full(len(forms), none, np.uint64)  # an empty bin is empty in a like text, too
                    if len(has):
                        out[has] = best.reduceat(x, starts)
                    yield out

    values = minhashes()
    left, right = np.empty((len(forms), LEFTS), np.uint64), np.empty((len(forms), RIGHTS), np.uint16)
    with np.errstate(over="ignore"):
        for t in range(RIGHTS):
            key = np.zeros(len(forms), np.uint64)
            for _ in range(RIGHT):
                key = (key << np.uint64(BITS)) | (next(values) & np.uint64((1 << BITS) - 1))
            right[:, t] = key.astype(np.uint16)
        for t in range(LEFTS):
            key = np.full(len(forms), t + 1, np.uint64)
            for _ in range(LEFT):
                key = mix((key * MIX) ^ next(values))
            left[:, t] = key
    return left, right


def common_keys(df: DataFrame, least: int | None = None) -> tuple[np.ndarray, int]:
    """Left half keys with more than PART texts, judged by a bounded sample of texts, and the number of parts for all keys."""
    rows = df.count()
    share = min(1.0, SAMPLE / max(1, rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            forms = distinct_block(b)[1]
            if forms:
                yield pa.RecordBatch.from_arrays([pa.array([half_keys(forms)[0].tobytes()], pa.binary())], ["lefts"])

    sample = df.sample(False, share, 1) if share < 1 else df
    found = np.frombuffer(b"".join(r["lefts"] for r in sample.mapInArrow(run, "lefts binary").collect()), np.uint64)  # of SAMPLE texts, about
    keys, n = np.unique(found, return_counts=True)
    return keys[n >= (least if least is not None else max(COMMON, PART * share))], int(max(16, rows * LEFTS // PART))


def keyed(df: DataFrame, common: np.ndarray, parts: int) -> DataFrame:
    """``part int, split int, n int, texts binary, keys binary``: the distinct texts of a block with their half keys, packed by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            cls, forms = distinct_block(b)
            if not forms:
                continue
            left, right = half_keys(forms)
            hot = np.isin(left, common)
            one, at = np.nonzero(~hot)
            jobs = [(0, one, left[one, at])]
            one, at = np.nonzero(hot)
            with np.errstate(over="ignore"):
                tables = _pair_key(np.repeat(left[one, at], RIGHTS), right[one].reshape(-1), np.tile(np.arange(RIGHTS), len(one)))
            jobs.append((1, np.repeat(one, RIGHTS), tables))
            for split, text, key in jobs:
                part = (mix(key) % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                cuts = np.searchsorted(part[order], np.arange(parts + 1))
                rows = []
                for i in np.nonzero(cuts[1:] > cuts[:-1])[0].tolist():
                    pick = order[cuts[i] : cuts[i + 1]]
                    own, to = np.unique(text[pick], return_inverse=True)
                    rows.append((i, split, len(own), len(pick), pack(cls[own], right[own]), pack(key[pick], to.astype(np.uint32))))
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in cols[:4]), *(pa.array(c, pa.binary()) for c in cols[4:])], ["part", "split", "texts", "keys", "text", "key"])

    return df.mapInArrow(run, "part int, split int, texts int, keys int, text binary, key binary")


def _pair_key(left: np.ndarray, right: np.ndarray, table: np.ndarray) -> np.ndarray:
    return mix(left ^ (right.astype(np.uint64) + np.uint64(1) + (table.astype(np.uint64) << np.uint64(16))) * MIX)


def runs_to_pairs(keys: np.ndarray, longest: int | None = None, long: list[np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of all pairs with equal keys. The rows of runs over ``longest`` are put into ``long`` instead, a run each."""
    rows = np.argsort(keys, kind="stable")
    keys = keys[rows]
    starts = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0] if len(keys) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(keys)))
    if longest is not None and (sizes > longest).any():
        over = sizes > longest
        long += [rows[at : at + n] for at, n in zip(starts[over], sizes[over], strict=True)]
        short = np.repeat(~over, sizes)
        keys, rows = keys[short], rows[short]
    step = 1
    alive = np.arange(len(keys))
    while True:
        alive = alive[alive + step < len(keys)]
        alive = alive[keys[alive] == keys[alive + step]]
        if not len(alive):
            return
        yield rows[alive], rows[alive + step]
        step += 1


def agreeing(rights: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of the carried minhashes agree in each pair of rows."""
    apart = rights[a] ^ rights[b]
    mask = np.uint16((1 << BITS) - 1)
    return sum((((apart >> np.uint16(BITS * k)) & mask) == 0).sum(1) for k in range(RIGHT))


def candidates(keys: DataFrame, parts: int, longest: int | None = None) -> DataFrame:
    """Distinct ``a, b`` (a < b) of classes that agree in a left and a right half key.

    A run over ``longest`` leaves the task of its key as block pairs, which cover all of its pairs and are spread over the tasks.
    """
    longest = longest or LONG_RUN
    carried = np.dtype([("cls", "<i8"), ("rights", "<u2", (RIGHTS,))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[tuple[int, int, bytes, bytes]]] = {}
        for b in batches:
            for part, split, *row in zip(*(b.column(c).to_pylist() for c in ("part", "split", "texts", "keys", "text", "key")), strict=True):
                held.setdefault((split, part), []).append(tuple(row))
        found = _Distinct()
        for split, part in sorted(held):
            left, cls, rights = [], [], []
            for n, many, text, key in held.pop((split, part)):
                (c, r), (k, to) = unpack(text, n, TEXTS), unpack(key, many, KEYS)
                left.append(k), cls.append(c[to]), rights.append(r[to])
            left, cls, rights = np.concatenate(left), np.concatenate(cls), np.concatenate(rights)
            order = np.lexsort((cls, left))
            left, cls, rights = left[order], cls[order], rights[order]
            once = np.concatenate([[True], (left[1:] != left[:-1]) | (cls[1:] != cls[:-1])])
            left, cls, rights = left[once], cls[once], rights[once]
            same = left[1:] == left[:-1]
            shared = np.concatenate([same, [False]]) | np.concatenate([[False], same])  # a half key of one class alone makes no pair
            left, cls, rights = left[shared], cls[shared], rights[shared]
            for t in range(1 if split else RIGHTS):
                with np.errstate(over="ignore"):
                    key = left if split else _pair_key(left, rights[:, t], np.full(len(left), t))
                long: list[np.ndarray] = []
                for a, b in runs_to_pairs(key, longest, long):
                    near = agreeing(rights, a, b) >= AGREE
                    yield from found.add(cls[a[near]], cls[b[near]])
                for one in long:
                    rows = np.empty(len(one), carried)
                    rows["cls"], rows["rights"] = cls[one], rights[one]
                    cuts = [rows[at : at + longest].tobytes() for at in range(0, len(rows), longest)]
                    for i, x in enumerate(cuts):
                        for j in range(i, len(cuts)):
                            name = mix(key[one[:1]] ^ np.uint64(i << 32 | j)).view(np.int64)
                            yield pa.RecordBatch.from_arrays([pa.array(name), pa.array([j - i]), pa.array([x], pa.binary()), pa.array([cuts[j]], pa.binary())], names)
        yield from found.rest()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Distinct()
        for batch in batches:
            unit = batch.column("x").is_valid().to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(~unit)).select(["a", "b"])
            for k in np.nonzero(unit)[0].tolist():
                x, y = (np.frombuffer(batch.column(c)[k].as_py(), carried) for c in ("x", "y"))
                rows = np.concatenate([x, y])
                for i in range(len(x)):
                    # a block against itself: each two of its rows once
                    b = np.arange(len(x) + (0 if batch.column("b")[k].as_py() else i + 1), len(rows))
                    b = b[agreeing(rows["rights"], np.full(len(b), i), b) >= AGREE]
                    for part in found.add(np.full(len(b), rows["cls"][i]), rows["cls"][b]):
                        yield part.select(["a", "b"])
        for part in found.rest():
            yield part.select(["a", "b"])

    names = ["a", "b", "x", "y"]
    first = keys.repartition(parts, "part", "split").mapInArrow(run, "a bigint, b bigint, x binary, y binary")
    return first.repartition("a", "b").mapInArrow(meet, "a bigint, b bigint").distinct()


class _Distinct:
    """Collects pairs of classes and gives them on as distinct as its bounded memory allows."""

    def __init__(self) -> None:
        self.held: list[np.ndarray] = []
        self.some = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append(np.stack([np.minimum(a, b), np.maximum(a, b)], 1))
        self.some += len(a)
        if self.some > 2_000_000:
            done = np.unique(np.concatenate(self.held), axis=0)
            self.held, self.some = [done], len(done)
            if self.some > 1_000_000:
                yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        found = np.unique(np.concatenate(self.held), axis=0) if self.held else np.zeros((0, 2), np.int64)
        self.held, self.some = [], 0
        for cut in range(0, len(found), 100_000):
            part = found[cut : cut + 100_000]
            none = pa.nulls(len(part), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(part[:, 0].copy()), pa.array(part[:, 1].copy()), none, none], ["a", "b", "x", "y"])


def _linked(df: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """``cls, id`` of every row with a text long enough, and ``a, b, likeness`` of the pairs of different classes that reach ``least``."""
    source = spread(df.select("text").where(F.col("text").isNotNull()))
    common, parts = common_keys(source)
    pairs = checkpoint(candidates(keyed(source, common, parts), parts))
    rows = checkpoint(class_rows(df, class_filter(pairs), all_ids=True))
    table = rows.where("plain IS NOT NULL").groupBy("cls").agg(F.first("plain").alias("plain"))
    return rows.select("cls", "id").distinct(), verified(pairs, table, least)


#: Ids of a class that meet in one task when copies are listed as pairs.
COPIES = 2000


def _copies(ids: DataFrame) -> DataFrame:
    """``id_a, id_b`` (id_a < id_b) of different ids of one class; a class of very many copies is paired block by block."""
    many = ids.groupBy("cls").agg(F.count("*").alias("n")).where("n > 1").select("cls", F.ceil(F.col("n") / COPIES).cast("int").alias("blocks"))
    own = ids.join(many, "cls").select("cls", "id", "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"))
    a = own.select("cls", F.col("id").alias("x"), F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"))
    b = own.select("cls", F.col("id").alias("y"), F.explode(F.sequence(F.lit(0), F.col("block"))).alias("i"), F.col("block").alias("j"))
    met = a.join(b, ["cls", "i", "j"]).where("CASE WHEN i = j THEN x < y ELSE x <> y END")
    return met.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def found(df: DataFrame, least: float = LEAST) -> DataFrame:
    """``id_a, id_b`` (id_a < id_b): all pairs of different ids whose texts reach ``least``, exact copies among them.

    Null texts and plain forms under 40 characters belong to no pair; null ids are left out; a redelivered row is the same id.
    An id with different texts has the pairs of each.
    """
    ids, pairs = _linked(df, least)
    a = ids.select(F.col("cls").alias("a"), F.col("id").alias("id_a"))
    b = ids.select(F.col("cls").alias("b"), F.col("id").alias("id_b"))
    across = pairs.select("a", "b").join(a, "a").join(b, "b").select("id_a", "id_b")
    either = across.where("id_a <> id_b").select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
    return either.unionByName(_copies(ids)).distinct()


#: Copies of a label's own label, so that a group of very many texts isn't one key of a join.
SALT = 16


def groups(df: DataFrame, least: float = LEAST, rounds: int = 200) -> DataFrame:
    """``id, group_id, links``: each id with its group and the number of class links of its text.

    Groups are the connected components of the class links; ``group_id`` is the least class of a group. Labels spread by
    least neighbour with pointer jumping until none changes; each round cuts the lineage in the checkpoint folder. Pointer jumping
    needs few rounds even for long chains, and more than ``rounds`` of them raise. One row per id, so copies and redelivered
    rows aren't expanded into pairs.
    """
    ids, pairs = _linked(df, least)
    links = checkpoint(pairs.select("a", "b"))
    edges = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = edges.groupBy("a").agg(F.count("*").alias("links"))
    labels = checkpoint(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")))
    for n in range(rounds + 1):
        if n == rounds:
            raise RuntimeError(f"groups still change after {rounds} rounds")
        near = edges.join(labels.select(F.col("a").alias("b"), F.col("label").alias("other")), "b").groupBy("a").agg(F.min("other").alias("other"))
        low = labels.join(near, "a").select("a", F.least("label", "other").alias("label"), F.col("label").alias("old"))
        salt = F.pmod(F.xxhash64("a"), F.lit(SALT)).cast("int").alias("salt")
        named = low.select("label").distinct()
        jump = low.select(F.col("a").alias("label"), F.col("label").alias("further")).join(named, "label", "left_semi").select("*", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
        new = checkpoint(low.select("*", salt).join(jump, ["label", "salt"]).select("a", F.least("label", "further").alias("label"), "old"))
        changed = new.where("label <> old").limit(1).count()
        labels = new.select("a", "label")
        if not changed:
            break
    whole = ids.join(labels.withColumnRenamed("a", "cls"), "cls", "left").join(degree.withColumnRenamed("a", "cls"), "cls", "left")
    one = Window.partitionBy("id").orderBy("cls")
    rows = whole.select("id", "cls", F.coalesce("label", "cls").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
    return rows.withColumn("n", F.row_number().over(one)).where("n = 1").select("id", "group_id", "links")
