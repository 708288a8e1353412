"""Exact-copy classes of texts and exact verification of candidate pairs of classes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.forms import SHORTEST, WIDTH, blocks, fingerprint, mix, plain
from veilspark.session import spread

#: Bits of the filter by which texts without a candidate stay where they are. It is of this size for any input; a full one lets all pass.
FILTER = 1 << 23
#: The bits of a class that the filter, and the shorter names of classes, go by.
REF = np.uint64((1 << 39) - 1)


def plain_block(batch: pa.RecordBatch, shortest: int = SHORTEST) -> tuple[np.ndarray, list[str]]:
    """Row numbers and plain forms of the rows whose plain form is long enough; nulls have none."""
    forms = [plain(t) if t is not None else "" for t in batch.column("text").to_pylist()]
    at = np.array([i for i, f in enumerate(forms) if len(f) >= shortest], np.int64)
    return at, [forms[i] for i in at]


def distinct_block(batch: pa.RecordBatch, shortest: int = SHORTEST) -> tuple[np.ndarray, list[str]]:
    """Class and plain form of each distinct text of a block: copies shrink to one before any shuffle."""
    seen: dict[str, None] = dict.fromkeys(plain_block(batch, shortest)[1])
    forms = list(seen)
    return np.array([fingerprint(f) for f in forms], np.int64), forms


def pack(*columns: np.ndarray) -> bytes:
    """Columns of one length, byte by byte and compressed; what is sorted costs little."""
    import zstandard

    data = b"".join(np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T).tobytes() for c in columns)
    return zstandard.ZstdCompressor(1).compress(data)


def unpack(data: bytes, n: int, kinds: tuple[tuple[type, int], ...]) -> list[np.ndarray]:
    """The ``n`` rows of each packed column, given its type and width."""
    import zstandard

    raw, at, out = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8), 0, []
    for kind, wide in kinds:
        size = np.dtype(kind).itemsize * wide
        rows = np.ascontiguousarray(raw[at : at + size * n].reshape(size, n).T).view(kind)
        out.append(rows if wide > 1 else rows.reshape(n))
        at += size * n
    return out


def class_filter(pairs: DataFrame, columns: tuple[str, ...] = ("a", "b")) -> bytes:
    """A bit filter of the classes in ``columns`` of the pairs, of FILTER bits whatever their number."""
    kind = ((np.uint8, 1),)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER // 8, np.uint8)
        for b in batches:
            if b.schema.names == ["bits"]:
                for one in b.column("bits").to_pylist():
                    bits |= unpack(one, FILTER // 8, kind)[0]
            else:
                for c in columns:
                    at = _place(b.column(c).to_numpy())
                    np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([pack(bits)], pa.binary())], ["bits"])

    whole = pairs.select(*columns).mapInArrow(partial, "bits binary").coalesce(1).mapInArrow(partial, "bits binary").first()
    return unpack(whole["bits"], FILTER // 8, kind)[0].tobytes()


def _place(cls: np.ndarray) -> np.ndarray:
    return (mix(cls.view(np.uint64) & REF) % np.uint64(FILTER)).astype(np.int64)


def class_rows(df: DataFrame, bits: bytes, all_ids: bool = False) -> DataFrame:
    """``cls, id, plain`` of the rows whose class passes the filter; with ``all_ids`` the others too, without their text.

    So texts without a candidate stay where they are. Null ids and texts and plain forms that are too short are left out.
    """
    data = df.sparkSession.sparkContext.broadcast(bits)  # FILTER bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(data.value, np.uint8)
        for b in blocks(batches):
            rows, forms = plain_block(b)
            cls = np.array([fingerprint(f) for f in forms], np.int64)
            at = _place(cls)
            on = (known[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            pick = np.arange(len(forms)) if all_ids else np.nonzero(on)[0]
            plain = pa.array([forms[i] if on[i] else None for i in pick.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(cls[pick]), b.column("id").take(pa.array(rows[pick])), plain], ["cls", "id", "plain"])

    source = spread(df.select("id", "text").where(F.col("id").isNotNull() & F.col("text").isNotNull()))
    return source.mapInArrow(run, f"cls bigint, id {source.schema['id'].dataType.simpleString()}, plain string")


def likenesses(left: list[str], right: list[str], width: int = WIDTH, least: float = 0.0) -> np.ndarray:
    """Exact likeness of each pair of plain forms; 0 where one set against the other's length keeps it under ``least``."""
    out = np.zeros(len(left))
    for k, (x, y) in enumerate(zip(left, right, strict=True)):
        if x == y:
            out[k] = 1.0
            continue
        a = {x[i : i + width] for i in range(len(x) - width + 1)}
        if len(y) - width + 1 < least * len(a):
            continue
        b = {y[i : i + width] for i in range(len(y) - width + 1)}
        both = len(a & b)
        out[k] = both / max(1, len(a) + len(b) - both)
    return out


def verified(pairs: DataFrame, table: DataFrame, least: float) -> DataFrame:
    """``a, b, likeness`` of the candidate pairs of classes that reach ``least``. ``table``: ``cls, plain``, a row per class.

    A pair is two rows, each with the text of one end: the candidates are computed and travel once.
    """
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("cls"), F.lit(0).alias("side")), F.struct(F.col("b").alias("cls"), F.lit(1).alias("side")))).alias("e"), "a", "b")
    both = ends.select("e.cls", "e.side", "a", "b").join(table, "cls")
    return _scored(both.select("a", "b", F.when(F.col("side") == 0, F.col("plain")).alias("x"), F.when(F.col("side") == 1, F.col("plain")).alias("y")), least)


def _scored(halves: DataFrame, least: float) -> DataFrame:
    whole = halves.groupBy("a", "b").agg(F.max("x").alias("x"), F.max("y").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cut in range(0, b.num_rows, 2000):
                part = b.slice(cut, 2000)
                score = likenesses(part.column("x").to_pylist(), part.column("y").to_pylist(), least=least)
                keep = np.nonzero(score >= least - 1e-12)[0]
                yield pa.RecordBatch.from_arrays([part.column("a").take(pa.array(keep)), part.column("b").take(pa.array(keep)), pa.array(score[keep])], ["a", "b", "likeness"])

    return whole.mapInArrow(run, "a bigint, b bigint, likeness double")
