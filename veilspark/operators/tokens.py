"""Tokens, windows, and what a tagger's answers over overlapping windows say about a document.

A tagger is any stage that adds, per window, ``tag_probs array<array<double>>`` (token, tag), ``level_probs array<double>`` and
``category_probs array<double>``; its model is loaded in the Python workers and is no part of this library.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions import spans as S
from veilspark.schema import BIO, CATEGORIES, LEVELS

SURE_OTHER = 0.8


class Tagger(Protocol):
    """From windows (``id, window_no, tokens array<struct<start,end>>, text``) to the same rows with the three probability columns."""

    def __call__(self, windows: DataFrame) -> DataFrame: ...


def no_tagger(windows: DataFrame) -> DataFrame:
    """The default: every token is surely no entity, the level is none, no category."""
    sure = F.transform("tokens", lambda _: F.array(F.lit(1.0), *[F.lit(0.0)] * (len(BIO) - 1)))
    return windows.withColumns({"tag_probs": sure, "level_probs": F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)), "category_probs": F.array(*[F.lit(0.0)] * len(CATEGORIES))})


def tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, text, tokens array<struct<start,end>>``: runs without white space; none for a null or blank text."""
    import re

    word = re.compile(r"\S+")
    rows = df.select(F.col(id_col).alias(id_col), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[m.span() for m in word.finditer(t or "")] for t in b.column("text").to_pylist()]
            flat = [x for spans in found for x in spans]
            cuts = np.cumsum([0, *map(len, found)]).astype(np.int32)
            ends = [pa.array([x[k] for x in flat], pa.int32()) for k in (0, 1)]
            spans = pa.ListArray.from_arrays(pa.array(cuts), pa.StructArray.from_arrays(ends, ["start", "end"]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column("text"), spans], [id_col, "text", "tokens"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, text string, tokens array<struct<start:int,end:int>>")


def windows(tokenised: DataFrame, max_length: int = 512, stride: int | None = None) -> DataFrame:
    """One row per window: ``window_no, first, tokens``, with one empty special token at either end.

    ``max_length - 2`` tokens a window, ``stride`` (a quarter of max_length by default) shared by neighbours; the last one ends with
    the last token; a text without tokens has one window.
    """
    size = max_length - 2
    shared = max_length // 4 if stride is None else stride
    if not 0 <= shared < size:
        raise ValueError(f"windows of {size} tokens can't share {shared}")
    n = F.size("tokens")
    last = F.greatest(F.lit(0), F.ceil((n - size) / F.lit(size - shared))).cast("int")
    special = F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end")))
    per = tokenised.withColumn("window_no", F.explode(F.sequence(F.lit(0), last))).withColumn("first", F.col("window_no") * (size - shared))
    return per.withColumn("tokens", F.concat(special, F.slice("tokens", F.col("first") + 1, F.lit(size)), special))


def decided_tag(probs: Column, threshold: float | None = SURE_OTHER) -> Column:
    """Number of the tag: O only if at least ``threshold`` sure, else the best entity; the plain best with None."""
    if threshold is None:
        return (F.array_position(probs, F.array_max(probs)) - 1).cast("int")
    entity = F.slice(probs, 2, F.size(probs) - 1)
    return F.when(probs[0] >= threshold, F.lit(0)).otherwise(F.array_position(entity, F.array_max(entity)).cast("int"))


def resolve_overlaps(tagged: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id, start, end, tag``: of a token in several windows, the tag from where it lies most centrally, the earlier window on a tie.

    Input: ``window_no, pos, n`` (position and number of tokens in the window, special ones included), ``start, end, tag``.
    """
    central = F.least(F.col("pos"), F.col("n") - 1 - F.col("pos"))
    best = Window.partitionBy(id_col, "start", "end").orderBy(central.desc(), F.col("window_no"))
    return tagged.where("start < end").withColumn("k", F.row_number().over(best)).where("k = 1").select(id_col, "start", "end", "tag")


def islands(tagged: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id, start, end, kind``: runs of one kind among the tokens of a document, by gaps and islands.

    Input: ``start, end, tag string``. A run goes on if the kind is the same and the tag is an I or the token touches the run.
    """
    order = Window.partitionBy(id_col).orderBy("start", "end")
    kind = F.when(F.col("tag") != "O", F.substring("tag", 3, 99))
    rows = tagged.withColumn("kind", kind).withColumn("last_kind", F.lag("kind").over(order)).withColumn("last_end", F.lag("end").over(order))
    new = F.when(F.col("kind").isNotNull() & F.col("last_kind").eqNullSafe(F.col("kind")) & ((F.substring("tag", 1, 1) == "I") | (F.col("start") <= F.col("last_end"))), 0).otherwise(1)
    return (
        rows.withColumn("new", new).withColumn("island", F.sum("new").over(order)).where("kind IS NOT NULL")
        .groupBy(id_col, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("kind").alias("kind")).drop("island")
    )


def bio_labels(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id, tags array<int>`` from ``tokens`` and ``spans`` of each document; empty tokens are -100."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [S.bio_tags([(t["start"], t["end"]) for t in ts or ()], [(s["start"], s["end"], s["kind"]) for s in ss or ()]) for ts, ss in zip(b.column("tokens").to_pylist(), b.column("spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(out, pa.list_(pa.int32()))], [id_col, "tags"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, "tokens", "spans").mapInArrow(run, f"`{id_col}` {kind}, tags array<int>")


def decisive(judged: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id, level, probabilities, categories, windows``: the most sensitive window decides (the surer, then the earlier of equals);
    each category takes its greatest probability."""
    at = (F.array_position("level_probs", F.array_max("level_probs")) - 1).cast("int")
    best = F.max_by(F.struct(at.alias("at"), "level_probs"), F.struct(at, F.array_max("level_probs"), -F.col("window_no")))
    cats = [F.max(F.col("category_probs")[k]).alias(c) for k, c in enumerate(CATEGORIES)]
    rows = judged.groupBy(id_col).agg(best.alias("best"), F.count("*").cast("int").alias("windows"), *cats)
    return rows.select(
        id_col, F.element_at(F.array(*map(F.lit, LEVELS)), F.col("best.at") + 1).alias("level"),
        F.map_from_arrays(F.array(*map(F.lit, LEVELS)), F.col("best.level_probs")).alias("probabilities"),
        F.map_from_arrays(F.array(*map(F.lit, CATEGORIES)), F.array(*CATEGORIES)).alias("categories"), "windows",
    )


def resolve(tagged: DataFrame, id_col: str = "doc_id", threshold: float | None = SURE_OTHER) -> DataFrame:
    """A tagger's windows as one column ``tags`` per document for :func:`veilspark.operators.scan.analyse`.

    Tags are decided, overlaps resolved, spans decoded and touching pieces joined.
    """
    tag = F.transform("tag_probs", lambda p: decided_tag(p, threshold))
    flat = tagged.select(id_col, "window_no", F.size("tokens").alias("n"), F.posexplode(F.arrays_zip(F.col("tokens"), tag.alias("tag"))).alias("pos", "z"))
    best = resolve_overlaps(flat.select(id_col, "window_no", "n", "pos", F.col("z.tokens.start").alias("start"), F.col("z.tokens.end").alias("end"), F.element_at(F.array(*map(F.lit, BIO)), F.col("z.tag") + 1).alias("tag")), id_col)
    per = best.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("start", "end", "tag"))).alias("tagged"))  # the tokens of one document
    texts = tagged.where("window_no = 0").select(id_col, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, ts in zip(b.column("text").to_pylist(), b.column("tagged").to_pylist(), strict=True):
                text = text or ""
                offsets = S.token_spans([(t["start"], t["end"]) for t in ts or ()], text)
                out.append([{"start": s, "end": e, "kind": k} for s, e, k in S.merge(text, S.decode(text, offsets, [t["tag"] for t in ts or ()]))])
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])))], [id_col, "spans"])

    kind = tagged.schema[id_col].dataType.simpleString()
    spans = texts.join(per, id_col, "left").select(id_col, "text", "tagged").mapInArrow(run, f"`{id_col}` {kind}, spans array<struct<start:int,end:int,kind:string>>")
    return spans.join(decisive(tagged, id_col), id_col).select(id_col, F.struct("spans", "level", "probabilities", "categories", "windows").alias("tags"))


def truncated(tokenised: DataFrame, max_length: int = 512) -> DataFrame:
    """One window per document: its first ``max_length - 2`` tokens between the special ones."""
    special = F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end")))
    return tokenised.withColumn("tokens", F.concat(special, F.slice("tokens", 1, max_length - 2), special))


def labelled_windows(docs: DataFrame, max_length: int = 512, stride: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, window_no, tokens, tags`` of labelled documents (``text, spans``): windows as at inference, each with its own tags."""
    w = windows(tokens(docs, id_col, text_col), max_length, stride).join(docs.select(id_col, "spans"), id_col)
    keyed = w.withColumn("key", F.struct(id_col, "window_no"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [S.bio_tags([(t["start"], t["end"]) for t in ts or ()], [(s["start"], s["end"], s["kind"]) for s in ss or ()]) for ts, ss in zip(b.column("tokens").to_pylist(), b.column("spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("tokens"), pa.array(out, pa.list_(pa.int32()))], ["key", "tokens", "tags"])

    rows = keyed.select("key", "tokens", "spans")
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, tokens array<struct<start:int,end:int>>, tags array<int>").select("key.*", "tokens", "tags")


def length_groups(windowed: DataFrame, size: int = 16, most_tokens: int = 8192, id_col: str = "doc_id", parts: int = 64) -> DataFrame:
    """``id, part, batch``: documents of like width in batches of at most ``size`` windows and ``most_tokens`` padded tokens.

    Range-partitioned by width, then packed in one pass per part, so that no part sees the whole table.
    """
    per = windowed.groupBy(id_col).agg(F.count("*").cast("int").alias("windows"), F.max(F.size("tokens")).cast("int").alias("width"))
    ranged = per.repartitionByRange(parts, "width", id_col).sortWithinPartitions("width", id_col).withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch, filled, wide = 0, 0, 0
        for b in batches:
            out = []
            for n, w in zip(b.column("windows").to_pylist(), b.column("width").to_pylist(), strict=True):
                if filled and (filled + n > size or (filled + n) * max(wide, w) > most_tokens):
                    batch, filled, wide = batch + 1, 0, 0
                filled, wide = filled + n, max(wide, w)
                out.append(batch)
            yield pa.RecordBatch.from_arrays([b.column(id_col), b.column("part"), pa.array(out, pa.int32())], [id_col, "part", "batch"])

    kind = per.schema[id_col].dataType.simpleString()
    return ranged.mapInArrow(run, f"`{id_col}` {kind}, part int, batch int")
