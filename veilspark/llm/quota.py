"""Problem 3: a sample that matches target category proportions.

Calibration on the exponential-tilting dual. Without targets each id is drawn with probability BASE; the calibrated chances are
the exponential tilt of that draw, whose odds are ``BASE / (1 - BASE) * exp(sum of the id's categories' multipliers)``, so they stay
between 0 and 1. Newton steps on the dual find the multipliers for which the expected number of each category is its target.
The moments need only the number of ids of each observed combination, one distributed aggregate whose rows are bounded by the
product of the target categories. Targets that exclude each other have no solution; a small quadratic term on the multipliers
(SOFT) then gives the least sum of squared misses, each against its target, and every miss is reported.

The draw is the pivotal method: units in the order of their combinations meet in duels that keep every unit's probability and
fix one of the two, first within blocks, then among the one undecided unit that each block leaves, until one block is left.
After it a category under its floor gets further ids of its own, and the gaps between the targets and what was drawn are listed.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.session import checkpoint

FIELDS = ("lang", "sensitivity", "cell")
#: Newton steps after which the calibration counts as failed, and the largest slope of the dual left, against the target.
STEPS, SLOPE = 100, 1e-7
#: Weight, against its target, of a multiplier's square.
SOFT = 0.001
BASE = 1 / 5
#: Ids of a block of duels, about.
BLOCK_IDS = 100_000


def category(field: str) -> Column:
    """A field as it is read: trimmed and lower-cased; in ``cell`` a space or hyphen inside stands for an underscore."""
    read = F.lower(F.trim(F.col(field)))
    return F.regexp_replace(read, "[ -]", "_") if field == "cell" else read


def _ids(table: DataFrame) -> DataFrame:
    """Distinct ids with their three categories; redelivered rows have the same content, so any copy will do.

    A null id counts for nothing. Should copies differ, the least values stand, so the result doesn't depend on order.
    """
    return table.where(F.col("id").isNotNull()).select("id", *(category(f).alias(f) for f in FIELDS)).groupBy("id").agg(*(F.min(f).alias(f) for f in FIELDS))


def _counts(ids: DataFrame, targets: DataFrame) -> DataFrame:
    cells = checkpoint(ids.groupBy(*FIELDS).agg(F.count("*").alias("n")))  # a row per combination of categories
    per = reduce(DataFrame.unionByName, [cells.groupBy(F.lit(f).alias("field_name"), F.col(f).alias("category")).agg(F.sum("n").alias("ids")) for f in FIELDS])
    size = (cells.agg(F.sum("n")).first()[0] or 0) // 5
    rows = targets.select("field_name", "category", "target_share", "min_count").distinct().join(per, ["field_name", "category"], "left")
    wanted = F.greatest(F.col("min_count").cast("double"), F.col("target_share") * F.lit(float(size)))
    return rows.select(
        "field_name", "category", "target_share", "min_count", F.coalesce("ids", F.lit(0)).alias("ids"), wanted.alias("wanted"), (F.coalesce("ids", F.lit(0)) < wanted).alias("short"),
    )


def counts(table: DataFrame, targets: DataFrame) -> DataFrame:
    """Each row of ``targets`` with its distinct ids, the wanted number and whether they fall short.

    wanted = greatest(min_count, target_share * N), N = distinct ids / 5 rounded down. An empty table gives N = 0, so only
    ``min_count`` can fall short. Repeated target rows count once.
    """
    return _counts(_ids(table), targets)


def calibrate(cells: pd.DataFrame, wanted: dict[tuple[str, str], float], floors: dict[tuple[str, str], float] | None = None) -> tuple[np.ndarray, dict[tuple[str, str], float]]:
    """Inclusion probability of each combination, and the expected number of each category. Newton on the dual.

    ``cells``: the three fields and ``n``. A target that its ids can't fill is set to all of them, and the fields' targets are
    brought to one total, floors kept. A dual that isn't solved to SLOPE within STEPS raises.
    """
    keys = sorted(wanted)
    x = np.array([[float(row[f] == c) for f, c in keys] for row in cells.to_dict("records")]).reshape(len(cells), len(keys))
    n = cells["n"].to_numpy(float)
    have = n @ x
    goal = np.minimum(np.array([wanted[k] for k in keys]), have)
    floor = np.minimum(np.array([(floors or {}).get(k, 0.0) for k in keys]), goal)
    # fields must agree on one total: where one runs out of ids, what the others want beyond their floors shrinks in proportion
    parts = [np.array([f == g for g, _ in keys], bool) for f in FIELDS]
    most = min(goal[part].sum() + n.sum() - have[part].sum() for part in parts)
    for part in parts:
        over = goal[part].sum() - floor[part].sum()
        if goal[part].sum() > most and over > 0:
            goal[part] = floor[part] + (goal[part] - floor[part]) * max(0.0, most - floor[part].sum()) / over
    soft = SOFT * np.maximum(goal, 1.0)

    def chances(m: np.ndarray) -> np.ndarray:
        return 1 / (1 + (1 - BASE) / BASE * np.exp(-np.clip(x @ m, -700, 700)))

    def dual(m: np.ndarray) -> float:
        return float(goal @ m - soft @ (m * m) / 2 - n @ np.logaddexp(np.log(1 - BASE), np.log(BASE) + x @ m))

    multipliers = np.zeros(len(keys))
    for _ in range(STEPS):
        p = chances(multipliers)
        slope = goal - (n * p) @ x - soft * multipliers
        if not len(slope) or (np.abs(slope) <= SLOPE * np.maximum(goal, 1.0)).all():
            return p, dict(zip(keys, ((n * p) @ x).tolist(), strict=True))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.diag(soft), slope)
        size, value = 1.0, dual(multipliers)
        while size > 1e-12 and dual(multipliers + size * step) < value + 1e-4 * size * (slope @ step) - 1e-9 * abs(value):
            size /= 2
        multipliers = multipliers + size * step
    raise RuntimeError(f"calibration: slope {np.abs(slope).max():.3g} after {STEPS} Newton steps")


@dataclass
class Calibrated:
    """The ids with their categories, the target rows with ``expected``, and the chance of each combination of target categories."""

    ids: DataFrame
    rows: list[dict]
    cells: pd.DataFrame

    def masked(self) -> DataFrame:
        """Ids with categories outside the targets as an empty string."""
        names = {f: [r["category"] for r in self.rows if r["field_name"] == f] for f in FIELDS}
        return self.ids.select("id", *(F.when(F.col(f).isin(names[f]), F.col(f)).otherwise("").alias(f) for f in FIELDS))


def calibrated(table: DataFrame, targets: DataFrame) -> Calibrated:
    """The calibration of ``table`` to ``targets``, a bounded table of a row per category."""
    ids = checkpoint(_ids(table))
    rows = sorted((r.asDict() for r in _counts(ids, targets).collect()), key=lambda r: (r["field_name"], r["category"]))
    out = Calibrated(ids, rows, pd.DataFrame())
    keys = {(r["field_name"], r["category"]): r for r in rows if r["field_name"] in FIELDS}
    out.cells = out.masked().groupBy(*FIELDS).agg(F.count("*").alias("n")).toPandas()  # bounded by the product of the target categories
    expected: dict = {}
    if len(out.cells):
        out.cells["p"], expected = calibrate(out.cells, {k: float(r["wanted"]) for k, r in keys.items()}, {k: float(r["min_count"]) for k, r in keys.items()})
    for r in rows:
        r["expected"] = float(expected.get((r["field_name"], r["category"]), 0.0))
    return out


def out_of_reach(table: DataFrame, targets: DataFrame) -> DataFrame:
    """The target rows that no calibration can meet, as they want more than their distinct ids."""
    found = [(r["field_name"], r["category"]) for r in calibrated(table, targets).rows if r["short"]]
    return table.sparkSession.createDataFrame(found, "field_name string, category string")


def _duels(ids: list[str], chances: np.ndarray, rng: random.Random) -> tuple[list[str], list[tuple[str, float]]]:
    """Ordered pivotal method: the ids taken, and the one unit left with a chance between 0 and 1."""
    taken: list[str] = []
    holder, a = None, 0.0
    for one, b in zip(ids, chances, strict=True):
        if b >= 1 - 1e-12:
            taken.append(one)
        elif b > 1e-12:
            if holder is None:
                holder, a = one, b
            elif a + b < 1:
                holder, a = (holder if rng.random() < a / (a + b) else one), a + b
            else:
                first = rng.random() < (1 - b) / (2 - a - b)
                taken.append(holder if first else one)
                holder, a = (one if first else holder), a + b - 1
            if a >= 1 - 1e-9 and holder is not None:
                taken.append(holder)
                holder, a = None, 0.0
            elif a <= 1e-9:
                holder, a = None, 0.0
    return taken, [(holder, a)] if holder is not None else []


def _drawn(units: DataFrame, n: int, seed: int) -> DataFrame:
    """``id`` of the units (``id, p`` and FIELDS) that win. Blocks follow the number of units; what they leave meets in fewer blocks."""
    won, level = [], 0
    while True:
        blocks = -(-n // BLOCK_IDS)
        of = units.withColumn("block", F.pmod(F.xxhash64(F.lit(seed + level), "id"), F.lit(blocks))).withColumn("at", F.xxhash64("id", F.lit(seed + level)))
        first = checkpoint(of.repartition("block").sortWithinPartitions("block", *FIELDS, "at", "id").select("id", *FIELDS, "p", "block").mapInArrow(_fight(seed + level, blocks == 1), units.select("id", *FIELDS, "p").schema))
        won.append(first.where("p >= 1").select("id"))
        if blocks == 1:
            return reduce(DataFrame.unionByName, won)
        units, n, level = first.where("p < 1"), blocks, level + 1


def _fight(seed: int, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, None  # sorted by block, so one undecided unit is all that is carried over
        names = ["id", *FIELDS, "p"]

        def rest() -> pa.RecordBatch:
            rows = [held] if held is not None else []
            if last:
                rows = [{**r, "p": 1.0} for r in rows if random.Random(f"{seed}-last").random() < r["p"]]
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.float64() if c == "p" else pa.string()) for c in names], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            number = batch.column("block").to_numpy()
            cuts = [0, *(np.nonzero(number[1:] != number[:-1])[0] + 1).tolist(), len(number)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if number[a] != block:
                    yield rest()
                    block, held = number[a], None
                part = batch.slice(a, b - a).select(names)
                if held is not None:
                    part = pa.concat_batches([pa.RecordBatch.from_pylist([held], part.schema), part])
                p = part.column("p").to_numpy()
                taken, left = _duels(list(range(len(p))), p, random.Random(f"{seed}-{block}-{part.column('id')[0]}"))
                held = {**part.slice(left[0][0], 1).to_pylist()[0], "p": left[0][1]} if left else None
                done = part.take(pa.array(taken, pa.int64()))
                yield pa.RecordBatch.from_arrays([*done.columns[:-1], pa.array(np.ones(len(taken)))], names)
        yield rest()

    return run


def _floored(c: Calibrated, drawn: DataFrame, seed: int) -> DataFrame:
    """The drawn ids and, of categories that the draw left under their floor, as many further ids as that takes."""
    chosen = checkpoint(c.ids.join(drawn.hint("shuffle_hash"), "id", "left_semi"))
    for f in FIELDS:
        floors = {r["category"]: min(r["min_count"], r["ids"]) for r in c.rows if r["field_name"] == f}
        have = {r[f]: r["n"] for r in chosen.where(F.col(f).isin(list(floors))).groupBy(f).agg(F.count("*").alias("n")).collect()}  # a row per target category
        lack = [(k, n - have.get(k, 0)) for k, n in floors.items() if n > have.get(k, 0)]
        if lack:
            need = F.broadcast(c.ids.sparkSession.createDataFrame(lack, f"{f} string, lack int"))
            spare = c.ids.join(need, f).join(chosen.select("id"), "id", "left_anti").withColumn("at", F.xxhash64("id", F.lit(seed))).withColumn("block", F.pmod("at", F.lit(256)))
            # the first of each block, then of those, so that no category is one task
            few = spare.withColumn("n", F.row_number().over(Window.partitionBy(f, "block").orderBy("at", "id"))).where("n <= lack")
            more = few.withColumn("n", F.row_number().over(Window.partitionBy(f).orderBy("at", "id"))).where("n <= lack")
            chosen = checkpoint(chosen.unionByName(more.select(*chosen.columns)))
    return chosen


def _sample(c: Calibrated, seed: int) -> DataFrame:
    if not len(c.cells):
        return c.ids.limit(0)
    chances = c.ids.sparkSession.createDataFrame(c.cells[[*FIELDS, "p"]])
    units = c.masked().join(F.broadcast(chances), list(FIELDS)).select("id", *FIELDS, "p")
    return _floored(c, _drawn(units, int(c.cells["n"].sum()), seed), seed)


def sample(table: DataFrame, targets: DataFrame, seed: int = 3) -> DataFrame:
    """``id, lang, sensitivity, cell`` of the drawn ids, about a fifth of all distinct ids.

    Every id has a chance whatever its categories: one outside the targets is drawn only with what its other categories
    give it. Floors: a category has at least ``min_count`` ids in the sample, or all it has.
    """
    return _sample(calibrated(table, targets), seed)


def gaps(table: DataFrame, targets: DataFrame, seed: int = 3) -> DataFrame:
    """Each row of ``targets`` with ``ids, wanted, expected, drawn, gap, missed``: what the calibration expects, what was drawn, and
    drawn less wanted. ``missed`` says why a category is more than 2 % and 5 ids off: ``ids`` (it has too few), ``targets`` (the targets
    of the other fields exclude it) or ``draw``; null where it is met."""
    c = calibrated(table, targets)
    drawn = checkpoint(_sample(c, seed))
    per = {}
    for f in FIELDS:
        names = [r["category"] for r in c.rows if r["field_name"] == f]
        per |= {(f, r[f]): r["n"] for r in drawn.where(F.col(f).isin(names)).groupBy(f).agg(F.count("*").alias("n")).collect()}  # a row per target category
    out = []
    for r in c.rows:
        n = per.get((r["field_name"], r["category"]), 0)
        off = [abs(x - r["wanted"]) > max(5, 0.02 * r["wanted"]) for x in (n, r["expected"])]
        why = ("ids" if r["short"] else "targets" if off[1] else "draw") if off[0] else None
        out.append((r["field_name"], r["category"], r["target_share"], r["min_count"], r["ids"], r["wanted"], r["expected"], n, n - r["wanted"], why))
    return table.sparkSession.createDataFrame(out, "field_name string, category string, target_share double, min_count int, ids bigint, wanted double, expected double, drawn bigint, gap double, missed string")
