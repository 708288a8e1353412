"""Problem 7: mix sources to target weights by entropy balancing.

Each document starts from one base rate, the same for all documents of all sources: the size of the mixture over the tokens
there are. Of all rates between 0 and a source's largest repeat count whose tokens add up to ``weight * size`` in every source,
entropy balancing takes those closest to the base in relative entropy. They are exponentially tilted,
``min(max_repeat, base * exp(multiplier * tokens))``, with one multiplier per source, and the multipliers maximise a concave
dual. Newton steps with a line search find them. What a step needs (value, slope and curvature of the dual at several step
lengths) is one aggregate over ``source, tokens, number of documents``, so no document leaves its task. The cap is part of
the dual; a source whose dual has no maximum (``weight * size`` is more than all its texts ``max_repeat`` times) is out of reach
and gives every text ``max_repeat`` times.

Rates become copies by systematic rounding: along a source's documents in order of their tokens the rates are summed, and
each whole number passed is a copy. As neighbours have nearly the same size, the tokens of the copies stay near the tokens wanted.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.bpe import token_counts
from veilspark.session import checkpoint, spread

#: Newton steps after which the balance counts as not found, largest slope of the dual left (as a share of the tokens wanted), and
#: step lengths (halvings) that one pass tries.
STEPS, SLOPE, HALVINGS = 100, 1e-9, 8
#: Documents that one task of the rounding sums up, about.
BLOCK_DOCS = 1_000_000


@dataclass
class Source:
    """The balance of one source. ``multiplier`` is per token; ``slope`` is what is missing of the wanted tokens, as a share."""

    source: str
    weight: float
    max_repeat: int
    docs: int
    tokens: int
    total: int
    wanted: float
    short: bool
    base: float
    multiplier: float | None = None
    slope: float = 0.0
    solves: int = 0


def token_table(documents: DataFrame) -> DataFrame:
    """``doc_id, source, tokens`` of every non-null text, computed once and cut off from its lineage."""
    return checkpoint(token_counts(spread(documents.select("doc_id", "source", "text").where(F.col("text").isNotNull())), keep=("doc_id", "source")))


def _rows(weights: DataFrame) -> DataFrame:
    return weights.select("source", "weight", "max_repeat").na.drop().distinct()


def balance(counted: DataFrame, weights: DataFrame, size: int | None = None) -> list[Source]:
    """The balance of every row of ``weights`` (a bounded table: a row per source), from the token table.

    A source without documents has no tokens and is out of reach if its weight is positive; documents of a null or unlisted source
    don't count. Repeated rows of ``weights`` count once; rows with a null source, weight or max_repeat are left out. A balance that
    isn't found within STEPS raises.
    """
    spark = counted.sparkSession
    rows = _rows(weights)
    lengths = checkpoint(counted.join(F.broadcast(rows.select("source").distinct()), "source").groupBy("source", "tokens").agg(F.count("*").alias("n")))
    have = {r["source"]: (r["docs"], r["s"]) for r in lengths.groupBy("source").agg(F.sum("n").alias("docs"), F.sum(F.col("n") * F.col("tokens")).alias("s")).collect()}
    table = sorted((r["source"], float(r["weight"]), int(r["max_repeat"])) for r in rows.collect())
    total = sum(have.get(s, (0, 0))[1] for s, _, _ in table)
    whole = total if size is None else size
    base = whole / max(1, total)
    out = []
    for source, weight, most in table:
        docs, s = have.get(source, (0, 0))
        out.append(Source(source, weight, most, docs, s, total, weight * whole, weight * whole > most * s, base))
    # what is to be solved: reachable, not at the very end of its reach, and with something to give
    open_ = {k: x for k, x in enumerate(out) if x.tokens and 0 < x.wanted < x.max_repeat * x.tokens * (1 - 1e-12)}
    unit = {k: x.tokens / x.docs for k, x in open_.items()}  # multipliers are found per mean text, which keeps them near 1
    at, tried = dict.fromkeys(open_, 0.0), {k: [0.0] for k in open_}
    best: dict[int, tuple[float, float, float]] = {}
    step: dict[int, float] = {}
    for _ in range(STEPS):
        found = _moments(spark, lengths, {k: out[k] for k in open_}, unit, tried) if open_ else {}
        for k in list(open_):
            for n, m in enumerate(tried[k]):
                value, slope, bend = found[k, n]
                if k not in best or value >= best[k][0] + 1e-4 * (m - at[k]) * best[k][1] or n == len(tried[k]) - 1 and abs(slope) < abs(best[k][1]):
                    best[k], at[k] = (value, slope, bend), m
                    break
            else:
                step[k] /= 2**HALVINGS
                tried[k] = [at[k] + step[k] / 2**h for h in range(HALVINGS)]
                continue
            value, slope, bend = best[k]
            x = out[k]
            x.multiplier, x.slope = at[k] / unit[k], abs(slope) * unit[k] / x.wanted
            if x.slope <= SLOPE:
                del open_[k]
                continue
            step[k] = slope / bend if bend > 0 else math.copysign(1.0, slope)  # all at the cap: straight, one unit back
            x.solves += 1
            tried[k] = [at[k] + step[k] / 2**h for h in range(HALVINGS)]
        tried = {k: tried[k] for k in open_}
        if not open_:
            return out
    raise RuntimeError(f"entropy balancing did not converge for {[out[k].source for k in open_]}")


def _moments(spark, lengths: DataFrame, open_: dict[int, Source], unit: dict[int, float], tried: dict[int, list[float]]) -> dict[tuple[int, int], tuple[float, float, float]]:
    """Value, slope and curvature of each source's dual at the multipliers tried; one aggregate over the table of lengths."""
    spec = [(k, x.source, n, m, unit[k], x.wanted / unit[k], float(x.max_repeat), x.base) for k, x in open_.items() for n, m in enumerate(tried[k])]
    points = spark.createDataFrame(spec, "k int, source string, at int, m double, unit double, want double, cap double, base double")
    t = F.col("tokens") / F.col("unit")
    turn = F.log(F.col("cap") / F.col("base"))  # where a rate reaches the cap and the dual goes on straight
    u = F.col("m") * t
    rate = F.col("base") * F.exp(F.least(u, turn))
    term = F.when(u < turn, rate).otherwise(F.col("cap") * (1 + u - turn))
    sums = lengths.join(F.broadcast(points), "source").groupBy("k", "at").agg(
        F.sum(F.col("n") * term).alias("f"), F.sum(F.col("n") * t * rate).alias("g"), F.sum(F.when(u < turn, F.col("n") * t * t * rate).otherwise(0.0)).alias("h"), F.first("m").alias("m"), F.first("want").alias("want"),
    )
    return {(r["k"], r["at"]): (r["m"] * r["want"] - r["f"], r["want"] - r["g"], r["h"]) for r in sums.collect()}


def out_of_reach(documents: DataFrame, weights: DataFrame) -> DataFrame:
    """``source``: those whose constraint the balance can't meet within ``max_repeat`` copies of each text."""
    found = sorted({x.source for x in balance(token_table(documents), weights) if x.short})
    return documents.sparkSession.createDataFrame([(s,) for s in found], "source string")


def _mixed(counted: DataFrame, sources: list[Source], key: int) -> DataFrame:
    spark = counted.sparkSession
    spec = [(x.source, x.base, x.multiplier, float(x.max_repeat)) for x in sources if x.tokens and x.wanted > 0]
    at = spark.createDataFrame(spec, "source string, base double, multiplier double, cap double")
    rate = F.least(F.col("cap"), F.col("base") * F.exp(F.least(F.col("multiplier") * F.col("tokens"), F.lit(700.0))))
    rated = counted.where("tokens > 0").join(F.broadcast(at), "source").select(
        "doc_id", "source", "tokens", F.coalesce(rate, F.col("cap")).alias("rate"), F.ceil("cap").cast("double").alias("cap"), F.xxhash64(F.lit(key), "doc_id").alias("at"),
    )
    # running sums of a source's rates in order of size: by band of sizes, within it by blocks, each from where the ones before it end
    blocks = 1 + sum(x.docs for x in sources) // BLOCK_DOCS
    rated = rated.withColumn("band", F.floor(4 * F.log2("tokens")).cast("int")).withColumn("block", F.pmod("at", F.lit(blocks)).cast("int"))
    ends = rated.groupBy("source", "band", "block").agg(F.sum("rate").alias("sum"))
    ahead = Window.partitionBy("source").orderBy("band", "block").rowsBetween(Window.unboundedPreceding, -1)
    start = F.pmod(F.xxhash64(F.lit(key), "source"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    ends = ends.select("source", "band", "block", (F.coalesce(F.sum("sum").over(ahead), F.lit(0.0)) + start).alias("before"))
    order = Window.partitionBy("source", "band", "block").orderBy("tokens", "at", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("before") + F.sum("rate").over(order)
    copies = F.least(F.col("cap"), F.greatest(F.lit(0.0), F.floor(upto + 1e-9) - F.floor(upto - F.col("rate") + 1e-9))).cast("int")
    return rated.join(ends, ["source", "band", "block"]).withColumn("copies", copies).where("copies > 0").select("doc_id", "source", "tokens", "rate", "copies")


def mixture(documents: DataFrame, weights: DataFrame, tokens: int | None = None, key: int = 7) -> DataFrame:
    """``doc_id, source, tokens, rate, copies`` of every document with at least one copy.

    ``tokens`` is the size of the mixture, by default the total T of the sources. A source out of reach gives every text
    ``max_repeat`` times. No document has more than ``max_repeat`` copies. Empty and null texts have no tokens and no copies.
    """
    counted = token_table(documents)
    return _mixed(counted, balance(counted, weights, tokens), key)


def shares(documents: DataFrame, weights: DataFrame, tokens: int | None = None, key: int = 7) -> DataFrame:
    """Per row of ``weights``: weight, largest repeat count, tokens wanted and reached, share reached, the most copies of a text,
    the multiplier of the tilt per token (null where the source stands at its cap) and whether the source is out of reach."""
    counted = token_table(documents)
    sources = balance(counted, weights, tokens)
    got = _mixed(counted, sources, key).groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
    spec = [(x.source, x.weight, x.max_repeat, x.wanted, x.multiplier, x.short) for x in sources]
    rows = documents.sparkSession.createDataFrame(spec, "source string, weight double, max_repeat int, wanted double, multiplier double, short boolean")
    rows = rows.join(got, "source", "left").na.fill(0, ["tokens", "most_copies"])
    total = F.sum("tokens").over(Window.partitionBy(F.lit(1)))  # a row per source
    return rows.withColumn("total", total).select("source", "weight", "max_repeat", "wanted", "tokens", "most_copies", "multiplier", "short", (F.col("tokens") / F.greatest(F.lit(1), F.col("total"))).alias("share"))
