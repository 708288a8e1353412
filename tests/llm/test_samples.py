"""Problems 3 and 7, and the SQL of the registry."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from veilspark.llm import mixing, quota, registry

DIR = "/root/testdata/sf0.001"
TARGETS = "field_name string, category string, target_share double, min_count int, ids int"


def test_p3_counts_and_edges(spark):
    es = spark.createDataFrame([("a", " EN", "low", "x-y", 1), ("a", " EN", "low", "x-y", 2), ("b", "de", None, "X Y", 1), ("c", None, "?", "", 1), (None, "de", "low", "x_y", 1)] + [(f"k{k}", "de", "high", "z", 1) for k in range(7)], "id string, lang string, sensitivity string, cell string, p int")
    targets = spark.createDataFrame([("lang", "en", 0.5, 1, 1), ("lang", "de", 0.5, 9, 1), ("cell", "x_y", 1.0, 2, 1), ("cell", "none", 0.0, 1, 1), ("lang", "en", 0.5, 1, 2)], TARGETS)
    got = {(r.field_name, r.category): (r.ids, r.wanted, r.short) for r in quota.counts(es, targets).collect()}
    assert got == {("lang", "en"): (1, 1.0, False), ("lang", "de"): (8, 9.0, True), ("cell", "x_y"): (2, 2.0, False), ("cell", "none"): (0, 1.0, True)}
    none = es.limit(0)
    assert {tuple(r) for r in quota.out_of_reach(none, targets).collect()} == {("lang", "en"), ("lang", "de"), ("cell", "x_y"), ("cell", "none")} and quota.sample(none, targets).count() == 0


def test_p3_sample_follows_targets(spark):
    es = spark.createDataFrame([(f"i{k:05d}", "en" if k % 10 else "de", ("low", "high")[k % 3 == 0], ("a", "b", "c")[k % 3 if k % 7 else 0]) for k in range(5000)], "id string, lang string, sensitivity string, cell string")
    targets = spark.createDataFrame([("lang", "en", 0.6, 1, 1), ("lang", "de", 0.4, 1, 1), ("sensitivity", "low", 0.5, 1, 1), ("sensitivity", "high", 0.5, 1, 1)], TARGETS)
    s = quota.sample(es, targets).toPandas()
    assert s["id"].is_unique and abs(len(s) - 1000) <= 15
    assert abs((s["lang"] == "de").mean() - 0.4) < 0.03 and abs((s["sensitivity"] == "high").mean() - 0.5) < 0.03
    assert sorted(quota.sample(es.repartition(7), targets).toPandas()["id"]) == sorted(s["id"])


def test_pivotal_keeps_probabilities():
    import random

    hits = np.zeros(40)
    p = np.linspace(0.05, 0.9, 40)
    for seed in range(3000):
        taken, rest = quota._duels([str(k) for k in range(40)], p, random.Random(seed))
        assert abs(len(taken) + sum(x for _, x in rest) - p.sum()) < 1e-6
        for t in taken:
            hits[int(t)] += 1
        for t, x in rest:
            hits[int(t)] += x
    assert np.abs(hits / 3000 - p).max() < 0.04


def test_p3_infeasible_margins_still_converge():
    cells = pd.DataFrame([("en", "low", "a", 50), ("en", "", "", 5), ("", "high", "b", 3)], columns=["lang", "sensitivity", "cell", "n"])
    p, expected = quota.calibrate(cells, {("lang", "en"): 30.0, ("sensitivity", "high"): 20.0, ("cell", "a"): 1.0})
    assert ((0 <= p) & (p <= 1)).all() and expected["sensitivity", "high"] <= 3


def test_p3_feasible_margins_are_met():
    rng = np.random.default_rng(1)
    cells = pd.DataFrame([(lang, s, "", int(rng.integers(50, 2000))) for lang in "abcd" for s in "xyz"], columns=["lang", "sensitivity", "cell", "n"])
    total = cells["n"].sum() / 5
    wanted = {**{("lang", k): w * total for k, w in zip("abcd", (0.4, 0.3, 0.2, 0.1), strict=True)}, **{("sensitivity", k): w * total for k, w in zip("xyz", (0.5, 0.3, 0.2), strict=True)}}
    p, expected = quota.calibrate(cells, wanted)
    assert all(abs(expected[k] / w - 1) < 0.01 for k, w in wanted.items()) and p.min() > 0 and p.max() < 1


def test_p3_floors_and_gaps(spark, monkeypatch):
    monkeypatch.setattr(quota, "BLOCK_IDS", 500)  # three rounds of duels
    es = spark.createDataFrame([(f"i{k:05d}", "rare" if k < 12 else "en", "low" if k % 2 else None, "few" if 100 <= k < 104 else "c") for k in range(3000)], "id string, lang string, sensitivity string, cell string")
    targets = spark.createDataFrame([("lang", "rare", 0.001, 10, 1), ("lang", "en", 0.999, 1, 1), ("sensitivity", "low", 0.5, 1, 1), ("sensitivity", "high", 0.5, 1, 1), ("cell", "few", 0.0, 9, 1), ("cell", "c", 1.0, 1, 1)], TARGETS)
    got = quota.sample(es, targets).toPandas()
    assert got["id"].is_unique and (got["lang"] == "rare").sum() >= 10 and (got["cell"] == "few").sum() == 4
    rows = {(r.field_name, r.category): r for r in quota.gaps(es, targets).collect()}
    assert rows["sensitivity", "high"].missed == "ids" and rows["cell", "few"].gap == -5 and rows["lang", "rare"].missed is None
    assert all(r.drawn == (got[r.field_name] == r.category).sum() for r in rows.values())


def test_p7_shares(spark):
    words = ["one two three", "alpha beta", "lorem ipsum dolor sit amet consectetur", "x"]
    docs = spark.createDataFrame([(k, words[k % 4] * (1 + k % 5), ("big", "small", "tiny", None)[min(3, k % 40 // 12)], 1) for k in range(4000)] + [(9001, None, "big", 1), (9002, "", "tiny", 1)], "doc_id bigint, text string, source string, tokens int")
    weights = spark.createDataFrame([("big", 0.3, 2), ("small", 0.3, 3), ("tiny", 0.4, 1), ("absent", 0.1, 2), (None, 0.1, 1)], "source string, weight double, max_repeat int")
    rows = {r.source: r for r in mixing.shares(docs, weights, 30000).collect()}
    size = {s: rows[s].tokens for s in rows}
    assert abs(size["big"] - 9000) < 200 and abs(size["small"] - 9000) < 200 and size["absent"] == 0
    mix = mixing.mixture(docs, weights, 30000).toPandas()
    assert mix["doc_id"].is_unique and (mix.groupby("source")["copies"].max() <= pd.Series({"big": 2, "small": 3, "tiny": 1})).all() and not mix["doc_id"].isin([9001, 9002]).any()
    assert {r.source for r in mixing.out_of_reach(docs, weights).collect()} >= {"absent"}
    assert mixing.mixture(docs.limit(0), weights).count() == 0 and mixing.out_of_reach(docs.limit(0), weights).count() == 0


def test_p7_tilts_meet_the_tokens(spark):
    docs = spark.createDataFrame([(k, "one two three " * (1 + k % 9), ("a", "b", "c")[k % 3]) for k in range(900)], "doc_id bigint, text string, source string")
    weights = spark.createDataFrame([("a", 0.2, 4), ("b", 0.7, 4), ("c", 0.1, 1)], "source string, weight double, max_repeat int")
    counted = mixing.token_table(docs)
    found = {x.source: x for x in mixing.balance(counted, weights)}
    assert all(x.solves >= 1 and x.slope < 1e-6 and x.multiplier for x in found.values())
    per = counted.toPandas()
    for source, x in found.items():  # the optimality conditions, from the definition
        t = per[per["source"] == source]["tokens"].to_numpy(float)
        rate = np.minimum(x.max_repeat, x.base * np.exp(x.multiplier * t))
        assert abs((rate * t).sum() - x.wanted) < 1e-6 * x.wanted
    mix = mixing.mixture(docs, weights).toPandas()
    assert (mix.groupby("source")["rate"].nunique() > 1).all()
    got = {r.source: r.tokens for r in mixing.shares(docs, weights).collect()}
    assert all(abs(got[s] - x.wanted) < max(0.005 * x.wanted, per["tokens"].max()) for s, x in found.items())


def test_p7_cap_inside_the_dual(spark):
    docs = spark.createDataFrame([(k, "word " * (1 + k % 50), "ab"[k % 2]) for k in range(400)], "doc_id bigint, text string, source string")
    weights = spark.createDataFrame([("a", 0.95, 2), ("b", 0.05, 2)], "source string, weight double, max_repeat int")
    found = {x.source: x for x in mixing.balance(mixing.token_table(docs), weights)}
    assert found["a"].slope < 1e-6 and not found["a"].short and found["b"].multiplier < 0 < found["a"].multiplier
    assert mixing.mixture(docs, weights).toPandas()["copies"].max() <= 2


@pytest.mark.parametrize("name", registry.queries())
def test_query(spark, name):
    df = registry.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    rows = sorted(tuple(str(r[c]) for c in cols) for r in df.collect())
    if name in registry.oracle_sql():
        duck = duckdb.connect()
        for f in os.listdir(DIR):
            duck.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{DIR}/{f}')")
        found = duck.execute(registry.oracle_sql()[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == cols and sorted(tuple(str(r[names.index(c)]) for c in cols) for r in found.fetchall()) == rows
    if name.endswith("_found"):
        assert len(set(rows)) == len(rows)
