"""Scoring of predicted against labelled findings as joins and aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.schema import RANK

# Honorifics left out when names are compared.
HONORIFICS = "さん くん ちゃん 様 氏 君 殿 先生 部長 課長 社長 医師 女士 小姐 经理 老师 医生 教授 博士 主席 씨 님 선생님 교수 박사 Mr. Ms. Mrs. Dr. Prof. Mr Ms Mrs Dr M. Mme Mlle Herr Frau Sig. Sig.ra Dott. Dott.ssa Sr. Sra. Srta. Don Doña".split()
RECALL = 0.98


def _quoted(word: str) -> str:
    return "\\Q" + word + "\\E"


#: Honorifics at the end of a name that has more, or at its start before a space, as often as they come.
_LONGEST = sorted(HONORIFICS, key=len, reverse=True)
#: Tried on the reversed name, where the end is the start: one place to look at instead of all.
TAIL = "^(?:(?:" + "|".join(_quoted(h[::-1]) for h in _LONGEST) + r")\s*)+(?=\S)"
HEAD = "^(?:(?:" + "|".join(map(_quoted, _LONGEST)) + r") \s*)+(?=\S)"


def normal(value: Column, ftype: Column) -> Column:
    """Value for comparison. All honorifics at either end of a name are stripped, as long as something is left."""
    name = F.trim(F.regexp_replace(F.trim(F.reverse(F.regexp_replace(F.reverse(F.trim(value)), TAIL, ""))), HEAD, ""))
    return (
        F.when(ftype.isin("phone", "number"), F.regexp_replace(value, r"[\s\-().]", "")).when(ftype == "email", F.lower(value)).otherwise(F.regexp_replace(name, r"\s+", " "))
    )


def split_reversed(findings: DataFrame) -> DataFrame:
    """A name written "Surname, Given" as its two parts, so that it agrees with either way of labelling it."""
    parts = F.split("value", ", ")
    both = (F.col("type") == "person_name") & (F.size(parts) == 2) & (F.trim(parts[0]) != "") & (F.trim(parts[1]) != "")
    values = F.when(both, F.transform(parts, lambda p: F.trim(p))).otherwise(F.array("value"))
    return findings.select("*", F.posexplode(values).alias("part", "one")).drop("value").withColumnRenamed("one", "value")


def first_of_each(predicted: DataFrame, id_col: str = "id") -> DataFrame:
    """Predictions without repeats of type, value and pii in a document; the first by ``pos`` stays."""
    w = Window.partitionBy(id_col, "type", normal(F.col("value"), F.col("type")), "pii").orderBy("pos")
    return predicted.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def match(predicted: DataFrame, expected: DataFrame, id_col: str = "id") -> DataFrame:
    """``id, type, value, pii, predicted, expected, number_type, predicted_number_type``: one row per pair or leftover.

    Both inputs: ``id, pos, type, value, pii, number_type``. Equal means same type, pii and normalised value, which is an
    equivalence, so greedy one-to-one matching is pairing the k-th with the k-th: a full outer join.
    """

    def numbered(df: DataFrame, side: str) -> DataFrame:
        rows = split_reversed(df).withColumn("norm", normal(F.col("value"), F.col("type")))
        w = Window.partitionBy(id_col, "type", "pii", "norm").orderBy("pos", "part")
        return rows.select(id_col, "type", "pii", "norm", F.row_number().over(w).alias("k"), F.lit(True).alias(side), F.col("number_type").alias(f"{side}_number_type"))

    both = numbered(predicted, "predicted").join(numbered(expected, "expected"), [id_col, "type", "pii", "norm", "k"], "full_outer")
    return both.select(
        id_col, "type", "pii", F.col("norm").alias("value"), F.coalesce("predicted", F.lit(False)).alias("predicted"), F.coalesce("expected", F.lit(False)).alias("expected"),
        "predicted_number_type", "expected_number_type",
    )


def scored(rows: DataFrame, expected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that count, and ``name, n`` of those that don't: false predictions of a type, or a number type, that no label has."""
    types = expected.select("type").distinct()
    numbers = expected.where("type = 'number'").select(F.coalesce("number_type", F.lit("")).alias("nt")).distinct()
    alone = ~F.col("expected")
    key = F.coalesce("predicted_number_type", F.lit(""))
    # the values of the data; they are sent to all tasks only if their size, known by then, allows it
    marked = rows.join(types.withColumn("known", F.lit(True)), "type", "left").join(numbers.withColumn("known_number", F.lit(True)), key == F.col("nt"), "left")
    odd_number = alone & (F.col("type") == "number") & F.col("known_number").isNull()
    odd = odd_number | alone & F.col("known").isNull()
    name = F.when(odd_number, F.concat(F.lit("number:"), F.coalesce("predicted_number_type", F.lit("None")))).otherwise(F.col("type"))
    counts = marked.where(odd).groupBy(name.alias("name")).agg(F.count("*").alias("n"))
    return marked.where(~odd).drop("known", "known_number", "nt"), counts


def outcome() -> Column:
    return F.when(F.col("predicted") & F.col("expected"), "tp").when(F.col("expected"), "fn").otherwise("fp")


def prf(rows: DataFrame, *by: str) -> DataFrame:
    """``by..., tp, fp, fn, precision, recall, f1``, rounded to four places; a rate of nothing is 0."""
    n = rows.groupBy(*by).agg(*(F.count_if(outcome() == o).alias(o) for o in ("tp", "fp", "fn")))
    p = F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fp"))
    r = F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fn"))
    return n.withColumns({"precision": F.round(p, 4), "recall": F.round(r, 4), "f1": F.round(2 * p * r / F.greatest(F.lit(1e-9), p + r), 4)})


def confusion(levels: DataFrame) -> DataFrame:
    """``expected, predicted, n`` of ``expected_level, predicted_level``."""
    return levels.groupBy(F.col("expected_level").alias("expected"), F.col("predicted_level").alias("predicted")).agg(F.count("*").alias("n"))


def _rank(c: Column) -> Column:
    return F.coalesce(*(F.when(c == level, F.lit(r)) for level, r in RANK.items()))


def missed(levels: DataFrame, id_col: str = "id") -> DataFrame:
    """``id, expected_level, predicted_level, high_missed, personal_missed, under_estimated`` of documents judged too low."""
    e, p = F.col("expected_level"), F.col("predicted_level")
    flags = {"high_missed": (e == "high") & (p != "high"), "personal_missed": (e != "none") & (p == "none"), "under_estimated": _rank(p) < _rank(e)}
    return levels.select(id_col, "expected_level", "predicted_level").withColumns(flags).where("high_missed OR personal_missed OR under_estimated")


def acceptance(rows: DataFrame, levels: DataFrame) -> DataFrame:
    """One row: ``documents, sensitivity_accuracy, person_recall_ok, high_missed_ok, personal_missed_ok, pass``."""
    names = rows.where("type = 'person_name'").agg(F.count_if(outcome() == "tp").alias("tp"), F.count_if(outcome() == "fn").alias("fn"))
    e, p = F.col("expected_level"), F.col("predicted_level")
    docs = levels.agg(F.count("*").alias("documents"), F.count_if(e == p).alias("right"), F.count_if((e == "high") & (p != "high")).alias("high"), F.count_if((e != "none") & (p == "none")).alias("personal"))
    zero = {c: F.lit(0) for c in ("tp", "fn", "documents", "right", "high", "personal")}
    both = names.select("tp", "fn", *(zero[c].alias(c) for c in ("documents", "right", "high", "personal"))).unionByName(docs.withColumns({"tp": zero["tp"], "fn": zero["fn"]}))
    one = both.agg(*(F.sum(c).alias(c) for c in zero))
    recall = F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fn")) >= RECALL
    return one.select(
        "documents", F.round(F.col("right") / F.greatest(F.lit(1), F.col("documents")), 4).alias("sensitivity_accuracy"), recall.alias("person_recall_ok"),
        (F.col("high") == 0).alias("high_missed_ok"), (F.col("personal") == 0).alias("personal_missed_ok"), (recall & (F.col("high") == 0) & (F.col("personal") == 0)).alias("pass"),
    )


def token_scores(tokens: DataFrame) -> DataFrame:
    """One row of token tp, fp, fn, f1 from ``predicted, expected`` tag numbers; tokens with a negative label are ignored."""
    e, p = F.col("expected"), F.col("predicted")
    n = tokens.where(e >= 0).agg(F.count_if((p == e) & (e != 0)).alias("tp"), F.count_if((p != e) & (p != 0)).alias("fp"), F.count_if((p != e) & (e != 0)).alias("fn"))
    return n.withColumn("f1", 2 * F.col("tp") / F.greatest(F.lit(1), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def selection_key(dev_based: bool = True) -> Column:
    """Score of a checkpoint, null where it may not be chosen: with a development corpus only the last 40 % of the steps count,
    and each high document and each personal one judged too low weighs against it."""
    score = F.col("token_f1") + F.col("sensitivity_acc") + F.col("category_acc")
    if not dev_based:
        return score
    return F.when(F.col("step") >= 0.6 * F.col("total"), score - 0.02 * F.col("dev_high_missed") - 0.01 * F.col("dev_personal_missed"))


def best_checkpoint(runs: DataFrame, dev_based: bool = True) -> DataFrame:
    """The run with the greatest key; ties go to the earlier step."""
    return runs.withColumn("score", selection_key(dev_based)).where("score IS NOT NULL").orderBy(F.desc("score"), "step").limit(1)


def summary(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
