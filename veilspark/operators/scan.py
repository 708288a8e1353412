"""Rule scan, reports and masked reports of a table of documents. Everything is per document: no exchange."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions import judge as J
from veilspark.functions import spans as S
from veilspark.functions.expressions import mask
from veilspark.functions.rules import compiled, scan_text
from veilspark.schema import BIO, FINDING, LEVELS, MATCH, RANK, SECRET


def may_match(text: Column | str) -> Column:
    """JVM-side test that every text with a match passes: a literal of some rule, or the characters of the others.

    Rules without a literal need digits, an at sign, or a word about passwords, so texts without any of these never reach Python.
    """
    words = sorted({w for one in compiled() for w in one.literals if len(w) > 2})
    few = sorted({w for one in compiled() for w in one.literals if len(w) <= 2})
    quoted = "|".join("\\Q" + w + "\\E" for w in [*words, *few])
    column = F.col(text) if isinstance(text, str) else text
    return column.rlike(f"(?iu){quoted}|\\p{{Nd}}|@|%40|::|pass|pwd|パスワード|密码|비밀번호|kennwort|contrase|mot de passe")


def matches(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id, rule, description, category, start, end, value, rule_ord, match_ord`` and the columns ``keep``: one row per match.

    Null and empty texts have none. Positions are 0-based code points, end exclusive. Texts that fail :func:`may_match` never
    leave the JVM.
    """
    kept = F.struct(F.col(id_col).alias("id"), *(F.col(c).alias(f"k{n}") for n, c in enumerate(keep)))
    rows = df.select(kept.alias("kept"), F.col(text_col).alias("text")).where(F.col("text").isNotNull() & may_match("text"))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            found = [scan_text(t) for t in b.column("text").to_pylist()]
            at = [k for k, m in enumerate(found) for _ in m]
            flat = [m for per in found for m in per]
            cols = [b.column(0).take(pa.array(at, pa.int64()))]
            cols += [pa.array([getattr(m, n) for m in flat], pa.string()) for n in ("rule", "description", "category")]
            cols += [pa.array([m.start for m in flat], pa.int32()), pa.array([m.end for m in flat], pa.int32()), pa.array([m.value for m in flat], pa.string())]
            cols += [pa.array([m.rule_ord for m in flat], pa.int32()), pa.array([m.match_ord for m in flat], pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, ["kept", "rule", "description", "category", "start", "end", "value", "rule_ord", "match_ord"])

    kind = rows.schema["kept"].dataType.simpleString()
    found = rows.mapInArrow(run, f"kept {kind}, rule string, description string, category string, start int, end int, value string, rule_ord int, match_ord int")
    return found.select(F.col("kept.id").alias(id_col), "rule", "description", "category", "start", "end", "value", "rule_ord", "match_ord", *(F.col(f"kept.k{n}").alias(c) for n, c in enumerate(keep)))


REPORT_SCHEMA = f"sensitivity struct<level:string,probabilities:map<string,double>>, categories map<string,double>, findings array<{FINDING}>, secrets array<{SECRET}>, windows int"


def analyse(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tagger: str | None = None, use_rules: bool = True, show_values: bool = True, places: frozenset[str] = frozenset()
) -> DataFrame:
    """``id, sensitivity, categories, findings, secrets, windows`` of each document.

    ``tagger`` names an optional column ``struct<spans:array<struct<start,end,kind>>, level:string, probabilities:map<string,double>,
    categories:map<string,double>, windows:int>``, the outcome of :func:`veilspark.operators.tokens.resolve` over a model's
    windows. Without it there are no spans, the level starts at none and probabilities are 0. A null text is an empty one.
    With ``show_values`` off, values are masked and secrets lose value and positions but keep their line.
    """
    columns = [F.col(id_col).alias(id_col), F.col(text_col).alias("text"), *([F.to_json(F.col(tagger)).alias("tags")] if tagger else [])]
    rows = df.select(*columns)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        for f in frames:
            out = []
            tags = f["tags"] if "tags" in f else [None] * len(f)
            for text, tag in zip(f["text"], tags, strict=True):
                t = json.loads(tag) if isinstance(tag, str) else {}
                found = [(s["start"], s["end"], s["kind"]) for s in t.get("spans") or ()]
                r = J.judge(text if isinstance(text, str) else "", found, t.get("level") or "none", t.get("categories"), use_rules, places)
                chances = t.get("probabilities") or dict.fromkeys(LEVELS, 0.0)
                out.append(({"level": r["level"], "probabilities": chances}, r["categories"], r["findings"], r["secrets"], int(t.get("windows") or 1)))
            names = ["sensitivity", "categories", "findings", "secrets", "windows"]
            yield pd.DataFrame({id_col: f[id_col], **{n: pd.Series([o[k] for o in out], index=f.index, dtype=object if k < 4 else "int32") for k, n in enumerate(names)}})

    kind = rows.schema[id_col].dataType.simpleString()
    report = rows.mapInPandas(run, f"`{id_col}` {kind}, {REPORT_SCHEMA}")
    return report if show_values else masked(report)


def masked(report: DataFrame) -> DataFrame:
    """A report with masked values; of a secret only its rule and line stay."""
    hide = F.transform("findings", lambda f: f.withField("value", mask(f["value"], f["type"])))
    drop = F.transform("secrets", lambda s: s.withField("value", F.lit("…")).withField("start", F.lit(None).cast("int")).withField("end", F.lit(None).cast("int")))
    return report.withColumn("findings", hide).withColumn("secrets", drop)


def rank(level: Column) -> Column:
    return F.coalesce(*(F.when(level == name, F.lit(r)) for name, r in RANK.items()))


def worst(report: DataFrame) -> DataFrame:
    """``level``: the highest level of all documents; none for an empty table."""
    top = F.coalesce(F.max(rank(F.col("sensitivity.level"))), F.lit(0))
    return report.agg(top.alias("r")).select(F.element_at(F.array(*map(F.lit, LEVELS)), F.col("r") + 1).alias("level"))


def fails(report: DataFrame, level: str) -> bool:
    """Whether some document reaches ``level``: the answer for an exit status."""
    return report.where(rank(F.col("sensitivity.level")) >= RANK[level]).limit(1).count() > 0


def without_secrets(findings: DataFrame, secrets: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Findings that overlap no secret of their document: a left anti join on id with a range condition."""
    f, s = findings.alias("f"), secrets.select(id_col, "start", "end").alias("s")
    return f.join(s, (F.col(f"f.{id_col}") == F.col(f"s.{id_col}")) & (F.col("f.start") < F.col("s.end")) & (F.col("s.start") < F.col("f.end")), "left_anti")


__all__ = ["BIO", "MATCH", "S", "analyse", "fails", "masked", "matches", "may_match", "rank", "without_secrets", "worst"]
