"""Named queries over the test tables, one or more per operator, with SQL of the same meaning where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions import expressions as X
from veilspark.functions.catalogue import RULES
from veilspark.operators import coverage as C
from veilspark.operators import evaluate as E
from veilspark.operators import generate as G
from veilspark.operators import scan, testset, tokens
from veilspark.plans import cases
from veilspark.schema import RANK
from veilspark.session import read_table, spread

Query = Callable[[SparkSession, str], DataFrame]

#: A card as four groups of four digits or one run of sixteen, as native operators look for it.
CARD = r"[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}"
US_PHONE = r"[0-9]{3}[-. )]{1,2}[0-9]{3}[-. ][0-9]{4}"
EDGES = [("short", 0, 200), ("medium", 200, 1000), ("long", 1000, 2000), ("very_long", 2000, 6000)]


def _docs(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "documents", "doc_id", "text", "lang", "format", "source")


def _holdout(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "holdout", "id", "lang", "format", "text", "expected", "split", "source").where("id IS NOT NULL").dropDuplicates(["id"])


def gold(s: SparkSession, d: str) -> DataFrame:
    flat = _holdout(s, d).select("id", F.posexplode("expected.findings").alias("pos", "f"))
    return flat.where("f.value IS NOT NULL").select("id", "pos", F.col("f.type").alias("type"), F.col("f.value").alias("value"), F.col("f.pii").alias("pii"), F.col("f.number_type").alias("number_type"))


def predicted(s: SparkSession, d: str) -> DataFrame:
    r = read_table(s, d, "report_findings", "finding_id", "id", "finding_type", "finding_value", "pii", "number_type").where("id IS NOT NULL AND finding_value IS NOT NULL").dropDuplicates(["finding_id"])
    return E.first_of_each(r.select("id", F.col("finding_id").alias("pos"), F.col("finding_type").alias("type"), F.col("finding_value").alias("value"), "pii", "number_type"))


def _matched(s: SparkSession, d: str) -> DataFrame:
    return E.match(predicted(s, d), gold(s, d))


def _levels(s: SparkSession, d: str) -> DataFrame:
    """The labelled level of each record against the level its reported findings alone would give."""
    high = F.max(F.when(F.col("pii") & (F.col("finding_type") == "number"), 2).when(F.col("pii"), 1).otherwise(0))
    per = read_table(s, d, "report_findings", "finding_id", "id", "finding_type", "pii").dropDuplicates(["finding_id"]).groupBy("id").agg(high.alias("r"))
    levels = F.element_at(F.array(*map(F.lit, RANK)), F.coalesce("r", F.lit(0)) + 1)
    return _holdout(s, d).where("expected.sensitivity IS NOT NULL").join(per, "id", "left").select("id", F.col("expected.sensitivity").alias("expected_level"), levels.alias("predicted_level"))


def _tagged(s: SparkSession, d: str) -> DataFrame:
    """Tokens of overlapping windows of all documents. What a tagger says of a token follows from its place and its window, so two
    windows that share a token mostly say different things of it."""
    w = tokens.windows(tokens.tokens(_docs(s, d)), 66, 16).select("doc_id", "window_no", F.size("tokens").alias("n"), F.posexplode("tokens").alias("pos", "t"))
    k = (F.col("t.start") + 31 * F.col("window_no")) % 7
    tag = F.element_at(F.array(*map(F.lit, ("O", "B-PERSON", "B-PERSON", "I-PERSON", "I-PERSON", "B-EMAIL", "I-EMAIL"))), k + 1)
    return w.select("doc_id", "window_no", "pos", "n", F.col("t.start").alias("start"), F.col("t.end").alias("end"), tag.alias("tag"))


def _compare(s: SparkSession, d: str) -> DataFrame:
    h = _holdout(s, d)
    first = h.select("id", F.col("expected.sensitivity").alias("sensitivity"), F.col("expected.findings").alias("findings"))
    second = predicted(s, d).groupBy("id").agg(F.collect_list(F.struct("type", "value", "pii", "number_type")).alias("findings")).join(_levels(s, d).select("id", F.col("predicted_level").alias("sensitivity")), "id", "left").select("id", "sensitivity", "findings")
    return testset.compare(first, second)


def _selected(s: SparkSession, d: str) -> DataFrame:
    es = read_table(s, d, "es_1", "id", "lang", "text", "sensitivity").where("id IS NOT NULL AND text IS NOT NULL").dropDuplicates(["id"])
    es = es.withColumn("sensitivity", F.lower(F.trim("sensitivity"))).withColumn("lang", F.lower(F.trim("lang"))).where(F.col("sensitivity").isin(*RANK))
    cov = {"sensitivity": {"none": 0.2, "low": 0.4, "high": 0.4}, "length": {n: [a, b, w] for (n, a, b), w in zip(EDGES, (0.35, 0.35, 0.2, 0.1), strict=True)}}
    return C.select(es, es.count() // 5, cov)[0]


def _off_target(s: SparkSession, d: str) -> DataFrame:
    es = read_table(s, d, "es_1", "id", "lang", "sensitivity", "cell").where("id IS NOT NULL")
    targets = read_table(s, d, "coverage_targets")
    parts = []
    for field in ("lang", "sensitivity", "cell"):
        read = F.lower(F.trim(field))
        per = es.groupBy("id").agg(F.min(F.regexp_replace(read, "[ -]", "_") if field == "cell" else read).alias(field))
        wanted = targets.where(F.col("field_name") == field).select(F.col("category").alias("value"), F.col("target_share").alias("target"))
        parts.append(C.off_target(C.measured(per, field).where("value IS NOT NULL"), wanted).withColumn("field", F.lit(field)))
    return reduce(DataFrame.unionByName, parts)


def _with_case(s: SparkSession, d: str, behind: bool) -> DataFrame:
    """Every document with its planted case: behind its own text, or alone."""
    texts = [t for rule, before, value, after, miss in cases.RULE_CASES for t in (before + value + after, miss)]
    docs = read_table(s, d, "documents", "doc_id", "text").where("doc_id IS NOT NULL")
    case = F.element_at(F.array(*map(F.lit, texts)), (F.col("doc_id") % len(texts)).cast("int") + 1)
    own = F.concat(F.coalesce("text", F.lit("")), F.lit(cases.PAD)) if behind else F.lit("")
    return docs.select("doc_id", F.concat(own, case).alias("text"), F.length(own).alias("own"), (F.col("doc_id") % len(texts)).cast("int").alias("k"))


def _planted(s: SparkSession, d: str) -> DataFrame:
    rules = [name for name, *_ in cases.RULE_CASES for _ in (0, 1)]
    docs = _with_case(s, d, True)
    found = scan.matches(spread(docs), keep=("own", "k")).where(F.col("start") >= F.col("own"))
    return found.where(F.col("rule") == F.element_at(F.array(*map(F.lit, rules)), F.col("k") + 1)).select("doc_id", "rule", (F.col("start") - F.col("own")).alias("start"), (F.col("end") - F.col("own")).alias("end"))


def _verdicts(s: SparkSession, d: str) -> DataFrame:
    rows = [(2 * k + j, name, value) for k, (name, *both) in enumerate(cases.VALIDATOR_CASES) for j, value in enumerate(both)]
    table = F.broadcast(s.createDataFrame(rows, "k int, validator string, value string"))  # two rows a validator
    docs = read_table(s, d, "documents", "doc_id").where("doc_id IS NOT NULL").withColumn("k", (F.col("doc_id") % len(rows)).cast("int"))
    return X.validated(docs.join(table, "k"), "validator", "value").select("doc_id", "validator", "ok")


def _planted_reports(s: SparkSession, d: str) -> DataFrame:
    report = scan.analyse(spread(_with_case(s, d, False).where("k % 2 = 0")))
    first = F.get("findings", F.lit(0))
    return report.select("doc_id", F.col("sensitivity.level").alias("level"), first["type"].alias("type"), first["pii"].alias("pii"), first["number_type"].alias("number_type"), (F.size("secrets") > 0).alias("has_secret"))


def queries() -> dict[str, Query]:
    return {
        "rule_planted": _planted,
        "validator_planted": _verdicts,
        "report_planted": _planted_reports,
        "rule_matches": lambda s, d: scan.matches(spread(_docs(s, d))).drop("description"),
        "rule_card_matches": lambda s, d: scan.matches(spread(_docs(s, d))).where("rule = 'pii-credit-card'").select("doc_id", "value"),
        "rule_us_phone_matches": lambda s, d: scan.matches(spread(_docs(s, d))).where("rule = 'pii-phone-us'").select("doc_id", "value"),
        "rule_hits_by_rule_lang": lambda s, d: scan.matches(spread(_docs(s, d)), keep=("lang",)).groupBy("rule", "category", "lang").agg(F.count("*").alias("n")),
        "rule_hits_holdout": lambda s, d: scan.matches(spread(_holdout(s, d)), "id").groupBy("rule").agg(F.count("*").alias("n"), F.countDistinct("id").alias("docs")),
        "report_rules_only": lambda s, d: scan.analyse(spread(_docs(s, d))).select("doc_id", F.col("sensitivity.level").alias("level"), F.size("findings").alias("findings"), F.size("secrets").alias("secrets")),
        "report_masked": lambda s, d: scan.analyse(spread(_holdout(s, d)), "id", show_values=False).select("id", F.explode("findings").alias("f")).select("id", "f.type", "f.value", "f.start", "f.pii"),
        "worst_level": lambda s, d: scan.worst(scan.analyse(spread(_docs(s, d)))),
        "secret_overlap_anti": lambda s, d: scan.without_secrets(
            read_table(s, d, "report_findings", "finding_id", "id", "start_pos", "end_pos").dropDuplicates(["finding_id"]).select("finding_id", F.col("id").alias("doc_id"), F.col("start_pos").alias("start"), F.col("end_pos").alias("end")),
            read_table(s, d, "report_findings", "id", "start_pos", "end_pos", "finding_type").where("finding_type = 'email'").select(F.col("id").alias("doc_id"), F.col("start_pos").alias("start"), F.col("end_pos").alias("end")),
        ).select("finding_id"),
        "card_matches": lambda s, d: _docs(s, d).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(CARD), F.lit(0))).alias("value")).where(X.real_card("value")),
        "us_phone_matches": lambda s, d: _docs(s, d).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(US_PHONE), F.lit(0))).alias("value")).where(X.us_phone("value")),
        "card_offsets": lambda s, d: _docs(s, d).where("text IS NOT NULL").select("doc_id", F.explode(X.offsets("text", CARD)).alias("m")).select("doc_id", "m.start", "m.end", "m.value"),
        "entropy_of_values": lambda s, d: read_table(s, d, "report_findings", "finding_id", "finding_value").distinct().where("finding_value IS NOT NULL").select("finding_id", F.round(X.entropy("finding_value"), 6).alias("bits")),
        "mask_values": lambda s, d: read_table(s, d, "report_findings", "finding_id", "finding_type", "finding_value").distinct().where("finding_value IS NOT NULL").select("finding_id", X.mask("finding_value", "finding_type").alias("masked")),
        "line_numbers": lambda s, d: read_table(s, d, "report_findings", "finding_id", "id", "start_pos").distinct().join(_holdout(s, d).where("text IS NOT NULL").select("id", "text"), "id").select("finding_id", X.line_number("text", "start_pos").cast("int").alias("line")),
        "length_bucket_hist": lambda s, d: _docs(s, d).where("text IS NOT NULL").groupBy("lang", C.bucket(F.coalesce("lang", F.lit("")), F.length("text"), {"length": {n: [a, b] for n, a, b in EDGES}}).alias("bucket")).agg(F.count("*").alias("n")),
        "coverage_formats": lambda s, d: C.measured(_docs(s, d), "format"),
        "coverage_finding_rates": lambda s, d: C.rates(_holdout(s, d), F.array_distinct(F.transform("expected.findings", lambda f: f["type"]))),
        "coverage_off_target": _off_target,
        "apportion_counts": lambda s, d: C.apportion(read_table(s, d, "mix_weights").select(F.col("source").alias("key"), F.col("weight").alias("share"), F.col("source").alias("ord")), 1003).select("key", "n"),
        "stratified_select": _selected,
        "token_windows": lambda s, d: tokens.windows(tokens.tokens(_docs(s, d).where("text IS NOT NULL")), 66, 16).select("doc_id", "window_no", F.size("tokens").alias("n_tokens")),
        "overlap_resolve": lambda s, d: tokens.resolve_overlaps(_tagged(s, d)),
        "bio_islands": lambda s, d: tokens.islands(tokens.resolve_overlaps(_tagged(s, d))),
        "match_prf": lambda s, d: E.prf(E.scored(_matched(s, d), gold(s, d))[0], "type"),
        "match_personal_prf": lambda s, d: E.prf(E.scored(_matched(s, d), gold(s, d))[0].where("pii"), "type"),
        "match_person_by_lang": lambda s, d: E.prf(_matched(s, d).where("type = 'person_name'").join(_holdout(s, d).select("id", "lang"), "id"), "lang"),
        "match_unscored": lambda s, d: E.scored(_matched(s, d), gold(s, d))[1],
        "confusion_matrix": lambda s, d: E.confusion(_levels(s, d)),
        "judged_too_low": lambda s, d: E.missed(_levels(s, d)),
        "acceptance": lambda s, d: E.acceptance(E.scored(_matched(s, d), gold(s, d))[0], _levels(s, d)),
        "near_duplicates": lambda s, d: testset.near_duplicates(_docs(s, d).select(F.col("doc_id").alias("id"), "lang", "text")),
        "repeated_sentences": lambda s, d: testset.repeated_sentences(_holdout(s, d).where("text IS NOT NULL")),
        "script_problems": lambda s, d: testset.script_problems(_holdout(s, d).where("text IS NOT NULL").withColumn("lang", F.lower(F.trim("lang")))),
        "script_problems_mislabelled": lambda s, d: testset.script_problems(_docs(s, d).where("text IS NOT NULL").select(F.col("doc_id").alias("id"), F.element_at(F.array(F.lit("ko"), F.lit("ja"), F.lit("zh")), (F.col("doc_id") % 3).cast("int") + 1).alias("lang"), F.concat("text", F.when(F.col("doc_id") % 5 == 0, F.lit("\\n")).otherwise("")).alias("text"))),
        "values_not_in_text": lambda s, d: testset.values_not_in_text(_holdout(s, d).where("text IS NOT NULL")),
        "labels_compare": _compare,
        "labels_agreement": lambda s, d: testset.agreement(_compare(s, d)),
        "split_findings": lambda s, d: _holdout(s, d).select("id", "split", F.explode(testset.split_findings(F.col("expected.findings"))).alias("f")).groupBy("split", "f.type").agg(F.count("*").alias("n"), F.count_if("f.pii").alias("personal")),
        "generated_labels": lambda s, d: G.documents(s, 400, seed=1).select("id", "lang", "format", "sensitivity", F.size("spans").alias("spans"), F.length("text").alias("chars")),
    }


_HOLD = "hold AS (SELECT id, any_value(lang) AS lang, any_value(text) AS text, any_value(expected) AS expected, any_value(split) AS split FROM holdout WHERE id IS NOT NULL GROUP BY id)"
_FINDS = "finds AS (SELECT DISTINCT finding_id, id, finding_type, finding_value, start_pos, end_pos, pii, number_type FROM report_findings)"
_DIGITS = "regexp_replace(value, '[^0-9]', '', 'g')"


def _norm(v: str, t: str) -> str:
    tail = "|".join(sorted((w.replace(".", "\\.") for w in E.HONORIFICS), key=len, reverse=True))
    name = f"trim(regexp_replace(trim(regexp_replace(trim({v}), '(\\S)\\s*(?:(?:{tail})\\s*)+$', '\\1')), '^(?:(?:{tail}) \\s*)+(\\S)', '\\1'))"
    return f"CASE WHEN {t} IN ('phone', 'number') THEN regexp_replace({v}, '[\\s\\-().]', '', 'g') WHEN {t} = 'email' THEN lower({v}) ELSE regexp_replace({name}, '\\s+', ' ', 'g') END"


def _split(cte: str) -> str:
    return f"""SELECT id, pos, type, pii, number_type, unnest(CASE WHEN type = 'person_name' AND len(string_split(value, ', ')) = 2 AND trim(string_split(value, ', ')[1]) <> '' AND trim(string_split(value, ', ')[2]) <> ''
      THEN list_transform(string_split(value, ', '), lambda x: trim(x)) ELSE [value] END) AS value, unnest(CASE WHEN type = 'person_name' AND len(string_split(value, ', ')) = 2 AND trim(string_split(value, ', ')[1]) <> '' AND trim(string_split(value, ', ')[2]) <> '' THEN [0, 1] ELSE [0] END) AS part FROM {cte}"""


_MATCH = f"""
{_HOLD}, {_FINDS},
gold AS (SELECT id, pos, f.type AS type, f.value AS value, f.pii AS pii, f.number_type AS number_type FROM (SELECT id, unnest(range(len(expected.findings))) AS pos, unnest(expected.findings) AS f FROM hold) WHERE f.value IS NOT NULL),
pred0 AS (SELECT id, finding_id AS pos, finding_type AS type, finding_value AS value, pii, number_type FROM finds WHERE id IS NOT NULL AND finding_value IS NOT NULL),
pred AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY id, type, {_norm("value", "type")}, pii ORDER BY pos) AS k FROM pred0) WHERE k = 1),
g1 AS (SELECT *, {_norm("value", "type")} AS norm FROM ({_split("gold")})),
p1 AS (SELECT *, {_norm("value", "type")} AS norm FROM ({_split("pred")})),
g2 AS (SELECT id, type, pii, norm, number_type, row_number() OVER (PARTITION BY id, type, pii, norm ORDER BY pos, part) AS k FROM g1),
p2 AS (SELECT id, type, pii, norm, number_type, row_number() OVER (PARTITION BY id, type, pii, norm ORDER BY pos, part) AS k FROM p1),
m AS (SELECT coalesce(p2.id, g2.id) AS id, coalesce(p2.type, g2.type) AS type, coalesce(p2.pii, g2.pii) AS pii, p2.id IS NOT NULL AS predicted, g2.id IS NOT NULL AS expected, p2.number_type AS pnt
  FROM p2 FULL OUTER JOIN g2 ON p2.id = g2.id AND p2.type = g2.type AND p2.pii = g2.pii AND p2.norm = g2.norm AND p2.k = g2.k),
odd AS (SELECT *, NOT expected AND type = 'number' AND coalesce(pnt, '') NOT IN (SELECT coalesce(number_type, '') FROM gold WHERE type = 'number') AS odd_number,
  NOT expected AND type NOT IN (SELECT type FROM gold) AS odd_type FROM m)
"""


def _prf(rows: str, by: str) -> str:
    return f"""SELECT {by}, tp, fp, fn, round(tp / greatest(1, tp + fp), 4) AS precision, round(tp / greatest(1, tp + fn), 4) AS recall,
      round(2 * (tp / greatest(1, tp + fp)) * (tp / greatest(1, tp + fn)) / greatest(1e-9, tp / greatest(1, tp + fp) + tp / greatest(1, tp + fn)), 4) AS f1
      FROM (SELECT {by}, count(*) FILTER (predicted AND expected) AS tp, count(*) FILTER (predicted AND NOT expected) AS fp, count(*) FILTER (expected AND NOT predicted) AS fn FROM {rows} GROUP BY {by})"""


_LEVELS = f"""{_HOLD}, {_FINDS}, lv AS (SELECT h.id, h.expected.sensitivity AS e, ['none', 'low', 'high'][coalesce(r, 0) + 1] AS p, coalesce(r, 0) AS pr FROM hold h LEFT JOIN
  (SELECT id, max(CASE WHEN pii AND finding_type = 'number' THEN 2 WHEN pii THEN 1 ELSE 0 END) AS r FROM finds GROUP BY id) USING (id) WHERE h.expected.sensitivity IS NOT NULL)"""
_BUCKET = "CASE WHEN n < {0} THEN 'short' WHEN n < {1} THEN 'medium' WHEN n < {2} THEN 'long' ELSE 'very_long' END"
_TEST_CARDS = ", ".join(f"'{c}'" for c in X.TEST_CARDS)


def _pattern(rule: str) -> str:
    """A rule's own pattern; these two have no look-around, so the other engine reads them alike."""
    return next(r.pattern for r in RULES if r.name == rule)


def oracle_sql() -> dict[str, str]:
    luhn = f"list_sum(list_transform(range(length({_DIGITS})), lambda i: CASE WHEN i % 2 = 1 THEN (ascii({_DIGITS}[length({_DIGITS}) - i]) - 48) * 2 - 9 * CASE WHEN ascii({_DIGITS}[length({_DIGITS}) - i]) - 48 > 4 THEN 1 ELSE 0 END ELSE ascii({_DIGITS}[length({_DIGITS}) - i]) - 48 END)) % 10 = 0"
    white = "[^\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{0B}\\x{1C}-\\x{1F}]+"
    tagged = f"""tk AS (SELECT doc_id, unnest(regexp_extract_all(text, '{white}')) AS tok, unnest(string_split_regex(text, '{white}')[1:len(regexp_extract_all(text, '{white}'))]) AS gap, unnest(range(len(regexp_extract_all(text, '{white}')))) AS i, len(regexp_extract_all(text, '{white}')) AS many FROM documents WHERE text IS NOT NULL),
      ps AS (SELECT doc_id, i, many, (sum(length(gap)) OVER u + sum(length(tok)) OVER u - length(tok))::INT AS start, (sum(length(gap)) OVER u + sum(length(tok)) OVER u)::INT AS "end" FROM tk WINDOW u AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
      wn AS (SELECT *, unnest(range(0, greatest(0, ceil((many - 64) / 48.0))::BIGINT + 1)) AS w FROM ps),
      tg AS (SELECT doc_id, w AS window_no, i - w * 48 + 1 AS pos, least(64, many - w * 48) + 2 AS n, start, "end", ['O', 'B-PERSON', 'B-PERSON', 'I-PERSON', 'I-PERSON', 'B-EMAIL', 'I-EMAIL'][(start + 31 * w) % 7 + 1] AS tag FROM wn WHERE i >= w * 48 AND i < w * 48 + 64),
      rs AS (SELECT doc_id, start, "end", tag FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, start, "end" ORDER BY least(pos, n - 1 - pos) DESC, window_no) AS k FROM tg) WHERE k = 1)"""
    key = "f.type || chr(31) || lower(CASE WHEN f.type IN ('phone', 'number') THEN regexp_replace(trim(f.value), '[\\s\\-().]', '', 'g') ELSE trim(f.value) END) || chr(31) || CASE WHEN f.pii THEN 'true' ELSE 'false' END || chr(31) || coalesce(f.number_type, '')"
    levels = _LEVELS.split("finding_id, id, finding_type, finding_value, start_pos, end_pos, pii, number_type FROM report_findings), ")[1]
    compared = f"""{_MATCH}, {levels}, a AS (SELECT id, expected.sensitivity AS s1, list_distinct(list_transform(list_filter(coalesce(expected.findings, []), lambda f: f.value IS NOT NULL), lambda f: {key})) AS k1 FROM hold),
      b AS (SELECT id, list_distinct(list({key})) AS k2 FROM pred f GROUP BY id),
      c AS (SELECT a.id, b.id IS NULL AS missing, s1 IS NOT DISTINCT FROM (CASE WHEN b.id IS NULL THEN NULL ELSE lv.p END) AS same_level, k1, coalesce(k2, []) AS k2 FROM a LEFT JOIN b USING (id) LEFT JOIN lv USING (id)),
      cmp AS (SELECT id, missing, same_level, len(list_intersect(k1, k2))::INT AS n_both, len(list_distinct(list_concat(k1, k2)))::INT AS n_any, list_sort(list_filter(k1, lambda x: NOT list_contains(k2, x))) AS only_first, list_sort(list_filter(k2, lambda x: NOT list_contains(k1, x))) AS only_second FROM c)"""
    return {
        **cases.sql(),
        "rule_card_matches": f"SELECT doc_id, value FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_pattern('pii-credit-card')}', 0)) AS value FROM documents) WHERE {luhn} AND {_DIGITS} NOT IN ({_TEST_CARDS}) AND NOT (length({_DIGITS}) >= 12 AND len(list_filter([{_TEST_CARDS}], lambda t: contains(t, {_DIGITS}))) > 0)",
        "rule_us_phone_matches": f"SELECT doc_id, value FROM (SELECT doc_id, value, right({_DIGITS}, 10) AS d FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_pattern('pii-phone-us')}', 0)) AS value FROM documents)) WHERE length(d) = 10 AND d[1:3] <> '555' AND NOT (d[4:6] = '555' AND (d[7:10] = '1212' OR d[7:8] = '01')) AND d[1:3] NOT IN ('800', '888', '877', '866', '855', '844', '833')",
        "token_windows": f"SELECT doc_id, w::INT AS window_no, (least(64, n - w * 48) + 2)::INT AS n_tokens FROM (SELECT doc_id, n, unnest(range(0, greatest(0, ceil((n - 64) / 48.0))::BIGINT + 1)) AS w FROM (SELECT doc_id, len(regexp_extract_all(text, '{white}')) AS n FROM documents WHERE text IS NOT NULL))",
        "overlap_resolve": f"WITH {tagged} SELECT * FROM rs",
        "bio_islands": f"WITH {tagged}, k AS (SELECT *, CASE WHEN tag <> 'O' THEN tag[3:] END AS kind FROM rs), l AS (SELECT *, lag(kind) OVER w AS lk, lag(\"end\") OVER w AS le FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY start, \"end\")), i AS (SELECT *, sum(CASE WHEN kind IS NOT NULL AND lk = kind AND (tag[1] = 'I' OR start <= le) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY start, \"end\" ROWS UNBOUNDED PRECEDING) AS island FROM l) SELECT doc_id, min(start) AS start, max(\"end\") AS \"end\", any_value(kind) AS kind FROM i WHERE kind IS NOT NULL GROUP BY doc_id, island",
        "labels_compare": f"WITH {compared} SELECT * FROM cmp",
        "labels_agreement": f"WITH {compared} SELECT docs, round(same / greatest(1, docs), 4) AS level_agreement, round(bo / greatest(1, an), 4) AS finding_agreement, dis AS disagreements FROM (SELECT count(*) AS docs, count(*) FILTER (same_level) AS same, sum(n_both) AS bo, sum(n_any) AS an, count(*) FILTER (NOT same_level OR n_both <> n_any) AS dis FROM cmp WHERE NOT missing)",
        "card_matches": f"SELECT doc_id, value FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{CARD}')) AS value FROM documents) WHERE {luhn} AND {_DIGITS} NOT IN ({_TEST_CARDS})",
        "us_phone_matches": f"SELECT doc_id, value FROM (SELECT doc_id, value, right({_DIGITS}, 10) AS d FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{US_PHONE}')) AS value FROM documents)) WHERE length(d) = 10 AND d[1:3] <> '555' AND NOT (d[4:6] = '555' AND (d[7:10] = '1212' OR d[7:8] = '01')) AND d[1:3] NOT IN ('800', '888', '877', '866', '855', '844', '833')",
        "entropy_of_values": "SELECT finding_id, round(coalesce(-sum(c / n * log2(c / n)), 0.0), 6) AS bits FROM (SELECT finding_id, length(finding_value) AS n, ch, count(*) AS c FROM (SELECT finding_id, finding_value, unnest(string_split(finding_value, '')) AS ch FROM (SELECT DISTINCT finding_id, finding_value FROM report_findings WHERE finding_value IS NOT NULL)) GROUP BY ALL) GROUP BY finding_id, n",
        "mask_values": "SELECT finding_id, CASE WHEN length(v) < 2 THEN '…' WHEN t = 'person_name' OR length(v) < 8 THEN v[1] || '…' ELSE v[1:2] || '…' || right(v, 2) END AS masked FROM (SELECT DISTINCT finding_id, finding_type AS t, finding_value AS v FROM report_findings WHERE finding_value IS NOT NULL)",
        "line_numbers": f"WITH {_HOLD}, {_FINDS} SELECT finding_id, (length(text[1:start_pos]) - length(replace(text[1:start_pos], chr(10), '')) + 1)::INT AS line FROM (SELECT DISTINCT finding_id, id, start_pos FROM finds) JOIN hold USING (id) WHERE text IS NOT NULL",
        "secret_overlap_anti": f"WITH {_FINDS} SELECT finding_id FROM finds f WHERE NOT EXISTS (SELECT 1 FROM report_findings s WHERE s.finding_type = 'email' AND s.id = f.id AND f.start_pos < s.end_pos AND s.start_pos < f.end_pos)",
        "length_bucket_hist": f"SELECT lang, CASE WHEN lang IN ('ja', 'zh', 'ko') THEN {_BUCKET.format(100, 500, 1000)} ELSE {_BUCKET.format(200, 1000, 2000)} END AS bucket, count(*) AS n FROM (SELECT lang, length(text) AS n FROM documents WHERE text IS NOT NULL) GROUP BY 1, 2",
        "coverage_formats": "SELECT format AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM documents), 4) AS share FROM documents GROUP BY format",
        "coverage_finding_rates": f"WITH {_HOLD} SELECT value, count(*) AS n, round(count(*) * 1000 / (SELECT count(*) FROM hold), 1) AS per_1000 FROM (SELECT unnest(list_distinct(list_transform(expected.findings, lambda f: f.type))) AS value FROM hold) GROUP BY value",
        "coverage_off_target": "WITH ids AS (SELECT id, min(lower(trim(lang))) AS lang, min(lower(trim(sensitivity))) AS sensitivity, min(regexp_replace(lower(trim(cell)), '[ -]', '_', 'g')) AS cell FROM es_1 WHERE id IS NOT NULL GROUP BY id), s AS (SELECT field, value, round(count(*) / (SELECT count(*) FROM ids), 4) AS share FROM (SELECT unnest(['lang', 'sensitivity', 'cell']) AS field, unnest([lang, sensitivity, cell]) AS value FROM ids) WHERE value IS NOT NULL GROUP BY field, value) SELECT coalesce(s.field, t.field_name) AS field, coalesce(s.value, t.category) AS value, coalesce(t.target_share, 0.0) AS target, coalesce(s.share, 0.0) AS share FROM s FULL OUTER JOIN (SELECT field_name, category, target_share FROM coverage_targets) t ON s.value = t.category AND s.field = t.field_name WHERE coalesce(t.target_share, 0) = 0 AND coalesce(s.share, 0) > 0 OR coalesce(t.target_share, 0) > 0 AND abs(coalesce(s.share, 0) - t.target_share) > 0.2 * t.target_share",
        "card_offsets": f"SELECT doc_id, start, (start + length(value))::INT AS \"end\", value FROM (SELECT doc_id, ms[i] AS value, (list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))::INT AS start FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{CARD}') AS ms, string_split_regex(text, '{CARD}') AS ps FROM documents WHERE text IS NOT NULL)))",
        "apportion_counts": "WITH r AS (SELECT source AS key, floor(weight * 1003)::BIGINT AS whole, weight * 1003 - floor(weight * 1003) AS rest FROM mix_weights) SELECT key, whole + CASE WHEN row_number() OVER (ORDER BY rest DESC, key) <= 1003 - (SELECT sum(whole) FROM r) THEN 1 ELSE 0 END AS n FROM r",
        "match_prf": f"WITH {_MATCH} " + _prf("(SELECT * FROM odd WHERE NOT odd_number AND NOT odd_type)", "type"),
        "match_personal_prf": f"WITH {_MATCH} " + _prf("(SELECT * FROM odd WHERE NOT odd_number AND NOT odd_type AND pii)", "type"),
        "match_person_by_lang": f"WITH {_MATCH} " + _prf("(SELECT m.*, hold.lang FROM m JOIN hold USING (id) WHERE type = 'person_name')", "lang"),
        "match_unscored": f"WITH {_MATCH} SELECT CASE WHEN odd_number THEN 'number:' || coalesce(pnt, 'None') ELSE type END AS name, count(*) AS n FROM odd WHERE odd_number OR odd_type GROUP BY 1",
        "confusion_matrix": f"WITH {_LEVELS} SELECT e AS expected, p AS predicted, count(*) AS n FROM lv GROUP BY e, p",
        "judged_too_low": f"WITH {_LEVELS} SELECT * FROM (SELECT id, e AS expected_level, p AS predicted_level, e = 'high' AND p <> 'high' AS high_missed, e <> 'none' AND p = 'none' AS personal_missed, pr < CASE e WHEN 'none' THEN 0 WHEN 'low' THEN 1 ELSE 2 END AS under_estimated FROM lv) WHERE high_missed OR personal_missed OR under_estimated",
        "acceptance": f"WITH {_MATCH}, {_LEVELS.split('finding_id, id, finding_type, finding_value, start_pos, end_pos, pii, number_type FROM report_findings), ')[1]}, n AS (SELECT count(*) FILTER (predicted AND expected) AS tp, count(*) FILTER (expected AND NOT predicted) AS fn FROM m WHERE type = 'person_name'), l AS (SELECT count(*) AS documents, count(*) FILTER (e = p) AS ok, count(*) FILTER (e = 'high' AND p <> 'high') AS h, count(*) FILTER (e <> 'none' AND p = 'none') AS q FROM lv) SELECT documents, round(ok / greatest(1, documents), 4) AS sensitivity_accuracy, tp / greatest(1, tp + fn) >= 0.98 AS person_recall_ok, h = 0 AS high_missed_ok, q = 0 AS personal_missed_ok, tp / greatest(1, tp + fn) >= 0.98 AND h = 0 AND q = 0 AS pass FROM n, l",
        "script_problems": f"WITH {_HOLD} SELECT id, problem FROM (SELECT id, unnest([CASE WHEN lower(trim(lang)) = 'ko' AND NOT regexp_matches(text, '[가-힣]') THEN 'no Hangul' END, CASE WHEN lower(trim(lang)) = 'ja' AND NOT regexp_matches(text, '[\\x{{3040}}-\\x{{30FF}}]') THEN 'no kana' END, CASE WHEN lower(trim(lang)) = 'zh' AND regexp_matches(text, '[\\x{{3040}}-\\x{{30FF}}가-힣]') THEN 'kana or Hangul in zh' END, CASE WHEN contains(text, '\\n') THEN 'literal backslash-n' END]) AS problem FROM hold WHERE text IS NOT NULL) WHERE problem IS NOT NULL",
        "script_problems_mislabelled": f"WITH hold AS (SELECT doc_id AS id, ['ko', 'ja', 'zh'][doc_id % 3 + 1] AS lang, text || CASE WHEN doc_id % 5 = 0 THEN '\\n' ELSE '' END AS text FROM documents) SELECT id, problem FROM (SELECT id, unnest([CASE WHEN lower(trim(lang)) = 'ko' AND NOT regexp_matches(text, '[가-힣]') THEN 'no Hangul' END, CASE WHEN lower(trim(lang)) = 'ja' AND NOT regexp_matches(text, '[\\x{{3040}}-\\x{{30FF}}]') THEN 'no kana' END, CASE WHEN lower(trim(lang)) = 'zh' AND regexp_matches(text, '[\\x{{3040}}-\\x{{30FF}}가-힣]') THEN 'kana or Hangul in zh' END, CASE WHEN contains(text, '\\n') THEN 'literal backslash-n' END]) AS problem FROM hold WHERE text IS NOT NULL) WHERE problem IS NOT NULL",
        "values_not_in_text": f"WITH {_HOLD} SELECT id, f.type AS type, f.value AS value FROM (SELECT id, text, unnest(expected.findings) AS f FROM hold WHERE text IS NOT NULL) WHERE NOT contains(text, f.value)",
        "split_findings": f"WITH {_HOLD} SELECT split, type, count(*) AS n, count(*) FILTER (type = 'person_name' OR pii) AS personal FROM (SELECT split, f.type AS type, f.value AS value, f.pii AS pii, f.number_type AS nt FROM (SELECT split, unnest(expected.findings) AS f FROM hold)) WHERE type IN ('person_name', 'email', 'phone', 'number') AND (type <> 'number' OR coalesce(nt, '') IN ('my_number', 'national_id', 'driver_licence_or_passport', 'credit_card', 'bank_account')) AND NOT (type = 'person_name' AND coalesce(starts_with(value, '@') OR contains(value, '_'), FALSE)) GROUP BY split, type",
        "repeated_sentences": f"WITH {_HOLD} SELECT id, count(*) AS repeated FROM (SELECT id, s FROM (SELECT id, unnest(list_transform(regexp_split_to_array(text, '[。．.!?！？\\n]+'), lambda x: regexp_replace(x, '^[\\s\\x{{A0}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}\\x{{3000}}]+|[\\s\\x{{A0}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}\\x{{3000}}]+$', '', 'g'))) AS s FROM hold WHERE text IS NOT NULL) WHERE length(s) > 15 GROUP BY id, s HAVING count(*) > 1) GROUP BY id",
        "near_duplicates": "WITH t AS (SELECT doc_id AS id, coalesce(lang, '') AS lang, regexp_replace(text, '[\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{0B}]+', ' ', 'g') AS x FROM documents WHERE text IS NOT NULL), s AS (SELECT id, lang, list_distinct(list_transform(range(0, greatest(1, length(x) - 12), 6), lambda i: x[i + 1:i + 12])) AS sh FROM t), e AS (SELECT id, lang, len(sh) AS n, unnest(sh) AS g FROM s) SELECT a.lang, a.id, b.id AS other, count(*) / least(a.n, b.n) AS overlap FROM e a JOIN e b ON a.lang = b.lang AND a.g = b.g AND a.id > b.id GROUP BY a.lang, a.id, b.id, a.n, b.n HAVING count(*) / least(a.n, b.n) > 0.5",
    }
