"""Problem 2: one form for text that looks the same but differs in its characters.

Format characters go, compatibility forms (full and half width, presentation forms, kinds of space) become their plain
characters, accents are composed, hyphen forms become the hyphen. Look-alike letters are repaired by script: a token is a
run of letters; where its letters come from more than one of Latin, Cyrillic and Greek, or from another script than
nearly all of its text, the letters of the other script are replaced by their look-alikes of the dominant script, provided
that the result is a word of the corpus. The corpus vocabulary is a table of its own, never collected or broadcast: the
few doubtful spellings are joined with it.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.forms import _format_characters
from veilspark.session import checkpoint

# Letters of Cyrillic and Greek with the Latin letters they look like; the commonest of several alike is the last.
CYRILLIC = dict(zip("ѵӏӀҮѴаеорсухіјѕһԁԛԝкАВСЕНІЈКМОРЅТУХԜԚ", "vlIYVaeopcyxijshdqwkABCEHIJKMOPSTYXWQ", strict=True))
GREEK = dict(zip("ϳͿονριαυχκΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "jJovpiauxkABEZHIKMNOPTYX", strict=True))
TO_LATIN = str.maketrans({**CYRILLIC, **GREEK})
TO_CYRILLIC = str.maketrans({v: k for k, v in CYRILLIC.items()})
TO_GREEK = str.maketrans({v: k for k, v in GREEK.items()})
HYPHENS = str.maketrans({"‐": "-", "‑": "-", "﹣": "-"})

FOREIGN = re.compile("[Ͱ-ϿЀ-ԯ]")
#: Runs of letters of the three scripts; others have no look-alikes here.
TOKEN = re.compile("[A-Za-zªºÀ-ÖØ-öø-ɏͰ-ϿЀ-ԯḀ-ỿ]+")


def even(text: str) -> str:
    """The text in one form but for look-alike letters."""
    if text.isascii():
        return text
    return unicodedata.normalize("NFKC", _format_characters().sub("", text)).translate(HYPHENS)


def script(ch: str) -> str:
    if "Ͱ" <= ch <= "Ͽ":
        return "greek"
    if "Ѐ" <= ch <= "ԯ":
        return "cyrillic"
    return "latin" if ch < "ɐ" or "Ḁ" <= ch <= "ỿ" else "other"


def _scripts(text: str) -> dict[str, int]:
    n: dict[str, int] = {}
    for ch in text:
        s = script(ch)
        if s != "other":
            n[s] = n.get(s, 0) + 1
    return n


def main_script(texts: list[str]) -> tuple[str, dict[str, int]]:
    """The script of most letters of a record, Latin if it has none of the three, and the number of letters of each."""
    whole = _scripts("".join(texts))
    return (max(sorted(whole), key=lambda s: (whole[s], s == "latin")) if whole else "latin"), whole


def proposals(text: str, main: str, whole: dict[str, int]) -> dict[str, list[str]]:
    """Doubtful tokens of an even text with what they may stand for, the likelier first.

    ``main`` and ``whole`` say which scripts the record is written in. A mixed token is tried in the record's script, then
    in its own dominant one; a token of one other script is doubtful only where the record has little of that script.
    """
    if not FOREIGN.search(text):
        return {}
    out: dict[str, list[str]] = {}
    for token in set(TOKEN.findall(text)):
        own = _scripts(token)
        if not own or set(own) == {main}:
            continue
        if len(own) == 1 and whole.get(main, 0) < 2 * sum(whole.get(s, 0) for s in own):
            continue
        tried = []
        for target in dict.fromkeys([main, *sorted(own, key=lambda s: (-own[s], s))]):
            new = token.translate({"latin": TO_LATIN, "cyrillic": TO_CYRILLIC, "greek": TO_GREEK}[target])
            if new != token and set(_scripts(new)) <= {target} and new not in tried:
                tried.append(new)
        if tried:
            out[token] = tried
    return out


def repaired(text: str, words: dict[str, str]) -> str:
    """An even text with its doubtful tokens replaced by the accepted words."""
    return TOKEN.sub(lambda m: words.get(m[0], m[0]), text) if words and FOREIGN.search(text) else text


def _evidence(records: DataFrame) -> DataFrame:
    """``key, spelling, rank, word, low`` of doubtful tokens, and ``low`` alone for each clean word of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            clean: set[str] = set()
            key, spelling, rank, word = [], [], [], []
            for k, pieces in zip(b.column("key").to_pylist(), b.column("pieces").to_pylist(), strict=True):
                forms = [even(t) for t in pieces or () if t]
                if not any(map(FOREIGN.search, forms)):
                    clean.update(w.casefold() for form in forms for w in TOKEN.findall(form))
                    continue
                main, whole = main_script([t for form in forms for t in TOKEN.findall(form)])
                for form in forms:
                    doubtful = proposals(form, main, whole)
                    clean.update(w.casefold() for w in TOKEN.findall(form) if w not in doubtful)
                    for s, words in doubtful.items():
                        for i, w in enumerate(words):
                            key.append(k), spelling.append(s), rank.append(i), word.append(w)
            n = len(clean)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([None] * n + key, pa.string()), pa.array([None] * n + spelling, pa.string()), pa.array([0] * n + rank, pa.int32()),
                    pa.array([None] * n + word, pa.string()), pa.array([*clean, *(w.casefold() for w in word)], pa.string()),
                ],
                ["key", "spelling", "rank", "word", "low"],
            )

    return records.select("key", "pieces").mapInArrow(run, "key string, spelling string, rank int, word string, low string")


def repairs(records: DataFrame) -> DataFrame:
    """``key, words map<string,string>``: the accepted repairs of the records (``key string, pieces array<string>``) that have any.

    The first proposal that is a word of the corpus is accepted; the word may be written in any case.
    """
    evidence = checkpoint(_evidence(records))  # read twice, made once
    doubtful = evidence.where("spelling IS NOT NULL").distinct()
    proposed = doubtful.select("spelling", "rank", "word", "low").distinct()
    clean = evidence.where("spelling IS NULL").select("low").distinct()
    accepted = proposed.join(clean, "low", "left_semi").groupBy("spelling").agg(F.min_by("word", "rank").alias("word"))
    per = doubtful.select("key", "spelling").distinct().join(accepted, "spelling")
    return per.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("spelling", "word"))).alias("words"))  # bounded by a record's own tokens


def _with_repairs(holdout: DataFrame) -> DataFrame:
    """``id, text, vals, words``: one row per distinct record, its values and its repairs."""
    rows = holdout.where(F.col("id").isNotNull()).select("id", "text", F.col("expected.findings.value").alias("vals")).distinct()
    records = rows.select(F.col("id").alias("key"), F.concat(F.array("text"), F.coalesce("vals", F.array().cast("array<string>"))).alias("pieces"))
    return rows.join(repairs(records).withColumnRenamed("key", "id"), "id", "left")


def found(holdout: DataFrame) -> DataFrame:
    """``id, finding_no``: findings whose value isn't literally in the text but looks the same as a stretch of it.

    Null texts, values, ids and finding lists give nothing; an empty value is a part of any text. Case, accents, digits, words
    and visible spacing are kept, so a difference in them stays one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, no = [], []
            for i, t, values, words in zip(*(b.column(c).to_pylist() for c in ("id", "text", "vals", "words")), strict=True):
                if t is None or not values:
                    continue
                known, form = dict(words or ()), None
                for k, v in enumerate(values):
                    if v is None or v in t:
                        continue
                    if form is None:
                        form = repaired(even(t), known)
                    if repaired(even(v), known) in form:
                        ids.append(i), no.append(k + 1)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(no, pa.int32())], ["id", "finding_no"])

    return _with_repairs(holdout).mapInArrow(run, "id string, finding_no int").distinct()


def consistent(holdout: DataFrame) -> DataFrame:
    """``id, text, vals``: every distinct record with its text and values in one form; nulls stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, values = [], []
            for t, vals, words in zip(*(b.column(c).to_pylist() for c in ("text", "vals", "words")), strict=True):
                known = dict(words or ())
                texts.append(None if t is None else repaired(even(t), known))
                values.append(None if vals is None else [None if v is None else repaired(even(v), known) for v in vals])
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(texts, pa.string()), pa.array(values, pa.list_(pa.string()))], ["id", "text", "vals"])

    return _with_repairs(holdout).mapInArrow(run, "id string, text string, vals array<string>")
