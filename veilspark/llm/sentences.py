"""Problem 8: sentence units of documents in any language and layout.

First the layout: blank lines, list items, labelled fields, chat turns, log lines and lines broken off early begin units; a
line broken because it was full ends nothing. Then the sentences:
what a period means is learned without labels, per language, from all documents. Log-likelihood ratios tell
abbreviations, whose period belongs to the word, from words that happen to end sentences; collocations of a number with a
period and the word after it (months, mostly), which the period doesn't part; and sentence starters, words that follow
sentence ends more often than chance has it. A period is then judged by these statistics and its neighbours: after a word
that is no abbreviation it ends a sentence; after an abbreviation it does before a starter, or before a capital letter if
the abbreviation is one that ends paragraphs; after a number it doesn't before a collocate.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.forms import blocks
from veilspark.llm.personal import judged_language
from veilspark.session import spread

#: Least score of an abbreviation, least log-likelihood ratios of a starter and of a collocation.
ABBREVIATION, STARTER, COLLOCATION = 0.3, 30.0, 7.88
#: Rows of learned statistics that are sent to the tasks; more are refused, as they can't be abbreviations of a language.
MOST_LEARNED = 200_000

ENDS = ".!?。！？｡…"
WIDE_ENDS = "。！？｡"
CLOSERS = "\"'”’»」』)]）］】"
PAIRS = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "‘": "’", "»": "«", "(": ")", "（": "）", "《": "》"}
_WORD = re.compile(r"[^\W\d_](?:[^\W_]|[.](?=[^\W\d_]))*\.?")
_TOKEN = re.compile(r"\S+")
_BLANK = re.compile(r"(?:\r\n|\r(?!\n)|(?<!\r)\n)[^\S\r\n]*(?:\r\n?|\n)\s*")
_LINE = re.compile(r"\r\n?|\n")
#: Line starts that always begin a unit: list marker, bracketed or plain clock time, date stamp, label or speaker.
_STARTS = re.compile(
    r"\s*(?:[-*•·‣◦▪–—+]\s+|\(?(?:\d{1,3}|[a-zA-Z])[.)]\s+|\[\d{1,2}:\d{2}(?::\d{2})?\]|\d{4}-\d\d-\d\d[T ]\d\d:\d\d|\d{1,2}:\d{2}(?::\d{2})? |[#>]+\s|[^\W\d_a-zß-öø-ÿ][\w '’/-]{0,28}\.?[:：](?!//)(?:\s|$)|[一-鿿가-힣぀-ヿ][\w ]{0,10}[:：])"
)
_MARK = re.compile(r"\s*(?:[-*•·‣◦▪–—+]\s+|\(?(?:\d{1,3}|[a-zA-Z])[.)]\s+)")
_CJK = re.compile("[぀-ヿ一-鿿가-힣]")
_OPENERS = re.compile("[" + "".join(PAIRS) + "\"']")
_RUN = re.compile(f"[{ENDS}]+")
#: What a period or mark of its own may be preceded by in a word.
_LEADS = re.compile("[\\s\"'“„«‘¿¡([（「『，、,;:：/’]")


@dataclass
class Learned:
    """Statistics of one language: abbreviations (value: may end a sentence), collocations after a number, starters, and endings of
    words whose period always goes before a number (those of streets)."""

    abbreviations: dict[str, bool] = field(default_factory=dict)
    after_number: set[str] = field(default_factory=set)
    starters: set[str] = field(default_factory=set)
    before_number: set[str] = field(default_factory=set)


#: Columns from which a line without an end mark counts as broken because it was full; a document's first line may be a heading.
FULL, HEADING = 40, 60

# ---- learning ------------------------------------------------------------------------------------------------------

#: A number that may be an ordinal, with its period; and what stands for all of them in the counts.
_ORDINAL = re.compile(r"\d{1,2}\.")
_LISTED = re.compile(r"(?m)^\s*\(?\d{1,3}[.)]\s+")
_BEFORE_WORD = "\"'“„«»‘¿¡(["
_AFTER_WORD = ",;:)”\"»'"


def _counts(docs: DataFrame) -> DataFrame:
    """``lang, kind, word, n``: pre-aggregated per block. Kinds: w word, p with period, e at a paragraph's end, l before a small letter,
    f following a sentence end in capitals, c with a capital, d after number and period. "~xyz" is any word that ends so.

    Scripts without spaces between words have no such words and are left out. A word after an apostrophe is a word of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            single: dict[str, Counter] = {}
            pairs: dict[str, Counter] = {}
            last: dict[str, Counter] = {}
            for text in b.column("text").to_pylist():
                lang = judged_language(text)[0] if text else "zh"
                if lang in ("ja", "zh"):
                    continue
                for part in _BLANK.split(text):
                    tokens = _LISTED.sub(" ", part).split()
                    if tokens:
                        single.setdefault(lang, Counter()).update(tokens)
                        pairs.setdefault(lang, Counter()).update([x for x in zip(tokens, tokens[1:], strict=False) if x[0][-1] in ".!?"])
                        if tokens[-1][-1] == ".":
                            last.setdefault(lang, Counter())[tokens[-1]] += 1
            n: Counter = Counter()
            for lang, tokens in single.items():
                for token, many in tokens.items():
                    if "@" in token or "/" in token:
                        continue
                    if (word := _word(token)) is None:
                        if _ORDINAL.fullmatch(token):
                            n[lang, "w", "#."] += many
                        continue
                    dotted = _dotted(token, word)
                    n[lang, "p" if dotted else "w", word.lower().rstrip(".")] += many
                    if dotted and token[-1] != ".":
                        n[lang, "l", word.lower()[:-1]] += many  # a comma or a bracket follows the period
                    if word[0].isupper():
                        n[lang, "c", word.lower().rstrip(".")] += many
            for lang, seen in last.items():
                for token, many in seen.items():
                    if (word := _word(token)) is not None and _dotted(token, word):
                        n[lang, "e", word.lower()[:-1]] += many
            for lang, seen in pairs.items():
                for (one, two), many in seen.items():
                    word, after = _word(one), _word(two)
                    if word is not None and _dotted(one, word) and (two[0].islower() or any(ch.isdigit() for ch in two)):
                        n[lang, "l", word.lower()[:-1]] += many
                    if word is not None and _dotted(one, word) and len(word) > 4:
                        n[lang, "p", "~" + word.lower()[-4:-1]] += many
                        if two[0].isdigit():
                            n[lang, "l", "~" + word.lower()[-4:-1]] += many
                    if after is not None and _ORDINAL.fullmatch(one):
                        n[lang, "d", after.lower().rstrip(".")] += many
                    if after is not None and after[0].isupper() and len(one) > 4 and one[-2].islower():
                        n[lang, "f", after.lower().rstrip(".")] += many
            keys = list(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.string()), pa.array(list(n.values()), pa.int64())],
                ["lang", "kind", "word", "n"],
            )

    return docs.select("text").mapInArrow(run, "lang string, kind string, word string, n bigint").groupBy("lang", "kind", "word").agg(F.sum("n").alias("n"))


def _word(token: str) -> str | None:
    """The word at the start of a token, after quotation marks; of words that an apostrophe joins the last."""
    token = token.lstrip(_BEFORE_WORD)
    m = _WORD.match(token)
    while m and token[m.end() : m.end() + 1] in ("'", "’") and (more := _WORD.match(token, m.end() + 1)):
        m = more
    return m[0] if m else None


def _dotted(token: str, word: str) -> bool:
    """Whether the token is the word, its period and nothing but closing marks."""
    return word[-1] == "." and not token[token.rfind(word) + len(word) :].strip(_AFTER_WORD)


def _log_likelihood(k: Column, n: Column, p: Column) -> Column:
    p = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), p))
    return k * F.log(p) + (n - k) * F.log(1 - p)


def _share(part: Column, whole: Column) -> Column:
    """A share; of nothing 0."""
    return part / F.greatest(whole, F.lit(1))


def _ratio(both: Column, first: Column, second: Column, every: Column) -> Column:
    """Log-likelihood ratio for ``second`` following ``first`` in ``both`` of ``every`` cases, against independence."""
    p, p1, p2 = _share(second, every), _share(both, first), _share(second - both, every - first)
    return 2 * (_log_likelihood(both, first, p1) + _log_likelihood(second - both, every - first, p2) - _log_likelihood(both, first, p) - _log_likelihood(second - both, every - first, p))


def statistics(docs: DataFrame) -> DataFrame:
    """``lang, word, abbreviation, may_end, after_number, starter, before_number`` of the words that are any of these, over all documents."""
    wide = _counts(docs).groupBy("lang", "word").pivot("kind", ["w", "p", "e", "l", "f", "c", "d"]).agg(F.sum("n")).na.fill(0)
    ending = F.col("word").startswith("~")
    total = wide.groupBy("lang").agg(*(F.sum(F.when(ending, 0).otherwise(F.col(k))).alias("t" + k) for k in ("w", "p", "f")), F.sum(F.when(F.col("word") == "#.", F.col("w")).otherwise(0)).alias("tn"))
    both = wide.join(F.broadcast(total), "lang")  # a row per language the code knows
    used, every = F.col("w") + F.col("p"), F.col("tw") + F.col("tp")
    # how much better "nearly always with a period" explains the word than the language's rate of periods
    fit = -2 * (_log_likelihood(F.col("p"), used, _share(F.col("tp"), every)) - _log_likelihood(F.col("p"), used, F.lit(0.99)))
    letters = F.length(F.regexp_replace("word", "[.]", ""))
    inner = F.length("word") - letters + 1
    score = fit * F.exp(-letters) * inner * F.pow(F.greatest(letters, F.lit(1)).cast("double"), -F.col("w").cast("double"))
    # words that go on with a small letter, a digit or a comma after their period can't be sentence ends there
    goes_on = _share(F.col("l"), F.col("p"))
    # and a title is never the last word of a paragraph, as the last word of a sentence is now and then
    never_last = (F.col("e") < 0.005 * F.col("p")) & (F.col("p") >= 3)
    spaced = ~F.col("word").rlike("[\\u3040-\\u30ff\\u4e00-\\u9fff\\uac00-\\ud7a3]")
    abbreviation = spaced & (F.col("p") > 0) & ((score >= ABBREVIATION) & ((goes_on > 0.02) | never_last) | (F.col("word").rlike("^([^.]{1,2}[.])+[^.]{1,3}$")) | ((goes_on >= 0.9) & never_last & (F.col("p") >= 5)) | ((goes_on > 0.2) & (F.col("p") >= 3) & (F.col("w") <= 0.1 * F.col("p"))))
    may_end = F.col("e") >= F.greatest(F.lit(1.0), 0.005 * F.col("p"))
    starter = (_ratio(F.col("f"), F.col("tf"), used, every) >= STARTER) & (_share(F.col("f"), F.col("tf")) > _share(used, every)) & (F.col("f") > 0)
    # a word also seen in small letters, as a name's capital says nothing
    starter &= F.col("c") < 0.9 * used
    # a word that follows numbers with a period more often than it follows the ends of sentences
    follows, ends = F.col("d") + F.col("f"), F.col("tn") + F.col("tf")
    after = spaced & (F.col("d") > 0) & (_ratio(F.col("d"), F.col("tn"), follows, ends) >= COLLOCATION) & (_share(F.col("d"), F.col("tn")) > _share(follows, ends)) & (F.col("d") > F.col("f"))
    before = ending & (F.col("l") >= 0.99 * F.col("p")) & (F.col("p") >= 10)
    return both.select(
        "lang", "word", (abbreviation & ~ending).alias("abbreviation"), may_end.alias("may_end"), (after & ~ending).alias("after_number"), (starter & ~ending).alias("starter"), before.alias("before_number"),
    ).where("abbreviation OR after_number OR starter OR before_number")


def learn(docs: DataFrame) -> dict[str, Learned]:
    """The statistics as they are sent to the tasks. Their number is checked: it follows the languages, not the documents."""
    rows = statistics(docs).limit(MOST_LEARNED + 1).collect()
    if len(rows) > MOST_LEARNED:
        raise ValueError(f"more than {MOST_LEARNED} learned words: the texts are no natural language")
    out: dict[str, Learned] = {}
    for r in rows:
        of = out.setdefault(r["lang"], Learned())
        if r["abbreviation"]:
            of.abbreviations[r["word"]] = r["may_end"]
        if r["after_number"]:
            of.after_number.add(r["word"])
        if r["starter"]:
            of.starters.add(r["word"])
        if r["before_number"]:
            of.before_number.add(r["word"][1:])
    out[""] = _all(out)
    return out


# ---- cutting -------------------------------------------------------------------------------------------------------


def _columns(line: str) -> int:
    """Width of a line; a character of a script without spaces is as wide as two."""
    return len(line) if line.isascii() else len(line) + len(_CJK.findall(line))


def paragraphs(text: str) -> Iterator[tuple[int, int]]:
    """Stretches that no unit crosses: between blank lines, and from a line that begins a unit to the next such line."""
    at = 0
    for m in [*_BLANK.finditer(text), None]:
        end = m.start() if m else len(text)
        lines, start = [], at
        for x in _LINE.finditer(text, at, end):
            lines.append((start, x.start()))
            start = x.end()
        lines.append((start, end))
        first = lines[0][0]
        for (a, b), (c, d) in zip(lines, lines[1:], strict=False):
            line, new = text[a:b].strip(), text[c:d].lstrip()
            if not new:
                continue
            # a full line breaks in the middle of a sentence; a short one without an end mark is a heading, greeting or entry
            full = _columns(line) >= (FULL if text[:a].strip() else HEADING)
            small = new[0].islower() and line[-1:] not in "!?:"
            open_ = bool(line) and line[-1] not in ".!?。！？｡:：…"
            # what looks like a marker or label after a full line is one only among others of its kind
            marked = _STARTS.match(text, c, d) and (not (full and open_) or _STARTS.match(text, a, b))
            if not line or marked or not small and not (open_ and full):
                yield first, b
                first = c
        yield first, end
        at = m.end() if m else end


def _quotes(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Stretches between a quotation mark or bracket and the one that closes it, outermost only."""
    out, i = [], start
    while m := _OPENERS.search(text, i, end):
        i, ch = m.start(), m[0]
        close = PAIRS.get(ch)
        if ch == "»" and "«" in text[start:i]:
            close = None
        if ch == '"' and (i == start or text[i - 1].isspace() or text[i - 1] in "(—–:，：") or ch == "'" and (i == start or text[i - 1].isspace()) and _CJK.match(text[i + 1 : i + 2]):
            close = ch
        ends = [j for j in (text.find(c, i + 1, end) for c in close or ()) if j >= 0]
        if ends:
            out.append((i, min(ends)))
            i = min(ends)
        i += 1
    return out


def _word_before(text: str, start: int, dot: int) -> str:
    i = dot
    while i > start and not text[i - 1].isspace() and text[i - 1] not in "\"'“„«‘¿¡([（「『，、,;:：/":
        i -= 1
    return text[i:dot]


def cut(text: str, start: int, end: int, known: Learned) -> Iterator[tuple[int, int]]:
    """Sentences of a paragraph."""
    quotes = _quotes(text, start, end)
    mark = _MARK.match(text, start, end)
    unit, i = start, mark.end() if mark else start
    quotes = [x for x in quotes if x[1] >= i]
    q = 0
    while True:
        m = _RUN.search(text, i, end)
        at = m.start() if m else end
        if q < len(quotes) and quotes[q][0] <= at:
            a, b = quotes[q]
            q, i = q + 1, max(i, b + 1)
            inner = text[b - 1 : b]
            bracket = text[a] in "(（《"
            # a quotation that ends its own sentence after words that introduce it ends the unit, if a new one follows
            if not bracket and text[unit:a].strip() and inner in ENDS and inner != "…":
                j = i
                while j < end and text[j].isspace():
                    j += 1
                gap, next_ = j > i, text[j : j + 1]
                if j >= end or (gap and (next_.isupper() or next_ in "¿¡\"“„«") and text[a] not in "「『"):
                    yield unit, i
                    unit = i
            continue
        if not m:
            break
        stop = i = m.end()
        while i < end and text[i] in CLOSERS and not (text[i] in "\"'" and i + 1 < end and not text[i + 1].isspace()):
            i += 1
        if _ends(text, unit, at, m[0], stop, i, end, known):
            yield unit, i
            unit = i
    yield unit, end


def _ends(text: str, unit: int, first: int, run: str, stop: int, i: int, end: int, known: Learned) -> bool:
    j = i
    while j < end and text[j].isspace():
        j += 1
    if j >= end:
        return False  # the paragraph ends anyway
    gap, after = j > i, text[j]
    if any(ch in WIDE_ENDS for ch in run):
        return after not in ",，、;；:：)）" and not (i > stop and not gap)
    if "…" in run or run.startswith("..") and len(run) > 2 or run == "..":
        return gap and (after.isupper() or after in "¿¡\"“„«")
    if run[0] in "!?" or "!" in run or "?" in run:
        if _CJK.match(after) and not gap:
            return bool(_CJK.match(text[first - 1 : first]) or text[first - 1 : first].isspace())
        if not gap:  # a space is missing
            return after.isupper() and text[j + 1 : j + 2].isalpha() or after.isupper() and text[j + 1 : j + 2] in "'’"
        return not after.islower() and after not in ",;:)»”–—-"
    word = _word_before(text, unit, first)
    if not gap:
        # a space is missing: a word in small letters, a period, and a capitalised word
        if i > stop or "@" in word or "/" in word:
            return False
        if _CJK.match(after) and _CJK.match(word[-1:]):
            return True
        tail = re.split(r"[.]", word)[-1]
        nxt = re.match(r"[^\W\d_][^\W\d_]*", text[j:end])
        whole = _TOKEN.match(text, j, end)[0]
        return bool(len(tail) > 1 and tail[-1].islower() and after.isupper() and nxt and (len(nxt[0]) == 1 or nxt[0][1:].islower()) and "@" not in whole and "/" not in whole and tail.lower() not in known.abbreviations) or bool(
            word[-1:].isdigit() and not re.search(r"[A-Za-z]", word[-3:]) and after.isupper() and nxt and len(nxt[0]) > 1 and nxt[0][1:].islower()
        )
    if after.islower() or after in ",;:)]»”":
        return False
    if not word:  # a mark of its own, which may stand between spaced digits
        return not (after.isdigit() and re.search(r"\d\s*$", text[unit:first]))
    low = re.split("-", word.lower())[-1]
    nxt = re.match(r"[^\W_]+", text[j:end])
    follower = nxt[0].lower() if nxt else ""
    starts = bool(nxt) and follower in known.starters and follower not in known.abbreviations and nxt[0] in (follower.capitalize(), after) and text[j + nxt.end() : j + nxt.end() + 1].isspace()
    if re.fullmatch(r"\d{1,2}", word) and (follower in known.after_number or after.isdigit() and not _CJK.match(text[first - 1 : first])):
        return False
    if after.isdigit() and re.fullmatch(r"\d{4}|\d{1,2}", word) and re.match(r"\d{1,2}\.\s", text[j:end]):
        return False  # a date written in parts
    if re.search(r"(?<!\d)\d{4}\.\s\d{1,2}\.\s\d{1,2}$", text[unit:first]) and "가" <= after <= "힣":
        return False  # such a date, and the sentence goes on
    if len(word) == 1 and word.isalpha() and word.isupper() and not starts and not (known.abbreviations.get(low) and re.search(r"[^\W\d_]\. ?$", text[unit : first - 1])):
        return False  # an initial, not the last part of an abbreviation of several
    if low in known.abbreviations:
        if starts:
            return True
        return known.abbreviations[low] and (after.isupper() or bool(_CJK.match(after)) or after in "¿¡\"“„«")
    if after.isdigit() and len(low) > 3 and low[-3:] in known.before_number:
        return False  # a street's name
    if re.fullmatch(r"(?:[^\W\d_]{1,2}\.)+[^\W\d_]{1,3}", word):
        return after.isupper() or after in "¿¡\"“„«"
    return True


def _all(learned: dict[str, Learned]) -> Learned:
    out = Learned()
    for one in learned.values():
        for word, ends in one.abbreviations.items():
            out.abbreviations[word] = out.abbreviations.get(word, False) or ends
        out.after_number |= one.after_number
        out.starters |= one.starters
        out.before_number |= one.before_number
    return out


def units(text: str | None, learned: dict[str, Learned]) -> list[tuple[int, int]]:
    """(start, end) of every sentence unit; together they cover all that isn't white space. None for null or blank texts."""
    if not text or not text.strip():
        return []
    lang, evidence = judged_language(text)
    known = learned.get(lang)
    if known is None or not known.abbreviations or not evidence:  # a language hardly seen, or none that can be told: what all say
        known = learned.get("") or _all(learned)
    out = []
    for a, b in paragraphs(text):
        for s, e in cut(text, a, b, known):
            while s < e and text[s].isspace():
                s += 1
            while e > s and text[e - 1].isspace():
                e -= 1
            if s < e:
                out.append((s, e))
    return out


def found(documents: DataFrame) -> DataFrame:
    """``doc_id, start_pos, end_pos`` of every unit of every document; null, empty and blank texts have none."""
    docs = spread(documents.select("doc_id", "text").where(F.col("text").isNotNull()))
    learned = learn(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            ids, starts, ends = [], [], []
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                for s, e in units(text, learned):
                    ids.append(i), starts.append(s), ends.append(e)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["doc_id", "start_pos", "end_pos"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, start_pos int, end_pos int").distinct()
