"""Catalyst expressions for the scalar functions that need no Python worker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from veilspark.functions.validators import TEST_CARDS, TOLL_FREE


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def entropy(value: Column | str) -> Column:
    """Shannon entropy in bits per character; null for null, 0 for the empty string."""
    v = _col(value)
    letters = F.split(v, "")
    n = F.length(v).cast("double")
    parts = F.transform(F.array_distinct(letters), lambda ch: F.size(F.filter(letters, lambda x: x == ch)) / n)
    return F.when(F.length(v) == 0, F.lit(0.0)).otherwise(F.aggregate(parts, F.lit(0.0), lambda acc, p: acc - p * F.log2(p)))


def mask(value: Column | str, ftype: Column | str) -> Column:
    """Enough of a value to tell findings apart: nothing of one character, the first of names and short values, else two and two."""
    v = _col(value)
    short = (_col(ftype) == "person_name") | (F.length(v) < 8)
    return F.when(F.length(v) < 2, F.lit("…")).when(short, F.concat(F.substring(v, 1, 1), F.lit("…"))).otherwise(F.concat(F.substring(v, 1, 2), F.lit("…"), F.right(v, F.lit(2))))


def line_number(text: Column | str, start: Column | str) -> Column:
    """1-based line of a 0-based position in code points."""
    head = F.substring(_col(text), F.lit(1), _col(start))
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


def digits(value: Column | str) -> Column:
    return F.regexp_replace(_col(value), "[^0-9]", "")


def real_card(value: Column | str) -> Column:
    """Luhn's check without published test numbers and their pieces of twelve digits or more."""
    d = digits(value)
    test = F.exists(F.array(*map(F.lit, TEST_CARDS)), lambda card: F.when(F.length(d) >= 12, card.contains(d)).otherwise(card == d))
    return F.coalesce(F.call_function("luhn_check", d), F.lit(False)) & ~test


def us_phone(value: Column | str) -> Column:
    d = F.right(digits(value), F.lit(10))
    fiction = (F.substring(d, 4, 3) == "555") & ((F.substring(d, 7, 4) == "1212") | (F.substring(d, 7, 2) == "01"))
    return (F.length(d) == 10) & (F.substring(d, 1, 3) != "555") & ~fiction & ~F.substring(d, 1, 3).isin(*sorted(TOLL_FREE))


def normal_value(value: Column | str, ftype: Column | str) -> Column:
    """Value for comparison: phones and numbers without separators, mail in small letters, others with single spaces."""
    v, t = _col(value), _col(ftype)
    return F.when(t.isin("phone", "number"), F.regexp_replace(v, r"[\s\-().]", "")).when(t == "email", F.lower(v)).otherwise(F.trim(F.regexp_replace(v, r"\s+", " ")))


def finding_key(value: Column | str, ftype: Column | str) -> Column:
    v = F.trim(_col(value))
    return F.lower(F.when(_col(ftype).isin("phone", "number"), F.regexp_replace(v, r"[\s\-().]", "")).otherwise(v))


def offsets(text: Column | str, pattern: str) -> Column:
    """array<struct<start,end,value>> of all matches of a Java pattern that can't match nothing, in code points.

    Positions are summed from the pieces between matches, as no built-in returns them.
    """
    t = _col(text)
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def sums(x: Column) -> Column:
        def add(acc: Column, k: Column) -> Column:
            start = acc["at"] + F.length(F.element_at(x["pieces"], k))
            value = F.element_at(x["found"], k)
            one = F.struct(start.cast("int").alias("start"), (start + F.length(value)).cast("int").alias("end"), value.alias("value"))
            return F.struct((start + F.length(value)).alias("at"), F.array_append(acc["out"], one).alias("out"))

        zero = F.struct(F.lit(0).cast("int").alias("at"), empty.alias("out"))
        return F.when(F.size(x["found"]) > 0, F.aggregate(F.sequence(F.lit(1), F.size(x["found"])), zero, add)["out"]).otherwise(empty)

    # bound as a lambda's variable, so that the text is matched once and not once a match
    both = F.array(F.struct(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("found"), F.split(t, pattern, -1).alias("pieces")))
    return F.flatten(F.transform(both, sums))


def validated(df: DataFrame, name: str, value: str) -> DataFrame:
    """The rows with ``ok``: whether the validator that ``name`` names takes ``value``. A null value or an unknown name gives null."""
    import pyarrow as pa

    from veilspark.functions.validators import VALIDATORS

    def run(batches):
        for b in batches:
            pairs = zip(b.column(name).to_pylist(), b.column(value).to_pylist(), strict=True)
            ok = [None if v is None or n not in VALIDATORS else bool(VALIDATORS[n](v)) for n, v in pairs]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ok, pa.bool_())], [*b.schema.names, "ok"])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField("ok", BooleanType())]))
