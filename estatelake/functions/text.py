"""Text helpers shared by the other function modules."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Java's (?U) makes \s cover the ideographic and no-break blanks that appear in Japanese pages.
BLANK = r"(?U)\s"


@F.arrow_udf(StringType())
def nfkc(texts: pa.Array) -> pa.Array:
    """Unicode compatibility folding, which Spark has no builtin for. Apply it to distinct names where possible."""
    return pa.array(
        [None if t is None else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], type=pa.string()
    )


def trim_all(c: Column) -> Column:
    return F.regexp_replace(c, BLANK.replace(r"\s", r"^\s+|\s+$"), "")


def collapse_ws(c: Column) -> Column:
    return trim_all(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def strip_brackets(c: Column) -> Column:
    return trim_all(F.regexp_replace(c, r"\[[^\]]*\]", ""))


def filled(c: Column) -> Column:
    """The text, or null where it is empty: an empty text counts as missing everywhere."""
    return F.when(c != "", c)


def first_filled(*cols: Column) -> Column:
    return F.coalesce(*[filled(c) for c in cols])


def split_csv(c: Column) -> Column:
    return F.filter(
        F.transform(F.split(F.coalesce(c, F.lit("")), ","), trim_all), lambda x: x != ""
    )


def digits(c: Column, pattern: str, group: int = 1, kind: str = "long") -> Column:
    """First regexp group as a number, 0 where the pattern is absent."""
    return F.coalesce(F.regexp_extract(c, pattern, group).try_cast(kind), F.lit(0).cast(kind))


def name_key(c: Column) -> Column:
    """Comparison key of a name: names that differ by width or case only are the same name."""
    return F.lower(nfkc(c))
