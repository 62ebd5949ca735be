"""What built-in functions can't express, in Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import plain


def _rows(**fields) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(k, v()) for k, v in fields.items()]))


#: Types are objects, as names of types can't be read before there is a session.
DIFF_TYPE = _rows(kind=T.StringType, start=T.IntegerType, end=T.IntegerType, text=T.StringType)
SPAN_TYPE = _rows(start=T.IntegerType, end=T.IntegerType)


@F.pandas_udf(T.StringType())
def fold(text: pd.Series) -> pd.Series:
    """folded() with the characters that have a compatible single one."""
    return text.map(plain.fold, na_action="ignore")


@F.pandas_udf(DIFF_TYPE)
def diff(old: pd.Series, new: pd.Series) -> pd.Series:
    names = ("kind", "start", "end", "text")
    return pd.Series([[dict(zip(names, x)) for x in plain.diff(a or "", b or "")] for a, b in zip(old, new)], dtype=object)


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([plain.similarity(x or "", y or "") for x, y in zip(a, b)], dtype=float)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def longest_rising(values: pd.Series) -> pd.Series:
    return values.map(lambda v: plain.longest_rising([int(x) for x in v]), na_action="ignore")


@F.pandas_udf(SPAN_TYPE)
def pattern_spans(text: pd.Series, pattern: pd.Series) -> pd.Series:
    """Spans of a Python pattern's matches that aren't empty."""
    import re

    return pd.Series([[{"start": m.start(), "end": m.end()} for m in re.finditer(p, t or "") if m.end() > m.start()] for t, p in zip(text, pattern)], dtype=object)
