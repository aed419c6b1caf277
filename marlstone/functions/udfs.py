"""The few functions that built-ins cannot express, as Arrow-batched pandas UDFs."""

from __future__ import annotations

import html
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """Compatibility normalisation. ASCII text, which it leaves alone, never goes to Python."""
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(_nfkc(text))


@F.pandas_udf(T.StringType())
def _unescape(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else html.unescape(t))


def html_unescape(text: Column) -> Column:
    """All named and numbered character references. Texts without an ampersand, nearly all, get an
    empty text to work on in Python and stay as they are."""
    marked = text.contains("&")
    return F.when(marked, _unescape(F.when(marked, text))).otherwise(text)


@F.pandas_udf(T.StringType())
def title_case(text: pd.Series) -> pd.Series:
    """Capital after every sign that is not a letter."""
    return text.map(lambda t: None if t is None else t.title())


@F.pandas_udf(T.DoubleType())
def _matched_share(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, a, b).ratio() if a and b else 0.0 for a, b in zip(left, right, strict=True)], dtype="float64")


#: Share of matching blocks of two texts (Ratcliff and Obershelp; the order of the two matters; an
#: empty or null side gives 0). Marked so that a filter on the result does not run it twice.
matched_share = _matched_share.asNondeterministic()
