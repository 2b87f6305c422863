"""Text pieces of entities for search: tokens, JSON leaves, JSON as text."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Types as objects: workers import this module, and they have no session to parse text with.
_LEAF = T.StructType([T.StructField("path", T.StringType()), T.StructField("value", T.StringType())])

# Words that search ignores.
STOP_WORDS = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "as", "is", "was", "are", "were", "been", "be",
    "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "must", "can", "this", "that", "these", "those",
    "i", "you", "he", "she", "it", "we", "they",
)


def tokens(text: Column) -> Column:
    """Distinct words of more than two characters that are no stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\w+)"), 1)
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS)))


def words(text: Column) -> Column:
    """Lower-case words between white space, repeats kept."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def python_tokens(text: str) -> list[str]:
    """``tokens`` of a query given as a Python string."""
    import re

    return sorted({t for t in re.findall(r"\w+", text.lower()) if len(t) > 2 and t not in STOP_WORDS})


def _walk(value, path, out):
    if isinstance(value, str):
        out.append({"path": path, "value": value})
    elif isinstance(value, dict):
        for k, v in value.items():
            _walk(v, f"{path}.{k}" if path else k, out)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            _walk(v, f"{path}[{i}]", out)
    return out


@F.pandas_udf(T.ArrayType(_LEAF))
def leaves(content: pd.Series) -> pd.Series:
    """All strings of JSON content at any depth, with their paths.  JSON of
    unknown depth has no built-in walk; compute this once, when data comes in."""
    return content.map(lambda c: _walk(json.loads(c), "", []) if c else [])


@F.pandas_udf(T.StringType())
def content_text(content: pd.Series) -> pd.Series:
    """Lower-case JSON text with ", " and ": " and escapes for non-ASCII."""
    return content.map(lambda c: json.dumps(json.loads(c)).lower() if c else "")


@F.pandas_udf(T.DoubleType())
def match_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """difflib's ratio of two strings, in this order."""
    from difflib import SequenceMatcher

    known: dict = {}

    def ratio(x, y):
        if (x, y) not in known:
            known[x, y] = SequenceMatcher(None, x, y).ratio()
        return known[x, y]

    return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


def content_preview(content: Column) -> Column:
    """First three keys with their values cut to 50 characters, then dots; null
    for content without keys (PRJ5)."""
    keys = F.json_object_keys(content)
    shown = F.transform(F.slice(keys, 1, 3), lambda k: F.concat(k, F.lit(": "), F.substring(F.element_at(F.from_json(content, "map<string,string>"), k), 1, 50)))
    return F.when(F.size(keys) > 0, F.concat(F.array_join(shown, ", "), F.lit("...")))
