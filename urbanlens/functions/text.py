"""Text expressions: severity, translation, question terms, formatting."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from urbanlens.functions import vocab


def fill(template: str, **values: Column) -> Column:
    """Text from a fixed template: literal pieces and the given columns at their {name} marks."""
    parts = re.split(r"\{(\w+)\}", template)
    cols = [F.lit(p) if i % 2 == 0 else values[p].cast("string") for i, p in enumerate(parts) if i % 2 or p]
    return F.concat(*cols)


def fixed(x: Column, decimals: int) -> Column:
    """Number as text with ``decimals`` places, rounded half-even on the exact binary value
    (the rule of Python's fixed-point formatting); no grouping separators."""
    return F.regexp_replace(F.format_number(x, decimals), ",", "")


def _quoted_alternation(words: list[str]) -> str:
    return "|".join(r"\Q" + w + r"\E" for w in words)


_DANGER_RE = _quoted_alternation(vocab.DANGEROUS_KEYWORDS)


def classify_severity(desc: Column) -> Column:
    """null -> PELIGROSO; upper-case text containing any keyword -> PELIGROSO; else SEGURO."""
    return (
        F.when(desc.isNull(), F.lit(vocab.SEVERITY_DANGEROUS))
        .when(F.upper(desc).rlike(_DANGER_RE), F.lit(vocab.SEVERITY_DANGEROUS))
        .otherwise(F.lit(vocab.SEVERITY_SAFE))
    )


def _ordered_pairs(pairs: list[tuple[str, str]]) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in pairs])


def _first_contained(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Value of the first pair (in list order) whose key occurs in ``text``."""
    hits = F.filter(_ordered_pairs(pairs), lambda p: F.contains(text, p["k"]))
    return F.get(hits, 0)["v"]


def translate_crime(name: Column) -> Column:
    """Spanish label: exact upper-case hit, else first contained key, else the input.

    Empty or null input gives 'Desconocido'.
    """
    up = F.upper(name)
    exact = F.try_element_at(
        F.create_map(*[x for k, v in vocab.CRIME_TRANSLATIONS for x in (F.lit(k), F.lit(v))]), up
    )
    return (
        F.when(name.isNull() | (name == F.lit("")), F.lit(vocab.UNKNOWN_LABEL))
        .otherwise(F.coalesce(exact, _first_contained(up, vocab.CRIME_TRANSLATIONS), name))
    )


def question_crime(text: Column) -> Column:
    """Incident type named in a question: first term (list order) contained in the lower-cased text."""
    return _first_contained(F.lower(text), vocab.QUESTION_TERMS)


def encode_sex(sex: Column) -> Column:
    """F -> 0, M -> 1, anything else (X, unknown codes, null) -> 2."""
    return F.when(sex == "F", 0).when(sex == "M", 1).otherwise(2).cast("int")


def duration_text(minutes: Column) -> Column:
    """'Hh Mmin' from 60 minutes on, else 'M min'."""
    return F.when(
        minutes >= 60, fill(vocab.DURATION_LONG, h=F.floor(minutes / 60), m=F.pmod(minutes, F.lit(60)))
    ).otherwise(fill(vocab.DURATION_SHORT, m=minutes))


def cut_text(text: Column, n: int = 50, ellipsis: bool = True) -> Column:
    """First ``n`` characters; with ``ellipsis`` '...' is added only when text was longer."""
    if not ellipsis:
        return F.substring(text, 1, n)
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def address_key(address: Column) -> Column:
    """Lower-cased address without surrounding white space (lookup key)."""
    return F.regexp_replace(F.lower(address), r"(?U)^\s+|\s+$", "")


def search_text(address: Column) -> Column:
    """Address with the city context appended unless the city is already named."""
    return F.when(F.contains(address, F.lit(vocab.CITY_NAME)), address).otherwise(
        F.concat(address, F.lit(vocab.CITY_SUFFIX))
    )
