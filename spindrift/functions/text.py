"""Text and scalar functions as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_MARK, _PART = "\x01", "\x02"


def cleaned(value: Column) -> Column:
    """Leading separators and trailing punctuation off."""
    return F.regexp_replace(F.regexp_replace(value, r"^[\s:：=\-,，;；|/]+", ""), r"[\s,，;；|/]+$", "")


def labelled_fields(text: Column, labels: Mapping[str, Sequence[str]]) -> Column:
    """map<field, value> of `label: value` runs anywhere in a text; a value runs to the next label, the last of a field wins.

    A label counts only where no letter, digit or underscore stands before it. Longer labels are tried first. The
    fields found are the map's keys; absent ones are not in it.
    """
    aliases = sorted(((a, k) for k, names in labels.items() for a in names), key=lambda x: (-len(x[0]), x[0]))
    any_label = "|".join(re.escape(a) for a, _ in aliases)
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), rf"(?iU)(?<!\w)({any_label})\s*[:：=]?\s*", f"{_MARK}$1{_PART}")
    parts = F.filter(F.split(marked, _MARK), lambda p: p.contains(_PART))
    label = lambda p: F.lower(F.substring_index(p, _PART, 1))
    key = lambda p: F.coalesce(*[F.when(label(p) == a.lower(), k) for a, k in aliases])
    pairs = F.transform(parts, lambda p: F.struct(key(p).alias("key"), cleaned(F.substring_index(p, _PART, -1)).alias("value")))
    names = F.array(*[F.lit(k) for k in labels])
    found = F.filter(names, lambda n: F.exists(pairs, lambda p: p["key"] == n))
    last = lambda n: F.element_at(F.filter(pairs, lambda p: p["key"] == n), -1)["value"]
    return F.map_from_arrays(found, F.transform(found, last))


def is_record(fields: Column, required: str, least: int = 3) -> Column:
    """The required field and at least so many fields are there."""
    return F.array_contains(F.map_keys(fields), required) & (F.size(fields) >= least)


def short_query(text: Column, pattern: str, longest: int = 120) -> Column:
    trimmed = F.trim(F.coalesce(text, F.lit("")))
    return (trimmed != "") & (F.length(trimmed) <= longest) & trimmed.rlike(pattern)


def squeezed_contains(text: Column, words: Sequence[str]) -> Column:
    """Any of the words in the text without white space, lower-cased."""
    squeezed = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", ""))
    return squeezed.rlike("|".join(re.escape(w) for w in words))


def flat_text(parts: Column) -> Column:
    """Concatenation of array<struct<text, href>>: text, else href, of each part."""
    return F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], p["href"], F.lit(""))), "")


def clipped(text: Column, longest: int = 1000) -> Column:
    return F.when(F.length(text) > longest, F.concat(F.substring(text, 1, longest - 3), F.lit("..."))).otherwise(text)


def identifier(text: Column) -> Column:
    return F.regexp_replace(F.upper(text), "[^A-Z0-9]", "")


def first_code(text: Column, patterns: Sequence[str], low: int = 6, high: int = 24) -> Column:
    """The first pattern's first group, normalised, whose length is within bounds."""
    found = [identifier(F.regexp_extract(text, p, 1)) for p in patterns]
    return F.coalesce(*[F.when(F.length(x).between(low, high), x) for x in found])


def object_key(name: Column, folder: str = "images") -> Column:
    return F.concat(F.lit(folder + "/"), F.substring(F.regexp_replace(name, r"[^A-Za-z0-9_.\-]", ""), 1, 80), F.lit(".jpg"))


def escaped(text: Column) -> Column:
    """Backslash before the marks of light markup."""
    return F.regexp_replace(text, r"([\\*_`\[])", r"\\$1")


def parsed_date(text: Column) -> Column:
    """`dd.MM.yyyy HH:mm:ss`, a zone behind it dropped, or ISO; else null."""
    plain = F.regexp_replace(text, r"\s+UTC[+-]\d{2}:?\d{2}$", "")
    return F.coalesce(F.try_to_timestamp(plain, F.lit("dd.MM.yyyy HH:mm:ss")), F.try_to_timestamp(text))


def conflicts(left: Mapping[str, Column], right: Mapping[str, Column]) -> Column:
    """array<struct<field, existing, incoming>> of fields that both have and that differ."""
    every = F.array(*[F.struct(F.lit(k).alias("field"), F.coalesce(left[k], F.lit("")).alias("existing"), F.coalesce(right[k], F.lit("")).alias("incoming")) for k in left])
    return F.filter(every, lambda x: (x["existing"] != "") & (x["incoming"] != "") & (x["existing"] != x["incoming"]))


def agreement(left: Mapping[str, Column], right: Mapping[str, Column], points: int = 20) -> Column:
    """points for each field that both have alike."""
    one = lambda k: F.when((F.coalesce(left[k], F.lit("")) != "") & (left[k] == right[k]), points).otherwise(0)
    return sum((one(k) for k in left), F.lit(0))
