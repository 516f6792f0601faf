"""Scalar functions over columns: values in text, keys, names, bounds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a checkable value.
#: In parity mode the suffix of an amount may be the first letter of the next word: $5 by June is five billion.
LOOSE_DOLLARS = r"(?i)\$\s*\d+(?:\.\d+)?\s*[BMK]|\$\s*[\d,]+(?:\.\d+)?|\d+(?:,\d{3})+\s*(?:dollars|USD)"
DOLLARS = r"(?i)\$\s*\d+(?:\.\d+)?\s*[BMK]\b|\$\s*[\d,]+(?:\.\d+)?|\d+(?:,\d{3})+\s*(?:dollars|USD)"
PERCENTS = r"(?i)\d+(?:\.\d+)?\s*%|\d+(?:\.\d+)?\s*percent"
DATES = r"(?i)(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2}(?:st|nd|rd|th)?,?\s*\d{4}|\d{1,2}/\d{1,2}/\d{2,4}|\d{4}-\d{2}-\d{2}"
SECTIONS = r"(?i)(?:Section|Article|Clause|Exhibit|Schedule)\s+[\d.]+(?:\([a-z]\))?"
UNITS = r"(?i)\b\d+(?:,\d{3})*(?:\.\d+)?\s*(?:days?|months?|years?|shares?)\b"
STOP_WORDS = "the a an is are was were be been of in to for with on at by from and or not that this but if as has had have will shall may must should".split()


#: Characters whose upper case is longer than themselves but has a form of one character too (ß: ẞ), with that form.
SHORT_UPPER = {c.lower(): c for c in map(chr, range(0x110000)) if len(c.lower()) == 1 and c.lower() != c and len(c.lower().upper()) > 1}


def upper_each(text: Column) -> Column:
    """Upper case of each character by itself: none becomes two (ß turns into ẞ, not into SS), so lower case brings the text back."""
    short = F.translate(text, "".join(SHORT_UPPER), "".join(SHORT_UPPER.values()))
    one = lambda x: F.when(F.length(F.upper(x)) == 1, F.upper(x)).otherwise(x)
    return F.array_join(F.transform(F.regexp_extract_all(short, F.lit("(?s)."), 0), one), "")


def all_matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), 0)


def amount(raw: Column) -> Column:
    """The amount of a text such as ``$1.5M``, fractions of a dollar included; null if it is no number."""
    s = F.lower(F.regexp_replace(raw, r"[$, ]", ""))
    suffix = F.substring(s, -1, 1)
    factor = F.when(suffix == "k", 1_000).when(suffix == "m", 1_000_000).when(suffix == "b", 1_000_000_000)
    number = F.when(factor.isNotNull(), F.substring(s, F.lit(1), F.length(s) - 1)).otherwise(s)
    return number.try_cast("double") * F.coalesce(factor, F.lit(1))


def dollars(raw: Column) -> Column:
    """Whole dollars of a text such as ``$1.5M``; the fraction is cut; null if it is no number."""
    return F.floor(amount(raw)).cast("long")


def number(raw: Column, parity: bool = False) -> Column:
    """A number in text: an amount first, then a percentage as a share, then the first number. In parity mode the
    fraction of a plain number is cut, as it is read as whole dollars."""
    first = F.nullif(F.regexp_extract(F.regexp_replace(raw, ",", ""), r"-?\d+(?:\.\d+)?", 0), F.lit("")).try_cast("double")
    plain = dollars(raw).cast("double") if parity else amount(raw)
    return F.coalesce(plain, F.when(raw.rlike("%"), first / 100), first)


def checkable_values(text: Column, parity: bool = False) -> Column:
    """Array of (type, raw, canonical) of all checkable values. In parity mode an amount takes the next word's first letter for its suffix."""
    kinds = (("dollar", LOOSE_DOLLARS if parity else DOLLARS), ("percent", PERCENTS), ("date", DATES), ("section_ref", SECTIONS), ("number_unit", UNITS))
    none = F.lit(None).cast("long")

    def found(kind: str, pattern: str) -> Column:
        return F.transform(all_matches(text, pattern), lambda m: F.struct(F.lit(kind).alias("type"), F.trim(m).alias("raw"), (dollars(m) if kind == "dollar" else none).alias("canonical")))

    return F.concat(*[found(kind, pattern) for kind, pattern in kinds])


def context_words(text: Column, most: int = 5) -> Column:
    """The first words of three letters or more that aren't stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z]{3,}"), 0)
    return F.slice(F.filter(words, lambda w: ~w.isin(STOP_WORDS)), 1, most)


def word_markers(text: Column, stop: list[str], most: int = 12) -> Column:
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z][a-z0-9_-]{3,}"), 0))
    return F.slice(F.filter(words, lambda w: ~w.isin(stop)), 1, most)


def section_key(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "))


def task_key(task: Column) -> Column:
    return F.regexp_replace(task, "/scenario-[0-9]+$", "")


def family(task: Column) -> Column:
    return F.element_at(F.split(task, "/"), 1)


def sheet_name(name: Column) -> Column:
    return F.substring(F.regexp_replace(name, r"[\[\]:*?/\\]", "_"), 1, 31)


def snapshot_label(name: Column) -> Column:
    return F.substring(F.regexp_replace(name, "[^A-Za-z0-9_-]+", "_"), 1, 50)


def size_bound(text: Column, envelope: int = 200, output: int = 16_384) -> tuple[Column, Column]:
    """Bytes of a request with its envelope; with the largest reply as well."""
    size = F.octet_length(text).cast("long")
    return size + envelope, size + envelope + output
