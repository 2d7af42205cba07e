"""Text normalisation shared by the operators. All of it is built in and runs in generated code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The whitespace that counts as blank, the ATC letters, the levels.
BLANKS = " \t\r\n"
ATC = "ABCDGHJLMNPRSV"
LEVELS = ("major", "moderate", "minor")


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(c: Column | str) -> Column:
    return F.btrim(column(c), F.lit(BLANKS))


def is_blank(c: Column | str) -> Column:
    """True for null, empty or whitespace only; never null."""
    return F.coalesce(trimmed(c) == "", F.lit(True))


def filled(c: Column | str) -> Column:
    """Trimmed; null where blank."""
    return F.nullif(trimmed(c), F.lit(""))


def folded(c: Column | str) -> Column:
    return F.lower(trimmed(c))


def bare(c: Column | str) -> Column:
    """Only letters and digits, lower case; null as empty."""
    return F.lower(F.regexp_replace(F.coalesce(column(c), F.lit("")), r"[^\p{L}\p{Nd}]", ""))


def valid_drug_id(c: Column | str) -> Column:
    """Whether the bare id is ddinter and digits; never null."""
    return bare(c).rlike(r"^ddinter[0-9]+\z")


def usable_level(c: Column | str, unknown: bool = False) -> Column:
    return F.coalesce(folded(c).isin(*LEVELS, *["unknown"] * unknown), F.lit(False))


def usable_source(c: Column | str) -> Column:
    return F.coalesce(folded(c).rlike(rf"^ddinter_downloads_code_[{ATC.lower()}]\.csv\z"), F.lit(False))


def usable_atc(c: Column | str) -> Column:
    return F.coalesce(folded(c).rlike(rf"^[{ATC.lower()}]\z"), F.lit(False))


def search_term(c: Column | str) -> Column:
    """Lower case, hyphens and underscores as spaces, runs of whitespace as one."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(column(c))), "[-_]+", " "), r"\s+", " "))


def compound_id(c: Column | str) -> Column:
    """An id of a compound in any case, with or without its prefix, as Compound::DB and digits; others trimmed, in lower case."""
    t = trimmed(c)
    digits = F.regexp_extract(t, r"(?i)^(?:compound::)?DB(\d{5,})\z", 1)
    return F.when(digits != "", F.concat(F.lit("Compound::DB"), digits)).otherwise(F.lower(t))


def mask(c: Column | str) -> Column:
    """The character classes of a value: A, a, 9 for runs of upper case, lower case and digits; other signs as they are."""
    out = column(c)
    for runs, sign in ((r"\p{Lu}+", "A"), (r"\p{Ll}+", "a"), (r"[\p{Lo}\p{Lm}\p{Lt}]+", "o"), (r"\p{Nd}+", "9"), (r"\s+", " ")):
        out = F.regexp_replace(out, runs, sign)
    return out
