"""Column functions on text: spaces, quotes, tokens, script language, names, ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that count as spaces or nothing, and punctuation around tokens.
ODD_SPACES = "              　​‌‍﻿"
STRIP = " \t\n.,!?:;\"'()[]{}<>-_*/\\|~`«»„“”‚‘’…–—"


def plain_spaces(s: Column) -> Column:
    """Odd and invisible spaces become spaces, CR LF and CR become LF."""
    return F.regexp_replace(F.translate(s, ODD_SPACES, " " * len(ODD_SPACES)), "\r\n?", "\n")


def plain_quotes(s: Column) -> Column:
    """Angle quotes become double quotes, low and single angle quotes single ones; others stay."""
    return F.translate(s, "«»„‹›", "\"\"'''")


def squeezed(s: Column) -> Column:
    """White space runs become one space; trimmed; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(s, F.lit("")), r"\s+", " "))


def words(s: Column) -> Column:
    """The words of a text; an empty array for blank text."""
    t = squeezed(s)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))


def norm_token(s: Column) -> Column:
    """Lower-cased, without punctuation around it; null is empty."""
    return F.lower(F.btrim(F.coalesce(s, F.lit("")), F.lit(STRIP)))


def is_number(s: Column) -> Column:
    return F.rlike(norm_token(s), F.lit(r"^[0-9]+([.,:/][0-9]+)*%?$"))


def script_lang(s: Column) -> Column:
    """ru or en where one script has at least three letters and twice those of the other, else auto.

    Latin counts code points 0x41-0x7A and 0xC0-0xFF, Cyrillic 0x400-0x4FF. Null is auto.
    """
    t = F.coalesce(s, F.lit(""))
    cyr = F.length(t) - F.length(F.regexp_replace(t, "[Ѐ-ӿ]", ""))
    lat = F.length(t) - F.length(F.regexp_replace(t, "[A-zÀ-ÿ]", ""))
    return F.when(cyr >= F.greatest(F.lit(3), lat * 2), "ru").when(lat >= F.greatest(F.lit(3), cyr * 2), "en").otherwise("auto")


def chapter_no(s: Column) -> Column:
    """The first digit run of a name; null without one."""
    return F.regexp_extract(s, "([0-9]+)", 1).try_cast("long")


def safe_name(s: Column) -> Column:
    """Letters, digits, dot, dash and underscore; the rest one underscore, none at the ends; ``item`` if nothing is left."""
    t = F.btrim(F.regexp_replace(F.coalesce(s, F.lit("")), "[^A-Za-z0-9._-]+", "_"), F.lit("_"))
    return F.when(t == "", "item").otherwise(t)


def flat_key(*parts: Column) -> Column:
    """Key parts joined by an underscore; nulls are left out."""
    return F.concat_ws("_", *parts)


def iso_second(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def job_name(ts: Column, seed: Column) -> Column:
    """YYYY-mm-dd_HH-MM-SS__ and eight hex digits that follow from the seed."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd_HH-mm-ss"), F.lit("__"), F.substring(F.md5(seed.cast("string")), 1, 8))
