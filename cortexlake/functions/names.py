"""What sessions, recordings and results are called: fields read from names, and names made from fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _found(name: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(name, pattern, group), F.lit(""))


def session_id(path: Column) -> Column:
    """The first mouse-and-session id of a path, lower-cased; ``Ignored`` if there is none, null if the path is."""
    return F.when(path.isNotNull(), F.coalesce(F.lower(_found(path, r"(?i)(m\d+s\d+)")), F.lit("Ignored")))


def marked_date(name: Column) -> Column:
    """The ISO date after an exclamation mark, else null."""
    return _found(name, r"!(\d{4}-\d{2}-\d{2})")


def suffix_date(name: Column) -> Column:
    """A final _MMDDYY as 20YY-MM-DD, else null."""
    return F.regexp_replace(_found(name, r"_(\d{6})$"), r"^(\d\d)(\d\d)(\d\d)$", "20$3-$1-$2")


def time_header(ms: Column) -> Column:
    """A column's header for a time: two decimals, ``p`` for the point and ``m`` for the minus."""
    return F.translate(F.format_string("T_%.2fms", ms), ".-", "pm")


def short_numbers(text: Column) -> Column:
    """Numbers of three or four digits, in order, on lines that hold no ``x``."""
    lines = F.filter(F.split(text, "\n"), lambda s: ~s.contains("x"))
    return F.flatten(F.transform(lines, lambda s: F.regexp_extract_all(s, F.lit(r"\b(\d{3,4})\b"))))


def trial(name: Column) -> tuple[Column, Column, Column]:
    """Trial number and the two compared groups of a result's name; null where the name is another."""
    pattern = r"_Trial(\d+)_([^_]+)_vs_([^_.]+)\.png$"
    return _found(name, pattern, 1).cast("int"), _found(name, pattern, 2), _found(name, pattern, 3)


def region_of_lead(name: Column) -> Column:
    """``Side_Region_Ch01`` as ``SideRegion``; other names stay."""
    return F.regexp_replace(name, r"^([A-Za-z]+)_([A-Za-z]+)_Ch\d+$", "$1$2")


def relative_path(path: Column, root: str) -> Column:
    """With forward slashes and without the leading ``root``."""
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(plain.startswith(root), F.substring(plain, F.lit(len(root) + 1), F.length(plain))).otherwise(plain)


def parsed_or_kept(text: Column, pattern: str) -> Column:
    """The date in ISO form, or the text as it is where it can't be read."""
    return F.coalesce(F.date_format(F.try_to_timestamp(text, F.lit(pattern)), "yyyy-MM-dd"), text)


def coded_name(name: Column) -> dict[str, Column]:
    """Fields of ``mWsXpYZ_mmddyy``, each by the first place of its letter: mouse, session, phase, its letter, and date.

    A field that can't be read gives 0, and ``x`` for the letter and ``0`` for the date.
    """
    part = lambda pattern, default: F.coalesce(_found(name, pattern).try_cast("int"), F.lit(default))
    return {
        "mouse": part(r"^[^m]*m(\d+)", 0), "session": part(r"^[^s]*s(\d+)", 0), "phase": part(r"^[^p]*p(\d+)", 0),
        "letter": F.coalesce(_found(name, r"^[^p]*p\d+([a-z])"), F.lit("x")), "date": F.coalesce(_found(name, r"_(\d{6})$"), F.lit("0")),
    }


def card(text: Column) -> dict[str, Column]:
    """Fields of a cage card's text: cage, sex, strain, date of birth and notes, null where they are missing."""
    field = lambda pattern: F.nullif(F.trim(F.regexp_extract(text, pattern, 1)), F.lit(""))
    return {
        "cage": field(r"(FX\d+-\d+)"), "sex": field(r"(?i)sex:?\s*(male|female|[mf])\b"), "strain": field(r"(?s)Strain:?\s*(.*?)\s*(?=DOB|Notes|\z)"),
        "dob": field(r"DOB:?\s*(\d{1,2}/\d{1,2}/\d{2,4})"), "notes": field(r"(?s)Notes:?\s*(.*?)\s*(?=Created|\z)"),
    }


def header_value(text: Column, name: str, default: float) -> Column:
    """A header's number after ``-name``, with or without an exponent; ``default`` where there is none."""
    return F.coalesce(_found(text, rf"-{name}\s+([-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?)").try_cast("double"), F.lit(default))


def posix_path(*parts: Column) -> Column:
    """The parts as one path with forward slashes and none doubled."""
    return F.regexp_replace(F.replace(F.concat_ws("/", *parts), F.lit("\\"), F.lit("/")), "/+", "/")


def is_number(text: Column) -> Column:
    return F.coalesce(text.try_cast("double").isNotNull(), F.lit(False))


def unique_names(name: Column, earlier: Column) -> Column:
    """``name`` with `` (n)`` before its extension, where ``earlier`` rows already have it; else as it is."""
    return F.when(earlier == 0, name).otherwise(F.regexp_replace(name, r"^(.*?)(\.[^.]*)?$", F.concat(F.lit("$1 ("), earlier.cast("string"), F.lit(")$2"))))
