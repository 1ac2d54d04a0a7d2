"""Column expressions over text: signatures, names, lines, slugs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without outer white space of any kind (``trim`` takes only plain spaces)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def filled(c: Column) -> Column:
    """Null instead of the empty string."""
    return F.when(c != "", c)


def signature(c: Column) -> Column:
    """First 16 hex digits of the SHA-256 of a text, null counting as empty."""
    return F.substring(F.sha2(F.coalesce(c, F.lit("")), 256), 1, 16)


def aliases(name: Column, face_names: Column) -> Column:
    """Lower-case name, then its faces' names in order, each once; nulls and blanks dropped; never null."""
    every = F.concat(F.array(F.lower(name)), F.transform(F.coalesce(face_names, F.array().cast("array<string>")), F.lower))
    return F.array_distinct(F.filter(every, lambda x: x.isNotNull() & (x != "")))


def face_value(top: Column, faces: Column, field: str, sep: str = " // ") -> Column:
    """The record's own value if it has one, or no faces; else its faces' values joined, null ones as empty."""
    n = F.size(F.coalesce(faces, F.array()))
    joined = F.array_join(F.transform(faces, lambda f: F.coalesce(f[field], F.lit(""))), sep)
    return F.when((top != "") | (n <= 0), top).when(n > 0, joined)


def face_text(top: Column, faces: Column, field: str, sep: str = "\n---\n") -> Column:
    """As ``face_value``, but an empty value of the record's own counts; only a null one falls back to the faces."""
    joined = F.array_join(F.transform(faces, lambda f: F.coalesce(f[field], F.lit(""))), sep)
    return F.when(top.isNull() & (F.size(faces) > 0), joined).otherwise(top)


def described(label: Column, slug: Column, description: Column) -> Column:
    """The text of a tag: its label, else its slug, else nothing; and its description after a full stop."""
    head = F.coalesce(filled(label), slug, F.lit(""))
    return F.when(description != "", F.concat(head, F.lit(". "), description)).otherwise(head)


def slug(c: Column, strict: bool = True) -> Column:
    """Lower case, without apostrophes, runs of anything but a-z and 0-9 as one hyphen, none outside.

    A name that leaves nothing is an error, or null where ``strict`` is off.
    """
    s = F.trim(F.regexp_replace(F.translate(F.lower(c), "'’", ""), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(c.isNull() | (s != ""), s).otherwise(F.raise_error(F.concat(F.lit("no slug in "), c)).cast("string") if strict else F.lit(None).cast("string"))


def deck_name(line: Column) -> Column:
    """The name on a line of a list: without sideboard mark, count, and a set in brackets with its number at the end.

    Null for blank lines and comments, and where nothing is left.
    """
    s = strip(line)
    n = F.regexp_replace(s, r"(?iU)^\s*SB:\s*", "")
    n = F.regexp_replace(n, r"(?iU)^\s*\d+x?\s+", "")
    n = F.regexp_replace(n, r"(?U)\s*\([^)]+\)(?:\s+\S+)?\s*$", "")
    return F.when((s == "") | s.startswith("#"), None).otherwise(filled(strip(n)))


def head_of(values: Column, n: int) -> Column:
    """The first n values joined, and how many more there are, as one more item of the list."""
    k = F.size(values)
    return F.concat(F.array_join(F.slice(values, 1, n), ", "), F.when(k > n, F.concat(F.lit(", (+"), (k - n).cast("string"), F.lit(" more)"))).otherwise(""))


def split_option(value: str | None, default: list[str] | None = None) -> list[str] | None:
    """A comma-separated option: None is the default, the empty string the empty list."""
    if value is None:
        return default
    return [part for part in (x.strip() for x in value.split(",")) if part]
