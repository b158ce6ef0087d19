"""Surrogate keys and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def name_key(name: Column) -> Column:
    """Key of a company or sector: md5 of the trimmed lower-case name."""
    return F.md5(F.lower(F.trim(name)))


def date_key(day: Column) -> Column:
    return F.md5(day.cast("string"))


def pair_key(name: Column, day: Column) -> Column:
    return F.md5(F.concat(name, F.lit("|"), day.cast("string")))


def article_id(symbol: Column, published: Column, *body: Column) -> Column:
    """symbol::published::twelve digits of the md5 of what identifies the body; nulls count as empty."""
    text = F.concat_ws("|", *[F.coalesce(b, F.lit("")) for b in body])
    empty = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.concat_ws("::", empty(symbol), empty(published), F.substring(F.md5(text), 1, 12))


def chunk_key(kind: Column, symbol: Column, day: Column, accession: Column, index: Column) -> Column:
    """kind-symbol-date-last six characters of the accession without dashes-c and two digits or more of the index."""
    bare = F.replace(accession, F.lit("-"), F.lit(""))
    tail = F.coalesce(F.when(F.length(bare) > 0, F.right(bare, F.lit(6))), F.lit("000000"))
    return F.concat(F.concat_ws("-", kind, symbol, day.cast("string"), tail), F.format_string("-c%02d", index))


def sanitised(name: str) -> str:
    """A column name: lower case, other than letters, digits and underscores replaced, never led by a digit."""
    clean = "".join(c.lower() if c.isalnum() or c == "_" else "_" for c in name)
    return f"_{clean}" if clean[:1].isdigit() else clean
