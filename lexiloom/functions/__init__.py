"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"\w+|[^\w\s]"
TERM = r"[\p{L}\p{N}]+"


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays, in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The array over its length; null for a zero vector."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where either vector is zero or null."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def token_count(text: Column) -> Column:
    """Words and punctuation marks; stands in for a byte-pair count."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0))


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits of any script."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), 0)


def lookup(values: Mapping[str, float | int | str], key: Column, default=None) -> Column:
    """A small mapping as an expression."""
    table = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))])
    got = F.try_element_at(table, key)
    return got if default is None else F.coalesce(got, F.lit(default))


#: White space of any script: what a regular expression's (?U)\\s is.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Removes white space of any script at both ends (which alone are looked at)."""
    return F.btrim(text, F.lit(SPACES))


def blank_to_null(text: Column) -> Column:
    return F.when(F.length(F.trim(text)) > 0, text)
