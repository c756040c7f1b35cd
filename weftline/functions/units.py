"""Lengths in UTF-16 units, the unit of all thresholds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.kernels import BLANK


def utf16_length(text: Column) -> Column:
    """Length of a text; null counts as 0."""
    # Only texts with characters beyond the basic plane need more than their number of characters.
    beyond = F.when(F.octet_length(text) > F.length(text) + 2, F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))).otherwise(0)
    return F.coalesce(F.length(text) + beyond, F.lit(0))


def js_trim(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANK))


def tokens(text: Column) -> Column:
    """The estimate of tokens: a token for every 3.5 units."""
    return F.ceil(utf16_length(text) / F.lit(3.5)).cast("long")


def djb2(text: Column, prefixed: bool = False) -> Column:
    """The 32-bit hash h = 33 h + unit over UTF-16 units, from 5381; ``prefixed`` puts the length and a colon before the text. Null for null."""
    whole = F.concat(utf16_length(text).cast("string"), F.lit(":"), text) if prefixed else text
    points = F.transform(F.filter(F.split(whole, "", -1), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    step = lambda h, u: (h * 33 + u).bitwiseAND(F.lit(0xFFFFFFFF))
    pair = lambda h, p: step(step(h, F.lit(0xD800) + F.floor((p - 0x10000) / 1024)), F.lit(0xDC00) + (p - 0x10000) % 1024)
    return F.aggregate(points, F.lit(5381).cast("long"), lambda h, p: F.when(p > 0xFFFF, pair(h, p)).otherwise(step(h, p)))
