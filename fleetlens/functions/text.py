"""Blank tests, joined parts and wildcard patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_blank(c: Column) -> Column:
    """Null, empty or nothing but white space."""
    return ~F.coalesce(c.rlike(r"\S"), F.lit(False))


def is_empty(c: Column) -> Column:
    return F.coalesce(c == "", F.lit(True))


def join_parts(*parts: Column, required: tuple[Column, ...] = ()) -> Column:
    """Lower-cased non-empty parts joined by dashes; null when a required part is null."""
    joined = F.concat_ws("-", *[F.nullif(F.lower(p), F.lit("")) for p in parts])
    for part in required:
        joined = F.when(part.isNotNull(), joined)
    return joined


def messages(*pairs: tuple[Column, Column | str]) -> Column:
    """Array of the messages whose condition holds."""
    picked = [
        F.when(condition, F.lit(text) if isinstance(text, str) else text)
        for condition, text in pairs
    ]
    return F.array_compact(F.array(*picked))


def wildcard(pattern: Column, ignore_case: bool = False) -> Column:
    """A pattern with ``*`` and ``?`` prepared for :func:`matches`.

    The pattern is cut at its stars. ``first`` and ``last`` are what a value must begin and
    end with, ``middle`` what must occur between them in order; without a star ``first`` is
    the whole. Only a pattern with ``?`` has a ``regex``.
    """
    text = F.lower(pattern) if ignore_case else pattern
    pieces = F.split(text, r"\*")
    quoted = F.regexp_replace(text, r"([\\.\[\]{}()+^$|])", r"\\$1")
    regex = F.concat(
        F.lit("(?s)^"),
        F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")),
        F.lit("$"),
    )
    between = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 2, F.lit(0)))
    return F.struct(
        F.get(pieces, F.lit(0)).alias("first"),
        F.element_at(pieces, -1).alias("last"),
        F.filter(between, lambda piece: piece != "").alias("middle"),
        (F.size(pieces) > 1).alias("star"),
        F.when(F.contains(text, F.lit("?")), regex).alias("regex"),
    )


def matches(value: Column, prepared: Column, ignore_case: bool = False) -> Column:
    """Does ``value`` match a pattern prepared by :func:`wildcard`? Null never matches."""
    text = F.lower(value) if ignore_case else value
    first, last = prepared["first"], prepared["last"]

    def after(place: Column, piece: Column) -> Column:
        found = F.call_function("locate", piece, text, place)
        return F.when((place > 0) & (found > 0), found + F.length(piece)).otherwise(0)

    place = F.aggregate(prepared["middle"], F.length(first) + 1, after)
    around = F.startswith(text, first) & F.endswith(text, last)
    with_star = around & (place > 0) & (place <= F.length(text) - F.length(last) + 1)
    plain = F.when(prepared["star"], with_star).otherwise(text == first)
    return F.coalesce(F.when(prepared["regex"].isNull(), plain).otherwise(F.rlike(text, prepared["regex"])), F.lit(False))
