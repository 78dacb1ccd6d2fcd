"""Lists, hours and payload triples, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def positions_of(values: Column, value: Column) -> Column:
    """Where ``value`` stands in a list, from 0."""
    places = F.transform(values, lambda x, i: F.when(x.eqNullSafe(value), i))
    return F.filter(places, lambda i: i.isNotNull())


def gather(values: Column, places: Column) -> Column:
    """The values at some places, from 0, in their order; null where there is none."""
    return F.transform(places, lambda i: F.get(values, i))


def without_empty(values: Column) -> Column:
    """A list without nulls and empty texts."""
    return F.filter(values, lambda x: x.isNotNull() & (F.length(x) > 0))


def hour_epoch(text: Column) -> Column:
    """Seconds since the epoch of an hour written as ``YYYY-MM-DD H`` or ``HH`` in the session's time zone; null if it isn't one."""
    return F.unix_timestamp(F.try_to_timestamp(text, F.lit("yyyy-MM-dd H")))


def payload_triple(hash_: Column, time: Column, length: Column) -> Column:
    """A packet's payload as sessions keep it: hash, time and length as texts; null without a hash."""
    return F.when(hash_.isNotNull(), F.array(hash_, time.cast("string"), length.cast("string")))


def sorted_payloads(items: Column, by: str = "size", legacy: bool = True) -> Column:
    """Payload triples in order of their length (``size``) or ``time``; as texts, so that 1000 comes before 99, or as numbers."""
    at = {"size": 2, "time": 1}[by]

    def key(x: Column) -> Column:
        value = F.get(x, F.lit(at))
        return value if legacy else value.try_cast("double")

    numbered = F.transform(items, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(numbered), lambda y: y["x"])


def any_begins(payloads: Column, marker: str) -> Column:
    """Whether the first line of any payload (bytes or text) holds the marker; false for null, empty lists and null payloads.

    That is how a pattern ``.*marker`` matches from a payload's start: its dot stops at the end of the line.
    """
    pattern = r"^[^\n]*" + "".join(f"\\x{{{ord(c):x}}}" for c in marker)
    return F.coalesce(F.exists(payloads, lambda p: F.coalesce(F.decode(p.cast("binary"), "ISO-8859-1").rlike(pattern), F.lit(False))), F.lit(False))
