"""Addresses, protocol paths and payload bytes, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ip_to_long(ip: Column) -> Column:
    """Dotted IPv4 text as a number; null for null and for whatever isn't four numbers, such as an IPv6 address."""
    parts = F.split(ip, r"\.")
    return F.when(F.size(parts) == 4, F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a * 256 + x.try_cast("long")))


def cidr_range(cidr: Column) -> tuple[Column, Column]:
    """First and last address of ``a.b.c.d/n``; null if it isn't one."""
    base, bits = ip_to_long(F.try_element_at(F.split(cidr, "/"), F.lit(1))), F.try_element_at(F.split(cidr, "/"), F.lit(2)).try_cast("int")
    bits = F.when(bits.between(0, 32), bits)
    size = F.pow(F.lit(2), F.lit(32) - bits).cast("long")
    first = base - F.pmod(base, size)
    return first, first + size - 1


def _is_lower(a: Column, b: Column) -> Column:
    """By number; where one has none, by text."""
    return F.coalesce(ip_to_long(a) < ip_to_long(b), a < b)


def lower_ip(a: Column, b: Column) -> Column:
    """The numerically smaller of two addresses."""
    return F.when(_is_lower(a, b), a).otherwise(b)


def higher_ip(a: Column, b: Column) -> Column:
    return F.when(_is_lower(b, a), a).otherwise(b)


def common_prefix(low: Column, high: Column) -> Column:
    """The longest common prefix of two texts; of a set's smallest and largest, that of all."""
    unequal = F.filter(F.sequence(F.lit(1), F.least(F.length(low), F.length(high))), lambda i: F.substr(low, i, F.lit(1)) != F.substr(high, i, F.lit(1)))
    shorter = F.least(F.length(low), F.length(high))
    end = F.when(shorter == 0, F.lit(0)).otherwise(F.coalesce(F.try_element_at(unequal, F.lit(1)) - 1, shorter))
    return F.substr(low, F.lit(1), end)


def hex_text(payload: Column) -> Column:
    """Text of colon-separated hex bytes, with a space for each CR, LF and TAB."""
    return F.translate(F.decode(F.unhex(F.regexp_replace(payload, ":", "")), "ISO-8859-1"), "\r\n\t", "   ")


def cluster_part(cluster_id: Column, part: str) -> Column:
    """``day`` (last two characters of the date), ``number`` or ``protocol`` of ``date_number_protocol``."""
    tokens = F.split(cluster_id, "_")
    return {"day": F.right(F.element_at(tokens, 1), F.lit(2)), "number": F.try_element_at(tokens, F.lit(2)), "protocol": F.element_at(tokens, -1)}[part]
