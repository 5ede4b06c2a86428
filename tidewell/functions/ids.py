"""Identifiers and placement of keys on nodes."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_id(key: Column) -> Column:
    """SHA-256 of a key's JSON text."""
    return F.sha2(F.concat(F.lit('"'), key.cast("string"), F.lit('"')).cast("binary"), 256)


def modulo(hex_id: Column, n: int) -> Column:
    """A 256-bit hex number modulo n, folded by eight digits at a time."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0).cast("long"), lambda acc, i: (acc * 4294967296 + F.conv(F.substr(hex_id, i * 8 + 1, F.lit(8)), 16, 10).cast("long")) % n)


def number(text: Column) -> Column:
    """The number that an id writes in hex, with or without `0x`: its digits in lower case without zeros in front, whatever their count; null for other texts."""
    digits = F.regexp_extract(text, "^(?:0x)?([0-9a-fA-F]+)$", 1)
    return F.when(digits != "", F.lower(F.regexp_replace(digits, "^0+(?=.)", "")))


def ring(hex_id: Column, nodes: list[str]) -> Column:
    """The least node id greater than the key's, else the least of all."""
    nodes = sorted(nodes)
    out = F.lit(nodes[0])
    for node in reversed(nodes):
        out = F.when(hex_id < node, F.lit(node)).otherwise(out)
    return out


def rendezvous(hex_id: Column, nodes: list[str]) -> Column:
    """The node for which the hash of key and node together is greatest."""
    best = F.array_max(F.array(*(F.struct(key_id(F.concat(hex_id, F.lit(n))).alias("h"), F.lit(n).alias("n")) for n in sorted(nodes))))
    return best["n"]
