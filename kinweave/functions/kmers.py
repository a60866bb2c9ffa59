"""Cyclic k-mers of a value and block keys made from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def filled(value: Column, k: int = 3) -> Column:
    """Short values are filled with 'a' to k characters."""
    return F.call_function("rpad", value, F.greatest(F.lit(k), F.length(value)), F.lit("a"))


def cyclic_kmers(value: Column, k: int = 3) -> Column:
    """As many windows as the filled value has characters; the last ones wrap to its start.

    Characters other than a-z and 0-9 count as 'a'.
    """
    s = F.regexp_replace(filled(value, k), "[^a-z0-9]", "a")
    return F.transform(F.sequence(F.lit(1), F.length(s)), lambda j: F.substring(F.concat(s, s), j, F.lit(k)))


def normal_block_keys(value: Column, k: int = 3) -> Column:
    return F.array_distinct(cyclic_kmers(value, k))


def super_block_keys(value: Column, k: int = 3) -> Column:
    """Distinct k-mers behind the first character, which is kept as it is."""
    first = F.substring(filled(value, k), 1, 1)
    return F.transform(normal_block_keys(value, k), lambda m: F.concat(first, m))


def kmer_code(kmer: Column, k: int = 3) -> Column:
    """A number in base 36, the first character counting least: a-z are 0 to 25, 0-9 are 26 to 35."""
    value = F.lit(0).cast("long")
    for i in range(k):
        c = F.ascii(F.substring(kmer, i + 1, 1))
        digit = F.when(c.between(97, 122), c - 97).when(c.between(48, 57), c - 22).otherwise(0)
        value = value + digit.cast("long") * (36**i)
    return value


def super_block_code(value: Column, kmer: Column, k: int = 3) -> Column:
    """The first character's place after 'a' counts 36**k; it is negative for characters before 'a'."""
    return (F.ascii(F.substring(filled(value, k), 1, 1)) - 97).cast("long") * 36**k + kmer_code(kmer, k)
