"""Column functions on chromosomes, alleles and variant ids. All are JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AUTOSOMES = [f"chr{i}" for i in range(1, 23)]
LAST = 2147483646  #: stands for an open end in interval arithmetic
VARIANT_ID = r"^chr[^_]+_[0-9]+_[A-Za-z]+_[A-Za-z]+_[A-Za-z0-9]+$"


def with_chr(c: Column) -> Column:
    """In the form chrN, never doubled; null stays null. Values that have it already cost no regular expression."""
    return F.when(c.startswith("chr"), c).when(F.lower(F.substr(c, F.lit(1), F.lit(3))) == "chr", F.concat(F.lit("chr"), F.substr(c, F.lit(4)))).otherwise(F.concat(F.lit("chr"), c))


def bare_chr(c: Column) -> Column:
    return F.when(F.lower(F.substr(c, F.lit(1), F.lit(3))) == "chr", F.substr(c, F.lit(4))).otherwise(c)


def chr_rank(c: Column) -> Column:
    """1 to 22 for autosomes, null for others."""
    n = bare_chr(c).try_cast("int")
    return F.when(n.between(1, 22), n)


def reverse_complement(c: Column) -> Column:
    """Upper case, reversed, with A-T and C-G exchanged; other letters are kept."""
    return F.translate(F.reverse(F.upper(c)), "ACGT", "TGCA")


def reference_allele(allele1: Column, allele2: Column, alt: Column) -> Column:
    """The one of two alleles that is not the effect allele."""
    return F.when(allele1 == alt, allele2).otherwise(allele1)


def effect_ordered(first: Column, second: Column, effect_allele: Column) -> tuple[Column, Column]:
    """(ref, alt) of a pair so that alt is the effect allele; kept as they are if neither is."""
    swap = F.upper(first) == F.upper(effect_allele)
    a, b = F.upper(first), F.upper(second)
    return F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)


def variant_id(chrom: Column, pos: Column, ref: Column, alt: Column, build: Column) -> Column:
    """chr_pos_ref_alt_build; null if any part is."""
    u = F.lit("_")
    return F.concat(chrom, u, pos.cast("string"), u, ref, u, alt, u, build)


def parsed_variant_id(c: Column) -> Column:
    """struct(chr, pos, ref, alt, build); every part is null if the id is not well formed."""
    ok = c.rlike(VARIANT_ID)
    part = lambda i: F.when(ok, F.split(c, "_").getItem(i))
    return F.struct(part(0).alias("chr"), part(1).try_cast("int").alias("pos"), part(2).alias("ref"), part(3).alias("alt"), part(4).alias("build"))
