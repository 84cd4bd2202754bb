"""Text cleaning for contigs, composite ids, questions and answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def with_chr(chrom: Column) -> Column:
    """Contig name with a ``chr`` prefix, added only when absent."""
    return F.when(chrom.startswith("chr"), chrom).otherwise(F.concat(F.lit("chr"), chrom))


def bare_chrom(chrom: Column) -> Column:
    """Chromosome without ``chr`` in any case and without outer blanks."""
    return F.trim(F.regexp_replace(chrom, "(?i)chr", ""))


def variant_chrom(variant: Column) -> Column:
    """Chromosome part of ``chrom:pos:a1:a2``."""
    return bare_chrom(F.get(F.split(variant, ":"), F.lit(0)))


def variant_position(variant: Column) -> Column:
    """Position part of ``chrom:pos:a1:a2``; NULL when it is not a number."""
    return F.trim(F.get(F.split(variant, ":"), F.lit(1))).try_cast("int")


def question_feature(question: Column) -> Column:
    """Feature name of a question: its last part, lower case, underscores."""
    return F.lower(F.replace(F.element_at(F.split(question, ": "), -1), F.lit(" "), F.lit("_")))


def numeric_answer(answer: Column, sentinels: Sequence[str]) -> Column:
    """Number in the answer; sentinels and other text become NULL."""
    return F.when(~answer.isin(*sentinels), answer.try_cast("double"))


def parse_region(region: str) -> tuple[str, int, int]:
    """``contig:start-end`` to its three parts."""
    contig, _, span = region.partition(":")
    start, _, end = span.replace(",", "").partition("-")
    return contig, int(start), int(end)
