"""Diploid calls and effect-allele dosage.

A call is ``array<int>`` of allele indices (0 = reference); NULL or a NULL
element is a missing genotype. Alleles are ``array<string>``, reference first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _first(gt: Column) -> Column:
    return F.get(gt, F.lit(0))


def _second(gt: Column) -> Column:
    return F.get(gt, F.lit(1))


def is_missing(gt: Column) -> Column:
    return _first(gt).isNull() | _second(gt).isNull()


def is_hom_ref(gt: Column) -> Column:
    return F.coalesce((_first(gt) == 0) & (_second(gt) == 0), F.lit(False))


def is_hom_var(gt: Column) -> Column:
    return F.coalesce((_first(gt) > 0) & (_first(gt) == _second(gt)), F.lit(False))


def is_het(gt: Column) -> Column:
    return F.coalesce(_first(gt) != _second(gt), F.lit(False))


def effect_place(alleles: Column, effect: Column) -> Column:
    """Place of the effect allele: 0 in neither, 1 reference, 2 and up alternative.

    NULL without a weight row. Made once per call; the dosage compares numbers.
    """
    return F.array_position(alleles, effect).cast("int")


def missing_dosage(place: Column) -> Column:
    """Dosage of a sample without an entry: two copies when the effect is ref."""
    return F.when(place == 1, 2).when(place.isNotNull(), 0)


def effect_dosage(gt: Column, place: Column, allele_specific: bool = False) -> Column:
    """Copies of the effect allele carried by a call; NULL without a weight row.

    By default any heterozygote counts one and any homozygous alternative
    counts two when the effect is one of the alternatives, whichever of them
    is carried. ``allele_specific`` counts the copies really carried.
    """
    a, b = _first(gt), _second(gt)
    missing = a.isNull() | b.isNull()
    if allele_specific:
        carried = (a == place - 1).cast("int") + (b == place - 1).cast("int")
        return F.when(missing, missing_dosage(place)).otherwise(carried)
    return (F.when(missing, missing_dosage(place))
            .when(a != b, (place > 0).cast("int"))
            .when(a == 0, F.when(place == 1, 2).when(place.isNotNull(), 0))
            .otherwise(F.when(place > 1, 2).when(place.isNotNull(), 0)))


def filter_label(ft: Column) -> Column:
    """PASS or FAIL; a missing filter flag stays missing."""
    return F.when(ft, "PASS").when(~ft, "FAIL")


def gt_text(gt: Column) -> Column:
    """``0/1`` text of a call, ``./.`` when missing."""
    return F.when(is_missing(gt), "./.").otherwise(F.array_join(gt.cast("array<string>"), "/"))


def parse_gt(text: Column) -> Column:
    """``0/1``, ``1|2``, ``./.`` or haploid ``1`` to a diploid call or NULL."""
    parts = F.split(F.get(F.split(text, ":"), F.lit(0)), r"[/|]")
    first = _index(F.get(parts, F.lit(0)))
    second = _index(F.coalesce(F.get(parts, F.lit(1)), F.get(parts, F.lit(0))))
    return F.when(first.isNotNull() & second.isNotNull(), F.array(first, second))


def _index(text: Column) -> Column:
    return text.try_cast("int")
