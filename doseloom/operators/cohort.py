"""Cohort selection: semi and anti joins, null-aware NOT IN, unions, sizes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doseloom.plans.sizing import BROADCAST_ROWS


def _by_id(df: DataFrame, ids: DataFrame, key: str, how: str, hot: bool) -> DataFrame:
    """Semi or anti join without a hint: Spark sees the sizes at run time.

    ``hot`` is for a key that may hold a large share of the rows while the ids
    come out of a grouping on the same key. Spark splits a skewed partition
    only where the join reads both shuffles directly; a second key, computed
    from the first, gives the ids a shuffle of their own.
    """
    if not hot:
        return df.join(ids, key, how)
    part = F.pmod(F.xxhash64(key), F.lit(1024))
    return df.withColumn("_part", part).join(ids.withColumn("_part", part), [key, "_part"], how).drop("_part")


def keep_ids(df: DataFrame, ids: DataFrame, key: str, id_key: str | None = None, hot: bool = False) -> DataFrame:
    """Rows whose key is among the ids (IN subquery)."""
    return _by_id(df, ids.select(F.col(id_key or key).alias(key)), key, "left_semi", hot)


def drop_ids(df: DataFrame, ids: DataFrame, key: str, id_key: str | None = None, hot: bool = False) -> DataFrame:
    """Rows whose key is not among the ids (NOT EXISTS)."""
    return _by_id(df, ids.select(F.col(id_key or key).alias(key)), key, "left_anti", hot)


def not_in(df: DataFrame, ids: DataFrame, key: str, id_key: str | None = None, hot: bool = False) -> DataFrame:
    """SQL ``NOT IN``: a NULL among the ids leaves nothing, a NULL key is dropped.

    Written as a plain anti join plus a one-row test, since Spark's null-aware
    join needs the whole id list in one hash table.
    """
    unwanted = ids.select(F.col(id_key or key).alias(key))
    facts = unwanted.agg(F.struct(F.count(F.lit(1)).alias("n"),
                                  F.count_if(F.col(key).isNull()).alias("nulls")).alias("f")).scalar()
    kept = _by_id(df, unwanted.where(F.col(key).isNotNull()), key, "left_anti", hot)
    return kept.where((facts["n"] == 0) | ((facts["nulls"] == 0) & F.col(key).isNotNull()))


def union_ids(*frames: DataFrame, key: str) -> DataFrame:
    """Distinct ids over several cohorts (UNION DISTINCT)."""
    out = frames[0].select(key)
    for other in frames[1:]:
        out = out.unionByName(other.select(key))
    return out.distinct()


def intersect_ids(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).intersect(right.select(key))


def genome_and_records_cohort(person: DataFrame, search_person: DataFrame) -> DataFrame:
    """Persons with both health records and whole-genome variants."""
    wanted = search_person.where((F.col("has_ehr_data") == 1) & (F.col("has_whole_genome_variant") == 1))
    return keep_ids(person.select("person_id"), wanted, "person_id")


def event_cohort(events: DataFrame, concepts: DataFrame | None = None,
                 concept_ids: Sequence[int] = (), is_standard: int = 1,
                 value_source_ids: Sequence[int] | None = None) -> DataFrame:
    """Distinct persons with an event of the given concepts."""
    rows = events.where(F.col("is_standard") == is_standard)
    if concepts is not None:
        rows = keep_ids(rows, concepts, "concept_id", hot=True)  # few concepts, very many events each
    else:
        rows = rows.where(F.col("concept_id").isin(*concept_ids))
    if value_source_ids is not None:
        rows = rows.where(F.col("value_source_concept_id").isin(*value_source_ids))
    return rows.select("person_id").distinct()


def with_dimension(df: DataFrame, dimension: DataFrame, dimension_key: str, label: str,
                   targets: Mapping[str, str]) -> DataFrame:
    """Left-join one dimension once per foreign key: ``{foreign key: label name}``.

    The dimension is first cut to the keys in use, counted in one job. Where these are few,
    as codes mostly are, the cut is broadcast and the rows stay where they are.
    """
    used = df.agg(*[F.count_distinct(k).alias(k) for k in targets]).first()
    for foreign_key, name in targets.items():
        keys = df.select(foreign_key).where(F.col(foreign_key).isNotNull()).distinct()
        side = dimension.select(F.col(dimension_key).alias(foreign_key), F.col(label).alias(name)) \
            .join(keys, foreign_key, "left_semi")
        df = df.join(F.broadcast(side) if used[foreign_key] <= BROADCAST_ROWS else side, foreign_key, "left")
    return df


def person_labels(person: DataFrame, concept: DataFrame) -> DataFrame:
    """Persons with the concept names of gender, race, ethnicity, sex at birth."""
    names = {f"{part}_concept_id": part for part in ("gender", "race", "ethnicity", "sex_at_birth")}
    labelled = with_dimension(person, concept, "concept_id", "concept_name", names)
    return labelled.select("person_id", "gender_concept_id", "gender",
                           F.col("birth_datetime").alias("date_of_birth"),
                           "race_concept_id", "race", "ethnicity_concept_id", "ethnicity",
                           "sex_at_birth_concept_id", "sex_at_birth")


def phenotype_flag(conditions: DataFrame, person: str, code: str, codes: Sequence[str],
                   into: str = "status") -> DataFrame:
    """1 for a person with any of the codes, else 0; exact code match."""
    hit = F.when(F.col(code).isin(*codes), 1).otherwise(0)
    return conditions.groupBy(F.col(person).alias("s")).agg(F.max(hit).alias(into))


def cohort_sizes(frames: Mapping[str, DataFrame], person: str = "person_id") -> DataFrame:
    """Rows and distinct persons of each named set; NULL persons do not count."""
    out = None
    for name, df in frames.items():
        row = df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(person).alias("n_persons"))
        row = row.select(F.lit(name).alias("cohort"), "n_rows", "n_persons")
        out = row if out is None else out.unionByName(row)
    return out


# Condition codes of the two phenotypes.
CORONARY_CODES = (
    "I25.1", "I25.10", "I25.11", "I25.118", "I25.119", "I25.2", "I25.3", "I25.41", "I25.42",
    "I25.5", "I25.6", "I25.89", "I25.9",
    "414", "414.0", "414.00", "414.01", "414.02", "414.03", "414.04", "414.05", "414.06",
    "414.07", "414.2",
)
CORONARY_CODES_SHORT = (
    "I25.1", "I25.10", "I25.11", "I25.118", "I25.119", "I25.2", "I25.3", "I25.41", "I25.42",
    "I25.5", "I25.6", "I25.89", "I25.9", "414.00", "414.01", "414.0", "414",
)
TYPE1_DIABETES_CODES = (
    "E10", "E10.0", "E10.1", "E10.2", "E10.3", "E10.4", "E10.5", "E10.6", "E10.7", "E10.8", "E10.9",
    "250.01", "250.03", "250.11", "250.13", "250.21", "250.23", "250.31", "250.33", "250.41",
    "250.43", "250.51", "250.53", "250.61", "250.63", "250.71", "250.73", "250.81", "250.83",
    "250.91", "250.93",
)
