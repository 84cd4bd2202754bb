"""Concept hierarchies kept as dotted paths of ids, for example ``7.12.5``.

Both LIKE tests over paths are turned into equi joins: the elements of each
path are exploded and met with the wanted ids, so no nested loop is planned.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_path_element(nodes: DataFrame, ids: DataFrame, path: str = "path", id_column: str = "id") -> DataFrame:
    """Nodes with one of the ids anywhere in the path, as a whole element.

    Same rows as ``path LIKE '%.id.%' OR '%.id' OR 'id.%' OR path = id``.
    """
    wanted = ids.select(F.col(id_column).cast("string").alias("_element"))
    elements = nodes.select(path).distinct().select(
        path, F.explode(F.array_distinct(F.split(path, r"\."))).alias("_element"))
    return nodes.join(elements.join(wanted, "_element", "left_semi"), path, "left_semi")


def by_path_substring(nodes: DataFrame, ids: DataFrame, path: str = "path", id_column: str = "id") -> DataFrame:
    """Nodes with ``path LIKE '%' || id || '.%'``: 12 also matches a wanted 2.

    An id has no dots, so the text before the dot must be the end of an element
    that is not the last one. Each such element gives its suffixes (as many as
    it has digits) to an equi join.
    """
    wanted = ids.select(F.col(id_column).cast("string").alias("_suffix"))
    parts = F.split(path, r"\.")
    inner = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    suffixes = (nodes.select(path).distinct()
                .select(path, F.explode(F.array_distinct(inner)).alias("_element"))
                .where(F.length("_element") > 0)
                .select(path, F.explode(F.sequence(F.lit(1), F.length("_element"))).alias("_from"),
                        "_element")
                .select(path, F.expr("substring(_element, _from)").alias("_suffix")))
    return nodes.join(suffixes.join(wanted, "_suffix", "left_semi"), path, "left_semi")


def survey_questions(criteria: DataFrame, concept_ids: Sequence[int]) -> DataFrame:
    """Distinct question concepts below the given surveys."""
    roots = criteria.where(F.col("concept_id").isin(*concept_ids) & (F.col("domain_id") == "SURVEY"))
    questions = criteria.where((F.col("domain_id") == "SURVEY") & (F.col("type") == "PPI")
                               & (F.col("subtype") == "QUESTION"))
    return by_path_substring(questions, roots).select("concept_id").distinct()


def concept_descendants(criteria: DataFrame, concept_ids: Sequence[int],
                        rank_text: str = "%_rank1]%") -> DataFrame:
    """Distinct standard, selectable concepts at or below the given ones."""
    roots = criteria.where(F.col("concept_id").isin(*concept_ids) & F.col("full_text").like(rank_text))
    open_nodes = criteria.where((F.col("is_standard") == 1) & (F.col("is_selectable") == 1))
    return by_path_element(open_nodes, roots).select("concept_id").distinct()
