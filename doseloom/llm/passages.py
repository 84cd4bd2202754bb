"""Whole repeated passages, joined from the groups that ``repeats`` names.

A group of ``repeats`` lies within one run of windows that share a key, so a long passage is
many overlapping groups. Groups are pieces of one passage where their places are the same
up to one shift: for places (document d, start s) the sums of h(d) and h(d) * s over all places give
``sum(h * s) - start of the least place * sum(h)``, which a shift leaves as it is. So one partly
combined aggregate per group is enough, whatever number of places it has, and no list of places is
ever held. Pieces with one such signature whose ranges in their least document touch are one passage.

Defined results: those of ``repeats``. Documents that are equal as a whole share their whole text;
what that text shares with others is listed for the least id alone. A passage whose places are
a part of another's is listed from where the two sets of places part, with up to one run of windows before it.
Places of rows that repeat an id are listed under that id. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doseloom.llm.repeats import repeats
from doseloom.llm.tables import saved, text_rows

_EXACT = "decimal(28,0)"  # sums of products of 31-bit numbers stay exact


def places(docs: DataFrame, min_bytes: int = 50) -> DataFrame:
    """``group, length, doc_id, start``: every place of every group, whole texts that repeat included."""
    listed = repeats(docs, min_bytes).select("doc_id", F.explode("groups").alias("g")) \
        .select("g.group", "g.length", "doc_id", "g.start")
    texts = text_rows(docs).where("doc_id is not null").select(
        F.sha2(F.col("text").cast("binary"), 256).alias("sha"), F.octet_length("text").cast("long").alias("length"), "doc_id")
    texts = texts.where(F.col("length") >= min_bytes)
    again = texts.groupBy("sha").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    name = F.conv(F.substring("sha", 1, 16), 16, -10).cast("long")  # as the groups are named
    firsts = texts.join(again, "sha").where("doc_id = least").select(name.alias("group"), "length", "doc_id", F.lit(0).cast("long").alias("start"))
    return listed.unionByName(firsts).distinct()


def _mark(seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit((1 << 31) - 1))


def passages(docs: DataFrame, min_bytes: int = 50) -> DataFrame:
    """One row per place of each repeated passage: ``passage, length, n_places, doc_id, start``."""
    spots = saved(places(docs, min_bytes), "places")
    sums = [F.sum(_mark(k).cast(_EXACT)).alias(f"marks{k}") for k in (1, 2)] \
        + [F.sum((_mark(k) * F.col("start")).cast(_EXACT)).alias(f"moved{k}") for k in (1, 2)]
    pieces = spots.groupBy("group", "length").agg(F.count("*").alias("n_places"), F.min(F.struct("doc_id", "start")).alias("least"), *sums)
    alike = ["least_doc", "n_places", "marks1", "marks2", "sign1", "sign2"]
    pieces = pieces.select("group", "length", "n_places", "marks1", "marks2", F.col("least.doc_id").alias("least_doc"),
                           F.col("least.start").alias("begin"), (F.col("least.start") + F.col("length")).alias("end"),
                           *[(F.col(f"moved{k}") - F.col("least.start").cast("decimal(10,0)") * F.col(f"marks{k}").cast(_EXACT)).alias(f"sign{k}")
                             for k in (1, 2)])
    inside = Window.partitionBy(*alike).orderBy("begin", F.desc("end"), "group")
    reached = F.max("end").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.withColumn("opens", F.when(reached.isNull() | (F.col("begin") > reached), 1).otherwise(0)) \
        .withColumn("island", F.sum("opens").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    whole = pieces.groupBy(*alike, "island").agg(F.min(F.struct("begin", "group")).alias("head"), F.max("end").alias("end")) \
        .select(F.col("head.group").alias("group"), (F.col("end") - F.col("head.begin")).alias("whole"), "n_places")
    # The first piece of a passage stands wherever the passage does. A hot piece is a skewed key that Spark splits.
    return spots.join(whole, "group").select(F.col("group").alias("passage"), F.col("whole").alias("length"), "n_places", "doc_id", "start")
