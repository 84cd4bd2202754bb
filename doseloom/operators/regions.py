"""Region slices, per-sample variant lines and consensus sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doseloom.functions import genotype as g
from doseloom.functions.text import parse_region
from doseloom.operators.cohort import keep_ids
from doseloom.operators.intervals import in_region
from doseloom.plans.storage import cut_lineage

CHUNK = 1_000
MAX_BROADCAST_CHUNKS = 20_000  # 20 MB of bases
ISLAND_BLOCK = 1_000_000


def slice_region(calls: DataFrame, region: str, end_inclusive: bool = False,
                 samples: DataFrame | None = None) -> DataFrame:
    """Calls of the samples inside a region. The region filter comes first and
    reaches the Parquet scan; the default excludes the end."""
    inside = calls.where(in_region(region, end_inclusive))
    return inside if samples is None else keep_ids(inside, samples, "s")


def count_variants(calls: DataFrame) -> DataFrame:
    """Distinct variant rows of a slice."""
    return calls.select("contig", "position", "alleles").distinct() \
        .agg(F.count(F.lit(1)).alias("n_variants"))


def variant_lines(calls: DataFrame) -> DataFrame:
    """(s, contig, position, line): one tab-separated variant line per call."""
    alts = F.slice("alleles", F.lit(2), F.greatest(F.size("alleles") - 1, F.lit(0)))
    alt_text = F.when(F.size(alts) > 0, F.array_join(alts, ",")).otherwise(".")
    has_filter = "ft" in calls.columns
    # A missing filter flag stays missing; text needs a dot for it.
    ft = F.coalesce(g.filter_label(F.col("ft")), F.lit(".")) if has_filter else F.lit(".")
    cell = F.concat_ws(":", g.gt_text(F.col("gt")), ft) if has_filter else g.gt_text(F.col("gt"))
    return calls.select(
        "s", "contig", "position",
        F.concat_ws("\t", "contig", F.col("position").cast("string"), F.lit("."),
                    F.get("alleles", F.lit(0)), alt_text, F.lit("."), F.lit("."), F.lit("."),
                    F.lit("GT:FT" if has_filter else "GT"), cell).alias("line"))


def _first_alt(gt: Column) -> Column:
    """Index of the first non-reference allele of a call; NULL without one."""
    return F.get(F.filter(gt, lambda a: a > 0), F.lit(0))


def _islands(edits: DataFrame) -> DataFrame:
    """Add ``island``, the start of the run of overlapping variants that an edit is in.

    Within blocks of positions, running values give the furthest stop so far
    and the last island start; one row per sample and block carries both on.
    """
    keys = ["s", "contig"]
    # One shuffle, which every branch below reads again.
    blocked = edits.withColumn("_block", F.floor(F.col("start") / ISLAND_BLOCK)).repartition(*keys, "_block")
    in_block = Window.partitionBy(*keys, "_block").orderBy("start", "stop", "alt")
    over_blocks = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = in_block.rowsBetween(Window.unboundedPreceding, -1)
    upto = in_block.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    stops = blocked.groupBy(*keys, "_block").agg(F.max("stop").alias("_stop"))
    carried = stops.select(*keys, "_block", F.max("_stop").over(over_blocks).alias("_carried"))
    reached = (blocked.withColumn("_inside", F.max("stop").over(before))
               .join(carried, [*keys, "_block"])
               .withColumn("_reach", F.greatest("_inside", "_carried")))
    begins = F.when(F.col("_reach").isNull() | (F.col("start") >= F.col("_reach")), F.col("start"))
    marked = reached.withColumn("_begin", begins)
    lasts = marked.groupBy(*keys, "_block").agg(F.max("_begin").alias("_last"))
    carried_begin = lasts.select(*keys, "_block", F.max("_last").over(over_blocks).alias("_earlier"))
    return (marked.withColumn("_here", F.last("_begin", ignorenulls=True).over(upto))
            .join(carried_begin, [*keys, "_block"])
            .withColumn("island", F.coalesce("_here", "_earlier"))
            .select(*edits.columns, "island"))


def _pointers(edits: DataFrame) -> DataFrame:
    """Add ``idx``, an edit's number within its sample and contig, and ``jump``, that of the next edit that starts at or after its stop.

    Both are counts of the starts before a position, from one sweep over starts and stops together, in blocks.
    """
    keys = ["s", "contig"]
    starts = edits.select(*keys, "row", F.col("start").alias("_pos"), F.lit(1).alias("_kind"), "stop", "alt", "ref")
    stops = edits.select(*keys, "row", F.col("stop").alias("_pos"), F.lit(0).alias("_kind"), "stop", "alt", "ref")
    events = starts.unionByName(stops).withColumn("_block", F.floor(F.col("_pos") / ISLAND_BLOCK)).repartition(*keys, "_block")
    # A stop comes before the starts at its place, so it counts those before it only.
    in_block = Window.partitionBy(*keys, "_block").orderBy("_pos", "_kind", "stop", "alt", "ref", "row") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    over_blocks = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = events.groupBy(*keys, "_block").agg(F.sum("_kind").alias("_n")) \
        .select(*keys, "_block", F.coalesce(F.sum("_n").over(over_blocks), F.lit(0)).alias("_before"))
    counted = events.withColumn("_in", F.sum("_kind").over(in_block)).join(offsets, [*keys, "_block"])
    count = F.col("_before") + F.col("_in")
    return edits.join(counted.groupBy("row").agg(F.max(F.when(F.col("_kind") == 1, count - 1)).alias("idx"),
                                                 F.max(F.when(F.col("_kind") == 0, count)).alias("jump")), "row")


def _first_wins(crowded: DataFrame) -> DataFrame:
    """Of overlapping edits, those that a walk in order keeps: each starts at or after the last kept stop.

    The walk is a chain of jumps from the first edit of an island. Jumps are doubled: once edits at a distance under
    2 ** k are marked, those 2 ** k jumps further are marked as well, so a chain of n edits takes log n joins, and an island is
    as many rows to spread as it has edits.
    """
    columns, keys = crowded.columns, ["s", "contig", "island"]
    state = _pointers(cut_lineage(crowded.withColumn("row", F.monotonically_increasing_id())))
    head = F.col("idx") == F.min("idx").over(Window.partitionBy(*keys))
    here = state.select(*keys, F.col("idx").alias("jump"), F.lit(True).alias("_there"))
    # A jump out of the island leads nowhere: the next island has a head of its own.
    state = cut_lineage(state.withColumn("kept", head).join(here, [*keys, "jump"], "left")
                        .withColumn("jump", F.when(F.col("_there"), F.col("jump"))).drop("_there"))
    while not state.where("jump is not null").isEmpty():
        reached = state.where("kept and jump is not null").select(*keys, F.col("jump").alias("idx"), F.lit(True).alias("_reached"))
        far = state.where("jump is not null").select(*keys, F.col("idx").alias("jump"), F.col("jump").alias("_far"))
        state = cut_lineage(state.join(reached, [*keys, "idx"], "left").join(far, [*keys, "jump"], "left")
                            .withColumn("kept", F.col("kept") | F.col("_reached").isNotNull())
                            .withColumn("jump", F.col("_far")).drop("_reached", "_far"))
    return state.where("kept").select(*columns)


def applied_edits(calls: DataFrame) -> DataFrame:
    """Per sample, the variants that a consensus applies.

    Variants are taken by position; one that starts inside the reference span
    of an applied one is skipped (the first wins). Overlap can only chain
    inside an island, a run of variants whose spans touch: an edit alone in its
    island is applied, of the others a chain of jumps from the island's first one.
    """
    edits = (calls.withColumn("_index", _first_alt(F.col("gt")))
             .where(F.col("_index").isNotNull())
             .select("s", "contig", F.col("position").alias("start"),
                     F.get("alleles", F.lit(0)).alias("ref"),
                     F.get("alleles", F.col("_index")).alias("alt"))
             .withColumn("stop", F.col("start") + F.length("ref")))
    keys, columns = ["s", "contig", "island"], ["s", "contig", "start", "stop", "alt", "ref"]
    counted = cut_lineage(_islands(edits).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys))))
    alone = counted.where("_n = 1").select(*columns)
    crowded = counted.where("_n > 1").select(*keys, "start", "stop", "alt", "ref")
    return alone if crowded.isEmpty() else alone.unionByName(_first_wins(crowded).select(*columns))


def reference_chunks(bases: DataFrame, region: str, chunk: int = CHUNK) -> DataFrame:
    """The region (both ends included) of a chunked reference, cut to size.

    ``bases`` is (contig, chunk_start, bases) with 1-based starts at multiples
    of ``chunk`` plus one.
    """
    contig, start, end = parse_region(region)
    first = F.greatest(F.col("chunk_start"), F.lit(start))
    last = F.least(F.col("chunk_start") + F.length("bases") - 1, F.lit(end))
    return (bases.where((F.col("contig") == contig) & (F.col("chunk_start") <= end)
                        & (F.col("chunk_start") > start - chunk))
            .where(first <= last)
            .select("contig", F.floor((F.col("chunk_start") - 1) / chunk).alias("chunk"),
                    first.alias("chunk_start"),
                    F.expr(f"substring(bases, greatest({start} - chunk_start, 0) + 1, "
                           f"least(chunk_start + length(bases) - 1, {end}) "
                           f"- greatest(chunk_start, {start}) + 1)").alias("bases")))


def consensus(samples: DataFrame, calls: DataFrame, bases: DataFrame, region: str,
              chunk: int = CHUNK) -> DataFrame:
    """(s, contig, chunk_start, sequence): the region of each sample, in pieces.

    Only the region is written, both ends included. A variant is applied when
    its reference span lies inside the region. An edit that crosses pieces
    brings its alternative to the first one and only removes bases in the rest.
    """
    contig, start, end = parse_region(region)
    inside = keep_ids(calls, samples, "s").where(in_region(region, end_inclusive=True))
    edits = applied_edits(inside.where(F.col("position") + F.length(F.get("alleles", F.lit(0))) - 1 <= end))
    pieces = (edits.withColumn("chunk", F.explode(F.sequence(
                  F.floor((F.col("start") - 1) / chunk), F.floor((F.col("stop") - 2) / chunk))))
              .withColumn("from", F.greatest("start", F.col("chunk") * chunk + 1))
              .withColumn("to", F.least("stop", (F.col("chunk") + 1) * chunk + 1))
              .withColumn("text", F.when(F.col("from") == F.col("start"), F.col("alt")).otherwise("")))
    per_chunk = pieces.groupBy("s", "contig", "chunk").agg(
        F.sort_array(F.collect_list(F.struct("from", "to", "text"))).alias("edits"))
    first, last = (start - 1) // chunk, (end - 1) // chunk
    spans = reference_chunks(bases, region, chunk)
    if last - first < MAX_BROADCAST_CHUNKS:
        spans = F.broadcast(spans)  # one row a chunk of the region
    # Edits meet the (sample, chunk) keys first, so no bases are shuffled.
    frame = (samples.select("s").withColumn("contig", F.lit(contig))
             .withColumn("chunk", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"))))
             .join(per_chunk, ["s", "contig", "chunk"], "left")
             .join(spans, ["contig", "chunk"]))
    begin = F.struct(F.lit("").alias("out"), F.col("chunk_start").cast("long").alias("at"))

    def bases_between(a: Column, b: Column) -> Column:
        return F.substring(F.col("bases"), (a - F.col("chunk_start") + 1).cast("int"), (b - a).cast("int"))

    written = F.aggregate(
        F.coalesce("edits", F.expr("cast(array() as array<struct<from:bigint,to:bigint,text:string>>)")),
        begin,
        lambda acc, e: F.struct(
            F.concat(acc["out"], bases_between(acc["at"], e["from"].cast("long")), e["text"]).alias("out"),
            e["to"].cast("long").alias("at")),
        lambda acc: F.concat(acc["out"], bases_between(
            acc["at"], F.col("chunk_start") + F.length("bases").cast("long"))))
    return frame.select("s", "contig", "chunk_start", written.alias("sequence"))
