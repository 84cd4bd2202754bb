"""Readers: each returns a DataFrame with a fixed schema."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from doseloom.functions import genotype as g
from doseloom.functions import text
from doseloom.operators.guards import conforms
from doseloom.operators.intervals import valid_intervals
from doseloom.plans.sizing import BROADCAST_ROWS
from doseloom.plans.storage import exists, folder_names
from doseloom.sources import folders, schemas


class Genotypes(NamedTuple):
    """Sparse genotypes; a call that is not stored is homozygous reference."""

    variants: DataFrame
    samples: DataFrame
    calls: DataFrame
    block_size: int | None = None
    folder_blocks: int = 1  # neighbouring blocks in a folder


def genotypes(spark: SparkSession, root: str) -> Genotypes:
    """Three Parquet tables below ``root``, and the block size if calls are stored by (contig, block)."""
    root, size, several = root.rstrip("/"), None, 1
    if exists(spark, f"{root}/layout"):
        layout = spark.read.schema(schemas.LAYOUT).parquet(f"{root}/layout").first()
        size, several = layout.block_size, layout.folder_blocks or 1
    kinds = {"variants": schemas.VARIANTS, "samples": schemas.SAMPLES,
             "calls": schemas.CALLS + (", block bigint" if size else "") + (", span bigint" if several > 1 else "")}
    return Genotypes(*(spark.read.schema(kind).parquet(f"{root}/{part}") for part, kind in kinds.items()), size, several)


def warehouse(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The warehouse tables as DataFrames and as temporary views for SQL."""
    frames = {}
    for name, schema in schemas.WAREHOUSE.items():
        frames[name] = spark.read.schema(schema).parquet(f"{root.rstrip('/')}/{name}")
        frames[name].createOrReplaceTempView(name)
    return frames


def typed_csv(spark: SparkSession, uri: str, schema: str, sep: str = ",", header: bool = True) -> DataFrame:
    return spark.read.schema(schema).option("sep", sep).option("header", header).csv(uri)


def flagged_samples(spark: SparkSession, uri: str) -> DataFrame:
    return typed_csv(spark, uri, schemas.FLAGGED_SAMPLES, sep="\t")


def person_ids(spark: SparkSession, uri: str) -> DataFrame:
    return typed_csv(spark, uri, schemas.PERSON_IDS)


def scoring_file(spark: SparkSession, uri: str) -> DataFrame:
    """Harmonised scoring file: tabs, ``#`` comments, plain or gzip.

    Files differ in their columns, so the names come from the header line and
    only the needed ones are kept and typed.
    """
    raw = (spark.read.option("sep", "\t").option("comment", "#").option("header", True)
           .option("inferSchema", False).csv(uri))
    needed = [c for c in schemas.SCORING_FILE if c != "other_allele" or c in raw.columns]
    conforms(raw, ", ".join(f"{c} string" for c in needed))
    return raw.select(*[F.col(c).try_cast(schemas.SCORING_FILE[c]).alias(c) for c in needed])


def prepare_weights(scoring: DataFrame, keep_other_allele: bool = False) -> DataFrame:
    """``chr, bp, effect_allele, weight`` (and the other allele)."""
    other = [F.col("other_allele").alias("noneffect_allele")] if keep_other_allele else []
    return scoring.select(F.col("hm_chr").alias("chr"), F.col("hm_pos").alias("bp"),
                          "effect_allele", *other, F.col("effect_weight").alias("weight"))


def locate_weights(weights: DataFrame) -> DataFrame:
    """Add ``contig`` (with ``chr``) and ``position`` (= ``bp``)."""
    conforms(weights, "chr void, bp void")
    return (weights.withColumn("contig", text.with_chr(F.col("chr").cast("string")))
            .withColumn("position", F.col("bp")))


def weight_report(weights: DataFrame) -> DataFrame:
    """Rows, rows without a locus, and rows beyond the first at their locus."""
    placed = F.col("contig").isNotNull() & F.col("position").isNotNull()
    return weights.agg(
        F.count(F.lit(1)).alias("weight_rows"), F.count_if(~placed).alias("without_locus"),
        (F.count_if(placed) - F.count_distinct(F.when(placed, F.struct("contig", "position"))))
        .alias("repeated_locus"))


def weight_csv(spark: SparkSession, uri: str) -> DataFrame:
    """Prepared weight CSV; one URI, whichever store it names."""
    return locate_weights(typed_csv(spark, uri, schemas.WEIGHT_CSV))


def located_weight_csv(spark: SparkSession, uri: str) -> DataFrame:
    """Weight CSV that already has ``contig`` and ``position``."""
    return conforms(typed_csv(spark, uri, schemas.PREPARED_WEIGHTS), schemas.PREPARED_WEIGHTS)


def processed_weights(spark: SparkSession, uri: str, chrom: str | None = None) -> DataFrame:
    """``chrom, pos, effect_allele, weight, id`` with bare chromosome names."""
    rows = typed_csv(spark, uri, schemas.PROCESSED_WEIGHTS).select(
        text.bare_chrom(F.col("chr")).alias("chrom"), "pos", "effect_allele", "weight", "id")
    return rows if chrom is None else rows.where(F.col("chrom") == chrom)


def variant_list(spark: SparkSession, uri: str, chrom: str | None = None) -> DataFrame:
    """Variant list with repeated blanks between columns: ``chrom, pos``.

    Position and chromosome come from the composite id in the second column; a
    malformed id gives a NULL position (see ``bad_variant_ids``).
    """
    fields = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(uri).where(F.length(F.trim("value")) > 0).select(
        text.bare_chrom(F.get(fields, F.lit(0))).alias("listed_chrom"),
        F.get(fields, F.lit(1)).alias("variant"))
    rows = rows.select("listed_chrom", "variant", text.variant_chrom(F.col("variant")).alias("chrom"),
                       text.variant_position(F.col("variant")).alias("pos"))
    return rows if chrom is None else rows.where(F.col("chrom") == chrom)


def bad_variant_ids(variants: DataFrame) -> DataFrame:
    return variants.where(F.col("pos").isNull()).agg(F.count(F.lit(1)).alias("bad_rows"))


def genome_contigs(spark: SparkSession) -> DataFrame:
    """Primary contigs of the human assembly: chr1 to chr22, chrX, chrY, chrM."""
    return spark.range(1, 26).select(F.concat(F.lit("chr"), F.when(F.col("id") <= 22, F.col("id").cast("string"))
                                              .otherwise(F.substring(F.lit("XYM"), F.col("id").cast("int") - 22,
                                                                     F.lit(1)))).alias("contig"))


def intervals(spark: SparkSession, uri: str, contigs: DataFrame | None = None) -> DataFrame:
    """Headerless interval TSV; malformed and invalid rows are skipped."""
    rows = (spark.read.schema(schemas.INTERVALS).option("sep", "\t").option("header", False)
            .option("mode", "DROPMALFORMED").csv(uri))
    return valid_intervals(rows, contigs)


def alignments(spark: SparkSession, uri: str) -> DataFrame:
    """Alignment records, one JSON object a line; broken lines are skipped."""
    return spark.read.schema(schemas.ALIGNMENT).option("mode", "DROPMALFORMED").json(uri)


def incidence_matrix(spark: SparkSession, uri: str) -> DataFrame:
    """Wide 0/1 CSV, all files below ``uri``; the first column is the participant."""
    raw = spark.read.option("header", True).option("inferSchema", False).option("recursiveFileLookup", True).csv(uri)
    first, *nodes = raw.columns
    return raw.select(F.col(f"`{first}`").alias("participant"),
                      *[F.col(f"`{n}`").cast("int").alias(n) for n in nodes])


def incidence_blocks(spark: SparkSession, uri: str) -> list[DataFrame]:
    """Every block of columns of a matrix written by ``writers.presence_csv``, in order."""
    numbers = sorted(int(name.removeprefix("block=")) for name in folder_names(spark, uri) if name.startswith("block="))
    return [incidence_matrix(spark, f"{uri.rstrip('/')}/block={k}") for k in numbers]


def scores_csv(spark: SparkSession, uri: str) -> DataFrame:
    return typed_csv(spark, uri, schemas.SCORES)


def preview(spark: SparkSession, uri: str, lines: int = 25) -> DataFrame:
    """The first lines of a text file."""
    return spark.read.text(uri).limit(lines)


def _vcf_lines(spark: SparkSession, uri: str) -> tuple[DataFrame, DataFrame]:
    """Lines of all files below ``uri``, and each file's sample names (one row per file)."""
    lines = spark.read.text(uri).select("value", F.col("_metadata.file_path").alias("file"))
    header = lines.where(F.col("value").startswith("#CHROM")).groupBy("file").agg(F.max("value").alias("value"))
    names = F.split("value", "\t")
    return lines, header.select("file", F.slice(names, F.lit(10), F.size(names)).alias("names"))


def _folder(file: str) -> Column:
    return F.regexp_replace(file, "/[^/]*$", "")


def vcf(spark: SparkSession, uri: str, region: str | None = None, end_inclusive: bool = True) -> DataFrame:
    """Calls of VCF text (plain or gzip-compatible): a file, or a folder of files.

    Each file has a header line of its own, and its variant lines are met with that
    header's names by place; a file without one, as a writer leaves when it splits a sample's
    lines, goes by the one header of its folder. Cells without a call (``.``) are kept with a NULL genotype.
    """
    lines, headers = _vcf_lines(spark, uri)
    body = lines.where(~F.col("value").startswith("#") & (F.length("value") > 0))
    fields = F.split("value", "\t")

    def at(i: int):
        return F.get(fields, F.lit(i))

    rows = body.select("file", at(0).alias("contig"), at(1).cast("int").alias("position"),
                       F.when(at(4) == ".", F.array(at(3)))
                       .otherwise(F.concat(F.array(at(3)), F.split(at(4), ","))).alias("alleles"),
                       F.split(at(8), ":").alias("format"),
                       F.slice(fields, F.lit(10), F.size(fields)).alias("cells"))
    if region is not None:
        from doseloom.operators.intervals import in_region
        rows = rows.where(in_region(region, end_inclusive))
    whole = headers.groupBy(_folder("file").alias("folder")).agg(
        F.max("names").alias("folder_names"), F.min("names").alias("least")).where("folder_names = least").drop("least")
    # Names that are counted as few are broadcast, so the lines of a file or a folder are not gathered in a task.
    if (headers.agg(F.sum(F.size("names"))).first()[0] or 0) <= BROADCAST_ROWS:
        headers, whole = F.broadcast(headers), F.broadcast(whole)
    cells = (rows.join(headers, "file", "left").withColumn("folder", _folder("file")).join(whole, "folder", "left")
             .withColumn("names", F.coalesce("names", "folder_names"))
             .select("contig", "position", "alleles", "format",
                     F.explode(F.arrays_zip("names", "cells")).alias("cell")))
    parts = F.split("cell.cells", ":")

    def field(name: str):
        place = F.array_position("format", name).cast("int")
        return F.when(place > 0, F.get(parts, place - 1))

    ft = field("FT")
    return cells.select("contig", "position", "alleles", F.col("cell.names").alias("s"),
                        g.parse_gt(field("GT")).alias("gt"),
                        F.when(ft == "PASS", True).when(ft.isNotNull() & (ft != "."), False).alias("ft"))


def vcf_samples(spark: SparkSession, uri: str) -> DataFrame:
    """Sample names with their place, from 0: files in the order of their paths, names as in the header."""
    _, headers = _vcf_lines(spark, uri)
    ahead = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    begun = headers.select("names", F.coalesce(F.sum(F.size("names")).over(ahead), F.lit(0)).alias("begin"))
    return begun.select("begin", F.posexplode("names").alias("nth", "s")) \
        .select((F.col("begin") + F.col("nth")).cast("int").alias("place"), "s")


def sample_lines(spark: SparkSession, uri: str, samples: DataFrame) -> DataFrame:
    """``s, value``: the lines of these samples' folders, one folder per sample."""
    return folders.read_lines(spark, uri, "s", samples)


def first_sample(samples: DataFrame) -> DataFrame:
    return samples.agg(F.min_by("s", "place").alias("s"))


def fasta(spark: SparkSession, uri: str, chunk: int = 1_000) -> DataFrame:
    """Reference text as ``contig, chunk_start, bases`` with 1-based starts.

    The file is read by lines in its normal splits, so no contig passes one
    task. Inside a split, running sums give each line's contig and offset; the
    totals of the splits before it (one row a split) complete them. Files of a
    folder are taken as one text in the order of their names.
    """
    lines = spark.read.text(uri).select(
        F.trim("value").alias("value"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("line"))
    is_name = F.col("value").startswith(">")
    name = F.get(F.split(F.substring("value", F.lit(2), F.length("value")), r"\s+"), F.lit(0))
    sized = lines.select("file", "split", "line", "value",
                         F.when(is_name, name).alias("name"),
                         F.when(is_name, 0).otherwise(F.length("value")).alias("size"))
    in_split = Window.partitionBy("file", "split").orderBy("line")
    upto = in_split.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = sized.withColumn("end", F.sum("size").over(upto)).withColumn(
        "head", F.last(F.when(F.col("name").isNotNull(), F.struct("name", F.col("end").alias("at"))),
                       ignorenulls=True).over(upto))
    totals = placed.groupBy("file", "split").agg(
        F.sum("size").alias("total"), F.max_by("head", "line").alias("last_head"))
    earlier = Window.orderBy("file", "split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("before", F.coalesce(F.sum("total").over(earlier), F.lit(0)))
    heads = F.when(F.col("last_head").isNotNull(),
                   F.struct(F.col("last_head.name").alias("name"),
                            (F.col("before") + F.col("last_head.at")).alias("at")))
    offsets = offsets.withColumn("carried", F.last(heads, ignorenulls=True).over(earlier)) \
        .select("file", "split", "before", "carried")
    full = (placed.join(offsets, ["file", "split"]).where((F.col("size") > 0))
            .select(F.coalesce("head.name", "carried.name").alias("contig"), "value", "size",
                    (F.col("before") + F.col("end") - F.col("size")
                     - F.coalesce(F.col("before") + F.col("head.at"), F.col("carried.at"))).alias("offset")))
    pieces = full.withColumn("chunk", F.explode(F.sequence(
        F.floor(F.col("offset") / chunk), F.floor((F.col("offset") + F.col("size") - 1) / chunk))))
    begin = F.greatest("offset", F.col("chunk") * chunk)
    stop = F.least(F.col("offset") + F.col("size"), (F.col("chunk") + 1) * chunk)
    piece = F.substring(F.col("value"), (begin - F.col("offset") + 1).cast("int"), (stop - begin).cast("int"))
    return (pieces.select("contig", "chunk", F.struct(begin.alias("at"), piece.alias("text")).alias("p"))
            .groupBy("contig", "chunk").agg(F.sort_array(F.collect_list("p")).alias("ps"))
            .select("contig", (F.col("chunk") * chunk + 1).alias("chunk_start"),
                    F.array_join("ps.text", "").alias("bases")))
