"""Writers: partitioned output only, nothing passes through the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doseloom.operators import incidence, regions
from doseloom.operators.intervals import point_intervals
from doseloom.sources import folders, schemas

FOLDERS = 4_096  # of (contig, block); a file costs more time than its rows where folders are many and small


def csv(df: DataFrame, uri: str, header: bool = True, sep: str = ",") -> str:
    df.write.mode("overwrite").option("header", header).option("sep", sep).csv(uri)
    return uri


def parquet(df: DataFrame, uri: str) -> str:
    df.write.mode("overwrite").parquet(uri)
    return uri


def person_ids(cohort: DataFrame, uri: str) -> str:
    return csv(cohort.select("person_id"), uri)


def weights(prepared: DataFrame, uri: str) -> str:
    return csv(prepared, uri)


def weight_intervals(located: DataFrame, uri: str) -> str:
    """Headerless TSV of one closed point interval per weight."""
    return csv(point_intervals(located), uri, header=False, sep="\t")


def scores(scored: DataFrame, table_uri: str, csv_uri: str | None = None) -> DataFrame:
    """Columnar score table, overwritten; the CSV is made from the saved table."""
    saved = scored.sparkSession.read.parquet(parquet(scored, table_uri))
    if csv_uri is not None:
        csv(saved, csv_uri)
    return saved


def found_variants(found: DataFrame, uri: str) -> str:
    """Matched variants as CSV; alleles joined by commas."""
    return csv(found.withColumn("alleles", F.array_join("alleles", ",")), uri)


def genotypes(variants: DataFrame, samples: DataFrame, calls: DataFrame, root: str,
              block_size: int = 1_000_000) -> str:
    """Genotype tables; calls in (contig, block) folders, sorted by position.

    Ranges over (contig, position, sample) split a crowded block over tasks. Where the variants lie in more blocks than
    ``FOLDERS``, a folder (contig, span) holds several neighbouring blocks, and each call keeps its block as a column. The block size
    and the blocks in a folder are kept with the tables, so that a reader prunes by what was written.
    """
    root, spark = root.rstrip("/"), calls.sparkSession
    parquet(variants, f"{root}/variants")
    parquet(samples.withColumn("s", F.col("s").cast("string")), f"{root}/samples")
    block = F.floor(F.col("position") / block_size)
    stored = spark.read.schema(variants.schema).parquet(f"{root}/variants")
    folder_blocks = max(1, -(-stored.select("contig", block).distinct().count() // FOLDERS))
    parquet(spark.createDataFrame([(block_size, folder_blocks)], schemas.LAYOUT).coalesce(1), f"{root}/layout")
    blocked, folder = calls.withColumn("s", F.col("s").cast("string")).withColumn("block", block), "block"
    if folder_blocks > 1:
        blocked, folder = blocked.withColumn("span", F.floor(F.col("block") / folder_blocks)), "span"
    (blocked.repartitionByRange(_write_tasks(calls), "contig", "position", "s")
     .sortWithinPartitions("contig", folder, "position", "s")  # begins with the folders, so the writer sorts no more
     .write.mode("overwrite").partitionBy("contig", folder).parquet(f"{root}/calls"))
    return root


def node_lists_json(pairs: DataFrame, uri: str, piece: int = 10_000) -> str:
    """One JSON object per name and piece: its sorted nodes."""
    incidence.node_lists(pairs, piece).write.mode("overwrite").json(uri)
    return uri


def readable_lines(pairs: DataFrame, piece: int = 10_000) -> DataFrame:
    """The text block of each name: an empty line, the name, its nodes."""
    lists = incidence.node_lists(pairs, piece)
    return lists.select("name", "part", F.concat(
        F.lit("\n"), F.col("name"), F.lit(":\nNodes: "), F.array_join("nodes", ", ")).alias("value"))


def node_lists_text(pairs: DataFrame, uri: str, piece: int = 10_000) -> str:
    lines = readable_lines(pairs, piece).repartitionByRange("name", "part") \
        .sortWithinPartitions("name", "part")
    lines.select("value").write.mode("overwrite").text(uri)
    return uri


def presence_csv(pairs: DataFrame, uri: str, names: DataFrame | None = None, width: int = incidence.BLOCK_COLUMNS,
                 file_rows: int = 100_000) -> str:
    """0/1 matrix as CSV in blocks of ``width`` columns: folders ``block=k/piece=j``, a header line in every file.

    Names are numbered in string order, and ``file_rows`` of them make a piece; each (block, piece) is a file of its own with its
    header first, so a block of any number of names is written by as many tasks as it has pieces.
    """
    def field(value: Column) -> Column:
        """A CSV field, quoted where it has to be; the escape is Spark's own, a backslash."""
        escaped = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
        return F.when(value.rlike("[\",\\\\\\r\\n]"), F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(value)

    rows, _ = incidence.matrix_axes(pairs, names)
    pieces = rows.select("name", F.floor(F.col("row_id") / file_rows).cast("int").alias("piece"))
    blocks = incidence.matrix_blocks(pairs, names, width).join(pieces, "name")
    lines = blocks.select("block", "piece", F.lit(1).alias("kind"), F.col("name").alias("at"),
                          F.concat_ws(",", field(F.col("name")), F.array_join("cells", ",")).alias("line"))
    last = pieces.agg(F.max("piece")).scalar()
    heads = incidence.matrix_columns(pairs, width).select(
        "block", F.explode(F.sequence(F.lit(0), last)).alias("piece"), F.lit(0).alias("kind"), F.lit("").alias("at"),
        F.concat_ws(",", F.lit("participant"), F.array_join(F.transform("nodes", field), ",")).alias("line"))
    ordered = lines.unionByName(heads).repartition(_write_tasks(pairs), "block", "piece") \
        .sortWithinPartitions("block", "piece", "kind", "at")
    ordered.select("block", "piece", "line").write.mode("overwrite").partitionBy("block", "piece").text(uri)
    return uri


def sparse_matrix(pairs: DataFrame, root: str, names: DataFrame | None = None) -> str:
    """Three Parquet tables: the ones, and both numbered axes."""
    root = root.rstrip("/")
    rows, columns = incidence.matrix_axes(pairs, names)
    spark = pairs.sparkSession
    rows = spark.read.parquet(parquet(rows, f"{root}/rows"))
    columns = spark.read.parquet(parquet(columns, f"{root}/cols"))
    parquet(incidence.sparse_matrix(pairs, rows, columns), f"{root}/ones")
    return root


def _write_tasks(df: DataFrame) -> int:
    """A fixed task count: many small folders cost time by number, not by size,
    so the ranges must not be merged because they hold few bytes."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def sample_variant_files(calls: DataFrame, uri: str) -> str:
    """One folder of variant lines per sample, in one job.

    Ranges over (sample, contig, position) keep the order and spread a sample
    with very many calls over several files.
    """
    lines = regions.variant_lines(calls)
    header = ("##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t")
    heads = lines.select("s").distinct().select(
        "s", F.lit("").alias("contig"), F.lit(0).alias("position"),
        F.concat(F.lit(header), F.col("s").cast("string")).alias("line"))
    ordered = (lines.unionByName(heads).repartitionByRange(_write_tasks(calls), "s", "contig", "position")
               .sortWithinPartitions("s", "contig", "position"))
    return folders.write_lines(ordered.select("s", "line"), uri)


def sample_sequences(sequences: DataFrame, uri: str, start: int) -> str:
    """One folder of FASTA lines per sample, pieces in order.

    The piece at ``start``, which every sample has, brings the name line.
    """
    name = F.when(F.col("chunk_start") == start, F.concat(F.lit(">"), F.col("contig"), F.lit("\n"))).otherwise("")
    lines = sequences.select("s", "contig", "chunk_start", F.concat(name, F.col("sequence")).alias("line"))
    ordered = (lines.where(F.length("line") > 0)
               .repartitionByRange(_write_tasks(sequences), "s", "contig", "chunk_start")
               .sortWithinPartitions("s", "contig", "chunk_start"))
    return folders.write_lines(ordered.select("s", "line"), uri)
