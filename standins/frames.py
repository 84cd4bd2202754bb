"""Stand-in frames on the given tables, and the same as SQL views (CTEs)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from doseloom.operators import scoring
from doseloom.plans.sizing import BROADCAST_ROWS
from doseloom.sources.readers import locate_weights


ELSEWHERE = 1_000_000_000  # beyond every part key and price
_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table; its schema is read from the file once per session."""
    uri = f"{sf.rstrip('/')}/{name}.parquet"
    if uri not in _SCHEMAS:
        _SCHEMAS[uri] = spark.read.parquet(uri).schema
    return spark.read.schema(_SCHEMAS[uri]).parquet(uri)


def base(number: Column) -> Column:
    return F.get(F.array(*map(F.lit, "ACGT")), (number % 4).cast("int"))


def variants(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as variants; every fifth one has a second alternative allele."""
    key = F.col("p_partkey")
    alleles = F.when(key % 5 == 0, F.array(base(key), base(key + 1), base(key + 2))) \
        .otherwise(F.array(base(key), base(key + 1)))
    return table(spark, sf, "part").select(
        F.concat(F.lit("chr"), F.replace("p_brand", F.lit("Brand#"), F.lit(""))).alias("contig"),
        key.cast("int").alias("position"), alleles.alias("alleles"))


def raw_weights(spark: SparkSession, sf: str, position: str = "p_partkey") -> DataFrame:
    """All parts as rows of a scoring file; every sixth one lies where no variant is, so some variants have no weight."""
    away = F.when(F.col("p_partkey") % 6 == 5, ELSEWHERE).otherwise(0)
    return table(spark, sf, "part").select(
        F.replace("p_brand", F.lit("Brand#"), F.lit("")).alias("chr"),
        (F.floor(position) + away).cast("int").alias("bp"),
        base(F.col("p_size")).alias("effect_allele"),
        ((F.col("p_size") - 25) / 10.0).cast("double").alias("weight"))


def weights(spark: SparkSession, sf: str, position: str = "p_partkey") -> DataFrame:
    return locate_weights(raw_weights(spark, sf, position))


def samples(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("s"))


def calls(spark: SparkSession, sf: str, one_in: int = 1) -> DataFrame:
    """One stored call per customer and part; the summed quantity gives the
    genotype: 0/0, 0/1, 1/1, missing, and 1/2 (0/1 without a second alternative).

    ``one_in`` takes the calls of a hash sample of the customers; where their orders are counted as few
    they are broadcast, so that the line items are not shuffled for it."""
    bought = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag")
    who = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    if one_in > 1:
        who = who.where(F.pmod(F.xxhash64("o_custkey"), F.lit(one_in)) == 0)
        who = F.broadcast(who) if who.count() <= BROADCAST_ROWS else who
    kind = (F.sum("l_quantity").cast("long") % 5).alias("kind")
    per_pair = (bought.join(who, bought.l_orderkey == who.o_orderkey)
                .groupBy(F.col("o_custkey").alias("s"), F.col("l_partkey").alias("p_partkey"))
                .agg(kind, F.max(F.ascii("l_returnflag")).alias("flag")))  # a number: hash aggregate
    part = variants(spark, sf).withColumn("p_partkey", F.col("position").cast("long"))

    def pair(a: int, b: int) -> Column:
        return F.array(F.lit(a), F.lit(b))

    gt = (F.when(F.col("kind") == 0, pair(0, 0)).when(F.col("kind") == 1, pair(0, 1))
          .when(F.col("kind") == 2, pair(1, 1))
          .when((F.col("kind") == 4) & (F.size("alleles") == 3), pair(1, 2))
          .when(F.col("kind") == 4, pair(0, 1)))
    ft = F.when(F.col("flag") == ord("A"), True).when(F.col("flag") == ord("N"), False)
    return per_pair.join(part, "p_partkey").select(
        "contig", "position", "alleles", "s", gt.alias("gt"), ft.alias("ft"))


def sampled_calls(spark: SparkSession, sf: str) -> Callable[[], DataFrame]:
    """What ``scoring.hot_loci`` looks at, made when it is asked for."""
    return lambda: calls(spark, sf, scoring.ONE_IN)


def spend(spark: SparkSession, sf: str) -> DataFrame:
    """Total order value per customer, as a score."""
    return table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("s")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("score"))


def conditions(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as condition records: priority and status make the code."""
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("person_id"),
        F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("condition_source_value"))


CODES = ("1-URGENT/P", "2-HIGH/P")


def scored_phenotype(spark: SparkSession, sf: str) -> DataFrame:
    from doseloom.operators.association import merge_phenotype
    from doseloom.operators.cohort import phenotype_flag
    flag = phenotype_flag(conditions(spark, sf), "person_id", "condition_source_value", CODES)
    return merge_phenotype(spend(spark, sf), flag)


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents with their length as the score."""
    docs = table(spark, sf, "documents").select("doc_id", "n_chars", "lang")
    return docs.join(table(spark, sf, "labels"), "doc_id")


#: All event types: those that stand for weights, and those that stand for the variant list.
WEIGHT_EVENTS, VARIANT_EVENTS = ("purchase", "error"), ("click", "view", "signup")


def minutes(spark: SparkSession, sf: str, event_types: Sequence[str]) -> DataFrame:
    """Events of some types with the minute as position, users dealt to 22 chromosomes."""
    return table(spark, sf, "events").where(F.col("event_type").isin(*event_types)).select(
        (F.col("user_id") % 22 + 1).cast("string").alias("chrom"),
        F.timestamp_diff("MINUTE", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts")).alias("pos"),
        "event_id", "user_id", "value")


def answers(spark: SparkSession, sf: str) -> DataFrame:
    """Events as survey answers: the type is the question, the value's band the
    answer, and a value under 1 is a missing answer."""
    band = (F.when(F.col("value") < 1, None).when(F.col("value") < 10, "Low")
            .when(F.col("value") < 30, "Middle").when(F.col("value") < 60, "High").otherwise("Skip"))
    return table(spark, sf, "events").select(
        F.col("user_id").alias("person_id"), F.concat(F.lit("Visit: "), F.initcap("event_type")).alias("question"),
        F.col("ts").alias("survey_datetime"), band.alias("answer"), "event_id", "value")


ANSWER_SCALE = {f"Visit: {t}": ("Low", "Middle", "High") for t in ("Click", "Error", "View", "Signup")}
ANSWER_FEATURES = ("click", "error", "view", "signup")


def answer_values(spark: SparkSession) -> DataFrame:
    rows = [(q, a, float(i)) for q, scale in ANSWER_SCALE.items() for i, a in enumerate(scale)]
    return spark.createDataFrame(rows, "question string, answer string, value double")


def records(spark: SparkSession, sf: str) -> DataFrame:
    """Events as alignment records: user and type are the name, ``k`` the node."""
    node = F.get_json_object("props", "$.k")
    step = F.struct(F.struct(node.alias("node_id")).alias("position"))
    return table(spark, sf, "events").select(
        F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("name"),
        F.struct(F.array(step).alias("mapping")).alias("path"))


# The same frames as SQL; each is used as a common table expression.

def sql_base(number: str) -> str:
    return f"substr('ACGT', cast(({number}) % 4 as int) + 1, 1)"


VARIANTS_SQL = f"""variants AS (
  SELECT 'chr' || replace(p_brand, 'Brand#', '') AS contig, cast(p_partkey AS int) AS position, p_partkey,
         {sql_base('p_partkey')} AS ref, {sql_base('p_partkey + 1')} AS alt1,
         CASE WHEN p_partkey % 5 = 0 THEN {sql_base('p_partkey + 2')} END AS alt2
  FROM part)"""


def weights_sql(position: str = "p_partkey") -> str:
    return f"""weights AS (
  SELECT replace(p_brand, 'Brand#', '') AS chr, 'chr' || replace(p_brand, 'Brand#', '') AS contig,
         cast(floor({position}) + CASE WHEN p_partkey % 6 = 5 THEN {ELSEWHERE} ELSE 0 END AS int) AS position,
         {sql_base('p_size')} AS effect_allele, cast((p_size - 25) / 10.0 AS double) AS weight
  FROM part)"""


WEIGHTS_SQL = weights_sql()
CALLS_SQL = """calls AS (
  SELECT o_custkey AS s, l_partkey AS p_partkey, cast(sum(l_quantity) AS bigint) % 5 AS kind,
         max(l_returnflag) AS flag
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"""
SPEND_SQL = """spend AS (SELECT o_custkey AS s, round(sum(o_totalprice), 2) AS score FROM orders GROUP BY 1)"""
PHENOTYPE_SQL = """phenotype AS (
  SELECT o_custkey AS s, max(CASE WHEN o_orderpriority || '/' || o_orderstatus IN ('1-URGENT/P', '2-HIGH/P')
                             THEN 1 ELSE 0 END) AS status FROM orders GROUP BY 1)"""
MERGED_SQL = f"""{SPEND_SQL}, {PHENOTYPE_SQL},
merged AS (SELECT s, score, status FROM spend JOIN phenotype USING (s))"""
LABELLED_SQL = "labelled AS (SELECT doc_id, n_chars, lang, quality, toxic FROM documents JOIN labels USING (doc_id))"
ANSWERS_SQL = """answers AS (
  SELECT user_id AS person_id, 'Visit: ' || upper(substr(event_type, 1, 1)) || substr(event_type, 2) AS question,
         ts AS survey_datetime, event_id, value,
         CASE WHEN value < 1 THEN NULL WHEN value < 10 THEN 'Low' WHEN value < 30 THEN 'Middle'
              WHEN value < 60 THEN 'High' ELSE 'Skip' END AS answer
  FROM events)"""
PAIRS_SQL = """pairs AS (
  SELECT DISTINCT cast(user_id AS varchar) || ':' || event_type AS name,
         json_extract_string(props, '$.k') AS node_id FROM events
  WHERE json_extract_string(props, '$.k') IS NOT NULL)"""


def minutes_sql(name: str, event_types: Sequence[str]) -> str:
    kinds = ", ".join(f"'{t}'" for t in event_types)
    return f"""{name} AS (SELECT cast(user_id % 22 + 1 AS varchar) AS chrom, cast(floor(epoch(ts) / 60) AS bigint) AS pos,
  event_id, user_id, value FROM events WHERE event_type IN ({kinds}))"""
