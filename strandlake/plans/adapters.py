"""The star-schema tables read as clusters, contigs, ontologies and sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as entities: parts are domains, parts of neighbouring lines are pairs."""
    # dealt by order once, which is all that follows asks for
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").repartition("l_orderkey").distinct()
    domains = lines.select(F.col("l_orderkey").alias("id"), F.lit("domain").alias("kind"), F.col("l_partkey").cast("string").alias("feature")).distinct()
    after = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    near = lines.select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("p"), after.alias("q")).filter("q is not null")
    pair = F.concat_ws("_", F.least("p", "q").cast("string"), F.greatest("p", "q").cast("string"))
    return domains.unionByName(near.select("id", F.lit("pair").alias("kind"), pair.alias("feature")).distinct())


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, is_partial, is_validated) of the orders."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "P").alias("is_partial"), (F.col("o_orderpriority") == "1-URGENT").alias("is_validated"))


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested labels of the orders: region, nation, then nation and segment of the customer."""
    customer = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    orders = table(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("row_idx"), F.col("n_regionkey").cast("string").alias("level_0"), F.col("n_nationkey").cast("string").alias("level_1"), F.concat_ws("/", F.col("n_nationkey").cast("string"), "c_mktsegment").alias("level_2"))


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, path, x, y): orders with their leaf label and made-up coordinates."""
    key = F.col("id")
    return levels(spark, sf_dir).select("id", F.col("level_2").alias("path"), ((key % 401) / 20.0 - 10).alias("x"), (((key * 7) % 401) / 20.0 - 10).alias("y"))


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as scored annotations of contigs (users): two to a frame in order of time."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    held = table(spark, sf_dir, "events").select("user_id", (F.row_number().over(order) - 1).alias("rn"), "value")
    return held.select(F.col("user_id").alias("sample"), F.floor(F.col("rn") / 2).cast("long").alias("orf_idx"), F.least(F.col("value") / 500, F.lit(1.0)).alias("score"))


def orfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample, orf_idx, start, end): the frames of each contig, the last one without an annotation."""
    n = annotations(spark, sf_dir).groupBy("sample").agg((F.max("orf_idx") + 1).alias("n"))
    i = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n")))
    return n.select("sample", i.alias("orf_idx")).select("sample", "orf_idx", (F.col("orf_idx") * 1000).alias("start"), (F.col("orf_idx") * 1000 + 900).alias("end"))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample, start, end): the middle third of each contig."""
    n = orfs(spark, sf_dir).groupBy("sample").agg(F.count("*").alias("n"))
    third = F.floor(F.col("n") / 3)
    return n.select("sample", (third * 1000).alias("start"), (2 * third * 1000).alias("end"))


def coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames as coding regions (sample, locus_tag, start, end, in_gt)."""
    o, t = orfs(spark, sf_dir), truth(spark, sf_dir).withColumnRenamed("start", "ts").withColumnRenamed("end", "te")
    return o.join(t, "sample").select("sample", F.concat(F.lit("orf"), F.col("orf_idx").cast("string")).alias("locus_tag"), "start", "end", ((F.col("start") < F.col("te")) & (F.col("end") > F.col("ts"))).alias("in_gt"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("sample")).distinct()


def ontology(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Terms (id) and links (child, parent): parts below their brand and their type, those below a root."""
    part = table(spark, sf_dir, "part")
    part_id = F.concat(F.lit("P"), F.col("p_partkey").cast("string"))
    brand, kind = F.concat(F.lit("B:"), "p_brand"), F.concat(F.lit("T:"), "p_type")
    links = part.select(part_id.alias("child"), F.explode(F.array(brand, kind)).alias("parent"))
    middle = links.select(F.col("parent").alias("child")).distinct().select("child", F.lit("ROOT").alias("parent"))
    terms = links.select(F.col("child").alias("id")).unionByName(middle.select(F.col("child").alias("id"))).unionByName(middle.select(F.col("parent").alias("id"))).distinct()
    return terms, links.unionByName(middle)


def term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("term")).agg(F.count("*").alias("cnt"))


def term_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, term): the parts of each order, as often as it has them."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("entity"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("term"))


def term_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, term): the parts of each order."""
    return term_rows(spark, sf_dir).distinct()


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ord, id, description, seq): documents as sequence records."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("id"), F.concat_ws(" ", F.col("doc_id").cast("string"), "lang").alias("description"), F.col("text").alias("seq"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, tool, raw): detectors' strings made of the parts' names of each order."""
    from strandlake.functions.classes import PRODUCT_TYPES

    names = [t for types in PRODUCT_TYPES.values() for t in types]
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").distinct()
    kinds = F.array(*(F.lit(n) for n in names))
    pick = lambda e: F.element_at(kinds, (e % len(names) + 1).cast("int"))
    tools = F.element_at(F.array(*(F.lit(t) for t in ("antiSMASH:8.0.1", "GECCO v0.9.8", "SanntiSv0.9.3.3", "mibig:4.0"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    base = F.element_at(F.array(*(F.lit(b) for b in ("Polyketide", "NRP_Other", "", "Unknown", "Alkaloid_Terpene", "Made-up"))), (F.col("l_partkey") % 6 + 1).cast("int"))
    raw = F.when(F.col("l_linenumber") % 4 == 0, F.concat_ws("_", pick(F.col("l_partkey")), pick(F.col("l_partkey") * 7 + 3))).otherwise(base)
    return lines.select(F.col("l_orderkey").alias("id"), tools.alias("tool"), raw.alias("raw"))
