"""Sequence records: filters by length and contig, regions, deduplication, token-budget batches and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Feature type of each caller.
CALLER_FEATURES = {"gecco": "bgc", "sanntis": "cluster", "antismash": "region"}
DEFAULT_FEATURE = "biosynthetic_gene_cluster"
#: Letters of protein sequences.
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWYBXZUOJ"


def passing(records: DataFrame, min_length: int) -> DataFrame:
    """(id) of records (id, seq) of at least that length."""
    return records.filter(F.length("seq") >= min_length).select("id").distinct()


def keep(records: DataFrame, ids: DataFrame) -> DataFrame:
    return records.join(ids, "id", "left_semi")


def contig_of(protein_id: Column) -> Column:
    """The contig's id within a protein's: without the digits at its end."""
    return F.regexp_replace(protein_id, "_[0-9]+$", "")


def bracketed(description: Column) -> Column:
    """The first [token] of a description."""
    return F.regexp_extract(description, r"\[([^\]]+)\]", 1)


def keep_proteins(proteins: DataFrame, ids: DataFrame) -> DataFrame:
    """Proteins (id, description, …) whose contig passes, by the id or else by the bracketed token."""
    names = F.explode(F.array_distinct(F.array(contig_of(F.col("id")), bracketed(F.col("description")))))
    held = proteins.withColumn("_row", F.struct(*proteins.columns)).select("_row", names.alias("id"))
    return held.join(ids, "id", "left_semi").select("_row").distinct().select("_row.*")


def keep_gff(lines: DataFrame, ids: DataFrame) -> DataFrame:
    """Lines (line_no, raw): all comments, and features of passing contigs; order by line_no to restore the file."""
    keyed = lines.withColumn("id", F.split_part("raw", F.lit("\t"), F.lit(1)))
    comments = keyed.filter(F.col("raw").startswith("#"))
    features = keyed.filter(~F.col("raw").startswith("#")).join(ids, "id", "left_semi").select(*comments.columns)
    return comments.unionByName(features).drop("id")


def feature_type(caller: Column, override: str | None = None) -> Column:
    known = F.create_map(*(F.lit(x) for kv in CALLER_FEATURES.items() for x in kv))
    return F.coalesce(F.lit(override), known[F.lower(caller)], F.lit(DEFAULT_FEATURE))


def parse_regions(lines: DataFrame, kind: str) -> DataFrame:
    """(line_no, seqid, start, end, attributes) of features of a type, in any case; 0-based, half-open; short lines are left out."""
    cols = F.split("raw", "\t")
    held = lines.filter(~F.col("raw").startswith("#")).select("line_no", cols.alias("c")).filter(F.size("c") >= 9)
    return held.filter(F.lower(F.col("c")[2]) == kind.lower()).select(
        "line_no", F.col("c")[0].alias("seqid"), (F.col("c")[3].cast("long") - 1).alias("start"), F.col("c")[4].cast("long").alias("end"), F.col("c")[8].alias("attributes")
    )


def numbered(regions: DataFrame) -> DataFrame:
    """Adds idx from 1 in line order, over all regions, those whose contig is missing too.

    Lines are counted by ranges of a thousand first, so that only the ranges' sizes meet in one task.
    """
    held = regions.withColumn("_range", F.floor(F.col("line_no") / 1000))
    ranges = held.groupBy("_range").agg(F.count("*").alias("_n"))
    before = ranges.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy("line_no"))
    return held.withColumn("_own", own).join(before, "_range").withColumn("idx", (F.col("_own") + F.col("_before")).cast("long")).drop("_range", "_own", "_before")


def extract(regions: DataFrame, records: DataFrame, caller: str, prefix: str) -> DataFrame:
    """(idx, id, description, seq, start, end, seqid): each region's slice of its contig, cut to the contig's ends."""
    end, start = F.least(F.col("end"), F.length("seq")), F.greatest(F.col("start"), F.lit(0))
    cut = numbered(regions).join(records.select(F.col("id").alias("seqid"), "seq"), "seqid")
    cut = cut.withColumn("end", end.cast("long")).withColumn("start", start.cast("long"))
    name = F.format_string(f"{prefix}_{caller}_bgc_%d", "idx")
    words = F.format_string(f"BGC region %d from {caller} | %s:%d-%d", "idx", "seqid", F.col("start") + 1, "end")
    size = F.greatest(F.col("end") - F.col("start"), F.lit(0)).cast("int")
    return cut.select("idx", name.alias("id"), words.alias("description"), F.substr("seq", (F.col("start") + 1).cast("int"), size).alias("seq"), "start", "end", "seqid")


def missing_contigs(regions: DataFrame, records: DataFrame) -> DataFrame:
    return numbered(regions).join(records.select(F.col("id").alias("seqid")), "seqid", "left_anti")


def within_region(features: DataFrame, start: int, end: int) -> DataFrame:
    """Features that lie whole in a slice, moved to its own coordinates."""
    return features.filter((F.col("start") >= start) & (F.col("end") <= end)).withColumn("start", F.col("start") - start).withColumn("end", F.col("end") - start)


def first_seen(sequences: DataFrame) -> DataFrame:
    """(ord, sha256, seq): the first row of each distinct sequence."""
    hashed = sequences.select("ord", F.sha2("seq", 256).alias("sha256"), "seq")
    return hashed.groupBy("sha256").agg(F.min("ord").alias("ord"), F.min("seq").alias("seq")).select("ord", "sha256", "seq")


def token_batches(sequences: DataFrame, budget: int = 6000, longest: int = 10_000) -> DataFrame:
    """(file, ord, batch): batches filled in order up to the budget, per file.

    Empty and longer sequences than ``longest`` are left out. A sequence over the
    budget stands alone if the batch is empty; else it closes the batch and
    starts its own, which the next one closes. The order decides, so a file is
    folded as one ordered array of lengths, which holds no sequence.
    """
    kept = sequences.filter((F.length("seq") > 0) & (F.length("seq") <= longest)).select("file", "ord", F.length("seq").alias("n"))
    ordered = kept.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("ord", "n"))).alias("rows"))
    state = "struct<used:bigint,batch:bigint,out:array<struct<ord:bigint,batch:bigint>>>"
    start = F.from_json(F.lit('{"used":0,"batch":0,"out":[]}'), state)

    def step(s: Column, r: Column) -> Column:
        closes = (s["used"] > 0) & (s["used"] + r["n"] > budget)
        batch = F.when(closes, s["batch"] + 1).otherwise(s["batch"])
        alone = (s["used"] == 0) & (r["n"] > budget)
        used = F.when(alone, F.lit(0).cast("long")).when(closes, r["n"].cast("long")).otherwise(s["used"] + r["n"])
        out = F.concat(s["out"], F.array(F.struct(r["ord"].cast("long").alias("ord"), batch.alias("batch"))))
        return F.struct(used.alias("used"), (batch + alone.cast("long")).alias("batch"), out.alias("out"))

    folded = ordered.select("file", F.aggregate("rows", start, step, lambda s: s["out"]).alias("out"))
    return folded.select("file", F.explode("out").alias("o")).select("file", "o.ord", "o.batch")


def validated(sequences: DataFrame) -> DataFrame:
    """Adds seq trimmed and in capitals, and ``bad``: its sorted letters that stand for no amino acid ('' for none, 'empty')."""
    clean = F.upper(F.trim("seq"))
    rest = F.array_sort(F.array_except(F.array_distinct(F.split(clean, "")), F.array(*(F.lit(c) for c in [*AMINO_ACIDS, ""]))))
    return sequences.withColumn("bad", F.when(F.length(clean) == 0, "empty").otherwise(F.array_join(rest, ""))).withColumn("seq", clean)


def require_valid(sequences: DataFrame) -> DataFrame:
    """As ``validated``, but the job fails at the first bad sequence."""
    held = validated(sequences)
    fail = F.raise_error(F.concat(F.lit("not an amino-acid sequence: "), F.col("bad"))).cast(T.StringType())
    return held.withColumn("seq", F.when(F.col("bad") == "", F.col("seq")).otherwise(fail)).drop("bad")
