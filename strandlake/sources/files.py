"""Readers and writers of sequence and annotation files, on Spark's own text source (gzip by suffix included)."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandlake.shared import cut

_WRAP = 60
#: Letters of a line of a location.
_LOCATION_WRAP = 58
#: A part of a location that lies in another record.
_REMOTE = r"[A-Za-z_][\w.]*:[^,)]*"
_SEGMENT = r"(?:complement\()?<?\d+(?:(?:\.\.|\^|\.)>?\d+)?"


def in_order(spark: SparkSession, path: str, separator: str, number: str) -> DataFrame:
    """(path, number, value) of text split at a separator; numbers rise with the path, then with the place in the file.

    Spark deals files to tasks by size and numbers rows by task, which is the file's
    order where there is one file. Of several, a first pass counts the rows of each
    split of a file, which Spark makes, and their sums in order of path and offset
    are where a split's numbers begin. That table has a row for each split, is stored,
    and is broadcast only where the planner finds its stored size small enough.
    """
    row = F.monotonically_increasing_id().alias("_row")
    raw = spark.read.option("lineSep", separator).text(path)
    if len(raw.inputFiles()) < 2:
        return raw.select(F.col("_metadata.file_path").alias("path"), row.alias(number), "value")
    held = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block"), row, "value")
    splits = cut(held.groupBy("path", "_block").agg(F.min("_row").alias("_first"), F.count("*").alias("_n")))
    # files first, so that splits are summed within each of them and one task sums files only
    files = splits.groupBy("path").agg(F.sum("_n").alias("_n"))
    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = files.select("path", before(Window.orderBy("path")).alias("_file"))
    splits = splits.select("path", "_block", "_first", before(Window.partitionBy("path").orderBy("_block")).alias("_before"))
    begins = cut(splits.join(files, "path").select("path", "_block", (F.col("_file") + F.col("_before") - F.col("_first")).alias("_begin")))
    return held.join(begins, ["path", "_block"]).select("path", (F.col("_row") + F.col("_begin")).alias(number), "value")


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(path, ord, id, description, seq): a record for each header; ord rises with the files' paths and the place in each.

    Records are split by Spark at the header sign, so a large file is read by many tasks.
    """
    raw = in_order(spark, path, "\n>", "ord").withColumn("value", F.regexp_replace("value", "^>", ""))
    head = F.regexp_replace(F.substring_index("value", "\n", 1), "\r$", "")
    body = F.when(F.instr("value", "\n") > 0, F.regexp_replace(F.expr("substring(value, instr(value, '\n') + 1)"), r"\s", "")).otherwise("")
    return raw.filter(F.trim("value") != "").select("path", "ord", F.split_part(F.regexp_replace(head, r"\s", " "), F.lit(" "), F.lit(1)).alias("id"), head.alias("description"), body.alias("seq"))


def fasta_proteins(spark: SparkSession, path: str) -> DataFrame:
    """(ord, sha256, seq) of the records with a sequence."""
    return fasta(spark, path).filter("seq <> ''").select("ord", F.sha2("seq", 256).alias("sha256"), "seq")


def _records(spark: SparkSession, path: str) -> DataFrame:
    return in_order(spark, path, "\n//", "record").withColumn("value", F.regexp_replace("value", r"^\s+", "")).filter("value <> ''")


def _section(name: str, until: str) -> Column:
    return F.regexp_extract("value", rf"(?s)(?:^|\n){name}[^\n]*\n(.*?)(?:\n{until}|$)", 1)


def genbank(spark: SparkSession, path: str) -> DataFrame:
    """(path, record, id, description, seq) of GenBank records; a later record of an id replaces an earlier one on ``distinct_ids``."""
    version = F.regexp_extract("value", r"(?m)^VERSION\s+(\S+)", 1)
    accession = F.regexp_extract("value", r"(?m)^ACCESSION\s+(\S+)", 1)
    locus = F.regexp_extract("value", r"(?m)^LOCUS\s+(\S+)", 1)
    name = F.coalesce(F.nullif(version, F.lit("")), F.nullif(accession, F.lit("")), locus)
    definition = F.regexp_replace(F.regexp_extract("value", r"(?s)(?:^|\n)DEFINITION\s+(.*?)(?:\n\S|$)", 1), r"\s+", " ")
    seq = F.upper(F.regexp_replace(F.regexp_extract("value", r"(?s)\nORIGIN[^\n]*\n(.*)$", 1), r"[\s0-9/]", ""))
    return _records(spark, path).select("path", "record", name.alias("id"), definition.alias("description"), seq.alias("seq"))


def genbank_records(spark: SparkSession, path: str) -> DataFrame:
    """(path, record, value) of whole records as they stand in the files, without the closing line."""
    return _records(spark, path)


def distinct_ids(records: DataFrame) -> DataFrame:
    """The last record of each id."""
    return records.groupBy("id").agg(F.max_by(F.struct("path", "record", "description", "seq"), "record").alias("r")).select("id", "r.*")


def genbank_features(spark: SparkSession, path: str) -> DataFrame:
    """(path, record, ord, type, location, start, end, strand, qualifiers): a row per feature; qualifiers map to their values in order.

    ``location`` is the whole location, whatever parts it has (see ``segments``);
    start and end are the least and the greatest of its places.
    """
    block = _section("FEATURES", "(?:ORIGIN|CONTIG|BASE COUNT)")
    parts = F.split(F.concat(F.lit("\n"), block), r"\n {5}(?=\S)")
    rows = _records(spark, path).select("path", "record", F.posexplode(parts).alias("ord", "f")).filter("ord > 0")
    kind = F.split_part("f", F.lit(" "), F.lit(1))
    location = F.regexp_replace(F.regexp_extract("f", r"(?s)^\S+\s+(.*?)(?:\n\s+/|$)", 1), r"\s+", "")
    quals = F.filter(F.split("f", r"\n {21}(?=/)"), lambda q: q.startswith("/"))
    pair = F.transform(quals, lambda q: F.struct(F.regexp_extract(q, r"^/([^=\s]+)", 1).alias("k"), F.regexp_replace(F.regexp_replace(F.regexp_extract(q, r"(?s)^/[^=]+=(.*)$", 1), r"\s*\n\s*", " "), r'^"|"\s*$', "").alias("v")))
    keys = F.array_distinct(F.transform(pair, lambda p: p["k"]))
    grouped = F.map_from_arrays(keys, F.transform(keys, lambda k: F.transform(F.filter(pair, lambda p: p["k"] == k), lambda p: p["v"])))
    numbers = F.transform(F.regexp_extract_all(F.regexp_replace("location", _REMOTE, ""), F.lit(r"(\d+)"), 1), lambda x: x.cast("long"))
    strand = F.when(F.col("location").contains("complement"), -1).otherwise(1)
    return rows.select("path", "record", "ord", kind.alias("type"), location.alias("location"), grouped.alias("qualifiers")).select(
        "path", "record", "ord", "type", "location", (F.array_min(numbers) - 1).alias("start"), F.array_max(numbers).alias("end"), strand.alias("strand"), "qualifiers"
    )


def genbank_proteins(spark: SparkSession, path: str) -> DataFrame:
    """(record, ord, sha256, seq): the first translation of each coding region."""
    cds = genbank_features(spark, path).filter("type = 'CDS'")
    seq = F.regexp_replace(F.get(F.col("qualifiers")["translation"], F.lit(0)), r"\s", "")
    return cds.select("record", "ord", seq.alias("seq")).filter("seq is not null and seq <> ''").select("record", "ord", F.sha2("seq", 256).alias("sha256"), "seq")


def proteins(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Proteins of a ``fasta`` or ``genbank`` file."""
    readers = {"fasta": fasta_proteins, "genbank": genbank_proteins}
    if kind not in readers:
        raise ValueError(f"no reader for {kind!r}")
    return readers[kind](spark, path)


def require_records(records: DataFrame) -> DataFrame:
    if records.limit(1).isEmpty():
        raise ValueError("the input holds no record")
    return records


def gff(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, raw) of the lines; numbers rise with the files' paths and the lines of each, and can have gaps."""
    return in_order(spark, path, "\n", "line_no").select("line_no", F.regexp_replace("value", "\r$", "").alias("raw"))


def obo(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Terms (ord, id, name, smarts) and links (child, parent, ord) of an OBO file, or of a zip archive with one; the last
    of several terms of an id counts."""
    raw = _obo_stanzas(spark, path)
    stanza = raw.filter(F.regexp_replace("value", r"^\[", "").startswith("Term]"))
    tag = lambda n: F.regexp_extract("value", rf"(?m)^{n}:[ \t]*(.*?)[ \t\r]*$", 1)
    smarts = F.nullif(F.regexp_extract("value", r'(?m)^xref: SMARTS "(.*)"', 1), F.lit(""))
    parents = F.transform(F.regexp_extract_all("value", F.lit(r"(?m)^is_a:[ \t]*([^!\n\r]*)"), 1), lambda p: F.trim(p))
    held = stanza.select("ord", tag("id").alias("id"), tag("name").alias("name"), smarts.alias("smarts"), parents.alias("parents")).filter("id <> ''")
    last = held.groupBy("id").agg(F.max_by(F.struct("ord", "name", "smarts", "parents"), "ord").alias("t")).select("id", "t.*")
    links = last.select(F.col("id").alias("child"), F.posexplode("parents").alias("ord", "parent")).filter("parent <> ''").select("child", "parent", "ord")
    return last.select("ord", "id", "name", "smarts"), links


def _stanzas(archives: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The stanzas of the first .obo file of each zip archive."""
    for batch in archives:
        out = []
        for archive in batch:
            with zipfile.ZipFile(io.BytesIO(archive.as_py())) as z:
                name = next((n for n in z.namelist() if n.endswith(".obo")), None)
                if name is None:
                    raise ValueError("the archive holds no .obo file")
                out.append(z.read(name).decode("utf-8").split("\n["))
        yield pa.array(out, pa.list_(pa.string()))


def _obo_stanzas(spark: SparkSession, path: str) -> DataFrame:
    """(ord, value) of an OBO file or of a zip archive that holds one."""
    if path.endswith(".zip"):
        held = spark.read.format("binaryFile").load(path)
        return held.select(F.posexplode(F.arrow_udf(_stanzas, "array<string>")("content")).alias("ord", "value")).select(F.col("ord").cast("long"), "value")
    return in_order(spark, path, "\n[", "ord").select("ord", "value")


def tsv(spark: SparkSession, path: str, needed: tuple[str, ...]) -> DataFrame:
    """A table with a header; a missing column is an error that names those there are."""
    held = spark.read.csv(path, header=True, sep="\t")
    if missing := [c for c in needed if c not in held.columns]:
        raise ValueError(f"no column {', '.join(missing)}; there are {', '.join(held.columns)}")
    return held


# -- writers -----------------------------------------------------------------


def fasta_text(records: DataFrame) -> DataFrame:
    """(value): a FASTA entry for each record (description, seq), lines of 60 letters."""
    lines = F.regexp_replace("seq", f"(.{{{_WRAP}}})(?=.)", "$1\n")
    rest = [c for c in ("ord",) if c in records.columns]
    return records.select(*rest, F.concat(F.lit(">"), "description", F.lit("\n"), lines).alias("value"))


def segments(location: Column) -> Column:
    """The parts of a location in their order: structs (start, end, strand, open_start, open_end), 0-based and half-open.

    Parts inside a ``complement`` are on the other strand, one by one or all
    together; < and > mark ends that lie beyond. Parts of other records are left out.
    """
    own = F.regexp_replace(location, _REMOTE, "")
    turned = own.rlike(r"^complement\((?:join|order)\(")

    def part(x: Column) -> Column:
        ends = F.transform(F.regexp_extract_all(x, F.lit(r"(\d+)"), 1), lambda n: n.cast("long"))
        strand = F.when(turned | x.startswith("complement"), -1).otherwise(1)
        return F.struct((F.element_at(ends, 1) - 1).alias("start"), F.element_at(ends, -1).alias("end"), strand.alias("strand"), x.contains("<").alias("open_start"), x.contains(">").alias("open_end"))

    return F.transform(F.regexp_extract_all(own, F.lit(_SEGMENT), 0), part)


def moved_location(location: Column, by: Column) -> Column:
    """The location with all places of its own record moved by so many letters; parts, strands and open ends stay."""
    tokens = F.regexp_extract_all(location, F.lit(rf"{_REMOTE}|\d+|[A-Za-z_]+|[^\dA-Za-z_]+"), 0)
    return F.array_join(F.transform(tokens, lambda t: F.when(t.rlike(r"^\d+$"), (t.cast("long") + by).cast("string")).otherwise(t)), "")


def _wrapped(location: Column) -> Column:
    """Broken after commas where a line is full."""
    lines = F.regexp_replace(location, rf"(.{{1,{_LOCATION_WRAP - 1}}},)(?=.)", "$1\n" + " " * 21)
    return F.when(F.length(location) > _LOCATION_WRAP, lines).otherwise(location)


def origin(seq: Column) -> Column:
    """The ORIGIN block of a sequence: 60 letters a line, in tens, each line numbered."""
    lines = F.regexp_extract_all(F.lower(seq), F.lit(f"(.{{1,{_WRAP}}})"), 1)
    spaced = lambda x: F.trim(F.regexp_replace(x, "(.{10})", "$1 "))
    return F.array_join(F.transform(lines, lambda x, i: F.concat(F.lpad((i * _WRAP + 1).cast("string"), 9, " "), F.lit(" "), spaced(x))), "\n")


def genbank_text(records: DataFrame, features: DataFrame | None = None) -> DataFrame:
    """(id, value): a GenBank record for each of (id, description, seq), with the features (id, start, end, type, strand,
    qualifiers[, location]) that lie in it; every qualifier stands on one line, so that no identifier is wrapped.

    A location is written as it is, with all its parts; without one, it's start to end.
    """
    held = records
    if features is not None:
        span = F.concat((F.col("start") + 1).cast("string"), F.lit(".."), F.col("end").cast("string"))
        place = F.when(F.col("strand") < 0, F.concat(F.lit("complement("), span, F.lit(")"))).otherwise(span)
        place = _wrapped(F.coalesce("location", place) if "location" in features.columns else place)
        quals = F.flatten(F.transform(F.map_entries("qualifiers"), lambda e: F.transform(e["value"], lambda v: F.concat(F.lit("\n" + " " * 21 + "/"), e["key"], F.lit('="'), v, F.lit('"')))))
        line = F.concat(F.lit("     "), F.rpad("type", 16, " "), place, F.array_join(quals, ""))
        lines = features.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", "end", line.alias("line")))).alias("f"))
        held = held.join(lines.select("id", F.array_join(F.transform("f", lambda x: x["line"]), "\n").alias("_features")), "id", "left")
    else:
        held = held.withColumn("_features", F.lit(None).cast("string"))
    head = F.concat(F.lit("LOCUS       "), "id", F.lit(" "), F.length("seq").cast("string"), F.lit(" bp    DNA"))
    parts = [head, F.concat(F.lit("DEFINITION  "), "description"), F.concat(F.lit("VERSION     "), "id"), F.lit("FEATURES             Location/Qualifiers"), F.col("_features"), F.lit("ORIGIN"), origin(F.col("seq")), F.lit("//")]
    return held.select("id", F.concat_ws("\n", *parts).alias("value"))


def region_features(regions: DataFrame, features: DataFrame) -> DataFrame:
    """Features (seqid, start, end, type, strand, qualifiers[, location]) that lie whole in a region (id, seqid, start, end), moved to its own coordinates."""
    r = regions.select("id", "seqid", F.col("start").alias("_s"), F.col("end").alias("_e"))
    held = features.join(r, "seqid").filter((F.col("start") >= F.col("_s")) & (F.col("end") <= F.col("_e")))
    place = [moved_location(F.col("location"), -F.col("_s")).alias("location")] if "location" in features.columns else []
    return held.select("id", (F.col("start") - F.col("_s")).alias("start"), (F.col("end") - F.col("_s")).alias("end"), "type", "strand", "qualifiers", *place)


def write_text(lines: DataFrame, path: str, order: str | None = None) -> None:
    """Write (value) as text; with ``order`` the files follow it, range by range."""
    held = lines.repartitionByRange(order).sortWithinPartitions(order).select("value") if order else lines.select("value")
    held.write.mode("overwrite").text(path)


def write_regions(regions: DataFrame, path: str, features: DataFrame | None = None) -> None:
    """A GenBank directory for each region: ``path/region=…``, written by the tasks that hold the rows."""
    held = genbank_text(regions, region_features(regions, features) if features is not None else None)
    text = held.select(F.col("id").alias("region"), "value")
    text.write.mode("overwrite").partitionBy("region").text(path)


def write_table(df: DataFrame, path: str, metadata: dict | None = None) -> None:
    """Parquet with zstd, NaN as null, and the metadata in the first column's schema and as a JSON row beside it."""
    whole = lambda c, t: F.nullif(F.col(c), F.lit(float("nan")).cast(t)).alias(c) if t in ("float", "double") else F.col(c)
    held = df.select(*(whole(f"`{c}`", t).alias(c) for c, t in df.dtypes))
    if metadata is not None:
        held = held.withMetadata(held.columns[0], metadata)  # goes with the schema in the footer
    held.write.mode("overwrite").option("compression", "zstd").parquet(path)
    if metadata is not None:
        df.sparkSession.createDataFrame([(json.dumps(metadata, sort_keys=True),)], "value string").write.mode("overwrite").text(path.rstrip("/") + "_metadata")


def write_matches(matches: DataFrame, path: str) -> None:
    matches.write.mode("overwrite").csv(path, header=True, sep="\t")


def unwrap_ids(text: Column, qualifiers: tuple[str, ...] = ("locus_tag", "protein_id", "gene")) -> Column:
    """Joins wrapped values of identifier qualifiers onto one line, over a whole GenBank text, however many lines they
    take; others stay as they are, and joined text comes out unchanged."""
    value = rf'\n {{21}}/(?:{"|".join(qualifiers)})="[^"\n]*+(?:\n {{21}}(?! */)[^"\n]*+)*+"?'
    whole = F.concat(F.lit("\n"), text)
    joined = F.transform(F.regexp_extract_all(whole, F.lit(value), 0), lambda v: F.concat(F.lit("\n"), F.regexp_replace(F.substring(v, 2, 2_147_483_647), r"[ \t\r]*\n[ \t]*", "")))
    between = F.split(whole, value)
    out = F.array_join(F.zip_with(between, F.concat(joined, F.array(F.lit(""))), lambda t, v: F.concat(t, v)), "")
    return F.substring(out, 2, 2_147_483_647)
