"""Operator 8: secret scans weighed by corpus-wide ownership.

Spans that look like credentials are found in every whole text. The value of
each is hashed and counted over the corpus by distinct repository (``source``)
and by owner of the repository; a value that several owners hold is a copied
example, one that a single owner holds looks live.

Base kinds are assign, access and hex, leftmost and non-overlapping each; the
method adds kinds of its own. Positions are code points, end exclusive.

Defined results: null and empty texts hold nothing; a text of any length is
scanned whole, in time that grows with its length; repeated rows come back as
often as they stand and count once for their repository; a null doc_id is kept;
a null source counts as an owner of its own; ties (spans that start together)
are ordered by kind as listed; an empty table gives an empty result; further
columns pass through ``redact`` untouched, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.llm.common import carried, mapped, small_batches, stored, table, tidied

_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+", re.A)
_HEX = re.compile(r"[0-9a-f]{24,}", re.A)
_WORD = re.compile(r"passw(?:or)?d|secret|token|api_?key", re.I | re.A)
#: Kinds that the method adds: a literal that must be present, and the pattern.
_MORE = [
    ("pem", "PRIVATE KEY-----", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----", re.A)),
    ("jwt", "eyJ", re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", re.A)),
    ("prefixed", "_", re.compile(r"\b(?:ghp|gho|ghs|glpat|xoxb|xoxp|sk_live|rk_live)[_-][A-Za-z0-9_-]{16,}", re.A)),
    ("url", "://", re.compile(r"://[^\s/:@]+:([^\s/:@]{6,})@", re.A)),  # the scheme before it is looked for backwards
]
KINDS = ["assign", "access", "hex", *(k for k, _, _ in _MORE)]
BASE = 3
_LETTER = re.compile(r"[a-z]", re.A)
#: A value held by this many owners or more is a copied example.
EXAMPLE_OWNERS = 3

Span = tuple[int, int, int, int]


def _scheme(text: str, end: int) -> int | None:
    """Where the scheme that ends at ``end`` begins, with a letter; schemes don't overlap, so all together are read once."""
    at = end
    while at and (text[at - 1].isascii() and (text[at - 1].isalnum() or text[at - 1] in "+.-")) and not text[at - 1].isupper():
        at -= 1
    found = _LETTER.search(text, at, end)
    return found.start() if found else None


def find(text: str) -> list[Span]:
    """(start, kind's place in KINDS, end, start of the value) of all spans, by start and kind."""
    out: list[Span] = []
    if _WORD.search(text):
        out += [(m.start(), 0, m.end(), m.start(2)) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end(), m.start()) for m in _HEX.finditer(text)]
    for i, (kind, mark, pattern) in enumerate(_MORE, BASE):
        if mark not in text:
            continue
        for m in pattern.finditer(text):
            start = _scheme(text, m.start()) if kind == "url" else m.start()
            if start is not None:
                out.append((start, i, m.end(), m.start(1) if pattern.groups else m.start()))
    out.sort()
    return out


_SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("value", pa.int32()), ("hash", pa.int64())])


def _hash(value: str) -> int:
    return xxhash.xxh64_intdigest(value.strip("\"'").encode("utf-8", "replace"), 7) - (1 << 63)


def _found(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
    return tidied(_scanned(arrays))


def _scanned(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in arrays:
        lists = []
        for item in texts:
            text = item.as_py() or ""
            lists.append([(s, k, e, v, _hash(text[v:e])) for s, k, e, v in find(text)])
        yield pa.array(lists, pa.list_(_SPAN))


_SPANS = T.ArrayType(T.StructType([*(T.StructField(n, T.IntegerType()) for n in ("start", "kind", "end", "value")), T.StructField("hash", T.LongType())]))


def spans_of(text: Column) -> Column:
    """The spans of each text of a column."""
    return F.arrow_udf(_found, _SPANS)(text)


def candidates(documents: DataFrame) -> DataFrame:
    """(doc_id, source, spans) of every row."""
    small_batches(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), spans_of(F.col("text").cast("string")).alias("spans"))


def ownership(spans: DataFrame) -> DataFrame:
    """(hash, repositories, owners) over rows (hash, source): partial counts come before each shuffle, so a value in every document is no hot key.

    The owner is the part of the repository's name before a slash, or all of it.
    """
    pairs = spans.select("hash", F.coalesce("source", F.lit("")).alias("source")).distinct()
    pairs = pairs.withColumn("owner", F.substring_index("source", "/", 1))
    owners = pairs.groupBy("hash", "owner").agg(F.count("*").alias("repositories"))
    return owners.groupBy("hash").agg(F.sum("repositories").alias("repositories"), F.count("*").alias("owners"))


def _redacted(batches: Iterator[pa.RecordBatch], mark: str) -> Iterator[pa.RecordBatch]:
    """The rows of (row, live) with ``mark`` in place of the live spans' values."""
    for batch in batches:
        row = batch.column(0)
        names = [row.type.field(i).name for i in range(row.type.num_fields)]
        parts = dict(zip(names, row.flatten()))
        out = []
        for text, live in zip(parts["text"].to_pylist(), batch.column(1).to_pylist()):
            done, kept = 0, []
            for start, end in sorted((s["value"], s["end"]) for s in live):
                if end > done:
                    kept += [text[done : max(done, start)], mark]
                    done = end
            out.append("".join(kept) + text[done:])
        parts["text"] = pa.array(out, parts["text"].type)
        if "n_chars" in parts:
            parts["n_chars"] = pa.array([len(x) for x in out]).cast(parts["n_chars"].type)
        yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(list(parts.values()), fields=list(row.type))], ["row"])


def redact(documents: DataFrame, example_owners: int = EXAMPLE_OWNERS, mark: str = "[secret]") -> DataFrame:
    """The rows, with their own columns, live-looking values replaced by ``mark`` (and n_chars set to the new length).

    Rows without a span pass straight through; only the others meet the
    ownership counts, so whole texts are shuffled for those alone.
    """
    small_batches(documents.sparkSession)
    found = documents.select(carried(documents), spans_of(F.col("text").cast("string")).alias("spans"))
    plain = found.filter(F.size("spans") == 0).select("row.*")
    held = stored(found.filter(F.size("spans") > 0).withColumn("number", F.monotonically_increasing_id()), "held")
    spans = held.select("number", F.col("row.source").cast("string").alias("source"), F.explode("spans").alias("span")).select("number", "source", "span", "span.hash")
    live = spans.join(ownership(spans), "hash").filter(F.col("owners") < example_owners).groupBy("number").agg(F.collect_list("span").alias("live"))
    none = F.array().cast(_SPANS)
    marked = held.select("row", "number").join(live, "number", "left").select("row", F.coalesce("live", none).alias("live"))
    changed = mapped(marked, partial(_redacted, mark=mark), T.StructType([marked.schema["row"]]))
    return plain.unionByName(changed.select("row.*"))


def _joined(chosen) -> F.Column:
    name = F.element_at(F.array(*(F.lit(k) for k in KINDS)), chosen["kind"] + 1)
    return F.concat_ws(":", name, chosen["start"], chosen["end"])


def scan(documents: DataFrame, example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """A row per document: the spans, how many look live and how many are copied examples."""
    each = stored(candidates(documents).withColumn("row", F.monotonically_increasing_id()), "candidates")
    exploded = each.filter(F.size("spans") > 0).select("row", "source", F.explode("spans").alias("span")).select("row", "source", "span.hash")
    held = ownership(exploded)
    spread = exploded.join(held, "hash").groupBy("row").agg(
        F.sum((F.col("owners") < example_owners).cast("long")).alias("n_live"),
        F.sum((F.col("owners") >= example_owners).cast("long")).alias("n_example"),
        F.max("owners").alias("max_owners"),
    )
    zero = F.lit(0).cast("long")
    return each.join(spread, "row", "left").select(
        "doc_id", "spans", F.coalesce("n_live", zero).alias("n_live"), F.coalesce("n_example", zero).alias("n_example"), F.coalesce("max_owners", zero).alias("max_owners")
    )


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < BASE)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(F.array_join(F.transform(base, _joined), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", _joined), ",").alias("spans"),
        "n_live",
        "n_example",
        "max_owners",
    )
