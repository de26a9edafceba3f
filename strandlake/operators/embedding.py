"""Embeddings: layers, positional encoding, norms and pooling of ordered protein vectors, and batched inference."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import partial
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from strandlake.operators.sequences import first_seen, require_valid
from strandlake.shared import cut


def layer_of(layers: Column, layer: int | str) -> Column:
    """One layer of an array of layers; ``final`` is the last; a layer out of range fails the job."""
    if layer == "final":
        return F.element_at(layers, -1)
    if int(layer) < 0:
        raise ValueError("layers count from 0")
    return F.when(F.size(layers) > int(layer), F.get(layers, F.lit(int(layer)))).otherwise(F.raise_error(F.lit(f"layer {layer} is out of range")).cast("array<double>"))


def strategy(layer: int | str, per_protein_norm: bool, aggregation: str, post_norm: bool, pe_before_norm: bool, scale: float) -> str:
    flags = f"layer_{layer}__ppnorm_{int(per_protein_norm)}__agg_{aggregation}__postnorm_{int(post_norm)}"
    return f"{flags}__pebefore_{int(pe_before_norm)}__scale_{scale:.4f}"


def encoding(position: Column, k: Column, dim: int) -> Column:
    """Sinusoidal encoding of place ``k`` (from 0) of a vector at a position (from 0): sine at even places, cosine at odd ones."""
    angle = position / F.pow(F.lit(10000.0), 2.0 * F.floor(k / 2) / dim)
    return F.when(k % 2 == 0, F.sin(angle)).otherwise(F.cos(angle))


def _norm(vector: Column) -> Column:
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(length > 0, F.transform(vector, lambda x: x / length)).otherwise(vector)


def pool(
    proteins: DataFrame, dim: int, layer: int | str | None = None, aggregation: str = "mean", scale: float = 0.0, per_protein_norm: bool = False, post_norm: bool = False, pe_before_norm: bool = True
) -> DataFrame:
    """(bgc, vector, n_proteins, strategy_id) from rows (bgc, ord, vector or layers).

    With a scale, the encoding of the protein's place in its cluster is added,
    before or after the protein's own norm. Elements are aggregated by place, so
    that partial sums, not vectors, are shuffled.
    """
    if dim % 2:
        raise ValueError("the dimension must be even")
    if aggregation not in ("mean", "max"):
        raise ValueError(f"no aggregation {aggregation!r}")
    vector = (layer_of(F.col("layers"), layer) if layer is not None else F.col("vector")).cast("array<double>")
    from pyspark.sql.window import Window

    held = proteins.select("bgc", (F.row_number().over(Window.partitionBy("bgc").orderBy("ord")) - 1).cast("double").alias("at"), vector.alias("v"))
    coded = F.transform("v", lambda x, k: x + F.lit(scale) * encoding(F.col("at"), k, dim))
    if scale == 0.0:
        held = held.withColumn("v", _norm(F.col("v"))) if per_protein_norm else held
    elif pe_before_norm:
        held = held.withColumn("v", coded)
        held = held.withColumn("v", _norm(F.col("v"))) if per_protein_norm else held
    else:
        held = held.withColumn("v", _norm(F.col("v"))) if per_protein_norm else held
        held = held.withColumn("v", coded)
    each = held.select("bgc", "at", F.posexplode("v").alias("k", "x"))
    value = F.max("x") if aggregation == "max" else F.avg(F.col("x").cast("decimal(28,14)")).cast("double")
    summed = each.groupBy("bgc", "k").agg(value.alias("x"), F.count("*").alias("n"))
    out = summed.groupBy("bgc").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("vector"), F.max("n").cast("int").alias("n_proteins"))
    if post_norm:
        out = out.withColumn("vector", _norm(F.col("vector")))
    name = strategy("final" if layer is None else layer, per_protein_norm, aggregation, post_norm, pe_before_norm, scale)
    return out.withColumn("strategy_id", F.lit(name))


def token_means(tokens: DataFrame) -> DataFrame:
    """(id, layer, vector): mean over the tokens of each layer, from rows (id, layer, token, vector)."""
    each = tokens.select("id", "layer", F.posexplode("vector").alias("k", "x"))
    mean = each.groupBy("id", "layer", "k").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return mean.groupBy("id", "layer").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("vector"))


class Embedder(Protocol):
    """A model: for a list of sequences, an array (layers, dimension) each, or an exception."""

    def __call__(self, sequences: list[str]) -> list[np.ndarray]: ...


def filled(sizes: Sequence[int], budget: int) -> list[int]:
    """Number of the batch of each size, in order: ``token_batches`` over what a task has before it.

    A batch closes before the size that would take it over the budget; a size over the budget stands alone.
    """
    out, batch, used = [], 0, 0
    for n in sizes:
        if used and used + n > budget:
            batch, used = batch + 1, 0
        out.append(batch)
        used += n
    return out


def _embedded(batches: Iterator[pd.DataFrame], load: Callable[[], Embedder], budget: int, longest: int) -> Iterator[pd.DataFrame]:
    model = load()
    for pdf in batches:
        size = pdf["seq"].str.len()
        fits = (size > 0) & (size <= longest)
        if not fits.all():
            yield _told(pdf[~fits], [ValueError(f"{n} letters, of {longest} at most") if n else ValueError("empty") for n in size[~fits]], "skipped", False)
        kept = pdf[fits]
        for _, part in kept.groupby(np.array(filled(size[fits].tolist(), budget), np.int64), sort=False):
            again = False
            try:
                found: list = list(model(part["seq"].tolist()))
                if len(found) != len(part):
                    raise ValueError(f"{len(found)} results for {len(part)} sequences")
            except Exception:  # each record once more, by itself
                found, again = [], True
                for seq in part["seq"]:
                    try:
                        found.append(model([seq])[0])
                    except Exception as e:
                        found.append(e)
            yield _told(part, found, "failed", again)


def _told(part: pd.DataFrame, found: list, otherwise: str, again: bool) -> pd.DataFrame:
    bad = [isinstance(x, Exception) for x in found]
    column = lambda values: pd.Series(list(values), part.index, object)
    return pd.DataFrame(
        {
            "sha256": part["sha256"],
            "sequence_length": part["seq"].str.len().astype("int32"),
            "layers": column(None if b else np.asarray(x, np.float32).tolist() for x, b in zip(found, bad)),
            "error": column(str(x) if b else None for x, b in zip(found, bad)),
            "outcome": column(otherwise if b else "embedded" for b in bad),
            "retried": again,
        }
    )


def embed(sequences: DataFrame, load: Callable[[], Embedder], budget: int = 6000, distinct: bool = True, longest: int = 10_000) -> DataFrame:
    """(sha256, sequence_length, layers, error, outcome, retried) of sequences (ord, seq): ``load`` makes the model once in each task.

    Batches are filled up to the budget. A batch that fails is repeated record by
    record (``retried``); what fails then has its error and no layers. Empty and
    longer sequences than ``longest`` don't go to the model and are ``skipped``.
    The rows aren't stored: each use of them runs the model (see ``embed_once``).
    """
    held = require_valid(sequences)
    held = first_seen(held) if distinct else held.select("ord", F.sha2("seq", 256).alias("sha256"), "seq")
    schema = "sha256 string, sequence_length int, layers array<array<float>>, error string, outcome string, retried boolean"
    return held.select("sha256", "seq").mapInPandas(partial(_embedded, load=load, budget=budget, longest=longest), schema)


@dataclass(frozen=True)
class Outcomes:
    """How many rows went in, were embedded, failed, were skipped, and were asked for once more by themselves."""

    seen: int
    written: int
    failed: int
    skipped: int
    retried: int

    def require_success(self) -> None:
        """An error if there were rows and none was embedded."""
        if self.seen and not self.written:
            raise ValueError(f"none of {self.seen} sequences could be embedded")


def embed_once(sequences: DataFrame, load: Callable[[], Embedder], budget: int = 6000, distinct: bool = True, longest: int = 10_000) -> tuple[DataFrame, Outcomes]:
    """The rows of ``embed`` as a stored table, and its counters, observed while it is written: the model runs once."""
    seen = Observation("embedding")
    of = lambda x: F.count_if(F.col("outcome") == x)
    counters = [F.count(F.lit(1)).alias("seen"), of("embedded").alias("written"), of("failed").alias("failed"), of("skipped").alias("skipped"), F.count_if("retried").alias("retried")]
    stored = cut(embed(sequences, load, budget, distinct, longest).observe(seen, *counters))
    return stored, Outcomes(**seen.get)


def embed_sequences(sequences: DataFrame, load: Callable[[], Embedder], budget: int = 6000, longest: int = 10_000) -> DataFrame:
    """(ord, layers) for every row (ord, seq); ``layers`` is null where the sequence was skipped or failed. Equal sequences run once."""
    found, _ = embed_once(sequences, load, budget, True, longest)
    rows = require_valid(sequences.select("ord", "seq")).select("ord", F.sha2("seq", 256).alias("sha256"))
    return rows.join(found.select("sha256", "layers"), "sha256", "left").select("ord", "layers")


def aggregate_sequences(sequences: DataFrame, load: Callable[[], Embedder], dim: int, layer: int | str = 26, scale: float = 0.5, budget: int = 6000, longest: int = 10_000, **pooling: object) -> DataFrame:
    """(bgc, vector) for every cluster of rows (bgc, ord, seq), pooled in order; null where any of its sequences has no embedding."""
    found, _ = embed_once(sequences.select("ord", "seq"), load, budget, True, longest)
    rows = require_valid(sequences.select("bgc", "ord", "seq")).select("bgc", "ord", F.sha2("seq", 256).alias("sha256"))
    rows = rows.join(found.select("sha256", "layers"), "sha256", "left")
    clusters = rows.groupBy("bgc").agg(F.count_if(F.col("layers").isNull()).alias("missing"))
    whole = rows.join(clusters.filter("missing = 0"), "bgc", "left_semi")
    return aggregate_embeddings(clusters.select("bgc"), whole, dim, layer, scale, **pooling)


def aggregate_embeddings(clusters: DataFrame, proteins: DataFrame, dim: int, layer: int | str = 26, scale: float = 0.5, **pooling: object) -> DataFrame:
    """(bgc, vector) for every row of clusters (bgc), from embeddings (bgc, ord, layers) that are there already; null for one without any."""
    pooled = pool(proteins, dim, layer, scale=scale, **pooling)
    return clusters.select("bgc").join(pooled.select("bgc", "vector"), "bgc", "left")


def pack_blob(layers: Column) -> Column:
    """Row-major bytes of float32, as stored in embedding tables."""

    @F.pandas_udf("binary")
    def packed(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else np.stack([np.asarray(r, np.float32) for r in x]).tobytes())

    return packed(layers)


def unpack_blob(blob: Column, dim: int) -> Column:
    @F.pandas_udf("array<array<float>>")
    def unpacked(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else np.frombuffer(b, np.float32).reshape(-1, dim).tolist())

    return unpacked(blob)
