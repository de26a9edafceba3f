"""The clustering run: from signatures to communities, coordinates, scores and projected partials, as tables."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators import hierarchy, similarity
from strandlake.shared import cut
from strandlake.sources.files import write_table


@dataclass
class RunParams:
    sources: tuple[str, ...] = ()
    weights: tuple[float, float] = similarity.WEIGHTS
    resolutions: tuple[float, ...] = hierarchy.RESOLUTIONS
    knn_k: int | None = None
    seed: int = 42
    prune_below: float = similarity.PRUNE_BELOW
    versions: dict[str, str] = field(default_factory=dict)


@dataclass
class Inputs:
    """entities (id, is_partial, is_validated) and signature (id, kind, feature)."""

    entities: DataFrame
    signature: DataFrame
    params: RunParams = field(default_factory=RunParams)


def read_inputs(spark: SparkSession, path: str) -> Inputs:
    stored = json.loads("".join(r["value"] for r in spark.read.text(f"{path}/params").collect()) or "{}")
    known = {k: tuple(v) if isinstance(v, list) else v for k, v in stored.items() if k in RunParams.__dataclass_fields__}
    return Inputs(spark.read.parquet(f"{path}/entity"), spark.read.parquet(f"{path}/signature"), RunParams(**known))


def write_inputs(inputs: Inputs, path: str) -> None:
    inputs.entities.write.mode("overwrite").parquet(f"{path}/entity")
    inputs.signature.write.mode("overwrite").parquet(f"{path}/signature")
    inputs.entities.sparkSession.createDataFrame([(json.dumps(asdict(inputs.params)),)], "value string").write.mode("overwrite").text(f"{path}/params")


def fingerprint(params: RunParams, k: int, n: int, last: int | None, nnz: int, width: int) -> str:
    parts = [
        f"sources={','.join(sorted(params.sources))}",
        f"weights={params.weights[0]:.6f},{params.weights[1]:.6f}",
        f"k={k}",
        "res=" + ",".join(f"{r:.6f}" for r in params.resolutions),
        f"seed={params.seed}",
        f"ibgc_etag={n}:{last}",
        f"domain_etag={nnz}:{width}",
    ]
    return hashlib.sha256("|".join(parts).encode()).hexdigest()


def run(inputs: Inputs, path: str) -> dict:
    """Cluster the primary entities, project the partial ones, write all tables under ``path`` and return the manifest."""
    p, spark = inputs.params, inputs.entities.sparkSession
    e = inputs.entities
    primary, partial = e.filter("not is_partial"), e.filter("is_partial")
    n, last = primary.agg(F.count("*"), F.max("id")).first()
    if not n:
        raise ValueError("no primary entity")
    k = p.knn_k or similarity.auto_k(n)
    of = lambda rows: inputs.signature.join(rows.select("id"), "id", "left_semi")
    signature = cut(of(primary))
    near = similarity.nearest(signature, signature, k, p.weights, within=True).filter(F.col("s") >= p.prune_below)
    edges = cut(similarity.knn_edges(near))
    labels = hierarchy.nested_communities(primary.select("id"), edges, p.resolutions, p.seed)
    pathed = cut(hierarchy.paths(labels.withColumn("row_idx", F.col("id"))))
    members = hierarchy.memberships(pathed)
    leaf = f"path_{len(p.resolutions) - 1}"
    coords = cut(hierarchy.layout(primary.select("id"), edges))
    scores = similarity.novelty(primary, signature, p.weights).join(similarity.domain_novelty(signature, pathed.select("id", F.col(leaf).alias("path"))), "id")
    placed = pathed.select("id", F.col(leaf).alias("path")).join(coords, "id")
    projected = similarity.project(partial.select("id", "is_validated"), of(partial), signature, placed, primary.filter("is_validated").select("id"), k, p.weights)
    write_table(pathed, f"{path}/hierarchy")
    pairs = similarity.similarity(signature, p.weights, p.prune_below)  # medoids need them all
    write_table(hierarchy.nodes(members, pairs), f"{path}/gcf_nodes")
    write_table(coords.select("id", F.col("x").alias("umap_x"), F.col("y").alias("umap_y")), f"{path}/coords")
    write_table(scores.withColumnRenamed("novelty", "novelty_score"), f"{path}/scores")
    write_table(projected, f"{path}/partial_assignments")
    nnz, width = signature.filter("kind = 'domain'").agg(F.count("*"), F.countDistinct("feature")).first()
    counts = members.groupBy("level").agg(F.countDistinct("path").alias("n")).collect()  # a row for each level
    by = {r["level"]: r["n"] for r in counts}
    assigned = spark.read.parquet(f"{path}/partial_assignments")
    left = partial.join(assigned.select("id"), "id", "left_anti")
    without = similarity.unplaced(partial, of(partial), assigned, similarity.nearest(of(left), signature, 1, p.weights)).first().asDict()
    manifest = {"run_sha": fingerprint(p, k, n, last, nnz, width), "knn_k": k, "n_primary": n, "n_root_communities": by.get(0, 0), "n_leaf_communities": by.get(len(p.resolutions) - 1, 0), "unplaced_partials": without, **asdict(p)}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").write.mode("overwrite").text(f"{path}/clustering_run")
    return manifest


def read_outputs(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{path}/{t}") for t in ("hierarchy", "gcf_nodes", "coords", "scores", "partial_assignments")}
