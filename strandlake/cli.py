"""Command line: python -m strandlake.cli COMMAND …"""

from __future__ import annotations

import argparse
import importlib
import sys
from collections.abc import Sequence

from pyspark.sql import functions as F

from strandlake import config, logs
from strandlake.operators import sequences
from strandlake.plans import clustering
from strandlake.session import get_session
from strandlake.sources import files


def _cluster(a: argparse.Namespace, spark) -> int:
    inputs = clustering.read_inputs(spark, a.input)
    for name, value in (("knn_k", a.knn_k), ("seed", a.seed), ("weights", a.weight and tuple(a.weight)), ("resolutions", a.resolutions and tuple(a.resolutions))):
        if value is not None:
            setattr(inputs.params, name, value)
    try:
        print(clustering.run(inputs, a.output)["run_sha"])
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


def _contigs(a: argparse.Namespace, spark) -> int:
    if not (a.fna or a.gbk):
        print("give contigs as FASTA or GenBank", file=sys.stderr)
        return 1
    contigs = files.fasta(spark, a.fna) if a.fna else files.genbank(spark, a.gbk).withColumn("ord", F.col("record"))
    ids = sequences.passing(contigs, a.min_length)
    kept = sequences.keep(contigs, ids)
    files.write_text(files.fasta_text(kept), f"{a.out_dir}/filtered.fna", order="ord")
    if a.gbk and not a.fna:
        # the records as they are, each of a repeated id too
        whole = files.genbank_records(spark, a.gbk).join(kept.select("path", "record"), ["path", "record"], "left_semi")
        text = F.concat(files.unwrap_ids(F.col("value")), F.lit("\n//"))
        files.write_text(whole.select("record", text.alias("value")), f"{a.out_dir}/filtered.gbk", order="record")
    if a.faa:
        files.write_text(files.fasta_text(sequences.keep_proteins(files.fasta(spark, a.faa), ids)), f"{a.out_dir}/filtered.faa", order="ord")
    if a.gff:
        files.write_text(sequences.keep_gff(files.gff(spark, a.gff), ids).withColumnRenamed("raw", "value"), f"{a.out_dir}/filtered.gff", order="line_no")
    return 0


def _regions(a: argparse.Namespace, spark) -> int:
    kind = a.feature_type or sequences.CALLER_FEATURES.get(a.caller_name.lower(), sequences.DEFAULT_FEATURE)
    regions = sequences.parse_regions(files.gff(spark, a.gff), kind)
    records = files.distinct_ids(files.genbank(spark, a.gbk))
    features = files.genbank_features(spark, a.gbk).join(records.select("path", "record", F.col("id").alias("seqid")), ["path", "record"])
    files.write_regions(sequences.extract(regions, records, a.caller_name, a.prefix), f"{a.out_dir}/regions", features)
    return 0


def _backend(name: str):
    """The object that ``module:name`` stands for."""
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def _classify(a: argparse.Namespace, spark) -> int:
    from strandlake.operators import chemistry, ontology

    terms, links = files.obo(spark, a.obo)
    depth = ontology.depths(terms, links, ontology.closure(terms, links, defined_only=True)).withColumnRenamed("term", "id")
    compounds = files.tsv(spark, a.input, ("id", "smiles")) if a.input else spark.createDataFrame([("1", a.smiles)], "id string, smiles string")
    found = chemistry.match(compounds, terms.join(depth, "id"), _backend(a.backend))
    if a.output:
        files.write_matches(found, a.output)
    else:
        found.orderBy("id", "rank").show(1000, truncate=False)
    return 0


def _embed(a: argparse.Namespace, spark) -> int:
    from strandlake.operators import embedding

    held = files.require_records(files.proteins(spark, a.input, a.format)).select("ord", "seq")
    found, counts = embedding.embed_once(held, _backend(a.backend), a.budget, distinct=False)
    print(f"embedded {counts.written} of {counts.seen}: {counts.failed} failed, {counts.skipped} skipped, {counts.retried} asked for again", file=sys.stderr)
    if not counts.written:
        return 1
    files.write_table(found.filter("error is null").select(F.col("sha256").alias("protein_sequence_sha256"), "sequence_length", embedding.pack_blob(F.col("layers")).alias("hidden_mean_blob")), a.output, {"backend": a.backend})
    return 0


def _embed_cluster(a: argparse.Namespace, spark) -> int:
    from strandlake.operators import embedding

    held = files.require_records(files.proteins(spark, a.input, a.format)).select("ord", "seq")
    found, counts = embedding.embed_once(held, _backend(a.backend), a.budget)
    if counts.written < counts.seen:
        print(f"{counts.seen - counts.written} of {counts.seen} proteins could not be embedded", file=sys.stderr)
        return 1
    order = held.select("ord", F.sha2(F.upper(F.trim("seq")), 256).alias("sha256"))
    layer = a.layer if a.layer == "final" else int(a.layer)
    rows = order.join(found, "sha256").select(F.lit(a.accession).alias("bgc"), "ord", "layers")
    pooled = embedding.pool(rows, a.dim, layer, a.aggregation, a.scale, a.per_protein_norm, a.post_norm)
    files.write_table(pooled.select(F.col("bgc").alias("accession"), "vector", F.size("vector").alias("vector_dim"), "strategy_id", "n_proteins"), a.output, {"backend": a.backend})
    return 0


def _project(a: argparse.Namespace, spark) -> int:
    """Partial entities of one input against the tables of a finished run."""
    from strandlake.operators import similarity

    inputs, out = clustering.read_inputs(spark, a.input), clustering.read_outputs(spark, a.primary)
    paths = sorted(c for c in out["hierarchy"].columns if c.startswith("path_"))
    placed = out["hierarchy"].select("id", F.col(paths[-1]).alias("path")).join(out["coords"].select("id", F.col("umap_x").alias("x"), F.col("umap_y").alias("y")), "id")
    e = inputs.entities
    primary, partial = e.join(placed.select("id"), "id", "left_semi"), e.filter("is_partial")
    of = lambda rows: inputs.signature.join(rows.select("id"), "id", "left_semi")
    k = inputs.params.knn_k or similarity.auto_k(primary.count())
    found = similarity.project(partial.select("id", "is_validated"), of(partial), of(primary), placed, primary.filter("is_validated").select("id"), k, inputs.params.weights)
    files.write_table(found, f"{a.output}/partial_assignments")
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandlake")
    top.add_argument("--config", help="YAML file of settings, an object for each command")
    top.add_argument("--log-level", default="INFO")
    top.add_argument("--log-file")
    commands = top.add_subparsers(dest="command", required=True)
    c = commands.add_parser("cluster")
    c.add_argument("--input", required=True)
    c.add_argument("--output", required=True)
    c.add_argument("--knn-k", type=int)
    c.add_argument("--resolutions", type=float, nargs="+")
    c.add_argument("--weight", type=float, nargs=2)
    c.add_argument("--seed", type=int)
    c.set_defaults(run=_cluster)
    c = commands.add_parser("contig-filter")
    for name in ("fna", "gbk", "faa", "gff"):
        c.add_argument(f"--{name}")
    c.add_argument("--min-length", type=int, default=3000)
    c.add_argument("--out-dir", default=".")
    c.set_defaults(run=_contigs)
    c = commands.add_parser("regions")
    c.add_argument("--gbk", required=True)
    c.add_argument("--gff", required=True)
    c.add_argument("--caller-name", default="unknown")
    c.add_argument("--feature-type")
    c.add_argument("--prefix", default="sample")
    c.add_argument("--out-dir", default=".")
    c.set_defaults(run=_regions)
    c = commands.add_parser("project-partials")
    for name in ("input", "primary", "output"):
        c.add_argument(f"--{name}", required=True)
    c.set_defaults(run=_project)
    c = commands.add_parser("classify")
    c.add_argument("--obo", required=True)
    c.add_argument("--backend", required=True, help="module:class of a Matcher")
    c.add_argument("--input")
    c.add_argument("--smiles")
    c.add_argument("--output")
    c.set_defaults(run=_classify)
    for name, run in (("embed", _embed), ("embed-cluster", _embed_cluster)):
        c = commands.add_parser(name)
        for option in ("input", "output", "backend"):
            c.add_argument(f"--{option}", required=True)
        c.add_argument("--format", choices=["fasta", "genbank"], default="fasta")
        c.add_argument("--budget", type=int, default=6000)
        c.set_defaults(run=run)
    c.add_argument("--accession", required=True)
    c.add_argument("--dim", type=int, required=True)
    c.add_argument("--layer", default="final")
    c.add_argument("--aggregation", choices=["mean", "max"], default="mean")
    c.add_argument("--scale", type=float, default=0.0)
    c.add_argument("--per-protein-norm", action="store_true")
    c.add_argument("--post-norm", action="store_true")
    return top


def arguments(args: Sequence[str] | None = None) -> argparse.Namespace:
    """The arguments of a command: flags, over the environment (STRANDLAKE_<COMMAND>__<OPTION>) and .env, over a YAML
    file (``--config``, which has an object for each command), over defaults.

    A dash in a command's or an option's name may be an underscore in settings. What
    settings give needn't be given as a flag; an option that a command doesn't have is an error.
    """
    first = argparse.ArgumentParser(add_help=False, allow_abbrev=False)
    first.add_argument("--config")
    path = first.parse_known_args(args)[0].config
    top = parser()
    commands = next(x for x in top._actions if isinstance(x, argparse._SubParsersAction)).choices
    held = config.load({}, path)
    given = {name.replace("_", "-"): values or {} for name, values in held.items() if name.replace("_", "-") in commands}
    for name, values in given.items():
        options = {x.dest: x for x in commands[name]._actions if x.option_strings and x.dest != "help"}
        for key, value in values.items():
            if (option := options.get(key.replace("-", "_"))) is None:
                commands[name].error(f"settings give {key!r}, which is no option of {name}")
            if isinstance(value, list) != (option.nargs is not None and option.nargs != 0):
                commands[name].error(f"settings give {key!r} as {value!r}")
            of = option.type or (bool if option.nargs == 0 else str)
            option.default = [of(v) for v in value] if isinstance(value, list) else value if value is None else of(value)
            if option.choices and option.default not in option.choices:
                commands[name].error(f"settings give {key!r} as {value!r}, not one of {', '.join(option.choices)}")
            option.required = False
    return top.parse_args(args)


def main(args: Sequence[str] | None = None) -> int:
    a = arguments(args)
    log = logs.setup(a.log_level, a.log_file)
    log.info("started", command=a.command)
    code = a.run(a, get_session())
    log.info("ended", command=a.command, code=code)
    return code


if __name__ == "__main__":
    sys.exit(main())
