import pytest

from strandlake import cli
from strandlake.sources import files

GBK = """LOCUS       c1                   24 bp    DNA
DEFINITION  one contig.
VERSION     c1
FEATURES             Location/Qualifiers
     CDS             3..8
                     /locus_tag="x"
                     /translation="MKV"
     CDS             complement(10..30)
                     /locus_tag="y"
ORIGIN
        1 acgtacgtac gtacgtacgt acgt
//
"""


@pytest.fixture(autouse=True)
def same_session(spark, monkeypatch):
    monkeypatch.setattr(cli, "get_session", lambda: spark)


def test_regions_are_written_as_genbank(spark, tmp_path):
    (tmp_path / "a.gbk").write_text(GBK)
    (tmp_path / "a.gff").write_text("##gff\nc1\tt\tbgc\t2\t12\t.\t+\t.\tID=1\nc1\tt\tBGC\t13\t99\t.\t+\t.\tID=2\n")
    assert cli.main(["regions", "--gbk", str(tmp_path / "a.gbk"), "--gff", str(tmp_path / "a.gff"), "--caller-name", "gecco", "--out-dir", str(tmp_path)]) == 0
    out = {r["id"]: r for r in files.genbank(spark, str(tmp_path / "regions/*/*.txt")).collect()}
    assert out["sample_gecco_bgc_1"]["seq"] == "CGTACGTACGT" and out["sample_gecco_bgc_2"]["seq"] == "ACGTACGTACGT"
    rows = files.genbank_features(spark, str(tmp_path / "regions/*/*.txt")).collect()
    assert [(r["type"], r["start"], r["end"], r["qualifiers"]["locus_tag"]) for r in rows] == [("CDS", 1, 7, ["x"])]


def test_contig_filter(spark, tmp_path):
    (tmp_path / "a.fna").write_text(">c1 long\n" + "A" * 100 + "\n>c2\nAC\n")
    (tmp_path / "a.faa").write_text(">c1_1\nMK\n>c2_1\nMK\n")
    (tmp_path / "a.gff").write_text("#h\nc1\ta\nc2\tb\n")
    args = ["contig-filter", "--fna", str(tmp_path / "a.fna"), "--faa", str(tmp_path / "a.faa"), "--gff", str(tmp_path / "a.gff"), "--min-length", "50", "--out-dir", str(tmp_path)]
    assert cli.main(args) == 0
    assert [r["id"] for r in files.fasta(spark, str(tmp_path / "filtered.fna")).collect()] == ["c1"]
    assert [r["id"] for r in files.fasta(spark, str(tmp_path / "filtered.faa")).collect()] == ["c1_1"]
    assert [r["value"] for r in spark.read.text(str(tmp_path / "filtered.gff")).collect()] == ["#h", "c1\ta"]


def test_classify_and_embed(spark, tmp_path):
    (tmp_path / "o.obo").write_text('[Term]\nid: T:1\nname: one\nxref: SMARTS "a"\n\n[Term]\nid: T:2\nname: two\nxref: SMARTS "b"\nis_a: T:1 ! one\n')
    (tmp_path / "c.tsv").write_text("id\tsmiles\nx\tab\ny\tzz\n")
    assert cli.main(["classify", "--obo", str(tmp_path / "o.obo"), "--backend", "strandlake.operators.chemistry:RegexMatcher", "--input", str(tmp_path / "c.tsv"), "--output", str(tmp_path / "m")]) == 0
    assert [(r["id"], r["chemont_id"], r["rank"]) for r in spark.read.csv(str(tmp_path / "m"), header=True, sep="\t").orderBy("rank").collect()] == [("x", "T:2", "1"), ("x", "T:1", "2")]
    (tmp_path / "p.faa").write_text(">a\nACD\n>b\nACDA\n")
    common = ["--input", str(tmp_path / "p.faa"), "--backend", "strandlake.plans.catalogue:_Letters"]
    assert cli.main(["embed", *common, "--output", str(tmp_path / "e")]) == 0 and spark.read.parquet(str(tmp_path / "e")).count() == 2
    assert cli.main(["embed-cluster", *common, "--output", str(tmp_path / "v"), "--accession", "B1", "--dim", "8"]) == 0
    r = spark.read.parquet(str(tmp_path / "v")).first()
    assert (r["accession"], r["n_proteins"], r["vector_dim"], r["vector"][0]) == ("B1", 2, 8, 0.5)


def test_settings_drive_each_command(spark, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "a.fna").write_text(">c1 long\n" + "A" * 100 + "\n>c2\n" + "C" * 20 + "\n>c3\nG\n")
    (tmp_path / "s.yaml").write_text(
        "contig-filter: {fna: '${HERE}/a.fna', min_length: 50, out_dir: '${HERE}/one'}\n"
        "cluster: {input: i, output: o, knn_k: 7, resolutions: [0.1, 0.5], weight: [0.3, 0.7]}\n"
        "regions: {gbk: g, gff: f, caller_name: gecco}\nproject_partials: {input: i, primary: p, output: o}\n"
        "classify: {obo: o, backend: 'm:C'}\nembed: {input: i, output: o, backend: b, budget: 99}\n"
        "embed-cluster: {input: i, output: o, backend: b, accession: B1, dim: 8, layer: 3, post_norm: true}\n"
    )
    monkeypatch.setenv("HERE", str(tmp_path))
    of = lambda *more: cli.arguments(["--config", "s.yaml", *more])
    a = of("cluster", "--knn-k", "9")
    assert (a.input, a.output, a.knn_k, a.resolutions, a.weight, a.seed) == ("i", "o", 9, [0.1, 0.5], [0.3, 0.7], None)
    assert (of("regions").caller_name, of("regions").prefix, of("project-partials").primary, of("classify").backend) == ("gecco", "sample", "p", "m:C")
    a = of("embed-cluster", "--dim", "4")
    assert (a.dim, a.layer, a.post_norm, a.per_protein_norm, of("embed").budget) == (4, "3", True, False, 99)
    assert cli.main(["--config", "s.yaml", "contig-filter"]) == 0
    assert [r["id"] for r in files.fasta(spark, str(tmp_path / "one/filtered.fna")).collect()] == ["c1"]
    monkeypatch.setenv("STRANDLAKE_CONTIG_FILTER__MIN_LENGTH", "10")
    assert of("contig-filter").min_length == 10 and of("contig-filter", "--min-length", "30").min_length == 30
    for bad in ("embed: {colour: red}", "embed: {budget: [1]}", "embed: {format: pdf}"):
        (tmp_path / "s.yaml").write_text(bad)
        with pytest.raises(SystemExit):
            of("embed", "--input", "i", "--output", "o", "--backend", "b")
    with pytest.raises(SystemExit):
        cli.arguments(["embed"])


def test_json_log_lines(tmp_path):
    import json

    from strandlake import logs

    log = logs.setup("info", str(tmp_path / "l"))
    log.info("héllo", n=3)
    line = json.loads((tmp_path / "l").read_text())
    assert line["msg"] == "héllo" and line["context"]["n"] in (3, "3")
    assert logs.package_version("pyspark") and logs.package_version("no-such-package") == ""
