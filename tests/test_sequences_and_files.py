import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake import config
from strandlake.operators import embedding, sequences
from strandlake.sources import files

GBK = """LOCUS       c1                   12 bp    DNA
DEFINITION  a long
            name.
ACCESSION   c1
FEATURES             Location/Qualifiers
     source          1..12
     CDS             complement(1..9)
                     /protein_id="ERZ12818450.521-NODE-521-length-3301-cov-
                     2.911275_5"
                     /product="a product
                     with spaces"
                     /translation="MKV
                     LL"
     CDS             4..12
                     /locus_tag="x"
ORIGIN
        1 acgtacgtac gt
//
LOCUS       c2                   3 bp    DNA
FEATURES             Location/Qualifiers
ORIGIN
        1 ttt
//
"""


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">a first one\nACGT\nAC\n>b [c9]\n\n>c\nTTTTTTTT")
    with gzip.open(tmp_path / "b.fa.gz", "wt") as f:
        f.write(">z\nAAAA\n")
    got = {r["id"]: (r["description"], r["seq"]) for r in files.fasta(spark, str(tmp_path / "*.fa*")).collect()}
    assert got == {"a": ("a first one", "ACGTAC"), "b": ("b [c9]", ""), "c": ("c", "TTTTTTTT"), "z": ("z", "AAAA")}
    assert files.fasta_proteins(spark, str(tmp_path / "a.fa")).count() == 2
    with pytest.raises(ValueError):
        files.proteins(spark, "x", "other")
    text = files.fasta_text(spark.createDataFrame([("d", "A" * 130)], "description string, seq string")).first()[0]
    assert text == ">d\n" + "A" * 60 + "\n" + "A" * 60 + "\n" + "A" * 10


def test_genbank(spark, tmp_path):
    (tmp_path / "x.gbk").write_text(GBK)
    got = {r["id"]: r for r in files.genbank(spark, str(tmp_path / "x.gbk")).collect()}
    assert got["c1"]["seq"] == "ACGTACGTACGT" and got["c2"]["seq"] == "TTT" and got["c1"]["description"].strip().startswith("a long name.")
    rows = files.genbank_features(spark, str(tmp_path / "x.gbk")).orderBy("ord").collect()
    assert [(r["type"], r["start"], r["end"], r["strand"]) for r in rows] == [("source", 0, 12, 1), ("CDS", 0, 9, -1), ("CDS", 3, 12, 1)]
    assert rows[1]["qualifiers"]["product"] == ["a product with spaces"]
    assert [r["seq"] for r in files.genbank_proteins(spark, str(tmp_path / "x.gbk")).collect()] == ["MKVLL"]


def test_unwrapping_is_idempotent(spark):
    df = spark.createDataFrame([(GBK,)], "t string")
    once = df.select(files.unwrap_ids(F.col("t")).alias("t"))
    text = once.first()[0]
    assert 'cov-2.911275_5"' in text and "a product\n                     with spaces" in text
    assert once.select(files.unwrap_ids(F.col("t"))).first()[0] == text


def test_obo(spark, tmp_path):
    (tmp_path / "o.obo").write_text('format-version: 1.2\n\n[Term]\nid: T:1\nname: one\n\n[Term]\nid: T:2\nname: old\n\n[Term]\nid: T:2\nname: two\nxref: SMARTS "[C]"\nis_a: T:1 ! one\n\n[Typedef]\nid: R\n')
    terms, links = files.obo(spark, str(tmp_path / "o.obo"))
    assert {(r["id"], r["name"], r["smarts"]) for r in terms.collect()} == {("T:1", "one", None), ("T:2", "two", "[C]")}
    assert [tuple(r) for r in links.collect()] == [("T:2", "T:1", 0)]


def test_tsv_names_missing_columns(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("id\tother\n1\t2\n")
    with pytest.raises(ValueError, match="smiles.*id, other"):
        files.tsv(spark, str(tmp_path / "t.tsv"), ("id", "smiles"))


def test_contig_filters(spark):
    ids = sequences.passing(spark.createDataFrame([("c1", "A" * 10), ("c2", "A")], "id string, seq string"), 5)
    faa = spark.createDataFrame([("c1_5", "p"), ("c2_1", "p [c1] [c2]"), ("c2_2", "p [c2]"), ("q", "q")], "id string, description string")
    assert {r["id"] for r in sequences.keep_proteins(faa, ids).collect()} == {"c1_5", "c2_1"}
    lines = spark.createDataFrame([(0, "##gff"), (1, "c1\tx"), (2, "c2\tx"), (3, "#c2")], "line_no long, raw string")
    assert [r["line_no"] for r in sequences.keep_gff(lines, ids).orderBy("line_no").collect()] == [0, 1, 3]


def test_regions_keep_their_numbers(spark):
    row = lambda c, t, a, b: "\t".join([c, "s", t, str(a), str(b), ".", "+", ".", "ID=1"])
    raws = ["#x", row("c1", "BGC", 3, 6), "c1\tshort", row("gone", "bgc", 1, 2), row("c1", "gene", 1, 2), row("c1", "bgc", 5, 99)]
    lines = spark.createDataFrame(list(enumerate(raws)), "line_no long, raw string")
    regions = sequences.parse_regions(lines, "bgc")
    records = spark.createDataFrame([("c1", "ACGTACGT")], "id string, seq string")
    got = {r["idx"]: r for r in sequences.extract(regions, records, "gecco", "p").collect()}
    assert {k: (v["id"], v["seq"], v["description"]) for k, v in got.items()} == {1: ("p_gecco_bgc_1", "GTAC", "BGC region 1 from gecco | c1:3-6"), 3: ("p_gecco_bgc_3", "ACGT", "BGC region 3 from gecco | c1:5-8")}
    assert [r["idx"] for r in sequences.missing_contigs(regions, records).collect()] == [2]


def test_batches_follow_the_budget(spark):
    sizes = [3, 4, 12, 2, 5, 11, 1, 0, 99, 9]
    df = spark.createDataFrame([("f", i, "A" * n) for i, n in enumerate(sizes)], "file string, ord long, seq string")
    got = {r["ord"]: r["batch"] for r in sequences.token_batches(df, budget=10, longest=50).collect()}

    def fold():
        batch, used, number, out = [], 0, 0, {}
        for i, n in enumerate(sizes):
            if not n or n > 50:
                continue
            if not batch and n > 10:
                out[i] = number
                number += 1
            elif used + n > 10 and batch:
                number += 1
                out[i], batch, used = number, [i], n
            else:
                out[i] = number
                batch.append(i)
                used += n
        return out

    assert got == fold()


def test_validation(spark):
    df = spark.createDataFrame([(0, " acd "), (1, "AC1*A"), (2, "  ")], "ord long, seq string")
    assert [(r["seq"], r["bad"]) for r in sequences.validated(df).orderBy("ord").collect()] == [("ACD", ""), ("AC1*A", "*1"), ("", "empty")]
    with pytest.raises(Exception, match="not an amino-acid"):
        sequences.require_valid(df).collect()


def test_pooling_against_numpy(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(5, 6))
    v[2] = 0
    df = spark.createDataFrame([("b", i, x.tolist()) for i, x in enumerate(v)], "bgc string, ord long, vector array<double>")
    pe = np.array([[(np.sin if k % 2 == 0 else np.cos)(i / 10000 ** (2 * (k // 2) / 6)) for k in range(6)] for i in range(5)])
    norm = lambda x: x / np.where((n := np.linalg.norm(x, axis=-1, keepdims=True)) == 0, 1, n)
    cases = [({}, v.mean(0)), ({"aggregation": "max"}, v.max(0)), ({"scale": 0.5}, (v + 0.5 * pe).mean(0)), ({"scale": 0.5, "per_protein_norm": True, "post_norm": True}, norm(norm(v + 0.5 * pe).mean(0))), ({"scale": 0.5, "per_protein_norm": True, "pe_before_norm": False}, (norm(v) + 0.5 * pe).mean(0))]
    for options, want in cases:
        assert np.allclose(embedding.pool(df, 6, **options).first()["vector"], want)
    with pytest.raises(ValueError):
        embedding.pool(df, 5)
    assert embedding.strategy(3, True, "mean", False, True, 0.5) == "layer_3__ppnorm_1__agg_mean__postnorm_0__pebefore_1__scale_0.5000"


class Fails:
    def __call__(self, seqs):
        if any("W" in s for s in seqs):
            raise RuntimeError("no W")
        return [np.ones((2, 3)) * len(s) for s in seqs]


def test_embedding_repeats_failed_records(spark):
    df = spark.createDataFrame([(0, "acd"), (1, "AW"), (2, "ACD"), (3, "AA")], "ord long, seq string")
    got = embedding.embed(df, Fails).collect()
    assert {(r["sequence_length"], r["error"], r["layers"] is None) for r in got} == {(2, None, False), (2, "no W", True), (3, None, False)} and len(got) == 3


def test_settings(tmp_path):
    (tmp_path / "c.yaml").write_text("a:\n  b: ${WHERE}\n  c: 1\nd: 2\n")
    (tmp_path / ".env").write_text("X_D=5\nWHERE=there\n")
    got = config.load({"a": {"c": 0, "e": 9}}, str(tmp_path / "c.yaml"), "X", str(tmp_path / ".env"), {"d": None}, {"X_A__C": "7"})
    assert got == {"a": {"b": "there", "c": 7, "e": 9}, "d": 5}
    with pytest.raises(KeyError):
        config.expand("${NOT_SET}", {})


def test_long_wrapped_ids_come_on_one_line(spark):
    pad = "\n" + " " * 21
    parts = [f"part{i}" for i in range(12)]
    text = f"     CDS             1..9{pad}/locus_tag=\"{pad.join(parts)}\"{pad}/product=\"two{pad}lines\"{pad}/gene=\"open{pad}/note=\"x\""
    got = spark.createDataFrame([(text,)], "t string").select(files.unwrap_ids(F.col("t"))).first()[0]
    assert got == f"     CDS             1..9{pad}/locus_tag=\"{''.join(parts)}\"{pad}/product=\"two{pad}lines\"{pad}/gene=\"open{pad}/note=\"x\""


def test_obo_in_an_archive_equals_the_plain_file(spark, tmp_path):
    import zipfile

    text = 'format-version: 1.2\n\n[Term]\nid: T:1\nname: one\nxref: SMARTS "C"\n\n[Term]\nid: T:2\nname: two\nis_a: T:1 ! one\n'
    (tmp_path / "o.obo").write_text(text)
    with zipfile.ZipFile(tmp_path / "o.zip", "w") as z:
        z.writestr("o.obo", text)
    rows = lambda p: [sorted(tuple(r)[1:] for r in t.collect()) if i == 0 else sorted(tuple(r) for r in t.collect()) for i, t in enumerate(files.obo(spark, str(tmp_path / p)))]
    assert rows("o.zip") == rows("o.obo") and len(rows("o.zip")[0]) == 2


def test_nan_is_written_as_null(spark, tmp_path):
    files.write_table(spark.createDataFrame([(1, float("nan")), (2, 0.5)], "id long, x double"), str(tmp_path / "t"))
    assert [r["x"] for r in spark.read.parquet(str(tmp_path / "t")).orderBy("id").collect()] == [None, 0.5]


def test_lineage_patterns(spark):
    from strandlake.operators import ontology

    terms = spark.createDataFrame([("A", "C"), ("B", None), ("D", "N")], "id string, smarts string")
    closed = ontology.closure(terms, spark.createDataFrame([("B", "A"), ("D", "B")], "child string, parent string"))
    assert sorted(tuple(r) for r in ontology.lineage_patterns(terms, closed).collect()) == [("A", "A", 0, "C"), ("B", "A", 1, "C"), ("D", "A", 2, "C"), ("D", "D", 0, "N")]
    ranked = ontology.lineage(terms.withColumn("ord", F.lit(0)), closed)
    assert sorted((r["term"], r["rank"], r["ancestor"]) for r in ranked.collect()) == [("A", 1, "A"), ("B", 1, "A"), ("D", 1, "D"), ("D", 2, "A")]


def test_a_service_that_fails_can_fail_the_query(spark):
    from strandlake.operators import chemistry

    class Gone(chemistry.FakeService):
        def lookup(self, key):
            raise ConnectionError("unreachable")

    df = spark.createDataFrame([("1", "CCO")], "id string, smiles string")
    assert chemistry.classify_remote(df, Gone).first()["error"] == "unreachable"
    with pytest.raises(Exception, match="unreachable"):
        chemistry.classify_remote(df, Gone, strict=True).collect()


def test_metadata_goes_with_the_table(spark, tmp_path):
    files.write_table(spark.createDataFrame([(1, 0.5)], "id long, x double"), str(tmp_path / "t"), {"backend": "b", "n": 3})
    assert spark.read.parquet(str(tmp_path / "t")).schema["id"].metadata == {"backend": "b", "n": 3}


def test_token_means(spark):
    rows = [("a", 0, t, [float(t), 2.0]) for t in range(4)] + [("a", 1, 0, [5.0, 6.0])]
    got = {(r["id"], r["layer"]): list(r["vector"]) for r in embedding.token_means(spark.createDataFrame(rows, "id string, layer int, token int, vector array<float>")).collect()}
    assert got == {("a", 0): [1.5, 2.0], ("a", 1): [5.0, 6.0]}


class Counting:
    """A model that writes down every sequence it is asked for; one with a W fails, and so does its batch."""

    def __init__(self, path):
        self.path = path

    def __call__(self):
        return self.run

    def run(self, seqs):
        with open(self.path, "a") as out:
            out.write("".join(f"{s} {sum(map(len, seqs))}\n" for s in seqs))
        if any("W" in s for s in seqs):
            raise RuntimeError("no W")
        return [np.array([[len(s), 1.0], [s.count("A"), 2.0]]) for s in seqs]


def asked(path):
    return sorted(line.split()[0] for line in open(path)) if path.exists() else []


def test_the_model_runs_once_and_its_outcomes_are_counted(spark, tmp_path):
    seqs = ["ACD", "ACDE", "AAAA", "ACD", "C" * 30]
    df = spark.createDataFrame(list(enumerate(seqs)), "ord long, seq string")
    found, counts = embedding.embed_once(df, Counting(tmp_path / "a"), longest=20)
    assert found.count() == 4 and found.filter("outcome = 'embedded'").count() == 3 and found.collect()
    assert asked(tmp_path / "a") == ["AAAA", "ACD", "ACDE"]  # one call for each, whatever is done with the rows
    assert counts == embedding.Outcomes(seen=4, written=3, failed=0, skipped=1, retried=0)
    counts.require_success()
    bad, counts = embedding.embed_once(df.limit(2).unionByName(spark.createDataFrame([(9, "AWA")], "ord long, seq string")).coalesce(1), Counting(tmp_path / "b"))
    assert (counts.seen, counts.written, counts.failed, counts.skipped) == (3, 2, 1, 0) and counts.retried == bad.filter("retried").count() >= 1
    with pytest.raises(ValueError, match="none of 1"):
        embedding.embed_once(df.filter("ord = 4"), Counting(tmp_path / "c"), longest=5)[1].require_success()
    assert asked(tmp_path / "c") == []
    embedding.embed_once(df.limit(0), Counting(tmp_path / "d"))[1].require_success()


def test_batches_keep_to_the_budget(spark, tmp_path):
    assert embedding.filled([1000, 5999, 5000, 1000, 7000, 1], 6000) == [0, 1, 2, 2, 3, 4]
    df = spark.createDataFrame([(i, "A" * n) for i, n in enumerate((10, 59, 50, 10, 70, 1, 3))], "ord long, seq string").coalesce(1)
    embedding.embed_once(df, Counting(tmp_path / "a"), budget=60, distinct=False)
    assert all(int(line.split()[1]) <= 60 or len(line.split()[0]) == 70 for line in open(tmp_path / "a"))


def test_library_functions_give_nothing_on_any_failure(spark, tmp_path):
    rows = [("x", 0, "ACD"), ("x", 1, "AAAA"), ("y", 2, "ACD"), ("y", 3, "AWA"), ("z", 4, "ACD"), ("z", 5, "C" * 30)]
    df = spark.createDataFrame(rows, "bgc string, ord long, seq string")
    each = {r["ord"]: r["layers"] for r in embedding.embed_sequences(df, Counting(tmp_path / "a"), longest=20).collect()}
    assert {o for o, x in each.items() if x is None} == {3, 5} and each[1] == [[4.0, 1.0], [4.0, 2.0]] and each[0] == each[2] == each[4]
    got = {r["bgc"]: r["vector"] for r in embedding.aggregate_sequences(df, Counting(tmp_path / "b"), 2, "final", 0.0, longest=20).collect()}
    assert got == {"x": [2.5, 2.0], "y": None, "z": None}
    clusters = spark.createDataFrame([("x",), ("none",)], "bgc string")
    held = spark.createDataFrame([("x", 1, [[4.0, 1.0]]), ("x", 0, [[2.0, 1.0]])], "bgc string, ord long, layers array<array<float>>")
    got = {r["bgc"]: r["vector"] for r in embedding.aggregate_embeddings(clusters, held, 2, 0, 0.0, aggregation="max").collect()}
    assert got == {"x": [4.0, 1.0], "none": None}


def test_unplaced_partials_are_counted(spark):
    from strandlake.operators import similarity

    partials = spark.createDataFrame([(i,) for i in range(4)], "id long")
    signature = spark.createDataFrame([(i, "domain", f"f{i}") for i in range(1, 4)], "id long, kind string, feature string")
    near = spark.createDataFrame([(2, 9, 0.05), (3, 9, 0.9)], "i long, j long, s double")
    assert tuple(similarity.unplaced(partials, signature, partials.filter("id = 3"), near).first()) == (3, 1, 1, 1)


COMPOUND = """LOCUS       C1                       120 bp    DNA     linear   BCT 01-JAN-2020
DEFINITION  first of
            two lines.
ACCESSION   C1
VERSION     C1.1
COMMENT     kept as it stands
  ORGANISM  Some thing
FEATURES             Location/Qualifiers
     source          1..120
                     /organism="Some thing"
     CDS             join(11..19,
                     complement(31..40),<51..>60)
                     /locus_tag="a_1"
     CDS             complement(order(21..29,J00194.1:100..202,41..50))
                     /locus_tag="a_2"
     misc_feature    70^71
                     /note="between"
ORIGIN
        1 acgtacgtac
//
LOCUS       C1                        20 bp    DNA
VERSION     C1.1
FEATURES             Location/Qualifiers
     CDS             1..9
                     /locus_tag="b_1"
ORIGIN
        1 acgtacgtac gtacgtacgt
//
LOCUS       C2                         4 bp    DNA
VERSION     C2.1
ORIGIN
        1 acgt
//
"""


def test_locations_are_parsed_moved_and_written_whole(spark, tmp_path):
    (tmp_path / "a.gbk").write_text(COMPOUND)
    got = files.genbank_features(spark, str(tmp_path / "a.gbk")).withColumn("parts", files.segments(F.col("location"))).orderBy("record", "ord").collect()
    assert [r["location"] for r in got] == ["1..120", "join(11..19,complement(31..40),<51..>60)", "complement(order(21..29,J00194.1:100..202,41..50))", "70^71", "1..9"]
    assert [tuple(p) for p in got[1]["parts"]] == [(10, 19, 1, False, False), (30, 40, -1, False, False), (50, 60, 1, True, True)]
    assert [tuple(p) for p in got[2]["parts"]] == [(20, 29, -1, False, False), (40, 50, -1, False, False)]
    assert [(r["start"], r["end"]) for r in got] == [(0, 120), (10, 60), (20, 50), (69, 71), (0, 9)]
    moved = spark.createDataFrame([(r["location"],) for r in got], "x string").select(files.moved_location(F.col("x"), F.lit(-10)).alias("x")).collect()
    assert [r["x"] for r in moved[1:4]] == ["join(1..9,complement(21..30),<41..>50)", "complement(order(11..19,J00194.1:100..202,31..40))", "60^61"]
    # written and read again, a long one over several lines
    long = "join(" + ",".join(f"{i}..{i + 5}" for i in range(1, 400, 10)) + ")"
    features = spark.createDataFrame([("r", 0, 396, "CDS", 1, {"gene": ["g"]}, long), ("r", 5, 9, "CDS", -1, {"gene": ["h"]}, None)], "id string, start long, end long, type string, strand int, qualifiers map<string,array<string>>, location string")
    text = files.genbank_text(spark.createDataFrame([("r", "d", "ACGT" * 100)], "id string, description string, seq string"), features).first()["value"]
    assert max(map(len, text.split("\n"))) < 81
    (tmp_path / "b.gbk").write_text(text + "\n")
    again = files.genbank_features(spark, str(tmp_path / "b.gbk")).orderBy("ord").collect()
    assert [(r["location"], r["start"], r["end"], r["strand"]) for r in again] == [(long, 0, 396, 1), ("complement(6..9)", 5, 9, -1)]


def test_filtered_records_stay_as_they_are(spark, tmp_path):
    from strandlake import cli

    (tmp_path / "a.gbk").write_text(COMPOUND)
    assert cli.main(["contig-filter", "--gbk", str(tmp_path / "a.gbk"), "--min-length", "10", "--out-dir", str(tmp_path / "out")]) == 0
    out = "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "out" / "filtered.gbk")).collect()) + "\n"
    assert out == COMPOUND[: COMPOUND.index("LOCUS       C2")]
    of = lambda p: [tuple(r)[2:] for r in files.genbank_features(spark, p).orderBy("record", "ord").collect()]
    assert of(str(tmp_path / "out" / "filtered.gbk")) == of(str(tmp_path / "a.gbk"))


def test_regions_keep_compound_locations(spark, tmp_path):
    (tmp_path / "a.gbk").write_text(COMPOUND)
    features = files.genbank_features(spark, str(tmp_path / "a.gbk")).filter("location <> '1..9'").withColumn("seqid", F.lit("C1.1"))
    regions = spark.createDataFrame([("r1", "C1.1", 10, 65), ("r2", "C1.1", 15, 65)], "id string, seqid string, start long, end long")
    got = {(r["id"], r["location"]) for r in files.region_features(regions, features).collect()}
    assert got == {("r1", "join(1..9,complement(21..30),<41..>50)"), ("r1", "complement(order(11..19,J00194.1:100..202,31..40))"), ("r2", "complement(order(6..14,J00194.1:100..202,26..35))")}


@pytest.mark.parametrize("block", ["64", "128m"])
def test_records_are_numbered_by_path_and_place(spark, tmp_path, block):
    """The larger file comes later by its name, but first in Spark's packing; small blocks part each."""
    (tmp_path / "fa").mkdir()
    (tmp_path / "gff").mkdir()
    names = [("a", 3), ("b", 40), ("c", 9)]
    for name, n in names:
        (tmp_path / "fa" / f"{name}.fa").write_text("".join(f">{name}{i} word\nAC\nGT\n" for i in range(n)))
        (tmp_path / "gff" / f"{name}.gff").write_text("".join(f"{name}{i}\tx\r\n" for i in range(n)))
    want = [f"{name}{i}" for name, n in names for i in range(n)]
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in held:
            spark.conf.set(k, block)
        records = files.fasta(spark, f"{tmp_path}/fa")
        got = records.orderBy("ord").collect()
        assert [r["id"] for r in got] == want and len({r["ord"] for r in got}) == len(want) and {r["seq"] for r in got} == {"ACGT"}
        assert [r["raw"] for r in files.gff(spark, f"{tmp_path}/gff").orderBy("line_no").collect()] == [f"{w}\tx" for w in want]
        one = files.fasta(spark, f"{tmp_path}/fa/b.fa").orderBy("ord").collect()
        assert [r["id"] for r in one] == [w for w in want if w[0] == "b"]
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
