import pytest
from pyspark.sql import functions as F

from strandlake.functions import classes
from strandlake.operators import chemistry, ontology


@pytest.fixture(scope="module")
def small(spark):
    terms = spark.createDataFrame([("A",), ("B",), ("C",), ("D",)], "id string")
    links = spark.createDataFrame([("B", "A"), ("C", "B"), ("D", "B")], "child string, parent string")
    ic = spark.createDataFrame([("A", 0.0), ("B", 1.0), ("C", 3.0), ("D", 3.0)], "term string, ic double")
    return ontology.closure(terms, links).persist(), ic, terms, links


def pairs(spark, *rows):
    return spark.createDataFrame(rows, "t1 string, t2 string")


def test_closure_and_depth(spark, small):
    closed, _, terms, links = small
    assert {(r["term"], r["ancestor"]): r["dist"] for r in closed.filter("term = 'C'").collect()} == {("C", "C"): 0, ("C", "B"): 1, ("C", "A"): 2}
    assert {r["term"]: r["depth"] for r in ontology.depths(terms, links, closed).collect()} == {"A": 0, "B": 1, "C": 2, "D": 2}
    more = links.unionByName(spark.createDataFrame([("A", "GONE")], "child string, parent string"))
    assert ontology.closure(terms, more).filter("ancestor = 'GONE'").count() == 4
    assert ontology.closure(terms, more, defined_only=True).filter("ancestor = 'GONE'").count() == 0
    with pytest.raises(ValueError):
        ontology.closure(terms, links.unionByName(spark.createDataFrame([("A", "D")], "child string, parent string")).withColumn("parent", F.concat("parent", F.lit(""))), max_depth=1)


def test_lin_and_resnik(spark, small):
    closed, ic, *_ = small
    got = {(r["t1"], r["t2"]): r["lin"] for r in ontology.lin(pairs(spark, ("C", "C"), ("C", "D"), ("C", "A"), ("A", "A")), closed, ic).collect()}
    assert got == {("C", "C"): 1.0, ("C", "D"): pytest.approx(1 / 3), ("C", "A"): 0.0, ("A", "A"): 0.0}
    assert ontology.resnik(pairs(spark, ("D", "D")), closed, ic).first()["resnik"] == 3


def test_semantic_sets(spark, small):
    closed, ic, *_ = small
    sets = spark.createDataFrame([(1, "C"), (1, "D"), (2, "C"), (3, "D"), (4, "B"), (4, "C")], "entity long, term string")
    compared = spark.createDataFrame([(4, 4), (2, 3), (1, 2), (2, 1), (1, 9)], "a long, b long")
    every = [(x, y) for x in "ABCD" for y in "ABCD"]
    lin = ontology.lin(pairs(spark, *every), closed, ic)
    bma = {(r["a"], r["b"]): r["score"] for r in ontology.best_match_average(sets, compared, lin, "lin").collect()}
    assert bma[4, 4] == 1 and bma[2, 3] == pytest.approx(1 / 3) and bma[1, 9] == 0
    cov = {(r["a"], r["b"]): r["score"] for r in ontology.coverage(sets, compared, lin).collect()}
    assert cov[2, 1] == 1 and cov[1, 2] == pytest.approx(2 / 3) and cov[1, 9] == 0


def test_information_content(spark, small):
    closed = small[0]
    counts = spark.createDataFrame([("C", 1), ("D", 1), ("X", 1)], "term string, cnt long")
    got = {r["term"]: r["ic"] for r in ontology.information_content(counts, closed, 4).collect()}
    assert got == {"A": 1.0, "B": 1.0, "C": 2.0, "D": 2.0, "X": 2.0}
    assert ontology.information_content(counts, closed, 0).count() == 0


ANTI = {
    "T1PKS": ["Polyketide"], "NRPS": ["NRP"], "RiPP_like": ["RiPP"], "RRE_containing": ["RiPP"], "terpene_precursor": ["Terpene"], "acyl_amino_acids": ["Other"], "hydrogen_cyanide": ["Other"],
    "NI_siderophore": ["Other"], "oligosaccharide": ["Saccharide"], "NRPS_T1PKS": ["NRP", "Polyketide"], "transAT_PKS_NRPS": ["NRP", "Polyketide"], "T1PKS_NRPS_like": ["NRP", "Polyketide"],
    "NRPS_like_T1PKS_NRPS": ["NRP", "Polyketide"], "NRP_T1PKS": ["NRP", "Polyketide"], "NRP_metallophore_NRPS": ["NRP"], "fungal_cdps": ["NRP"], "CDPS": ["NRP"], "NRP": ["NRP"], "Terpene": ["Terpene"],
    "thiopeptide": ["RiPP"], "LAP_thiopeptide": ["RiPP"], "totally_made_up": ["Other"], "": [], "  ": [], "-_": [],
}
BASE = {"Unknown": ["Other"], "NRP_Polyketide": ["NRP", "Polyketide"], "NRP_Other_Polyketide": ["NRP", "Other", "Polyketide"], "Alkaloid_Terpene": ["Alkaloid", "Terpene"], "": []}


def test_categories(spark):
    rows = [("antiSMASH:8.0.1", k, v) for k, v in ANTI.items()] + [("GECCO v0.9.8", k, v) for k, v in BASE.items()]
    df = spark.createDataFrame(rows, "tool string, raw string, want array<string>").withColumn("got", classes.categories(F.col("tool"), F.col("raw")))
    for r in df.collect():
        assert r["got"] == r["want"], r


def test_labels_and_unions(spark):
    cases = [([], "Other"), (["Other"], "Other"), (["Polyketide"], "Polyketide"), (["Other", "Polyketide"], "Polyketide"), (["NRP", "Other", "Polyketide", "RiPP"], "Hybrid(P+N)"), (["NRP", "Saccharide"], "Hybrid"), (["Alkaloid", "Terpene"], "Hybrid")]
    df = spark.createDataFrame([(c, w) for c, w in cases], "c array<string>, want string")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", classes.label(F.col("c"))).collect())
    rows = [(1, "antiSMASH", "T1PKS"), (1, "GECCO", "NRP"), (2, "antiSMASH", "terpene"), (2, "GECCO", "Terpene"), (3, "GECCO", "Unknown"), (4, "x", ""), (4, None, None)]
    got = {r["id"]: r["label"] for r in classes.classify(spark.createDataFrame(rows, "id long, tool string, raw string")).collect()}
    assert got == {1: "Hybrid(P+N)", 2: "Terpene", 3: "Other", 4: ""}


def test_vocabulary_size():
    types = [t for x in classes.PRODUCT_TYPES.values() for t in x]
    assert len(types) == len(set(types)) == 103


def test_matches_are_ranked_by_depth(spark):
    terms = spark.createDataFrame([("t1", "n1", "a", 1, 0), ("t2", "n2", "b", 3, 1), ("t3", "bad", "(", 9, 2), ("t4", "none", None, 9, 3)], "id string, name string, smarts string, depth int, ord int")
    got = chemistry.match(spark.createDataFrame([("c", "ab"), ("d", "zz"), ("e", None)], "id string, smiles string"), terms, chemistry.RegexMatcher).orderBy("rank").collect()
    assert [(r["id"], r["chemont_id"], r["rank"]) for r in got] == [("c", "t2", 1), ("c", "t1", 2)]


def test_remote_classification(spark):
    node = lambda i: {"chemont_id": i}
    assert chemistry.document_ids({"kingdom": node("a"), "superclass": None, "class": node("b"), "direct_parent": node("c"), "intermediate_nodes": [node("d"), node("a")], "alternative_parents": None}) == ["a", "b", "c", "d"]
    df = spark.createDataFrame([("1", "CC"), ("2", "CCC"), ("3", ""), ("4", "CC")], "id string, smiles string")
    got = {r["id"]: r for r in chemistry.classify_remote(df, chemistry.FakeService).collect()}
    assert got["1"]["chemont_ids"] == ["C:0", "C:2"] == got["4"]["chemont_ids"] and got["2"]["chemont_ids"] == [] and got["3"]["inchikey"] is None
