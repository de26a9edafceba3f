"""Product classes: from detectors' strings to canonical labels, as column expressions."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The canonical classes and labels.
BASE_CLASSES = ["Polyketide", "NRP", "RiPP", "Terpene", "Saccharide", "Alkaloid", "Other"]
LABELS = [*BASE_CLASSES, "Hybrid(P+N)", "Hybrid"]

# Class of each base name.
BASE_NAMES = {"polyketide": "Polyketide", "nrp": "NRP", "ripp": "RiPP", "terpene": "Terpene", "saccharide": "Saccharide", "alkaloid": "Alkaloid", "other": "Other", "unknown": "Other"}

# Product types of each class, written with underscores.
PRODUCT_TYPES = {
    "Polyketide": [
        "benzoxazole",
        "t1pks",
        "t2pks",
        "t3pks",
        "transat_pks",
        "hgle_ks",
        "prodigiosin",
        "ppys_ks",
        "arylpolyene",
        "ladderane",
        "hr_t2pks",
        "pufa",
        "pks_like",
        "transat_pks_like",
    ],
    "NRP": [
        "nrps",
        "cdps",
        "fungal_cdps",
        "rcdps",
        "thioamide_nrp",
        "napaa",
        "mycosporine",
        "t3nrps_iterative",
        "nrp_metallophore",
        "isocyanide_nrp",
        "nrps_like",
    ],
    "RiPP": [
        "atropopeptide",
        "lanthipeptide_class_i",
        "lanthipeptide_class_ii",
        "lanthipeptide_class_iii",
        "lanthipeptide_class_iv",
        "lanthipeptide_class_v",
        "lipolanthine",
        "azole_containing_ripp",
        "thioamitides",
        "linaridin",
        "cyanobactin",
        "glycocin",
        "lassopeptide",
        "sactipeptide",
        "bottromycin",
        "microviridin",
        "proteusin",
        "ranthipeptide",
        "redox_cofactor",
        "darobactin",
        "triceptide",
        "archaeal_ripp",
        "epipeptide",
        "cyclic_lactone_autoinducer",
        "spliceotide",
        "ras_ripp",
        "fungal_ripp",
        "guanidinotides",
        "crocagin",
        "methanobactin",
        "ripp_like",
        "rre_containing",
        "thiopeptide",
        "lap",
        "lanthipeptide",
        "lassopeptide_like",
    ],
    "Terpene": [
        "terpene",
        "terpene_precursor",
    ],
    "Saccharide": [
        "oligosaccharide",
    ],
    "Other": [
        "aureonuclemycin",
        "polyhalogenated_pyrrole",
        "leupeptin",
        "resorcinol",
        "blactam",
        "2dos",
        "amglyccycl",
        "aminocoumarin",
        "azoxy_crosslink",
        "azoxy_dimer",
        "cytokinin",
        "ni_siderophore",
        "ectoine",
        "naggn",
        "butyrolactone",
        "indole",
        "lincosamides",
        "nucleoside",
        "phosphoglycolipid",
        "melanin",
        "furan",
        "hserlactone",
        "phenazine",
        "phosphonate",
        "other",
        "acyl_amino_acids",
        "pbde",
        "polyyne",
        "betalactone",
        "tropodithietic_acid",
        "pyrrolidine",
        "nitropropanoic_acid",
        "opine_like_metallophore",
        "aminopolycarboxylic_acid",
        "isocyanide",
        "hydrogen_cyanide",
        "hydroxytropolone",
        "deazapurine",
        "phosphonate_like",
    ],
}

# The older exact map.
LEGACY = {"NRPS": "NRP", "PKS": "Polyketide", "other": "Other", "ribosomal": "RiPP", "saccharide": "Saccharide", "terpene": "Terpene", "alkaloid": "Alkaloid"}

FAMILIES = ["antismash", "gecco", "sanntis", "mibig"]


@lru_cache(1)
def product_classes() -> dict[str, str]:
    """Class of every product type and base name; a type goes before a base name."""
    return {**BASE_NAMES, **{t: c for c, types in PRODUCT_TYPES.items() for t in types}}


def tokens_pattern() -> str:
    """Finds the longest known run of atoms first, else one atom; tried on text of single underscores.

    Alternatives go from most atoms to fewest, as regular expressions take the first that fits.
    """
    names = sorted(product_classes(), key=lambda n: (-n.count("_"), -len(n), n))
    return f"({'|'.join(names)}|[^_]+)(?:_|$)"


def _cleaned(raw: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(F.lower(raw), F.lit("-"), F.lit("_")), "_+", "_"), F.lit("_"))


def tool_family(tool: Column) -> Column:
    t = F.lower(F.trim(F.coalesce(tool, F.lit(""))))
    out = F.lit("unknown")
    for family in reversed(FAMILIES):
        out = F.when(t.startswith(family), family).otherwise(out)
    return out


def _mapped(names: Column, table: dict[str, str]) -> Column:
    known = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.array_sort(F.array_distinct(F.transform(names, lambda n: F.coalesce(known[n], F.lit("Other")))))


def categories(tool: Column, raw: Column) -> Column:
    """Sorted classes of one prediction; none for a blank string."""
    atoms = F.filter(F.split(_cleaned(raw), "_"), lambda a: a != "")
    runs = F.regexp_extract_all(_cleaned(raw), F.lit(tokens_pattern()), 1)
    found = F.when(tool_family(tool) == "antismash", _mapped(runs, product_classes())).otherwise(_mapped(atoms, BASE_NAMES))
    return F.when(raw.isNull() | (F.trim(raw) == ""), F.array().cast("array<string>")).otherwise(found)


def label(classes: Column) -> Column:
    """One label for a set of classes: Other stands for none but itself, Polyketide with NRP goes first."""
    real = F.array_remove(classes, "Other")
    both = F.array_contains(classes, "Polyketide") & F.array_contains(classes, "NRP")
    return F.when(F.size(real) == 0, "Other").when(both, "Hybrid(P+N)").when(F.size(real) == 1, F.element_at(real, 1)).otherwise("Hybrid")


def single_label(tool: Column, raw: Column) -> Column:
    """The label of one prediction, '' where it has no signal."""
    found = categories(tool, raw)
    return F.when(F.size(found) == 0, "").otherwise(label(found))


def classify(predictions: DataFrame, key: str = "id") -> DataFrame:
    """(key, label): the union of all predictions' classes, reduced; '' without a signal."""
    held = predictions.withColumn("_c", categories(F.col("tool"), F.col("raw")))
    # a class is a flag, so that partial aggregation keeps one row for each key
    flags = held.groupBy(key).agg(*(F.bool_or(F.array_contains("_c", c)).alias(c) for c in BASE_CLASSES))
    joined = F.filter(F.array(*(F.when(F.col(f"`{c}`"), c) for c in BASE_CLASSES)), lambda c: c.isNotNull())
    return flags.select(key, F.when(F.size(joined) == 0, "").otherwise(label(joined)).alias("label"))


def legacy(raw: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in LEGACY.items() for x in kv))
    return F.coalesce(known[raw], raw)
