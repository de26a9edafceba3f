"""Compound classification: pattern matches against ontology terms, and a remote service behind a cache.

The chemistry itself (pattern compiler, keys, transport) is injected; what runs
here is the dataflow around it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import partial
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


class Matcher(Protocol):
    def compile(self, pattern: str) -> object | None:
        """A pattern ready for use; None if it is no pattern."""

    def parse(self, smiles: str) -> object | None:
        """A compound; None if it is none."""

    def matches(self, compound: object, pattern: object) -> bool: ...


class RegexMatcher:
    """Takes patterns as regular expressions over the string: for tests."""

    def compile(self, pattern: str) -> object | None:
        try:
            return re.compile(pattern)
        except re.error:
            return None

    def parse(self, smiles: str) -> object | None:
        return smiles or None

    def matches(self, compound: object, pattern: object) -> bool:
        return pattern.search(compound) is not None


def _matched(batches: Iterator[pd.DataFrame], load: Callable[[], Matcher], terms: list[tuple]) -> Iterator[pd.DataFrame]:
    matcher = load()
    compiled = [(t, p) for t, smarts in terms if (p := matcher.compile(smarts)) is not None]
    for pdf in batches:
        rows = []
        for cid, smiles in zip(pdf["id"], pdf["smiles"]):
            compound = matcher.parse(smiles) if smiles else None
            if compound is not None:
                rows += [(cid, smiles, t) for t, p in compiled if matcher.matches(compound, p)]
        yield pd.DataFrame(rows, columns=["id", "smiles", "term"])


def match(compounds: DataFrame, terms: DataFrame, load: Callable[[], Matcher], most_terms: int = 100_000) -> DataFrame:
    """(id, smiles, chemont_id, chemont_name, smarts, depth, rank): matches of compounds (id, smiles), deepest term first.

    Patterns compile once in each task; the ontology goes to the tasks whole and
    so is held to ``most_terms`` patterns.
    """
    held = terms.filter("smarts is not null").select("id", "smarts").limit(most_terms + 1).collect()
    if len(held) > most_terms:
        raise ValueError(f"more than {most_terms} patterns")
    found = compounds.select("id", "smiles").mapInPandas(partial(_matched, load=load, terms=[(r["id"], r["smarts"]) for r in held]), "id string, smiles string, term string")
    named = found.join(terms.select(F.col("id").alias("term"), F.col("name").alias("chemont_name"), "smarts", "depth", "ord"), "term")
    order = Window.partitionBy("id", "smiles").orderBy(F.desc("depth"), "ord")
    return named.select("id", "smiles", F.col("term").alias("chemont_id"), "chemont_name", "smarts", "depth", F.row_number().over(order).alias("rank"))


class Service(Protocol):
    def key(self, smiles: str) -> str | None:
        """The compound's key; None if it is no compound."""

    def lookup(self, key: str) -> dict | None:
        """The classification document, None while unknown."""

    def submit(self, smiles: str) -> str: ...

    def poll(self, ticket: str) -> dict | None:
        """The document of a finished job, {} if it holds no entity, None while it runs."""


class FakeService:
    """Answers from the string alone: for tests."""

    def key(self, smiles: str) -> str | None:
        return f"KEY-{len(smiles)}" if smiles else None

    def lookup(self, key: str) -> dict | None:
        n = int(key[4:])
        return None if n % 2 else {"kingdom": {"chemont_id": "C:0"}, "class": {"chemont_id": f"C:{n}"}, "direct_parent": {"chemont_id": f"C:{n}"}}

    def submit(self, smiles: str) -> str:
        return smiles

    def poll(self, ticket: str) -> dict | None:
        return {}


#: Nodes of a classification document, in order.
NODES = ["kingdom", "superclass", "class", "subclass", "direct_parent"]
NODE_LISTS = ["intermediate_nodes", "alternative_parents"]


def document_ids(document: dict) -> list[str]:
    """The nodes' ids in order, each once."""
    nodes = [document.get(n) for n in NODES] + [x for n in NODE_LISTS for x in document.get(n) or []]
    return list(dict.fromkeys(x["chemont_id"] for x in nodes if x and x.get("chemont_id")))


def _asked(batches: Iterator[pd.DataFrame], load: Callable[[], Service], polls: int) -> Iterator[pd.DataFrame]:
    service = load()
    for pdf in batches:
        rows = []
        for smiles in pdf["smiles"]:
            key = service.key(smiles) if smiles else None
            document, error = None, None
            if key is not None:
                try:
                    document = service.lookup(key)
                    if document is None:
                        ticket = service.submit(smiles)
                        document = next((x for _ in range(polls) if (x := service.poll(ticket)) is not None), None)
                        error = "no answer in time" if document is None else None
                except OSError as e:
                    error = str(e)
            rows.append((smiles, key, document_ids(document or {}) if key and not error else None, ((document or {}).get("direct_parent") or {}).get("chemont_id"), json.dumps(document, sort_keys=True) if document is not None else None, error))
        yield pd.DataFrame(rows, columns=["smiles", "inchikey", "chemont_ids", "direct_parent", "classification", "error"])


def classify_remote(compounds: DataFrame, load: Callable[[], Service], cache: DataFrame | None = None, polls: int = 30, strict: bool = False) -> DataFrame:
    """(id, smiles, inchikey, chemont_ids, direct_parent, classification, error), each distinct compound asked for once.

    ``cache``: earlier results by smiles, which are joined first and not asked for again. A service that can't be
    reached or gives no answer leaves its error in the row; with ``strict`` it fails the query.
    """
    schema = "smiles string, inchikey string, chemont_ids array<string>, direct_parent string, classification string, error string"
    wanted = compounds.select("smiles").filter("smiles is not null").distinct()
    if cache is not None:
        wanted = wanted.join(cache.select("smiles"), "smiles", "left_anti")
    asked = wanted.mapInPandas(partial(_asked, load=load, polls=polls), schema)
    if strict:
        asked = asked.filter(F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("the service failed: "), "error")).cast("boolean")).otherwise(True))
    known = asked if cache is None else asked.unionByName(cache)
    return compounds.select("id", "smiles").join(known, "smiles", "left").select("id", "smiles", "inchikey", "chemont_ids", "direct_parent", "classification", "error")
