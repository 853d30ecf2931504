"""Ranks as ordinals: the bigger the taxon, the higher the number."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

# The ranks in increasing order, numbered from 1.
RANKS = (
    "cluster", "subform", "forma", "form", "subvariety", "varietas", "variety", "natio", "subspecies",
    "infraspecificname", "species", "species subgroup", "species group", "subgenus", "genus", "subtribe",
    "tribe", "supertribe", "subfamily", "family", "superfamily", "subsection", "section", "parvorder",
    "infraorder", "suborder", "order", "superorder", "magnorder", "megaorder", "subcohort", "cohort",
    "subterclass", "infraclass", "subclass", "class", "superclass", "subdivision", "infraphylum",
    "subphylum", "phylum", "superphylum", "infrakingdom", "division", "subkingdom", "kingdom",
    "superkingdom", "domain", "top",
)

NUMBER = {name: i for i, name in enumerate(RANKS, start=1)}


def rank_number(rank: Column | str) -> Column:
    """Ordinal of a rank name; NULL for an unknown or missing rank."""
    rank = F.col(rank) if isinstance(rank, str) else rank
    table = F.create_map(*[F.lit(v) for v in chain.from_iterable(NUMBER.items())])
    return F.try_element_at(table, rank)
