"""Registry of posting sources: name to a function from landed rows to postings."""

from collections.abc import Callable

from pyspark.sql import DataFrame

from vacantia.session import cut_lineage
from vacantia.sources import board_pages, boards
from vacantia.sources.greenhouse_budget import attach_budgeted
from vacantia.sources.snippets import attach_snippets

Parser = Callable[[DataFrame], DataFrame]
_PARSERS: dict[str, Parser] = {}


def register(name: str, parser: Parser) -> None:
    """Add or replace a source; the parser turns landed rows into postings."""
    _PARSERS[name.lower()] = parser


def get(name: str) -> Parser:
    return _PARSERS[name.lower()]


def names() -> list[str]:
    return sorted(_PARSERS)


for _name, _parser in {
    "greenhouse": boards.greenhouse,
    "lever": boards.lever,
    "workday": boards.workday,
    "ashby": boards.ashby,
    "workable": board_pages.workable,
}.items():
    register(_name, _parser)


def fetch(name: str, landed: DataFrame, page_facts: DataFrame | None = None,
          cap: int | None = None) -> DataFrame:
    """Postings of one source, with snippets where landed page facts are given.

    Snippets read the postings several times, so the payloads are parsed once for them.
    """
    return with_snippets(name, get(name)(landed), page_facts, cap)


def with_snippets(name: str, postings: DataFrame, page_facts: DataFrame | None, cap: int | None = None) -> DataFrame:
    if page_facts is None:
        return postings
    postings = cut_lineage(postings)
    attach = attach_budgeted if name == "greenhouse" else attach_snippets
    return attach(postings, page_facts, cap)


def union_sources(parts: list[DataFrame]) -> DataFrame:
    """Postings of all sources; columns a source lacks are null."""
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part, allowMissingColumns=True)
    return first
