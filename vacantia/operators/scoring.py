"""Skill scores of postings."""

from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions.classify import is_engineering
from vacantia.functions.text import haystack, matched_terms


def _terms(terms) -> list:
    return sorted(set(terms or ()))


def _all_present(hay: Column, terms) -> Column:
    return reduce(and_, [hay.contains(t) for t in terms], F.lit(True))


def skill_score(any_terms, all_terms=(), hard: bool = False, hay: str = "hay") -> Column:
    """Number of ``any`` terms present, plus the number of ``all`` terms when every one is.

    Without hard gates an engineering title that matches nothing still scores 1.
    """
    body, wanted, needed = F.col(hay), _terms(any_terms), _terms(all_terms)
    score = reduce(add, [body.contains(t).cast("int") for t in wanted], F.lit(0))
    if needed:
        score = score + F.when(_all_present(body, needed), len(needed)).otherwise(0)
    if hard:
        return score
    return F.when((score == 0) & is_engineering(F.col("title")), 1).otherwise(score)


def passes_skill_gate(any_terms, all_terms=(), hay: str = "hay") -> Column:
    """Hard gate: every ``all`` term present, and something matched."""
    if not _terms(any_terms) and not _terms(all_terms):
        return F.lit(True)
    needed = _all_present(F.col(hay), _terms(all_terms))
    return needed & (skill_score(any_terms, all_terms, hard=True, hay=hay) > 0)


def with_haystack(postings: DataFrame) -> DataFrame:
    return postings.withColumn("hay", haystack(F.col("title"), F.col("description_snippet")))


def score(postings: DataFrame, any_terms, all_terms=(), hard: bool = False) -> DataFrame:
    """Add skill_score; with ``hard`` drop rows that fail the gate."""
    hay = with_haystack(postings)
    if hard:
        hay = hay.filter(passes_skill_gate(any_terms, all_terms))
    return hay.withColumn("skill_score", skill_score(any_terms, all_terms, hard)).drop("hay")


def with_matched_skills(postings: DataFrame, terms) -> DataFrame:
    return with_haystack(postings).withColumn("skills", matched_terms(F.col("hay"), terms)).drop("hay")
