"""Corpus pipeline: quality filter, exact dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and
all but the last return the columns of ``documents``. ``run`` applies them in turn;
what a stage returns is written as Parquet to the shared folder and read again. As a
stage's result is written before the next one starts, each stage first deletes the tables
that the one before it had left in the shared folder.
"""

from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from attestra.llm import exact_dedup, mixing, near_dedup, packing, quality_classifier
from attestra.llm.common import deleted, left_by, session, stored, table

#: Folders that the plan of the last stage's result reads, per thread: runs in several threads don't share them.
_left: ContextVar[tuple[str, ...]] = ContextVar("left", default=())


def stage(first: bool = False) -> Callable:
    """first: nothing goes before it starts, as another run's result may still be read."""

    def of(f: Callable[[SparkSession, DataFrame, str], DataFrame]):
        @wraps(f)
        def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            if not first:
                deleted(session(spark), list(_left.get()))
            with left_by() as folders:
                out = f(session(spark), docs, sf_dir)
            _left.set(tuple(folders))
            return out

        return run_stage

    return of


@stage(first=True)
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labelled rows that aren't held out."""
    return quality_classifier.accepted(docs, table(spark, sf_dir, "labels"))


@stage()
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts (A-Z lower-cased) the one with the largest doc_id stays."""
    return exact_dedup.deduplicated(docs)


@stage()
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return near_dedup.deduplicated(docs)


@stage()
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it: not at all, or one to three times."""
    return mixing.mixed(docs)


@stage()
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows with their place in a training sequence."""
    return packing.best_fit(docs)


STAGES = [("quality_classifier", quality), ("exact_dedup", exact), ("near_dedup", near), ("mix_sources", mix), ("best_fit_packing", pack)]

#: The classifier, the balancing and the packing are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES[:-1]:
        before, docs = docs, stored(f(spark, docs, sf_dir), f"stage-{name}", listed=False)
        deleted(spark, [before._folder] if hasattr(before, "_folder") else [])
    out = stored(STAGES[-1][1](spark, docs, sf_dir), "stage-result", listed=False)
    deleted(spark, [docs._folder, *_left.get()])
    _left.set(())
    return out
