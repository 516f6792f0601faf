"""Quality classifier: a sparse rule ensemble compiled into column expressions.

1. Statistics of the whole text (counts, shares, means), in one Arrow pass over its bytes;
   doc_id, lang, source and labels are no inputs.
2. A random forest of shallow trees is grown by Spark ML on labelled rows that aren't
   held out; at most ``FIT_ROWS`` of them, the first by a hash of doc_id (the one bounded
   sample here; a model needs no more).
3. Every path from a root to a node is a rule: a conjunction of threshold tests. Logistic
   regression with an L1 penalty (lasso) over the rules' 0/1 columns drops most of them.
4. What is left is one Spark expression: a sigmoid over ``CASE WHEN`` rules. Scoring is a
   projection over the scan and the pass: no shuffle, nothing broadcast.

Defined results: null and empty texts have all statistics 0 and get the score of that
point. Labels without quality are left out; of several labels of a doc_id the lowest
counts. Without labelled rows, or with labels of one kind, the score is the share of
label 1 (0.5 without any). Repeated rows get a row each; rows without doc_id hash as the
empty text. Further columns are ignored by the report and kept by ``accepted``. An empty
table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import codes_of, per_doc, scratch, session, slices, stored, table, utf8, whole_row, words_of

FIT_ROWS = 20_000
TREES, DEPTH, PENALTY, STEPS = 24, 3, 0.0003, 40
#: Predicted 1 from this score on.
THRESHOLD = 0.3

Rule = tuple[tuple[str, str, float], ...]


#: Characters that are counted.
COUNTED = {"symbols": b"#*$%&<>@~^=_\\", "bars": b"|", "shouts": b"!", "uppers": bytes(range(65, 91)), "digits": b"0123456789", "stops": b".?", "lines": b"\n"}
STATISTICS = ["words", "word_length", "distinct_share", "symbol_share", "bar_share", "shout_share", "upper_share", "digit_share", "stop_share", "lines_share"]


def statistics(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The statistics of each document of a slice, in the order of STATISTICS."""
    docs = len(offsets) - 1
    start, end, doc, _ = words_of(data, offsets)
    words = np.bincount(doc, minlength=docs)
    distinct = np.bincount(np.unique(codes_of(data, start, end) * docs + doc) % docs, minlength=docs)
    characters = per_doc((data & 0xC0) != 0x80, offsets)
    count = {}
    for name, those in COUNTED.items():
        mine = np.zeros(256, bool)
        mine[list(those)] = True
        count[name] = per_doc(mine[data], offsets)
    n, chars = np.maximum(words, 1), np.maximum(characters, 1)
    return [x.astype(float) for x in (words, characters / n, distinct / n, count["symbols"] / chars, count["bars"] / n, count["shouts"] / n, count["uppers"] / chars, count["digits"] / chars, count["stops"] / n, count["lines"] / n)]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = utf8(batch.column(1))
        for a, b in slices(at):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *map(pa.array, statistics(data[at[a] : at[b]], at[a : b + 1] - at[a]))], ["row", *STATISTICS])


def measured(rows: DataFrame) -> DataFrame:
    """``rows``: row (a struct), text. row and the statistics."""
    return rows.select("row", "text").mapInArrow(_measured, T.StructType([rows.schema["row"], *(T.StructField(x, T.DoubleType()) for x in STATISTICS)]))


def paths(debug: str) -> list[Rule]:
    """The conjunctions of a forest's printed trees, one per node below a root, as tests (feature number, sign, threshold)."""
    found: dict[Rule, None] = {}
    stack: list[tuple[int, tuple[str, str, float]]] = []
    for line in debug.splitlines():
        m = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (-?[\d.E+-]+)\)", line)
        if re.match(r" *Tree \d+", line):
            stack = []
        if m:
            indent = len(m[1])
            stack = [x for x in stack if x[0] < indent] + [(indent, (m[2], m[3], float(m[4])))]
            found[tuple(sorted({t for _, t in stack}))] = None
    return list(found)


def condition(rule: Rule, value) -> Column:
    """``value``: name -> column."""
    tests = [value(name) <= F.lit(limit) if sign == "<=" else value(name) > F.lit(limit) for name, sign, limit in rule]
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


class Rules:
    """A fitted ensemble: an intercept and weighted rules."""

    def __init__(self, intercept: float, weighted: list[tuple[Rule, float]]):
        self.intercept, self.weighted = intercept, weighted

    def score(self) -> Column:
        """The score of a row that has the statistics as columns."""
        return 1 / (1 + F.exp(-sum((F.when(condition(rule, F.col), F.lit(weight)).otherwise(0.0) for rule, weight in self.weighted), F.lit(self.intercept))))


def remainder() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Rules:
    """Learns quality from the labelled rows that aren't held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality")).where("doc_id is not null and quality is not null")
    known = known.where(remainder() != 0).groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    names = STATISTICS
    with scratch(docs.sparkSession):
        # at most ``rows`` ids: their size is bounded by the parameter; of rows that share an id one counts
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id").select(F.struct("doc_id", "quality").alias("row"), "text")
        found = stored(measured(texts).groupBy("row.doc_id").agg(F.min("row.quality").alias("quality"), F.min(F.struct(*names)).alias("s")).select("quality", "s.*"), "labelled")
        sample = found.coalesce(4)
        kinds = {r.quality: r["count"] for r in sample.groupBy("quality").count().collect()}
        if len(kinds) < 2:
            share = sum(k * n for k, n in kinds.items()) / max(1, sum(kinds.values())) if kinds else 0.5
            return Rules({0.0: -20.0, 1.0: 20.0}.get(share, 0.0), [])
        grown = RandomForestClassifier(labelCol="quality", featuresCol="features", numTrees=TREES, maxDepth=DEPTH, maxBins=64, featureSubsetStrategy="onethird", seed=7, cacheNodeIds=False)
        forest = grown.fit(VectorAssembler(inputCols=names, outputCol="features").transform(sample).select("quality", "features"))
        rules = [tuple((names[int(f)], sign, limit) for f, sign, limit in rule) for rule in paths(forest.toDebugString)]
        columns = [f"r{i}" for i in range(len(rules))]
        held = sample.select("quality", *[F.when(condition(rule, F.col), 1.0).otherwise(0.0).alias(c) for rule, c in zip(rules, columns)])
        lasso = LogisticRegression(labelCol="quality", featuresCol="rules", elasticNetParam=1.0, regParam=PENALTY, maxIter=STEPS).fit(VectorAssembler(inputCols=columns, outputCol="rules").transform(held).select("quality", "rules"))
        weights = lasso.coefficients.toArray().tolist()
        return Rules(float(lasso.intercept), [(rule, w) for rule, w in zip(rules, weights) if abs(w) > 1e-6])


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    rules = fit(docs, labels)
    rows = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id")).alias("row"), "text")
    return measured(rows).select("row.doc_id", rules.score().alias("score")).select("doc_id", (remainder() == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, all columns as they were."""
    rules = fit(docs, labels)
    rows = docs.select(whole_row(docs).alias("row"), "text")
    return measured(rows).where(rules.score() >= THRESHOLD).select("row.*")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    session(spark)
    return classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
