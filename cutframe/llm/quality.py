"""Quality classifier: a sparse ensemble of rules.

Statistics of a text are Spark columns. A forest of shallow trees is grown on a labelled sample; every path
from a root to a node becomes a conjunctive rule over the statistics. A logistic model with a lasso penalty weighs the
rules, and the few with a weight are compiled into one Spark expression that gives the score.

The sample is bounded: at most `MAX_ROWS` labelled rows, chosen by hash of their id. Texts are
scored in full, all of them.

Defined results: null texts count as empty and are scored like others; labels that are null are left
out, of repeated labels of a document the lowest counts; without labels of both classes the score is the share of
label 1 (0.5 without any); repeated rows get equal scores.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, own_columns

#: Most labelled rows that a model is fitted on.
MAX_ROWS = 20_000
#: Score from which a document counts as good (given).
THRESHOLD = 0.3
TREES, DEPTH, LASSO, SEED = 12, 3, 0.002, 7


#: Statistics of a text, none of them null.
NAMES = ("log_chars", "mean_word", "distinct_words", "upper", "digit", "symbol", "stop", "comma", "bang", "line_break", "echo")
_COUNTED = {
    "upper": r"\p{Lu}",
    "digit": r"[0-9]",
    "symbol": r"[#$%&*|<>{}\[\]=~^_@\\]",
    "stop": r"[.?]",
    "comma": r"[,;:]",
    "bang": r"!",
    "line_break": r"\n",
    "echo": r"(?<!\S)(\S++)\s++\1(?!\S)",
}
_BY_CHARS = ("upper", "digit", "symbol")


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `docs` as a struct _row, and a column for each of NAMES.

    The counts come out of an explode of one struct: each is then computed once, and a filter on a score stays above it instead of
    being pushed down with a copy of the counts for every rule.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    words = F.transform(F.array(F.split(F.lower(body), r"\s+")), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct")))[0]
    counts = F.struct(F.length(body).alias("chars"), words.alias("words"), *(F.regexp_count(body, F.lit(p)).alias(n) for n, p in _COUNTED.items()))
    flat = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.explode(F.array(counts)).alias("_c"))
    chars = F.greatest(F.col("_c.chars"), F.lit(1)).cast("double")
    n_words = F.greatest(F.col("_c.words.n"), F.lit(1)).cast("double")
    stats = [F.log1p(chars), chars / n_words, F.col("_c.words.distinct") / n_words, *(F.col(f"_c.{n}") / (chars if n in _BY_CHARS else n_words) for n in _COUNTED)]
    return flat.select("_row", *(c.alias(n) for n, c in zip(NAMES, stats)))


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, is_above, bound) and its weight."""

    terms: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0

    def column(self) -> Column:
        out = None
        for name, above, bound in self.terms:
            term = F.col(name) > F.lit(bound) if above else F.col(name) <= F.lit(bound)
            out = term if out is None else out & term
        return out.cast("double")


@dataclass(frozen=True)
class Model:
    rules: tuple[Rule, ...]
    intercept: float

    def score(self) -> Column:
        """Score between 0 and 1 from the columns NAMES."""
        total = F.lit(self.intercept)
        for rule in self.rules:
            total = total + rule.column() * F.lit(rule.weight)
        return 1.0 / (1.0 + F.exp(-total))


def tree_rules(described: str, names: list[str]) -> list[tuple]:
    """Paths to all nodes of a forest as its description lists them."""
    found, path = {}, []
    for line in described.splitlines():
        if m := re.match(r"\s*(If|Else) \(feature (\d+) (<=|>) (\S+)\)", line):
            depth = (len(line) - len(line.lstrip()))
            while path and path[-1][0] >= depth:
                path.pop()
            path.append((depth, (names[int(m[2])], m[3] == ">", float(m[4]))))
            found[tuple(sorted({t for _, t in path}))] = None
        elif line.lstrip().startswith("Tree"):
            path = []
    return list(found)


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(text, label) of at most about `max_rows` labelled documents, by hash of the id."""
    clean = labels.where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.min("label").alias("label"))
    n = clean.count()
    if n > max_rows:
        clean = clean.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1e6 * max_rows / n))
    return docs.join(F.broadcast(clean), "doc_id").select("text", "label")  # bounded by max_rows


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = MAX_ROWS) -> Model:
    """Fit on the labelled documents. `labels` has doc_id and the label (1: good)."""
    sample = labelled_sample(own_columns(docs, doc_id=doc_id, text=text), own_columns(labels, doc_id=doc_id, label=label), max_rows)
    names = list(NAMES)
    rows = materialize(with_statistics(sample).select(F.col("_row.label").cast("double").alias("label"), *names), "quality-sample")
    seen = rows.agg(F.count(F.lit(1)), F.sum("label")).first()
    n, good = seen[0], seen[1] or 0.0
    if not n or good in (0.0, float(n)):
        share = min(max(good / n if n else 0.5, 0.01), 0.99)
        return Model((), math.log(share / (1 - share)))
    points = VectorAssembler(inputCols=names, outputCol="features").transform(rows)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, maxBins=64, subsamplingRate=0.7, featureSubsetStrategy="onethird", seed=SEED).fit(points.select("label", "features"))
    rules = [Rule(terms) for terms in tree_rules(forest.toDebugString, names)]
    if not rules:
        if forest.totalNumNodes > TREES:  # there are splits, so their description has changed
            raise RuntimeError("no rules could be read from the forest's description")
        return Model((), math.log(good / (n - good)))
    fired = materialize(rows.select("label", F.array(*(r.column() for r in rules)).alias("fired")), "quality-rules").select("label", array_to_vector("fired").alias("features"))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, maxIter=60, standardization=False).fit(fired)
    weights = lasso.coefficients.toArray()
    return Model(tuple(Rule(r.terms, float(w)) for r, w in zip(rules, weights) if abs(w) > 1e-6), float(lasso.intercept))


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """`docs` with the model's score in column `out`; other columns pass through untouched."""
    kept = [f"_row.`{c}`" for c in docs.columns if c != out]
    return with_statistics(docs, text).select(*kept, model.score().alias(out))


def held_out(doc_id: Column) -> Column:
    """The fold that is never learnt from (given): CRC-32 of the id as text is a multiple of 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0
