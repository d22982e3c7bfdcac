"""Quality classifier: a sparse ensemble of rules over text statistics.

Trees are grown on the statistics of labelled texts by distributed training. Every path from a root
to a node is a conjunction of bounds, and so a rule. A logistic regression under an L1 penalty
picks and weights the rules, and the rules that keep a weight compile into one column expression.
Training and scoring read one table of statistics, so each text is looked at once.

Cases: null and empty texts have all-zero statistics and are scored like any other. Labels that are
null or whose id is null are not learned from; an id labelled twice counts twice. Without two
classes to learn from no rule is made and every score is the smoothed share of good labels. Repeated
rows get equal scores; an empty table gives an empty result. Only id and text are read, and the
statistics' names stand in a struct of their own, so that they clash with nothing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.text import whole
from plumbline.session import materialize


def statistics() -> dict[str, Column]:
    """Statistics by name over ``_text``, ``_words`` and ``_lines``; 0 for an empty text."""
    chars, words, lines = F.char_length("_text"), F.size("_words"), F.size("_lines")

    def share(part: Column, of: Column) -> Column:
        return F.when(of > 0, part / of).otherwise(0.0)

    def count(pattern: str) -> Column:
        return F.regexp_count("_text", F.lit(pattern))

    return {
        "log_chars": F.log1p(chars), "log_words": F.log1p(words), "log_lines": F.log1p(lines),
        "word_length": share(chars, words), "line_length": share(chars, lines),
        "distinct_words": share(F.size(F.array_distinct("_words")), words),
        "distinct_lines": share(F.size(F.array_distinct("_lines")), lines),
        "repeats": share(F.size(F.filter(F.arrays_zip(
            F.col("_words").alias("a"), F.slice("_words", 2, F.greatest(words, F.lit(1))).alias("b")),
            lambda p: p["a"] == p["b"])), words),
        "longest_word": F.coalesce(F.array_max(F.transform("_words", lambda w: F.char_length(w))),
                                   F.lit(0)),
        "capitals": share(count("[A-Z]"), chars), "digits": share(count("[0-9]"), chars),
        "stops": share(count("[.,;:?]"), words), "symbols": share(count("[!#$%&*+=<>|~^@_\\\\]"), words),
        "brackets": share(count("[{}()\\[\\]/]"), words),
        "pipes": share(count("\\|"), words), "addresses": share(count("://|www\\.|@"), words),
    }


def with_statistics(docs: DataFrame, text_col: str, stats: str = "stats") -> DataFrame:
    """``docs`` with a struct of doubles beside its columns."""
    if stats in docs.columns:
        raise ValueError(f"{stats} is already a column")
    words = F.array_remove(F.split("_text", r"[\x20\x09-\x0D]+", -1), "")
    lines = F.array_remove(F.split("_text", "\n", -1), "")
    split = docs.select(F.struct("*").alias("_row"), whole(text_col).alias("_text")).select(
        "_row", "_text", words.alias("_words"), lines.alias("_lines"))
    found = F.struct(*[c.cast("double").alias(n) for n, c in statistics().items()])
    return split.select("_row.*", found.alias(stats))


@dataclass(frozen=True)
class Rule:
    """A conjunction of bounds: statistic -> (above, up to)."""

    bounds: tuple[tuple[str, float, float], ...]

    def column(self) -> Column:
        tests = []
        for name, low, high in self.bounds:
            value = F.col("stats")[name]
            tests += [value > low] * (low != float("-inf")) + [value <= high] * (
                high != float("inf"))
        out = tests[0]
        for test in tests[1:]:
            out = out & test
        return out.cast("double")


@dataclass
class RuleEnsemble:
    """Weighted rules; scores are probabilities of label 1."""

    bias: float
    weights: dict[Rule, float] = field(default_factory=dict)

    def score(self) -> Column:
        """The score as an expression over ``stats``."""
        total = F.lit(self.bias)
        for rule, weight in self.weights.items():
            total = total + rule.column() * weight
        return 1 / (1 + F.exp(-total))


def tree_rules(root, names: list[str]) -> set[Rule]:
    """The rules of all paths of one tree that end below its root."""
    rules, open_nodes = set(), [(root, {})]
    while open_nodes:
        node, bounds = open_nodes.pop()
        if bounds:
            rules.add(Rule(tuple(sorted((n, *b) for n, b in bounds.items()))))
        if node.subtreeDepth() == 0:
            continue
        split = node.split()
        name, cut = names[split.featureIndex()], split.threshold()
        low, high = bounds.get(name, (float("-inf"), float("inf")))
        open_nodes += [(node.leftChild(), bounds | {name: (low, min(high, cut))}),
                       (node.rightChild(), bounds | {name: (max(low, cut), high)})]
    return rules


def fit_rules(examples: DataFrame, *, trees: int = 24, depth: int = 3, penalty: float = 5e-4,
              seed: int = 17) -> RuleEnsemble:
    """Learn from ``stats`` and a 0/1 ``label``."""
    spark = examples.sparkSession
    counts = {r["label"]: r["count"] for r in examples.groupBy("label").count().collect()}
    if len(counts) < 2:
        share = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
        return RuleEnsemble(bias=_logit(share))
    names = examples.schema["stats"].dataType.fieldNames()
    features = array_to_vector(F.array(*[F.col("stats")[n] for n in names]))
    forest = RandomForestClassifier(
        numTrees=trees, maxDepth=depth, maxBins=64, featureSubsetStrategy="onethird",
        subsamplingRate=0.7, seed=seed).fit(examples.select("label", features.alias("features")))
    rules = sorted({rule for tree in forest.trees
                    for rule in tree_rules(tree._java_obj.rootNode(), names)},
                   key=lambda r: r.bounds)
    matrix = materialize(spark, examples.select(
        "label", F.array(*[r.column() for r in rules]).alias("rules")), "rule-matrix")
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=60, tol=1e-5).fit(
        matrix.select("label", array_to_vector("rules").alias("features")))
    weights = {r: float(w) for r, w in zip(rules, lasso.coefficients.toArray()) if w}
    return RuleEnsemble(bias=float(lasso.intercept), weights=weights)


def _logit(share: float) -> float:
    return math.log(share / (1 - share))


def _learn(table: DataFrame, labels: DataFrame, learn: Column, id_col: str,
           label_col: str) -> RuleEnsemble:
    known = labels.filter(learn & F.col(label_col).isin(0, 1)).select(
        F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label"))
    examples = table.select(F.col(id_col).alias("_id"), "stats").join(known, "_id")
    return fit_rules(materialize(table.sparkSession, examples.select("stats", "label"),
                                 "quality-examples"))


def score_quality(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id",
                  text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Id and ``score`` per row of ``docs``, learned from the rows of ``labels`` where ``learn``.

    ``labels`` shares ``id_col`` with ``docs``; ``learn`` is an expression over ``labels``.
    """
    table = materialize(docs.sparkSession, with_statistics(
        docs.select(id_col, text_col), text_col).select(id_col, "stats"), "text-statistics")
    model = _learn(table, labels, learn, id_col, label_col)
    return table.select(id_col, model.score().alias("score"))


def keep_quality(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id",
                 text_col: str = "text", label_col: str = "quality", *,
                 least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score at least ``least``, with all their columns."""
    rows = docs.select(F.struct("*").alias("_kept"), F.col(id_col).alias("_id"), F.col(text_col).alias(
        "_read"))
    table = materialize(docs.sparkSession, with_statistics(rows, "_read").drop("_read"),
                        "scored-documents")
    model = _learn(table.select(F.col("_id").alias(id_col), "stats"), labels, learn, id_col, label_col)
    return table.filter(model.score() >= least).select("_kept.*")
