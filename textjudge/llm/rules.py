"""Quality classifier: a sparse ensemble of rules over text statistics.

1. Statistics of every text, as Column expressions.
2. A forest of shallow trees on the labelled rows; each path from a root to a node is a
   conjunctive rule.
3. A logistic regression with lasso penalty over the rules keeps few of them.
4. The kept rules are compiled into one Column expression, so scoring is a projection.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textjudge.llm.common import SPACE, id_and_text
from textjudge.operators.lineage import materialize

UPPER, DIGITS, SYMBOLS, MARKS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#*$%&|<>", "!?"


def without(chars: str) -> Column:
    """How many characters of the text are among ``chars``."""
    return F.length("text") - F.length(F.translate("text", chars, ""))


def statistics(texts: DataFrame) -> DataFrame:
    """Statistics of the column ``text``, next to all other columns of ``texts``."""
    words = F.filter(F.split("text", SPACE), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    basic = texts.withColumn("words", words).withColumn("lines", lines).withColumns(
        {
            "n_chars": F.length("text").cast("double"),
            "n_words": F.size("words").cast("double"),
            "n_lines": F.size("lines").cast("double"),
            "kinds": F.size(F.array_distinct("words")).cast("double"),
            "line_kinds": F.size(F.array_distinct("lines")).cast("double"),
            "spaces": without(" \t\n\x0b\x0c\r").cast("double"),
            "longest": F.coalesce(F.array_max(F.transform("words", F.length)), F.lit(0)).cast("double"),
        }
    )
    chars, count = F.greatest("n_chars", F.lit(1.0)), F.greatest("n_words", F.lit(1.0))
    named = {
        "log_words": F.log1p("n_words"),
        "word_length": (F.col("n_chars") - F.col("spaces")) / count,
        "longest_word": F.log1p("longest"),
        "kinds_share": F.col("kinds") / count,
        # vocabulary against the square root of the length: comparable between lengths
        "kinds_root": F.col("kinds") / F.sqrt(count),
        "line_kinds_share": F.col("line_kinds") / F.greatest("n_lines", F.lit(1.0)),
        "line_words": F.log1p(F.col("n_words") / F.greatest("n_lines", F.lit(1.0))),
        "symbol_share": without(SYMBOLS) / chars,
        "bar_share": without("|") / chars,
        "upper_share": without(UPPER) / chars,
        "digit_share": without(DIGITS) / chars,
        "mark_share": without(MARKS) / chars,
        "stop_share": without(".,;:") / chars,
        "space_share": F.col("spaces") / chars,
    }
    return basic.select(*texts.drop("text").columns, *[v.alias(k) for k, v in named.items()])


FEATURES = [
    "log_words", "word_length", "longest_word", "kinds_share", "kinds_root", "line_kinds_share", "line_words",
    "symbol_share", "bar_share", "upper_share", "digit_share", "mark_share", "stop_share", "space_share",
]


@dataclass(frozen=True)
class Rule:
    """Conjunction of bounds: feature name -> (above, at most)."""

    bounds: tuple[tuple[str, float, float], ...]

    def column(self) -> Column:
        parts = [F.col(f) > F.lit(low) for f, low, _ in self.bounds if low > -math.inf]
        parts += [F.col(f) <= F.lit(high) for f, _, high in self.bounds if high < math.inf]
        out = parts[0]
        for p in parts[1:]:
            out = out & p
        return out

    def holds(self, values: dict[str, float]) -> bool:
        return all(low < values[f] <= high for f, low, high in self.bounds)


@dataclass
class RuleModel:
    intercept: float
    rules: list[tuple[Rule, float]] = field(default_factory=list)

    def score(self) -> Column:
        """Probability of label 1, over the columns of ``statistics``."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def paths(node, bounds: dict[str, tuple[float, float]], found: set[Rule]) -> None:
    """Add the rule of every node below ``node`` of a fitted tree."""
    if not node.getClass().getSimpleName().startswith("Internal"):
        return
    split = node.split()
    name, cut = FEATURES[split.featureIndex()], split.threshold()
    low, high = bounds.get(name, (-math.inf, math.inf))
    for child, part in ((node.leftChild(), (low, min(high, cut))), (node.rightChild(), (max(low, cut), high))):
        inner = bounds | {name: part}
        found.add(Rule(tuple((f, *inner[f]) for f in FEATURES if f in inner)))
        paths(child, inner, found)


def fit_rules(train: DataFrame, trees: int = 20, depth: int = 3, penalty: float = 0.0005, seed: int = 11) -> RuleModel:
    """Rules and weights from rows of statistics with a column ``label`` (0 or 1).

    Runs on the cluster over all given rows. Without both labels there is nothing to
    separate: the score is then the smoothed share of label 1.
    """
    n, ones = train.agg(F.count("label"), F.sum("label")).first()
    ones = ones or 0
    prior = math.log((ones + 1) / (n - ones + 1))
    if not 0 < ones < n:
        return RuleModel(prior)
    vector = array_to_vector(F.array(*FEATURES))
    points = train.select(vector.alias("features"), F.col("label").cast("double").alias("label"))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, minInstancesPerNode=5, subsamplingRate=0.7, seed=seed)
    found: set[Rule] = set()
    for tree in forest.fit(points).trees:
        paths(tree._call_java("rootNode"), {}, found)
    rules = sorted(found, key=lambda r: r.bounds)
    if not rules:
        return RuleModel(prior)
    # few distinct rows after the rules: each pattern counts with its weight
    flags = train.select(F.array(*[r.column().cast("double") for r in rules]).alias("flags"), "label")
    patterns = flags.groupBy("flags", "label").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    points = patterns.select(array_to_vector("flags").alias("features"), F.col("label").cast("double").alias("label"), "weight")
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, weightCol="weight", maxIter=60, standardization=True)
    fitted = lasso.fit(points)
    weights = fitted.coefficients.toArray()
    return RuleModel(float(fitted.intercept), [(r, float(w)) for r, w in zip(rules, weights) if w])


def training_row(id_col: Column) -> Column:
    """Held-out rows are those whose checksum of the id leaves no rest by five."""
    return F.crc32(id_col.cast("string")) % 5 != 0


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Learns from rows of ``labels`` (doc_id, quality) outside the held-out fold, with
    statistics of the text as the only inputs. Null texts count as empty and are scored
    like others; null labels and ids without a label are not learnt from; a null id is
    held out. A document with several labels is learnt once with each. An empty table
    gives an empty result; other columns are not read.
    """
    found = materialize(statistics(id_and_text(docs, id_col, text_col)))
    marked = labels.select(F.col("doc_id").alias("of"), F.col("quality").cast("int").alias("label")).where("label in (0, 1)")
    train = found.where(training_row(F.col("doc_id"))).join(marked, F.col("doc_id") == F.col("of"))
    model = fit_rules(materialize(train), **options)
    held_out = F.coalesce(~training_row(F.col("doc_id")), F.lit(True))
    scored = found.select("doc_id", held_out.alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
