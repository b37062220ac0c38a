"""Quality classifier as a sparse ensemble of rules.

A forest of shallow trees is grown over text statistics of labelled rows; each path from a root becomes a rule, a
conjunction of comparisons. A lasso logistic regression over the rules keeps few of them, and those are compiled into
one Spark column expression, so that scoring reads each text once, in the JVM, without a shuffle.

The labelled rows are about ``sample_rows`` of those that may be learnt from, chosen by a hash of the id; only they are
broadcast to find their texts, and their statistics are written to the shared folder for the two fits.

Defined results: null and empty texts have all statistics 0 and are scored like any other; with labels of one class
only (or none) every score is that class's share by Laplace's rule; null ids are carried along and null labels are not
learnt from; repeated rows each get their row; other columns are not read.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored


def _dropped(text: Column, characters: str) -> Column:
    """How many of the characters the text has."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜ"


def statistics(text: Column) -> dict[str, Column]:
    """Name -> statistic of a text."""
    text = F.coalesce(text, F.lit(""))
    words = F.split(text, r"[ \n\t\r]+")
    n, k = F.greatest(F.length(text), F.lit(1)), F.greatest(F.size(words), F.lit(1))
    return {
        "log_chars": F.log1p(F.length(text).cast("double")),
        "word_length": F.length(text) / k,
        "symbols": _dropped(text, "#*$%&|<>") / n,
        "bars": _dropped(text, "|") / n,
        "shouts": _dropped(text, "!?") / n,
        "capitals": _dropped(text, UPPER) / n,
        "digits": _dropped(text, "0123456789") / n,
        "stops": _dropped(text, ".,;:") / n,
        "lines": _dropped(text, "\n") / k,
        "distinct_words": F.size(F.array_distinct(words)) / k,
        "log_repeated": F.log1p((F.size(words) - F.size(F.array_distinct(words))).cast("double")),
    }


Rule = tuple[tuple[str, str, float], ...]


def paths(tree: str, names: list[str]) -> list[Rule]:
    """All paths of a tree's printed form, of every length, as sorted conjunctions of (statistic, comparison, value)."""
    found, stack = set(), []
    for line in tree.split("\n"):
        m = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([-+.\dEe]+)\)", line)
        if m:
            depth = len(m[1])
            stack = [x for x in stack if x[0] < depth] + [(depth, (names[int(m[2])], m[3], float(m[4])))]
            found.add(tuple(sorted(_tight([x[1] for x in stack]))))
    return sorted(found)


def _tight(rule: list[tuple[str, str, float]]) -> list[tuple[str, str, float]]:
    """Of several bounds on one side of a statistic, the closest."""
    best: dict[tuple[str, str], float] = {}
    for name, sign, value in rule:
        best[name, sign] = (min if sign == "<=" else max)(value, best.get((name, sign), value))
    return [(name, sign, value) for (name, sign), value in best.items()]


def holds(rule: Rule) -> Column:
    return reduce(lambda a, b: a & b, [F.col(name) <= value if sign == "<=" else F.col(name) > value for name, sign, value in rule])


def fit_rules(rows: DataFrame, label: str, trees: int = 20, depth: int = 3, strength: float = 0.003, seed: int = 7) -> tuple[float, list[tuple[float, Rule]]]:
    """Offset and weighted rules from rows with the statistics and a label of 0.0 or 1.0, both of which occur."""
    names = [c for c in rows.columns if c != label]
    data = VectorAssembler(inputCols=names, outputCol="features").transform(rows)
    forest = RandomForestClassifier(labelCol=label, numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="0.5", cacheNodeIds=False).fit(data)
    rules = sorted({rule for tree in forest.trees for rule in paths(tree.toDebugString, names)})
    if not rules:
        return 0.0, []
    binary = rows.select(label, F.array(*[holds(r).cast("double") for r in rules]).alias("held"))
    from pyspark.ml.functions import array_to_vector

    binary = binary.select(label, array_to_vector("held").alias("features"))
    lasso = LogisticRegression(labelCol=label, elasticNetParam=1.0, regParam=strength, maxIter=60, standardization=True).fit(binary)
    return lasso.intercept, [(float(w), r) for w, r in zip(lasso.coefficients, rules, strict=True) if abs(w) > 1e-9]


def compiled(offset: float, rules: list[tuple[float, Rule]]) -> Column:
    """The score as an expression over the statistics."""
    total = reduce(lambda a, b: a + b, [F.when(holds(r), F.lit(w)).otherwise(0.0) for w, r in rules], F.lit(float(offset)))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def quality_scores(docs: DataFrame, labels: DataFrame, learn: Column, held_out: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = 20_000) -> DataFrame:
    """doc_id, held_out, score, predicted, n_rules_met per row of docs. learn and held_out are expressions over doc_id.

    Labels (id_col, label_col; null, 0 or 1) join documents by the id.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    known = labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("double").alias("label")).where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & learn)
    n = known.count()
    share = F.pmod(F.xxhash64(F.lit(29), "doc_id"), F.lit(1_000_003)) / 1_000_003
    chosen = known.where(share < min(1.0, sample_rows / max(n, 1)))
    stats = statistics(F.col("text"))
    sample = stored(rows.join(F.broadcast(chosen), "doc_id").select("label", *[v.alias(k) for k, v in stats.items()]), "rule-sample")
    counts = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if {0.0, 1.0} <= set(counts):
        offset, rules = fit_rules(sample, "label")
    else:
        offset, rules = math.log((counts.get(1.0, 0) + 1) / (counts.get(0.0, 0) + 1)), []
    scored = rows.select("doc_id", held_out.alias("held_out"), *[v.alias(k) for k, v in stats.items()])
    met = reduce(lambda a, b: a + b, [holds(r).cast("int") for _, r in rules], F.lit(0))
    scored = scored.select("doc_id", "held_out", compiled(offset, rules).alias("score"), met.alias("n_rules_met"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_rules_met")
