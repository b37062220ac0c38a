"""Compiled rules against a plain evaluation of the statistics and of each rule."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from allelix.llm import rule_ensemble


def plain_statistics(text):
    text = text or ""
    words = re.split(r"[ \n\t\r]+", text)
    n, k = max(len(text), 1), max(len(words), 1)
    has = lambda characters: sum(c in characters for c in text)
    return {
        "log_chars": math.log1p(len(text)), "word_length": len(text) / k, "symbols": has("#*$%&|<>") / n, "bars": has("|") / n, "shouts": has("!?") / n,
        "capitals": has(rule_ensemble.UPPER) / n, "digits": has("0123456789") / n, "stops": has(".,;:") / n, "lines": has("\n") / k,
        "distinct_words": len(set(words)) / k, "log_repeated": math.log1p(len(words) - len(set(words))),
    }


@pytest.mark.parametrize("seed", range(3))
def test_scores(spark, texts, seed):
    r = random.Random(seed)
    own = {i: texts[i] for i in r.sample(sorted(texts), 60)} | {-1: None, -2: "", -3: " \n ", -4: "| ! 1 É.\n"}
    stats = {i: plain_statistics(t) for i, t in own.items()}
    names = list(stats[-1])
    rules = []
    for _ in range(40):
        rule = tuple((name, r.choice(("<=", ">")), stats[r.choice(list(own))][name] + r.choice((1e-7, -1e-7))) for name in r.sample(names, r.randint(1, 3)))
        rules.append((r.uniform(-2, 2), rule))
    offset = r.uniform(-1, 1)
    df = spark.createDataFrame(list(own.items()), "doc_id long, text string")
    rows = df.select("doc_id", *[v.alias(k) for k, v in rule_ensemble.statistics(F.col("text")).items()])
    got = {x["doc_id"]: x for x in rows.select("*", rule_ensemble.compiled(offset, rules).alias("score")).collect()}
    for i, s in stats.items():
        assert {k: got[i][k] for k in names} == pytest.approx(s, abs=1e-12)
        total = offset + sum(w for w, rule in rules if all(s[name] <= v if sign == "<=" else s[name] > v for name, sign, v in rule))
        assert got[i]["score"] == pytest.approx(1 / (1 + math.exp(-total)))
