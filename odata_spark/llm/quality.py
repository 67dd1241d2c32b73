"""Quality rules by weak supervision: rules vote or abstain, EM learns how far to trust each.

Native: features and votes are DataFrame expressions. The only thing that reaches the
driver is the histogram of vote patterns, at most 3 ** len(RULES) rows whatever the input.
The rules' bounds are tight, so that each also errs on good text. Expectation-maximisation on
the histogram estimates how often each rule votes against good and against bad text, from a
start in which rules are better than chance, with a prior worth PRIOR_ROWS rows at any size.
An abstention tells nothing. The posterior replaces all-must-pass filtering: a rule that also
fires on good text, or one vote against many, does not reject a document.

Defined results: a null text has no words, so it fails the base rule. Repeated rows are
scored alike. An empty table gives an empty table with the prior model. Columns are added;
on a clash the computed column wins.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, WS, text_or_empty

WINDOW = 8
PRIOR_ROWS = 20.0
#: Frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = (
    "the of and to in is that it was for on are as with his they at be this from have or by one had not but what all were when we there can an your which their "
    "der die das und ist nicht mit ein eine zu von im den dem auf für sich des es auch als an werden aus er hat dass sie nach wird bei um am "
    "le la les et est un une que qui dans pour pas au sur ne se ce il sont avec plus par de du en "
    "el los las y una por con para su del lo como más pero sus ha me si sin sobre este ya entre cuando todo"
).split()
#: name, value, good if value in [lo, hi], bad if value < low or > high (else abstain).
RULES = [
    ("length", lambda c: c("n_words"), 100, math.inf, 50, math.inf),
    ("word_length", lambda c: c("word_chars") / c("n_words"), 3.5, 8, 3, 10),
    ("symbols", lambda c: c("n_symbols") / c("n_words"), 0, 0.02, 0, 0.1),
    ("letters", lambda c: c("n_marks") / c("word_chars"), 0, 0.05, 0, 0.08),
    ("dup_lines", lambda c: c("n_dup_lines") / c("n_word_lines"), 0, 0.1, 0, 0.2),
    ("repeats", lambda c: c("n_repeat_words") / c("n_words"), 0, 0.05, 0, 0.1),
    ("capitals", lambda c: c("n_capitals") / c("word_chars"), 0, 0.1, 0, 0.25),
    ("shouting", lambda c: c("n_shouts") / c("n_words"), 0, 0.02, 0, 0.1),
    ("distinct", lambda c: c("n_distinct") / F.sqrt(c("n_words")), 4, math.inf, 2.5, math.inf),
    ("function_words", lambda c: c("n_function") / F.least(c("n_words"), F.lit(40.0)), 0.1, math.inf, 0.05, math.inf),
]
VOTES = [f"vote_{r[0]}" for r in RULES]


def features(docs: DataFrame) -> DataFrame:
    """docs with the counts and one vote column (-1, 0, 1) for each rule.

    Write the result once (common.materialize) before fit() and verdict(): both read it, and the
    optimiser would otherwise copy these long expressions into every condition on a verdict.
    """
    text = text_or_empty()
    added = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_word_lines", "n_capitals", "n_shouts", "n_distinct", "n_marks", "n_function", *VOTES}
    keep = [c for c in docs.columns if c not in added]
    solid = F.translate(text, WS, "")
    without = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    df = docs.select(
        *keep,
        F.filter(F.split(text, "[ \\x09-\\x0D]+", -1), lambda w: w != "").alias("__q_words"),
        F.filter(F.split(text, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(WS))) > 0).alias("__q_lines"),
        F.length(solid).cast("long").alias("word_chars"),
        without("#*$%&|<>").cast("long").alias("n_symbols"),
        without(UPPER + "ÀÂÄÇÉÈÊËÎÏÔÖÙÛÜŸÑÁÍÓÚ").cast("long").alias("n_capitals"),
        without("!").cast("long").alias("n_shouts"),
        without("0123456789!\"#$%&'()*+-/:;<=>?@[\\]^_`{|}~").cast("long").alias("n_marks"),
    )
    n = F.size("__q_words")
    df = df.select("*", F.transform("__q_words", lambda w: F.xxhash64(w)).alias("__q_each"))
    window = lambda i: F.xxhash64(*[F.get("__q_each", i + k) for k in range(WINDOW)])
    df = df.select(
        "*",
        F.when(n > WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), window)).alias("__q_hashes"),
    )
    # Windows found twice or more: neighbours in the sorted (hash, place) pairs with the same hash.
    pairs = F.sort_array(F.transform("__q_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    at = lambda a, i: F.get(a, i)["h"]
    found = lambda a: F.sort_array(F.transform(F.filter(F.transform(a, lambda x, i: F.struct(x["i"].alias("i"), (F.coalesce(at(a, i - 1) == x["h"], F.lit(False)) | F.coalesce(at(a, i + 1) == x["h"], F.lit(False))).alias("d"))), lambda x: x["d"]), lambda x: x["i"]))
    covered = lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b)
    some = F.col("__q_hashes").isNotNull() & (F.size(F.array_distinct("__q_hashes")) < F.size("__q_hashes"))
    df = df.select("*", F.when(some, pairs).alias("__q_pairs"))
    df = df.select("*", F.when(F.col("__q_pairs").isNotNull(), found(F.col("__q_pairs"))).alias("__q_places"))
    df = df.select(
        *keep, "word_chars", "n_symbols", "n_capitals", "n_shouts", "n_marks",
        n.cast("long").alias("n_words"),
        F.size("__q_lines").cast("long").alias("n_word_lines"),
        (F.size("__q_lines") - F.size(F.array_distinct("__q_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("__q_places").isNotNull(), covered(F.col("__q_places"))).otherwise(0).cast("long").alias("n_repeat_words"),
        F.size(F.array_distinct("__q_words")).cast("long").alias("n_distinct"),
        F.size(F.array_intersect(F.transform("__q_words", lambda w: F.rtrim(F.lower(w), F.lit(".,"))), F.array(*map(F.lit, FUNCTION_WORDS)))).cast("long").alias("n_function"),
    )
    positive = lambda c: F.nullif(F.col(c).cast("double"), F.lit(0.0))
    votes = {}
    for name, value, lo, hi, low, high in RULES:
        v = value(lambda c: positive(c) if c in ("n_words", "word_chars", "n_word_lines") and name != "length" else F.col(c).cast("double"))
        bad = v < low
        if high < math.inf:
            bad = bad | (v > high)
        good = v >= lo
        if hi < math.inf:
            good = good & (v <= hi)
        votes[f"vote_{name}"] = F.when(bad, -1).when(good, 1).otherwise(0)
    return df.withColumns(votes)


def fit(feats: DataFrame, rounds: int = 100) -> dict:
    """EM over the vote patterns: log-odds of good text for each vote, the prior's, and both rates of each rule's votes."""
    rows = feats.groupBy(*VOTES).count().collect()
    votes = np.array([[r[v] for v in VOTES] for r in rows], dtype=int).reshape(-1, len(VOTES))
    return estimate(votes, np.array([r["count"] for r in rows], dtype=float), rounds)


def estimate(votes: np.ndarray, weight: np.ndarray, rounds: int = 100) -> dict:
    """votes (patterns x rules, -1 bad, 0 abstains, 1 good) and how often each pattern occurs."""
    against, cast = (votes == -1).astype(float), (votes != 0).astype(float)
    # Better than chance: more votes against than a single one make a text likelier bad than good.
    good = 1 / (1 + np.exp(2.0 * against.sum(1) - 3.0))
    prior, rate = 0.9, np.zeros((2, len(VOTES)))
    odds = np.zeros((2, len(VOTES)))
    for _ in range(rounds):
        # Beta priors of PRIOR_ROWS rows: of the votes cast, one in twenty errs on good text, and two in five find bad text.
        for i, (y, p) in enumerate(((good, 0.05), (1 - good, 0.4))):
            rate[i] = ((weight * y) @ against + PRIOR_ROWS * p) / ((weight * y) @ cast + PRIOR_ROWS)
        prior = ((weight * good).sum() + 0.9 * PRIOR_ROWS) / (weight.sum() + PRIOR_ROWS)
        odds[0] = np.minimum(np.log(rate[0] / rate[1]), 0)  # a rule may be worthless, but not worse than chance
        odds[1] = np.maximum(np.log((1 - rate[0]) / (1 - rate[1])), 0)
        z = math.log(prior / (1 - prior)) + against @ odds[0] + (cast - against) @ odds[1]
        good = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    return {
        "prior": math.log(prior / (1 - prior)),
        "odds": {v: [float(odds[0][k]), 0.0, float(odds[1][k])] for k, v in enumerate(VOTES)},
        "rates": {v: [float(rate[0][k]), float(rate[1][k])] for k, v in enumerate(VOTES)},
    }


def posterior(model: dict) -> Column:
    """Probability that a row of features() is good text."""
    total = F.lit(model["prior"])
    for name, (bad, none, good) in model["odds"].items():
        total = total + F.when(F.col(name) < 0, F.lit(bad)).when(F.col(name) > 0, F.lit(good)).otherwise(F.lit(none))
    return 1 / (1 + F.exp(-total))


def verdict(df: DataFrame, model: dict, threshold: float = 0.5) -> DataFrame:
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return df.withColumn("quality", posterior(model)).withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
