"""Learned operators: exhaustive search, explicit formulas and held-out scores; the whole pipeline on awkward tables."""

import itertools
import math
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chatgauge.llm import boosted, factor, gru, weak_rules

DATA = "/root/testdata/sf0.01"


# ---------------------------------------------------------------- boosted trees


def best_split(x, gradient, hessian, rows, cuts):
    """(gain, feature, cut) of the best admissible split, by trying every one."""
    def score(part):
        return gradient[part].sum() ** 2 / (hessian[part].sum() + boosted.RIDGE)

    found = []
    for f, values in enumerate(cuts):
        for c in values:
            left, right = rows[x[rows, f] <= c], rows[x[rows, f] > c]
            if min(len(left), len(right)) >= boosted.LEAST_ROWS:
                found.append((score(left) + score(right) - score(rows), f, c))
    return max(found, default=(0, None, None), key=lambda s: s[0])


def test_splits_equal_exhaustive_search():
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(300, 4)), 2)
    x[:, 3] = 1.0  # a statistic that never changes
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0.3).astype(float)
    trees = boosted.fit(x, y, n_trees=1, depth=3)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, boosted.BINS + 1)[1:-1])) for f in range(4)]
    p = 1 / (1 + np.exp(-trees.base))
    gradient, hessian = p - y, np.full(len(y), p * (1 - p))

    def check(node, rows, depth):
        value = -boosted.RATE * gradient[rows].sum() / (hessian[rows].sum() + boosted.RIDGE)
        assert trees.value[node] == pytest.approx(value)
        gain, _, _ = best_split(x, gradient, hessian, rows, cuts) if depth and len(rows) >= 2 * boosted.LEAST_ROWS else (0, None, None)
        if trees.left[node] == node:
            assert gain <= 1e-6
            return 1
        f, c = trees.feature[node], trees.cut[node]
        left, right = rows[x[rows, f] <= c], rows[x[rows, f] > c]
        made = sum(gradient[s].sum() ** 2 / (hessian[s].sum() + boosted.RIDGE) * k for s, k in ((left, 1), (right, 1), (rows, -1)))
        assert made == pytest.approx(gain)
        return check(trees.left[node], left, depth - 1) + check(trees.right[node], right, depth - 1)

    assert check(0, np.arange(300), 3) > 4


def test_traversal_equals_a_walk():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    trees = boosted.fit(x, y, n_trees=20)
    asked = np.concatenate([x[:50], rng.normal(size=(50, 5)) * 3, [[np.inf, -np.inf, 0, 0, 0]]])
    for row, margin in zip(asked, trees.margins(asked)):
        total = trees.base
        for root in trees.roots:
            at = root
            while trees.left[at] != at:
                at = trees.left[at] if row[trees.feature[at]] <= trees.cut[at] else trees.right[at]
            total += trees.value[at]
        assert margin == pytest.approx(total)


# ---------------------------------------------------------------- weak supervision


def test_posteriors_equal_the_product_of_shares():
    rng = random.Random(1)
    model = [(0.7, [0.01] * 7)] + [(0.3 / 7, [rng.uniform(0.05, 0.9) for _ in range(7)]) for _ in range(7)]
    for vote in rng.sample(list(itertools.product((-1, 0, 1), repeat=7)), 100):
        joint = [prior * math.prod(r if v < 0 else 1 - r for v, r in zip(vote, rates) if v) for prior, rates in model]
        assert weak_rules.posteriors(vote, model) == pytest.approx([j / sum(joint) for j in joint])


def test_em_recovers_what_votes_were_drawn_from():
    rng = random.Random(6)
    patterns, truth = {}, []
    rates = [[0.004] * 7] + [[0.85 if j == k else 0.04 for j in range(7)] for k in range(7)]
    share = [0.86] + [0.02] * 7
    for _ in range(30_000):
        kind = rng.choices(range(8), share)[0]
        vote = tuple(0 if rng.random() < 0.1 else -1 if rng.random() < rates[kind][j] else 1 for j in range(7))
        patterns[vote] = patterns.get(vote, 0) + 1
        truth.append((vote, kind == 0))
    model = weak_rules.estimate(list(patterns.items()))
    assert model[0][0] == pytest.approx(0.86, abs=0.03)
    for k in range(1, 8):
        assert model[k][1][k - 1] == pytest.approx(0.85, abs=0.12) and model[k][0] == pytest.approx(0.02, abs=0.012)
    # the bounds that keep classes apart are not what these estimates rest on
    assert max(model[0][1]) < 0.01 and all(model[k][1][k - 1] > 0.5 for k in range(1, 8))
    right = [(weak_rules.posteriors(v, model)[0] >= 0.5) == good for v, good in truth]
    best = [(weak_rules.posteriors(v, list(zip(share, rates)))[0] >= 0.5) == good for v, good in truth]
    assert sum(right) >= sum(best) - 0.005 * len(truth)


# ---------------------------------------------------------------- held-out scores


def auc(rows):
    """The share of (positive, negative) pairs in order, ties half."""
    ordered = sorted(rows)
    ranks, k = {}, 0
    for score, group in itertools.groupby(ordered, key=lambda r: r[0]):
        n = len(list(group))
        ranks[score], k = k + (n + 1) / 2, k + n
    positive = [ranks[s] for s, y in rows if y]
    return (sum(positive) - len(positive) * (len(positive) + 1) / 2) / (len(positive) * (len(rows) - len(positive)))


@pytest.fixture(scope="module")
def given(spark):
    if not os.path.exists(DATA):
        pytest.skip("no test tables here")
    return spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")


@pytest.mark.parametrize("made, value, floor", [(boosted.quality_scores, "quality", 0.97), (factor.toxicity_scores, "toxic", 0.85)])
def test_held_out_classifier_scores(given, made, value, floor):
    docs, labels = given
    rows = made(docs, labels).where("held_out").join(labels, "doc_id").where(f"{value} IS NOT NULL").select("score", value).collect()
    assert len(rows) > 50 and auc([(r[0], r[1]) for r in rows]) > floor


def test_held_out_languages(given):
    docs, _ = given
    rows = gru.languages(docs).where("held_out").join(docs.select("doc_id", "lang", "text"), "doc_id").where(
        "lang IS NOT NULL AND length(text) > 40"
    ).collect()
    assert len(rows) > 100 and sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.97


def test_quality_rules_agree_with_labels(given):
    docs, labels = given
    rows = weak_rules.weak_quality(docs).join(labels, "doc_id").select("kept", "quality").collect()
    good, bad = [r["kept"] for r in rows if r["quality"] == 1], [r["kept"] for r in rows if r["quality"] == 0]
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.1


# ---------------------------------------------------------------- pipeline


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n, seed=1, lang=True):
    rng = random.Random(seed)
    words = {"en": "the quick brown fox jumps over lazy dogs while rivers flow gently under bridges".split(), "de": "der schnelle braune fuchs springt über den faulen hund während flüsse fließen".split()}
    out = []
    for i in range(n):
        tongue = rng.choice(["en", "de"])
        text = " ".join(f"{rng.choice(words[tongue])}{rng.choice('abcdefgh')}" for _ in range(rng.randint(15, 60)))
        out.append((i, text, tongue if lang else None, rng.choice(["a", "b", None]), len(text)))
    return out


def run(spark, tmp_path, rows):
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    return corpus_pipeline.run(spark, str(tmp_path))


def test_pipeline_keeps_an_unlabelled_corpus(spark, tmp_path):
    made = run(spark, tmp_path, corpus(20, lang=False)).collect()
    assert len({r["doc_id"] for r in made}) > 15


def test_pipeline_of_an_empty_table(spark, tmp_path):
    assert run(spark, tmp_path, []).collect() == []


def test_pipeline_drops_what_its_stages_drop(spark, tmp_path):
    rows = corpus(120)
    rows += [rows[3], rows[3], (3000, rows[5][1], "en", "a", 0)]  # repeated rows and a copy under another id
    rows += [(4000, None, None, None, None), (4001, "", "en", "b", 0), (4002, "one two", "en", "b", 7), (4003, "spam " * 400, "en", "a", 2000)]
    rows += [(4004, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15", "en", "a", 30)]
    made = run(spark, tmp_path, rows)
    kept = {r["doc_id"] for r in made.collect()}
    assert kept <= set(range(120)) and len(kept) > 100  # the mix may leave some documents out
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.createDataFrame(rows, COLUMNS).withColumn("kept_row", F.lit(1)).withColumn("bucket", F.lit("x"))
    for name in ("quality rules", "language ID", "SimHash near-dedup"):
        docs = stages[name](spark, docs, "")
        assert docs.columns == [*COLUMNS.replace(" long", "").replace(" string", "").split(", "), "kept_row", "bucket"]
    left = [r["doc_id"] for r in docs.collect()]
    assert sorted(left) == list(range(120))  # clean documents stay, each group of copies once
