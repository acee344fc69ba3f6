import random

import numpy as np

from lotline.llm import toxicity
from tests.llm.data import documents, texts, with_odd_columns

BAD = ["grobk", "flimz", "wurt"]


def corpus(seed, n):
    """Prose of random words; some has one to four bad words in any case, next to signs."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rng.choice(["so", "on", "and", "plain", "words", "of", "it", "é", f"w{rng.randrange(300)}"]) for _ in range(rng.randint(10, 80))]
        toxic = rng.random() < 0.3
        for _ in range(rng.randint(1, 4) if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(BAD).upper() + "!"
        rows.append((i, " ".join(words), int(toxic and any(w[:-1].lower() in BAD for w in words))))
    return rows


def test_held_out_documents(spark):
    rows = corpus(1, 1500)
    docs = with_odd_columns(spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string"))
    labels = spark.createDataFrame([(i, g, "odd") for i, _, g in rows if i < 900] + [(None, 1, ""), (5, None, "")], "doc_id bigint, toxic int, text string")
    model = toxicity.train(docs, labels)
    assert set(model.weights) >= {b.encode() for b in BAD}
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == len(rows)
    unseen = [(got[i].toxic, g) for i, _, g in rows if i >= 900]
    assert np.mean([t == bool(g) for t, g in unseen]) > 0.98
    counts = {i: sum(w[:-1].lower() in BAD for w in t.split()) for i, t, _ in rows}
    mean = [np.mean([got[i].expected_severity for i in got if counts[i] == k]) for k in (0, 1, 3)]
    assert mean[0] < mean[1] < mean[2] and {got[i].grade for i in got} == {0, 1, 2}
    rejected = docs.where(toxicity.rejects(model)("text")).select("doc_id").collect()
    assert {r.doc_id for r in rejected} == {i for i in got if got[i].toxic}


def test_thresholds_share_weights_and_are_ordered():
    rng = np.random.default_rng(2)
    rows = [({b"a"} if g else set(), int(g + (g > 0 and rng.random() < 0.5))) for g in rng.integers(0, 2, 500)]
    rows = [(f | ({b"b"} if g == 2 else set()), g) for f, g in rows]
    weights, theta = toxicity.fit(rows)
    assert weights[b"a"] > 0 and weights[b"b"] > 0 and list(theta) == sorted(theta) and len(theta) == 2
    model = toxicity.Severity(weights, tuple(theta), 1.0)
    chances = model.grades(model.score(["", "a", "A, b!"]))
    assert np.allclose(chances.sum(axis=1), 1) and chances.argmax(axis=1).tolist() == [0, 1, 2]


def test_odd_rows_and_no_labels(spark):
    docs = documents(spark, texts(7, 20))
    docs = docs.union(docs.selectExpr("CAST(NULL AS bigint)", "text", "lang", "source", "n_chars"))
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    model = toxicity.train(docs, none)
    got = toxicity.score(docs, model).collect()
    assert len(got) == 40 and not any(r.toxic for r in got)
    assert toxicity.score(docs.limit(0), model).collect() == []
    assert toxicity.train(docs, docs.selectExpr("doc_id", "1 AS toxic")).cut == np.inf
    strict = toxicity.Severity({b"ka": 9.0}, (0.0,), 0.0)
    assert [r.toxic for r in toxicity.score(docs.limit(3).union(docs.limit(4).subtract(docs.limit(3))), strict).orderBy("doc_id").collect()] == [False, False, True, True]


def test_many_label_values_are_all_used(spark):
    """Labels 0 to 24, with words that mark those from 8 and from 16 on; ids and labels that repeat."""
    rng = random.Random(5)
    rows = []
    for i in range(2500):
        grade = i % 25
        words = [f"w{rng.randrange(200)}" for _ in range(20)] + ["flimz"] * (grade >= 8) + ["grobk"] * (grade >= 16)
        rows.append((i, " ".join(words), grade))
    docs = spark.createDataFrame([r[:2] for r in rows] * 2, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, g) for i, _, g in rows] * 3, "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels, fit_rows=50)
    assert {b"flimz", b"grobk"} <= set(model.weights) and 10 < len(model.thresholds) < toxicity.MOST_GRADES
    expected = model.grades(model.score(["w1", "w1 flimz", "w1 flimz grobk"])) @ np.arange(len(model.thresholds) + 1)
    assert expected[0] + 2 < expected[1] < expected[2] - 2


def test_long_texts_are_not_fitted_and_ties_at_the_limit(spark):
    """Of labelled rows beyond the limit those with the smallest hash count, whatever their order."""
    rows = corpus(3, 400)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000, "grobk " * 20_000)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, g) for i, _, g in rows] + [(1000, 0)], "doc_id bigint, toxic int")
    one, two = (toxicity.train(docs.repartition(n), labels.repartition(n), fit_rows=60) for n in (1, 4))
    assert one == two and set(one.weights) & {b.encode() for b in BAD}
    long_only = spark.createDataFrame([(1000, 1), (1, 0)], "doc_id bigint, toxic int")
    assert toxicity.train(docs, long_only).cut == np.inf


def test_rows_stand_for_what_was_counted():
    """The cut with few rows of a frequent label equals that with all of them."""
    expected, toxic = np.array([0.1, 0.2, 0.6, 0.5, 0.9, 1.5]), np.array([False, False, False, True, True, True])
    counts = np.array([10, 10, 10, 1, 1, 1])
    assert toxicity.best_cut(expected, toxic, counts) == toxicity.best_cut(np.repeat(expected, counts), np.repeat(toxic, counts)) != toxicity.best_cut(expected, toxic)
    rows = [({b"a"}, 1)] * 30 + [(set(), 0)] * 30 + [({b"a"}, 0)] * 2
    weights, theta = toxicity.fit(rows, [1] * 30 + [5] * 30 + [1] * 2)
    same, other = toxicity.fit(rows[:30] + [(set(), 0)] * 150 + rows[60:])
    assert weights.keys() == same.keys() and abs(weights[b"a"] - same[b"a"]) < 0.2 and np.abs(theta - other).max() < 0.2
