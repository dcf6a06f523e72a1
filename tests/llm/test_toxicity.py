import math
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import toxicity as x

from .conftest import prose


def corpus(spark, n=900):
    rows, labels = [], []
    for i in range(n):
        toxic = i % 6 == 0
        text = prose(i, 40) + (f" you awful {['idiot', 'grubling', 'grubbing', 'grubson'][i % 4]}!" if toxic else "")
        rows.append((i, text, "en", "src"))
        if i % 2 == 0 or toxic:
            labels.append((i, 1, int(toxic) if i % 50 else 1 - int(toxic)))  # some labels err
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    model = x.fit(docs, labels)
    assert {"idiot", "awful"} <= set(model.terms) and any(t.startswith("grub") and t.endswith("*") for t in model.terms)
    rows = x.score(docs, model).collect()
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 4 == 2:
            assert (r.toxicity >= 0.3) == (r.doc_id % 6 == 0)
    # labels of held-out rows change nothing
    flipped = labels.withColumn("toxic", F.when(x.is_held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = x.fit(docs, flipped)
    assert again.terms == model.terms and np.allclose(again.weights, model.weights) and again.bias == model.bias
    kept = x.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in range(900) if i % 6}


def test_inputs_are_texts_alone(spark):
    docs, labels = corpus(spark, 300)
    model = x.fit(docs, labels)
    other = docs.select((F.col("doc_id") * 7 + 1).alias("doc_id"), "text", F.lit("zz").alias("lang"), F.lit(None).cast("string").alias("source"))
    score = lambda df: {r.text: r.toxicity for r in x.score(df, model).collect()}
    assert score(docs) == score(other)


def test_odd_rows(spark, odd):
    docs, labels = corpus(spark, 300)
    model = x.fit(docs, labels)
    rows = x.score(odd, model, into="score").collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if not (r.text or "").strip()}) == 1
    assert x.score(odd.limit(0), model).count() == 0
    for few in (labels.limit(0), labels.filter("toxic = 0"), labels.withColumn("toxic", F.lit(None).cast("int"))):
        blank = x.fit(docs, few)
        assert blank.terms == [] and all(r.toxicity < 0.3 for r in x.score(odd, blank).collect())
    twice = x.fit(docs.union(docs), labels)
    assert twice.terms == model.terms


def test_label_model():
    """Posteriors mend wrong labels, and two voters who always agree count about once."""
    rng = np.random.default_rng(0)
    truth = rng.random(3000) < 0.3
    given = np.where(rng.random(3000) < 0.03, ~truth, truth).astype(int)
    voters = np.array([np.where(truth & (rng.random(3000) < 0.8), 1, np.where(~truth & (rng.random(3000) < 0.02), 1, 0)) for _ in range(5)]).T
    votes = np.hstack([voters, voters[:, :1], np.where(given == 1, 1, -1)[:, None]]).astype(np.int8)
    posterior = x.label_model(votes, given)
    assert np.abs(posterior - truth).mean() < np.abs(given - truth).mean()


def test_voters_outvote_wrong_labels():
    """Texts labelled clean in which independent toxic terms meet become toxic, and only those."""
    rng = np.random.default_rng(3)
    truth = rng.random(4000) < 0.15
    hits = [sorted(np.flatnonzero(rng.random(6) < (0.6 if t else 0.005)).tolist()) for t in truth]
    given = np.where(rng.random(4000) < 0.02, ~truth, truth).astype(int)
    posterior = x.label_model(x.votes_of(hits, [f"t{i}" for i in range(6)], given), given) > 0.5
    wrong = given != truth
    clear = wrong & truth & (np.array([len(h) for h in hits]) >= 4)
    assert clear.sum() >= 3 and posterior[clear].all()
    assert (posterior != truth).sum() < wrong.sum() and not (posterior != truth)[~wrong].any()


def test_voters():
    """A word and its beginnings are one voter; a beginning of several words is its own."""
    terms = ["trash", "tra*", "tras*", "scum", "scu*"]
    hits = [[0, 1, 2]] * 9 + [[1, 2], [3, 4], [3, 4], [4], [4], []]
    assert [terms[i] for i in x.voters(hits, terms)] == ["trash", "scum", "scu*"]


def test_logistic():
    rng = np.random.default_rng(1)
    hits = [sorted(np.flatnonzero(rng.random(6) < 0.3).tolist()) for _ in range(2000)]
    target = np.array([1 / (1 + np.exp(2 - 3 * (0 in h) + 2 * (1 in h))) for h in hits])
    w, bias = x.fit_logistic(hits, 6, target, l2=1e-3, rounds=3000)
    got = np.array([1 / (1 + np.exp(-(bias + w[h].sum() + w[-1] * np.log1p(len(h))))) for h in hits])
    assert np.abs(got - target).max() < 0.03


def test_scores_against_brute_force(spark, odd):
    """Scores from the model's terms and weights alone, each term looked for in all words."""
    docs, labels = corpus(spark, 300)
    model = x.fit(docs, labels)
    for r in x.score(docs.select("text").union(odd.select("text")), model, into="score").collect():
        words = set(re.findall(r"[^\W\d_]+", (r.text or "").lower()))
        found = [i for i, t in enumerate(model.terms) if t in words or t.endswith("*") and any(w.startswith(t[:-1]) and len(w) >= len(t) for w in words)]
        logit = model.bias + sum(model.weights[i] for i in found) + model.weights[-1] * math.log1p(len(found))
        assert abs(r.score - 1 / (1 + math.exp(-logit))) < 1e-9
