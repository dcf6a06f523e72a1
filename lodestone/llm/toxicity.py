"""Toxicity scores by weak supervision.

1. Terms: words, and beginnings of longer words, that go with toxic labels in a bounded sample of
   labelled texts. Counting is distributed; the driver gets the MOST_TERMS strongest.
2. Voters: the strongest words (lexicon) and beginnings (patterns) each vote toxic where they occur
   and else abstain, one voter for terms that occur in nearly the same texts; counting voters vote by
   how many terms occur; the given label is one more voter, which the others can outvote.
3. Label model: a generative model with a hidden class, in which each voter has a rate of each vote
   for each class, fitted by expectation maximisation. Voters that still go together within a class
   say the same thing twice: a voter's evidence is divided by one plus its correlations with others.
4. Classifier: a logistic regression on the terms is fitted to the model's posterior labels. It
   alone scores texts: it sees no labels, ids, languages or sources.

The fit is the same at any size: it takes SAMPLE_ROWS labelled rows at most, in hashed order.
Scoring is a map over whole texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Labelled rows for the fit, at most.
SAMPLE_ROWS = 20_000
#: Terms of the classifier, and of them lexicon and pattern voters, at most.
MOST_TERMS, LEXICON_VOTERS, PATTERN_VOTERS = 4_000, 40, 60
#: Least texts of a term, and the least log-likelihood ratio of its going with toxic labels.
LEAST_TEXTS, LEAST_RATIO = 5, 12.0
#: Lengths of beginnings of longer words.
BEGINNINGS = (3, 4, 5, 6, 7)
#: Numbers of different terms at which the counting voters vote toxic.
COUNTS = (1, 2, 4, 8)
#: Terms whose texts overlap by as much (Jaccard) are one voter, that of the strongest.
ALIKE = 0.8
#: The most that labels err, of clean and of toxic texts, and the most log odds of all other voters.
LABEL_ERRORS, MOST_EVIDENCE = (0.01, 0.05), 9.0
#: Rounds of the label model.
ROUNDS = 2
#: Terms and words that a task holds before it passes counts on, or forgets.
HELD = 100_000
THRESHOLD = 0.3

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> set[str]:
    """The distinct words of a text: runs of letters in lower case."""
    return set(_WORD.findall((text or "").lower()))


def terms_of_word(word: str) -> list[str]:
    """The word, and its beginnings marked by a star."""
    return [word, *(f"{word[:n]}*" for n in BEGINNINGS if len(word) > n)]


def is_held_out(key: Column) -> Column:
    """Rows whose labels aren't to be learnt from: checksum of the id's text modulo 4 is 2."""
    return F.crc32(F.encode(F.coalesce(key.cast("string"), F.lit("")), "UTF-8")) % 4 == 2


def training_sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(id, text, toxic) of labelled documents that aren't held out, `rows` label rows at most, taken
    by a hash of the id. Null labels don't count, null texts are empty; a document with two labels
    comes twice, and of equal texts with equal labels one stays."""
    usable = labels.select(F.col(key).alias("id"), F.col(label).cast("int").alias("toxic")).filter(F.col("toxic").isin(0, 1) & F.col("id").isNotNull() & ~is_held_out(F.col("id")))
    chosen = usable.orderBy(F.xxhash64(F.lit("toxicity"), "id"), "id", "toxic").limit(rows)
    # `rows` ids and labels at most
    found = docs.select(F.col(key).alias("id"), common.text_or_empty(text).alias("text")).join(F.broadcast(common.durable(chosen)), "id")
    # of a text that was copied about, one copy for each label
    copy = Window.partitionBy(F.xxhash64("text"), "text", "toxic").orderBy("id")
    return common.durable(found.withColumn("_copy", F.row_number().over(copy)).filter("_copy = 1").drop("_copy"))


def count_terms(train: DataFrame) -> DataFrame:
    """(term, toxic, clean): how many texts of each label have the term."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = {0: Counter(), 1: Counter()}

        def out() -> pd.DataFrame:
            terms = list(counts[0].keys() | counts[1].keys())
            found = pd.DataFrame({"term": pd.Series(terms, dtype="object"), "toxic": [counts[1][t] for t in terms], "clean": [counts[0][t] for t in terms]})
            counts[0].clear(), counts[1].clear()
            return found

        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"]):
                counts[toxic].update({t for w in words_of(text) for t in terms_of_word(w)})
                if len(counts[0]) + len(counts[1]) > HELD:
                    yield out()
        yield out()
        common.release_memory()

    counted = train.select("text", "toxic").mapInPandas(count, "term string, toxic long, clean long")
    return counted.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def toxic_terms(counts: DataFrame, n_toxic: int, n_clean: int) -> list[str]:
    """The strongest terms by the log-likelihood ratio of their going with toxic labels, then by name."""
    a, b = F.col("toxic"), F.col("clean")
    n = n_toxic + n_clean
    part = lambda seen, expected: F.when(seen > 0, seen * F.ln(seen / expected)).otherwise(F.lit(0.0))
    with_term = part(a, (a + b) * (n_toxic / n)) + part(b, (a + b) * (n_clean / n))
    without = part(n_toxic - a, (n - a - b) * (n_toxic / n)) + part(n_clean - b, (n - a - b) * (n_clean / n))
    strong = counts.filter((a + b >= LEAST_TEXTS) & (a * n_clean > b * n_toxic)).withColumn("ratio", F.round(2 * (with_term + without), 6)).filter(F.col("ratio") >= LEAST_RATIO)
    return [r["term"] for r in strong.orderBy(F.desc("ratio"), "term").limit(MOST_TERMS).collect()]


class TermFinder:
    """Which terms occur in a text; remembers words."""

    def __init__(self, terms: list[str]):
        self.at = {t: i for i, t in enumerate(terms)}
        self.known: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str | None) -> set[int]:
        found, known = set(), self.known
        if len(known) > HELD:
            known.clear()
        for w in words_of(text):
            hits = known.get(w)
            if hits is None:
                hits = known[w] = tuple(self.at[t] for t in terms_of_word(w) if t in self.at)
            if hits:
                found.update(hits)
        return found


def voters(hits: list[list[int]], terms: list[str]) -> list[int]:
    """The terms that vote, strongest first. Of terms that occur in nearly the same texts, such as a
    word and its beginnings, the strongest votes for all."""
    texts: dict[int, set[int]] = {i: set() for i in range(len(terms))}
    for row, own in enumerate(hits):
        for i in own:
            texts[i].add(row)
    chosen: list[int] = []
    room = {False: LEXICON_VOTERS, True: PATTERN_VOTERS}
    for i, term in enumerate(terms):
        pattern = term.endswith("*")
        if room[pattern] and not any(len(texts[i] & texts[j]) >= ALIKE * len(texts[i] | texts[j]) for j in chosen):
            chosen.append(i)
            room[pattern] -= 1
    return chosen


def votes_of(hits: list[list[int]], terms: list[str], given: np.ndarray) -> np.ndarray:
    """A row for each text and a column for each voter: 1 toxic, -1 clean, 0 abstains."""
    voter = {i: v for v, i in enumerate(voters(hits, terms))}
    votes = np.zeros((len(hits), len(voter) + len(COUNTS) + 1), np.int8)
    for row, own in enumerate(hits):
        for i in own:
            if i in voter:
                votes[row, voter[i]] = 1
        for k, least in enumerate(COUNTS):
            votes[row, len(voter) + k] = 1 if len(own) >= least else -1
    votes[:, -1] = np.where(given == 1, 1, -1)
    return votes


def label_model(votes: np.ndarray, given: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The posterior probability that each text is toxic; the last column votes by the given labels.

    Starts from the given labels, softened; rates are smoothed by one vote of each kind. Each round
    estimates the prior, all voters' rates and the within-class correlations of those that aren't
    given labels from the posterior, and then the posterior. Labels err in LABEL_ERRORS of a class at
    most, and the other voters' evidence together counts for MOST_EVIDENCE at most, which is enough
    to outvote any label. More rounds let the hidden class drift to some other contrast among the
    texts, such as a language or a group of copies.
    """
    posterior = np.where(given == 1, 0.9, 0.05)
    for _ in range(rounds):
        prior = np.clip(posterior.mean(), 1e-3, 1 - 1e-3)
        evidence = np.zeros(votes.shape)
        expected = np.zeros((2, votes.shape[1]))
        for v in (-1, 0, 1):
            is_v = votes == v
            rate = [((weight @ is_v) + 1) / (weight.sum() + 3) for weight in (1 - posterior, posterior)]
            evidence += is_v * np.log(rate[1] / rate[0])
            expected[0] += v * rate[0]
            expected[1] += v * rate[1]
        wrong = [np.clip(((weight * (given != y)).sum() + 1) / (weight.sum() + 2), 1e-3, most) for y, weight, most in ((0, 1 - posterior, LABEL_ERRORS[0]), (1, posterior, LABEL_ERRORS[1]))]
        label = np.where(given == 1, np.log((1 - wrong[1]) / wrong[0]), np.log(wrong[1] / (1 - wrong[0])))
        residual = votes - (posterior[:, None] * expected[1] + (1 - posterior[:, None]) * expected[0])
        spread = np.sqrt((residual**2).mean(0)) + 1e-9
        correlation = (residual.T @ residual) / len(votes) / np.outer(spread, spread)
        np.fill_diagonal(correlation, 0)
        correlation[-1] = correlation[:, -1] = 0
        discount = 1 / (1 + np.where(correlation > 0.1, correlation, 0).sum(1))
        others = np.clip(evidence[:, :-1] @ discount[:-1], -MOST_EVIDENCE, MOST_EVIDENCE)
        new = 1 / (1 + np.exp(-(np.log(prior / (1 - prior)) + label + others)))
        settled = np.abs(new - posterior).max() < 1e-4
        posterior = new
        if settled:
            break
    return posterior


def fit_logistic(hits: list[list[int]], n_terms: int, target: np.ndarray, l2: float = 1.0, rounds: int = 400) -> tuple[np.ndarray, float]:
    """(weights, bias) of a logistic regression on terms' occurrence and, as the last weight, on the
    logarithm of one plus their number; accelerated gradient descent on all rows."""
    rows = np.repeat(np.arange(len(hits)), [len(h) for h in hits])
    columns = np.fromiter((i for h in hits for i in h), np.int64, len(rows))
    size = np.log1p([len(h) for h in hits])
    w, bias = np.zeros(n_terms + 1), math.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3))
    ahead, ahead_bias, momentum = w.copy(), bias, 1.0
    n = len(hits)
    step = 1.0 / (0.25 * (max(1.0, np.mean([len(h) for h in hits]) + 1 + (size**2).mean()) + l2 / n) * 4)
    for _ in range(rounds):
        logit = np.bincount(rows, ahead[columns], n) + ahead[-1] * size + ahead_bias
        error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - target) / n
        slope = np.append(np.bincount(columns, error[rows], n_terms), error @ size) + l2 * ahead / n
        new, new_bias = ahead - step * slope, ahead_bias - step * error.sum()
        following = (1 + math.sqrt(1 + 4 * momentum**2)) / 2
        ahead, ahead_bias = new + (momentum - 1) / following * (new - w), new_bias + (momentum - 1) / following * (new_bias - bias)
        w, bias, momentum = new, new_bias, following
    return w, bias


@dataclass
class ToxicityModel:
    terms: list[str]
    weights: np.ndarray
    bias: float

    def logit(self, hits: set[int]) -> float:
        return self.bias + float(self.weights[list(hits)].sum() if hits else 0) + float(self.weights[-1]) * math.log1p(len(hits))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> ToxicityModel:
    """Fits on labelled documents. Without labels of both classes the model knows no terms and
    scores all texts by the share of toxic labels, near 0 if there are none."""
    common.ship(docs.sparkSession)
    train = training_sample(docs, labels, key, text, label)
    numbers = dict(train.groupBy("toxic").count().collect())
    n_toxic, n_clean = numbers.get(1, 0), numbers.get(0, 0)
    terms = toxic_terms(count_terms(train), n_toxic, n_clean) if n_toxic and n_clean else []
    if not terms:
        share = (n_toxic + 0.01) / (n_toxic + n_clean + 1)
        return ToxicityModel([], np.zeros(1), math.log(share / (1 - share)))
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = TermFinder(sent.value)
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "hits": [sorted(finder(t)) for t in batch["text"]], "toxic": batch["toxic"]})
        finder.known.clear()
        common.release_memory()

    # SAMPLE_ROWS rows of at most MOST_TERMS small numbers, and few have many
    found = train.mapInPandas(find, "id long, hits array<int>, toxic int").collect()
    found.sort(key=lambda r: (r["id"], r["toxic"], r["hits"]))
    hits, given = [r["hits"] for r in found], np.array([r["toxic"] for r in found])
    posterior = label_model(votes_of(hits, terms, given), given)
    return ToxicityModel(terms, *fit_logistic(hits, len(terms), posterior))


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", into: str = "toxicity") -> DataFrame:
    """Every row with a score from 0 to 1; null texts score like empty ones. A column that has the
    score's name is replaced."""
    common.ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = sent.value
        finder = TermFinder(model.terms)
        for batch in batches:
            logits = np.array([model.logit(finder(t)) for t in batch])
            yield pd.Series(1 / (1 + np.exp(-np.clip(logits, -30, 30))), dtype="float64")
        finder.known.clear()
        common.release_memory()

    return docs.withColumn(into, F.pandas_udf(scores, "double")(F.col(text)))


def drop_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with their own columns."""
    name = "_toxicity"
    return score(docs, fit(docs, labels, key, text), text, name).filter(F.col(name) < threshold).drop(name)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    """The score of every document."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, common.table(spark, sf_dir, "labels")), into="score")
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
