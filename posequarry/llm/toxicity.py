"""A toxicity classifier with counterfactual regularisation.

Logistic regression on words and word beginnings. For every labelled text that
names a group, a copy with its identity terms swapped for others of the same
kind is made, and the fit is penalised by the squared change of the score, so
that a group's name itself carries no weight.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posequarry.llm.common import saved

# Identity terms by kind and language; a term is swapped for the next of its group.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("she", "he"), ("her", "his"),
    ("muslims", "christians", "jews", "hindus", "buddhists"), ("muslim", "christian", "jewish", "hindu", "buddhist"),
    ("black", "white", "asian", "latino"), ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "natives"), ("immigrant", "refugee", "foreigner", "native"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"), ("negros", "blancos"), ("inmigrantes", "refugiados"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("noirs", "blancs"), ("immigrés", "réfugiés"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("schwarze", "weiße"), ("einwanderer", "flüchtlinge"),
)
SWAP = {term: group[(i + 1) % len(group)] for group in IDENTITY_TERMS for i, term in enumerate(group)}

_WORD = re.compile(r"\w+")
PREFIXES = (3, 4, 5, 6)
CACHED = 300_000


def word_features(word: str) -> list[str]:
    """The word and its beginnings; a beginning ends in ``*``."""
    return [word] + [word[:n] + "*" for n in PREFIXES if len(word) > n]


def distinct_words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def swapped(words: set[str]) -> set[str]:
    """The words with every identity term replaced."""
    return {SWAP.get(w, w) for w in words}


@dataclass
class Model:
    weights: dict[str, float]
    bias: float

    def __post_init__(self):
        self._known: dict[str, tuple[str, ...]] = {}

    def active(self, words: set[str]) -> set[str]:
        """Features of the words that carry weight."""
        known, weights, out = self._known, self.weights, set()
        for word in words:
            hit = known.get(word)
            if hit is None:
                hit = tuple(f for f in word_features(word) if f in weights)
                if len(known) >= CACHED:
                    known.clear()
                if len(word) <= 64:
                    known[word] = hit
            if hit:
                out.update(hit)
        return out

    def score(self, text: str | None) -> float:
        # Sorted, so that the sum does not depend on the order of a set.
        z = self.bias + sum(self.weights[f] for f in sorted(self.active(distinct_words(text))))
        return 1 / (1 + float(np.exp(-np.clip(z, -40, 40))))


def _feature_counts(batches):
    """(feature, texts, toxic texts) of a part of the sample."""
    total, toxic = Counter(), Counter()
    for batch in batches:
        for text, y in zip(batch["text"], batch["y"].to_pylist()):
            words = distinct_words(text.as_py())
            found = {f for w in words for f in word_features(w)}
            total.update(found)
            if y:
                toxic.update(found)
    names = list(total)
    for s in range(0, len(names), 50_000):
        part = names[s : s + 50_000]
        yield pa.record_batch(
            {"feature": part, "n": [total[f] for f in part], "t": [toxic[f] for f in part]},
            schema=pa.schema([("feature", pa.string()), ("n", pa.int64()), ("t", pa.int64())]),
        )


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int, seed: int) -> tuple[DataFrame, float]:
    """(text, y) of at most ``per_class`` documents of each label, equal texts once with the label most of them have; the toxic share of all labels."""
    known = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("y"))
    )
    order = F.xxhash64(F.lit(seed), "doc_id")
    parts = [known.filter(F.col("y") == y).orderBy(order, "doc_id").limit(per_class) for y in (0, 1)]
    share = known.agg(F.avg("y")).first()[0]
    chosen = parts[0].unionAll(parts[1]).select(F.col("doc_id").alias("_id"), "y")
    texts = docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("_id")).groupBy("text").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    return saved(texts, "labelled-sample"), 0.0 if share is None else float(share)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    per_class: int = 4000,
    max_features: int = 4000,
    min_texts: int = 5,
    min_ratio: float = 4.0,
    penalty: float = 1.0,
    ridge: float = 1e-4,
    steps: int = 500,
    seed: int = 11,
) -> Model:
    """A model learned from the rows of ``labels`` (doc_id, toxic) and the texts they name.

    Bounds: ``per_class`` documents of each label (the share of toxic ones is taken over all) and ``max_features`` features, those of the highest chi-square among
    the ones that at least ``min_texts`` texts have and that are ``min_ratio`` times as
    frequent in toxic texts, plus all identity terms. Without labels of both
    kinds the model has no weights and scores everything with the toxic share.
    """
    sample, share = labelled_sample(docs, labels, per_class, seed)
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    share = min(max(share, 1e-6), 1 - 1e-6)
    bias = float(np.log(share / (1 - share)))
    if not clean or not toxic:
        return Model({}, bias)
    counts = sample.mapInArrow(_feature_counts, "feature string, n bigint, t bigint").groupBy("feature").agg(
        F.sum("n").alias("n"), F.sum("t").alias("t")
    )
    expected = F.col("n") * (toxic / (clean + toxic))
    chosen = (
        counts.filter(F.col("n") >= min_texts)
        .filter((F.col("t") + 0.5) / (toxic + 1) >= min_ratio * (F.col("n") - F.col("t") + 0.5) / (clean + 1))
        .withColumn("chi2", F.pow(F.col("t") - expected, 2) / expected)
        .orderBy(F.desc("chi2"), "feature")
        .limit(max_features)
        .select("feature")
        .collect()
    )
    names = sorted({r["feature"] for r in chosen} | {f for term in SWAP for f in word_features(term)})
    place = {name: i for i, name in enumerate(names)}
    selector = Model(dict.fromkeys(names, 0.0), 0.0)

    def encode(batches):
        for batch in batches:
            rows, swaps = [], []
            for text in batch["text"]:
                words = distinct_words(text.as_py())
                other = swapped(words)
                rows.append(sorted(place[f] for f in selector.active(words)))
                swaps.append(None if other == words else sorted(place[f] for f in selector.active(other)))
            kind = pa.list_(pa.int32())
            yield pa.record_batch([batch["y"], pa.array(rows, kind), pa.array(swaps, kind)], names=["y", "x", "swap"])

    coded = sample.mapInArrow(encode, "y int, x array<int>, swap array<int>").toArrow()
    weights, bias = _descend(coded, len(names), penalty, ridge, steps)
    return Model({n: float(w) for n, w in zip(names, weights) if abs(w) > 1e-4}, bias)


def _descend(coded: pa.Table, size: int, penalty: float, ridge: float, steps: int):
    """Weights and bias that minimise the class-balanced log loss, the ridge and the counterfactual penalty."""
    y = coded["y"].to_numpy().astype(float)
    rows = coded["x"].to_pylist()
    swaps = coded["swap"].to_pylist()
    # A set of rows in one order whatever the partitions were.
    order = sorted(range(len(y)), key=lambda i: (y[i], rows[i]))
    y, rows, swaps = y[order], [rows[i] for i in order], [swaps[i] for i in order]

    def flat(lists):
        at = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        return at, np.array([v for x in lists for v in x], np.int64)

    at, col = flat(rows)
    pairs = [i for i, s in enumerate(swaps) if s is not None]
    plus_at, plus = flat([rows[i] for i in pairs])
    minus_at, minus = flat([swaps[i] for i in pairs])
    # Both classes count alike: a score of one half is as likely a toxic as a clean text if both were as frequent.
    even = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    w, b = np.zeros(size), 0.0
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for step in range(1, steps + 1):
        z = np.bincount(at, w[col], len(y)) + b
        error = even * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        grad = np.bincount(col, error[at], size) + ridge * w
        if pairs:
            change = np.bincount(plus_at, w[plus], len(pairs)) - np.bincount(minus_at, w[minus], len(pairs))
            scale = 2 * penalty / len(pairs)
            grad += scale * (np.bincount(plus, change[plus_at], size) - np.bincount(minus, change[minus_at], size))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        mb, vb = 0.9 * mb + 0.1 * error.sum(), 0.999 * vb + 0.001 * error.sum() ** 2
        fix, fix2 = 1 - 0.9**step, 1 - 0.999**step
        rate = 0.1 * (1 - 0.9 * step / steps)
        w -= rate * (m / fix) / (np.sqrt(v / fix2) + 1e-9)
        b -= rate * (mb / fix) / (np.sqrt(vb / fix2) + 1e-12)
    return w, b


def score(text: Column, model: Model) -> Column:
    """Score of a text column, 0 to 1; null and empty texts get that of a text without features."""

    @F.arrow_udf("double")
    def column(values: pa.Array) -> pa.Array:
        return pa.array((model.score(v.as_py()) for v in values), pa.float64())

    return column(text)


def held_out(doc_id: Column) -> Column:
    """The fold that no model may learn from: crc32 of the id as text leaves 1 modulo 3 (null ids: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, **options) -> Model:
    """``fit`` on the labels outside the held-out fold."""
    return fit(docs, labels.filter(~held_out(F.col("doc_id"))), **options)
