"""Toxicity by a chain of linear classifiers."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaloom.llm.common import hold, ship, spread

#: Labelled documents that the chain is fitted on at most: those with the smallest hashes of their doc_id.
MAX_LABELLED = 5000
#: Words of the model, the most telling ones for each category, and in how many labelled documents a word must occur.
MAX_WORDS, LEAST_DOCS = 4000, 3
#: Beginnings of words that are features beside the words themselves, by their length; and how many of them a document has.
BEGINNINGS, LEVELS = (3, 4, 5, 6, 7), (1, 2, 3, 5)
CACHED_WORDS = 500_000
FOLDS, ROUNDS, RIDGE = 5, 120, 1.0
#: Categories in the order of the chain; the last one decides.
CATEGORIES = ("quality", "toxic")

WORDS = re.compile(r"\w+").findall


def words_of(text: str | None) -> set[str]:
    """The distinct lower-cased runs of word characters of a whole text."""
    return set(WORDS((text or "").lower()))


def beginnings(word: str) -> list[str]:
    return [f"{word[:n]}^" for n in BEGINNINGS if len(word) > n]


def features_of(words) -> set[str]:
    """The words, and `beginning^level` for every level that the count of distinct words with that beginning reaches."""
    counts: dict[str, int] = {}
    for w in words:
        for b in beginnings(w):
            counts[b] = counts.get(b, 0) + 1
    out = set(words)
    for b, n in counts.items():
        out.update(f"{b}{k}" for k in LEVELS if n >= k)
    return out


@dataclass
class Chain:
    """weights[k][f] for category k and feature f; carry[k]: weights of the earlier categories' probabilities."""

    categories: tuple[str, ...]
    words: dict[str, int]
    weights: object
    bias: list[float]
    carry: list[list[float]] = field(default_factory=list)
    _of: dict[str, tuple] = field(default_factory=dict, repr=False)
    _begin: dict[str, tuple] | None = field(default=None, repr=False)

    def find(self, words) -> list[int]:
        """The model's features among a document's distinct words; what a word contributes is looked up once per task."""
        if self._begin is None:
            self._begin = {}
            for f in self.words:
                if "^" in f:
                    self._begin.setdefault(f[: f.index("^") + 1], ())
        if len(self._of) > CACHED_WORDS:
            self._of.clear()
        of, found, counts = self._of, [], {}
        for w in words:
            got = of.get(w)
            if got is None:
                got = of[w] = (self.words.get(w), tuple(b for b in beginnings(w) if b in self._begin))
            if got[0] is not None:
                found.append(got[0])
            for b in got[1]:
                counts[b] = counts.get(b, 0) + 1
        for b, n in counts.items():
            found += [k for k in (self.words.get(f"{b}{level}") for level in LEVELS if n >= level) if k is not None]
        return found

    def probabilities(self, found: list[int]):
        import math

        out: list[float] = []
        for k in range(len(self.categories)):
            z = self.bias[k] + float(self.weights[k][found].sum()) + sum(c * p for c, p in zip(self.carry[k], out))
            out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
        return out


def _fit(rows, cols, n_words: int, dense, y):
    """Ridge logistic regression on presence features (rows, cols) and dense columns; Adam on all data."""
    import numpy as np

    n, d = len(y), dense.shape[1]
    w, c, b = np.zeros(n_words), np.zeros(d), np.log((y.sum() + 1) / (n - y.sum() + 1))
    m, v = np.zeros(n_words + d + 1), np.zeros(n_words + d + 1)
    if not n:
        return w, c, 0.0
    for t in range(1, ROUNDS + 1):
        z = b + np.bincount(rows, w[cols], n) + dense @ c
        g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        grad = np.r_[np.bincount(cols, g[rows], n_words) + RIDGE * w, dense.T @ g + RIDGE * c, g.sum()] / n
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, c, b = w - step[:n_words], c - step[n_words : n_words + d], b - step[-1]
    return w, c, b


def fit(samples: list[tuple[int, str, tuple]], categories=CATEGORIES) -> Chain:
    """Fit the chain on (doc_id, distinct words joined by spaces, labels).

    Later categories see the earlier ones' probabilities. For the rows they are fitted on, those are predicted by models
    that have not seen the row's fold, so a later model can't lean on an earlier one's memory.
    """
    import numpy as np

    samples = sorted(samples, key=lambda s: (s[0] is None, s[0] or 0))
    y = np.array([[float(bool(v)) for v in s[2]] for s in samples]).reshape(len(samples), len(categories))
    names: dict[str, int] = {}
    held = [np.array([names.setdefault(w, len(names)) for w in sorted(features_of(s[1].split()))], np.int64) for s in samples]
    rows = np.repeat(np.arange(len(held)), [len(h) for h in held]).astype(np.int64)
    cols = np.concatenate([np.zeros(0, np.int64), *held])
    n, total = len(samples), len(names)
    has = np.bincount(cols, minlength=total).astype(float)
    keep = np.zeros(total, bool)
    for k in range(len(categories)):
        pos = np.bincount(cols, y[rows, k], total)
        p = y[:, k].mean() if n else 0.0
        gain = (pos - has * p) ** 2 / (has * max(p * (1 - p), 1e-9) * np.maximum(1 - has / max(n, 1), 1 / max(n, 1)) + 1e-9)
        gain[has < LEAST_DOCS] = -1
        best = np.argsort(-gain, kind="stable")[: MAX_WORDS // len(categories)]
        keep[best[gain[best] > 4]] = True
    new = np.cumsum(keep) - 1
    rows, cols = rows[keep[cols]], new[cols[keep[cols]]]
    n_words = int(keep.sum())
    fold = np.arange(n) % FOLDS
    dense, weights, bias, carry = np.zeros((n, 0)), [], [], []
    for k in range(len(categories)):
        w, c, b = _fit(rows, cols, n_words, dense, y[:, k])
        weights.append(w)
        bias.append(float(b))
        carry.append([float(x) for x in c])
        if k + 1 < len(categories):
            out = np.zeros(n)
            for f in range(FOLDS):
                seen = fold != f
                inside = seen[rows]
                at = np.cumsum(seen) - 1
                fw, fc, fb = _fit(at[rows[inside]], cols[inside], n_words, dense[seen], y[seen, k])
                z = fb + np.bincount(rows, fw[cols], n) + dense @ fc
                out[~seen] = (1 / (1 + np.exp(-np.clip(z, -30, 30))))[~seen]
            dense = np.c_[dense, out]
    kept = {w: int(new[i]) for w, i in names.items() if keep[i]}
    return Chain(tuple(categories), kept, np.array(weights).reshape(len(categories), n_words), bias, carry)


def train(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, max_labelled: int = MAX_LABELLED) -> Chain:
    """Fit on at most max_labelled labelled rows of docs; rows with a null doc_id or a null label are no examples.

    A doc_id with several texts is one example, the least of them; one with several labels has the largest of each.
    """
    spark = docs.sparkSession
    ship(spark)
    known = labels.where(F.col("doc_id").isNotNull()).dropna(subset=list(categories)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*(F.max(F.col(c).cast("int")).alias(f"_y{k}") for k, c in enumerate(categories)))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)  # bounded, so it may be broadcast

    def distinct_words(batches):
        import pyarrow as pa

        hold("toxicity")
        for batch in batches:
            text = [" ".join(sorted(words_of(t))) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(text, pa.string()), batch.column("y")], ["doc_id", "text", "y"])

    y = F.array(*(F.col(f"_y{k}") for k in range(len(categories))))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", y.alias("y"))
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")).mapInArrow(distinct_words, "doc_id long, text string, y array<int>")
    return fit([(r["doc_id"], r["text"], tuple(r["y"])) for r in rows.collect()], categories)


def score(docs: DataFrame, chain: Chain, threshold: float = 0.4) -> DataFrame:
    """docs with p_<category> for each category and `rejected`: the last category's probability reaches the threshold.

    A null or empty text holds no words: its probabilities are the biases', and it is never rejected. All columns of docs
    are kept; where one has the name of a new column, the new one replaces it.
    """
    ship(docs.sparkSession)
    new = [f"p_{c}" for c in chain.categories]
    sent = chain

    def run(batches):
        import numpy as np
        import pyarrow as pa

        hold("toxicity")
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                words = words_of(batch.column("text")[i].as_py())
                p = sent.probabilities(np.array(sent.find(words), np.int64))
                rows.append((*p, bool(words) and p[-1] >= threshold))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array([r[k] for r in rows], pa.float64()) for k in range(len(new))), pa.array([r[-1] for r in rows], pa.bool_())], [*kept, *new, "rejected"])

    kept = [c for c in docs.columns if c.lower() not in {*new, "rejected"}]
    kind = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema]
    return spread(docs.select(*kept)).mapInArrow(run, ", ".join([*kind, *(f"{c} double" for c in new), "rejected boolean"]))
