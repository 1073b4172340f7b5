"""Toxicity by a classifier chain.

Categories are predicted one after another. Each has a logistic model over the words that a text
holds and a few ratios of its form; from the second category on the model also reads the probabilities that the
earlier models give. In training these come from models fitted without the row's fold, so that later
models see probabilities as uncertain as they will be on new texts. The models are fitted on a bounded
sample of labelled rows; all rows are scored.

Defined cases: null and empty texts have no words and get the probabilities of such a text; equal texts get
equal results; an empty table gives an empty result; rows without a label aren't used in training; with no labelled rows, or
one class only, a category's probability is its share; other columns are passed through, and a column that has the
name of an output is replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicspan.llm.common import extended, small_batches
from civicspan.llm.decontamination import words_of

#: Ratios of a text's form, from its words as they stand.
FORM = ("symbols", "exclamations", "capitals", "repetition")
SYMBOLS = b"#*$%&|<>"


def features(text: bytes) -> tuple[set[bytes], list[float]]:
    """The words of a text and the ratios of its form."""
    words = words_of(text)
    distinct = set(words)
    n = max(len(words), 1)
    letters = max(len(text) - text.count(b" "), 1)
    capitals = len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    return distinct, [min(symbols / n, 1.0), min(text.count(b"!") / n, 1.0), capitals / letters, 1 - len(distinct) / n]


@dataclass
class Linear:
    """A logistic model: a weight for each known word, each ratio and each earlier category, and a constant."""

    words: dict[bytes, float]
    dense: np.ndarray
    constant: float

    def probability(self, words: set[bytes], dense: list[float]) -> float:
        known = self.words
        score = self.constant + float(np.dot(self.dense, dense))
        score += sum(known[w] for w in known.keys() & words)
        return float(1 / (1 + np.exp(-np.clip(score, -30, 30))))


def _choose(rows: list[set[bytes]], labels: np.ndarray, most: int, least_rows: int, least_z: float) -> list[bytes]:
    """Words whose share of rows differs between both classes by ``least_z`` standard errors or more."""
    yes: Counter = Counter()
    no: Counter = Counter()
    for words, label in zip(rows, labels, strict=True):
        (yes if label else no).update(words)
    n_yes, n_no = max(int(labels.sum()), 1), max(int((~labels).sum()), 1)
    scored = []
    for word in yes.keys() | no.keys():
        a, b = yes[word], no[word]
        if a + b >= least_rows:
            p = (a + b) / (n_yes + n_no)
            z = abs(a / n_yes - b / n_no) / np.sqrt(p * (1 - p) * (1 / n_yes + 1 / n_no) + 1e-12)
            if z >= least_z:
                scored.append((-z, word))
    return [word for _, word in sorted(scored)[:most]]


def fit_linear(
    rows: list[set[bytes]],
    dense: np.ndarray,
    labels: np.ndarray,
    most_words: int = 512,
    least_rows: int = 5,
    least_z: float = 6.0,
    penalty: float = 1.0,
    steps: int = 12,
) -> Linear:
    """Newton's method on the penalised likelihood; the constant isn't penalised."""
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    if not len(labels) or labels.all() or not labels.any():
        return Linear({}, np.zeros(dense.shape[1]), float(np.log(share / (1 - share))))
    chosen = _choose(rows, labels, most_words, least_rows, least_z)
    place = {word: i for i, word in enumerate(chosen)}
    x = np.zeros((len(rows), len(chosen) + dense.shape[1] + 1))
    for i, words in enumerate(rows):
        x[i, [place[w] for w in place.keys() & words]] = 1
    x[:, len(chosen) : -1] = dense
    x[:, -1] = 1
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    w = np.zeros(x.shape[1])
    w[-1] = np.log(share / (1 - share))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (labels - p) - ridge * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        w = w + np.linalg.solve(curve, slope)
    return Linear({word: float(w[i]) for word, i in place.items()}, w[len(chosen) : -1], float(w[-1]))


@dataclass
class Chain:
    categories: list[str]
    models: list[Linear]

    def probabilities(self, text: bytes) -> list[float]:
        words, dense = features(text)
        made: list[float] = []
        for model in self.models:
            made.append(model.probability(words, dense + made))
        return made


def fit_chain(texts: list[bytes], labels: dict[str, np.ndarray], folds: int = 5) -> Chain:
    """Models in the order of ``labels``; row ``i`` is in fold ``i % folds``."""
    of_rows = [features(t) for t in texts]
    rows = [words for words, _ in of_rows]
    dense = np.array([form for _, form in of_rows]).reshape(len(rows), len(FORM))
    fold = np.arange(len(rows)) % folds
    models = []
    for label in labels.values():
        label = label.astype(bool)
        models.append(fit_linear(rows, dense, label))
        unseen = np.zeros(len(rows))
        for k in range(folds):
            inside = np.flatnonzero(fold != k)
            part = fit_linear([rows[i] for i in inside], dense[inside], label[inside])
            for i in np.flatnonzero(fold == k):
                unseen[i] = part.probability(rows[i], list(dense[i]))
        dense = np.column_stack((dense, unseen))
    return Chain(list(labels), models)


def labelled_sample(docs: DataFrame, labels: DataFrame, categories: list[str], rows: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """At most ``rows`` labelled texts, chosen by the hash of their ids; ids only are sorted and texts joined after."""
    chosen = labels.select(key, *categories).dropna().orderBy(F.xxhash64(key), key).limit(rows)
    return docs.select(key, text).join(F.broadcast(chosen), key)


def train(
    docs: DataFrame,
    labels: DataFrame,
    categories: list[str],
    sample_rows: int = 6000,
    key: str = "doc_id",
    text: str = "text",
) -> Chain:
    """Fits a chain over 0/1 columns of ``labels``, in the order given. At most ``sample_rows`` labelled
    rows are collected, ordered by the hash of their ids."""
    found = labelled_sample(docs, labels, categories, sample_rows, key, text)
    rows = found.orderBy(F.xxhash64(key), key).limit(sample_rows).collect()
    texts = [(row[text] or "").encode() for row in rows]
    return fit_chain(texts, {c: np.array([row[c] for row in rows], dtype=bool) for c in categories})


def score(docs: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """Adds ``p_<category>`` for each category of the chain."""
    names = [f"p_{c}" for c in chain.categories]
    docs = docs.drop(*names)
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in small_batches(batches):
            made = [model.probabilities((t or "").encode()) for t in batch.column(text).to_pylist()]
            columns = [pa.array([m[i] for m in made], pa.float64()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, extended(docs.schema, ", ".join(f"{name} double" for name in names)))
