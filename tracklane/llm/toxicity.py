"""Toxicity: a logistic classifier that is penalised for minding which group is named.

Features are words and word beginnings of 4 to 8 bytes (so inflected forms count), each
at three levels: it occurs once, twice, three times or more. They are chosen on the
training sample by how unevenly the two classes hold them. For the penalty, each sampled sentence has counterfactual twins: one of its words
gives way to an identity term, and the term is swapped for others. The squared change of the
score within such a pair is added to the loss, so that naming a group neither raises nor
lowers a score, and whole-sentence evidence has to carry the decision.

The fit takes at most ``ROWS`` labelled documents, drawn by hash, whole, to the driver, and twins of
at most ``PAIRS`` of them. The model is a few weights for each of ``FEATURES`` features, broadcast; scoring is one pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tracklane.llm.common import Words, pieces, table
from tracklane.llm.quality import THRESHOLD, held_out, in_sample, scored

ROWS = 6000
FEATURES = 4096
HEADS = (4, 5, 6, 8)
LEVELS = 3
STEPS = 300
PENALTY = 5.0
RIDGE = 1e-3
PAIRS = 2000  # counterfactual pairs

IDENTITY_TERMS = [
    *("women", "men", "girls", "boys", "gay", "lesbian", "straight", "transgender", "black", "white", "asian", "latino"),
    *("african", "european", "american", "arab", "jewish", "muslim", "christian", "hindu", "buddhist", "atheist"),
    *("immigrants", "refugees", "disabled", "blind", "deaf", "elderly", "young", "poor", "rich"),
    *("frauen", "männer", "juden", "muslime", "christen", "femmes", "hommes", "juifs", "musulmans", "chrétiens"),
    *("mujeres", "hombres", "judíos", "musulmanes", "cristianos"),
]


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature hash) of every word and word beginning, repeats included."""
    text = words.text_index()
    parts = [words.hashes, *(words.prefixes[k] for k in HEADS)]
    hashes = np.concatenate(parts)
    texts = np.tile(text, len(parts))
    real = hashes != 0
    return texts[real], hashes[real]


def _words(texts: pa.Array) -> Words:
    return Words(texts, lower=True, prefixes=HEADS)


def _parts(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(number of the first, texts) of some MB at a time: features take many times the bytes of their text."""
    first = 0
    for some in pieces(iter([pa.RecordBatch.from_arrays([texts], ["text"])])):
        yield first, some["text"]
        first += some.num_rows


def _holders(texts: pa.Array, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features of the texts, and how many texts of label 1 and 0 hold each at every level: [2 * level + (label 0), feature]."""
    text, hashes = features(_words(texts))
    known, at = np.unique(hashes, return_inverse=True)
    pairs, count = np.unique(at * len(y) + text, return_counts=True)
    at, label = pairs // len(y), y[pairs % len(y)]
    out = []
    for level in range(LEVELS):
        there = count > level
        out += [np.bincount(at[there], weights=side[there], minlength=len(known)) for side in (label, 1 - label)]
    return known, np.array(out)


class Model:
    """Weights of the chosen features; without rows of both classes every score is the share of label 1."""

    def __init__(self, sample: pa.Table, terms: list[str] = IDENTITY_TERMS, penalty: float = PENALTY):
        texts, y = sample["text"].to_pylist(), sample["label"].to_numpy().astype(np.float64)
        self.prior = float(y.mean()) if len(y) else 0.5
        self.known = np.zeros(0, np.uint64)
        self.fitted = len(set(y.tolist())) == 2
        if not self.fitted:
            return
        self._choose(pa.array(texts, pa.string()), y, terms)
        twins, of = self._counterfactuals(texts, terms)
        rows = [self._held(pa.array(t, pa.string())) for t in (texts, *twins)]
        self._descend(rows, y, penalty if len(of) else 0.0)

    def _choose(self, texts: pa.Array, y: np.ndarray, terms: list[str]) -> None:
        """The features with the largest log odds between classes at some level, by how sure they are."""
        known, holders = np.zeros(0, np.uint64), np.zeros((2 * LEVELS, 0))
        for first, some in _parts(texts):
            found, more = _holders(some, y[first : first + len(some)])
            known, at = np.unique(np.concatenate([known, found]), return_inverse=True)
            both = np.concatenate([holders, more], axis=1)
            holders = np.array([np.bincount(at, weights=n, minlength=len(known)) for n in both])
        n1, n0 = y.sum(), len(y) - y.sum()
        sure = np.zeros(len(known))
        for level in range(LEVELS):
            toxic, clean = holders[2 * level], holders[2 * level + 1]
            odds = np.log((toxic + 0.5) / (n1 - toxic + 0.5)) - np.log((clean + 0.5) / (n0 - clean + 0.5))
            error = np.sqrt(1 / (toxic + 0.5) + 1 / (n1 - toxic + 0.5) + 1 / (clean + 0.5) + 1 / (n0 - clean + 0.5))
            sure = np.maximum(sure, np.where(toxic + clean >= 5, np.abs(odds) / error, 0))
        best = np.lexsort((known, -sure))[:FEATURES]
        best = best[sure[best] > 3]
        _, named = features(_words(pa.array(terms, pa.string())))
        # features of identity terms are in, so that the penalty can act on them
        self.known = np.unique(np.concatenate([known[best], named]))

    def _counterfactuals(self, texts: list[str], terms: list[str]) -> tuple[list[list[str]], np.ndarray]:
        draw = np.random.default_rng(11)
        of = draw.choice(len(texts), min(PAIRS, len(texts)), replace=False) if terms and texts else np.zeros(0, int)
        one, other, kept = [], [], []
        for i in of:
            words = texts[i].split(" ")
            there = [k for k, w in enumerate(words) if w.lower() in terms]
            k = there[0] if there else int(draw.integers(len(words)))
            a, b = draw.choice(len(terms), 2, replace=False) if len(terms) > 1 else (0, 0)
            one.append(" ".join([*words[:k], terms[a], *words[k + 1 :]]))
            other.append(" ".join([*words[:k], terms[b], *words[k + 1 :]]))
            kept.append(i)
        return [one, other], np.array(kept)

    def _held(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
        """(text, weight number) of the known features at each level they reach; and how many texts."""
        none = np.zeros(0, dtype=np.int64)
        held, numbers = [[none] for _ in range(LEVELS)], [[none] for _ in range(LEVELS)]
        for first, some in _parts(texts):
            text, hashes = features(_words(some))
            at = np.searchsorted(self.known, hashes)
            at[at == len(self.known)] = 0
            hit = self.known[at] == hashes
            pairs, count = np.unique(text[hit] * len(self.known) + at[hit], return_counts=True)
            text, at = pairs // len(self.known), pairs % len(self.known)
            for level in range(LEVELS):
                reached = count > level
                held[level].append(first + text[reached])
                numbers[level].append(at[reached] * LEVELS + level)
        return np.concatenate(sum(held, [])), np.concatenate(sum(numbers, [])), len(texts)

    def _logits(self, held: tuple) -> np.ndarray:
        text, at, n = held
        return np.bincount(text, weights=self.weights[at], minlength=n) + self.bias

    def _descend(self, rows: list[tuple], y: np.ndarray, penalty: float) -> None:
        m = len(self.known) * LEVELS
        self.weights, self.bias = np.zeros(m), 0.0
        balance = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
        speed, pull = np.zeros(m + 1), np.zeros(m + 1)
        for step in range(1, STEPS + 1):
            main, one, other = rows
            error = (_sigmoid(self._logits(main)) - y) * balance
            slope = np.bincount(main[1], weights=error[main[0]], minlength=m) + RIDGE * self.weights
            level = error.sum()
            if penalty:
                a, b = _sigmoid(self._logits(one)), _sigmoid(self._logits(other))
                change = 2 * penalty * (a - b) / one[2]
                slope += np.bincount(one[1], weights=(change * a * (1 - a))[one[0]], minlength=m)
                slope -= np.bincount(other[1], weights=(change * b * (1 - b))[other[0]], minlength=m)
                level += (change * (a * (1 - a) - b * (1 - b))).sum()
            g = np.append(slope, level)
            speed = 0.9 * speed + 0.1 * g
            pull = 0.99 * pull + 0.01 * g**2
            move = 0.05 * (speed / (1 - 0.9**step)) / (np.sqrt(pull / (1 - 0.99**step)) + 1e-8)
            self.weights, self.bias = self.weights - move[:m], self.bias - move[m]

    def score(self, texts: pa.Array) -> np.ndarray:
        if not self.fitted:
            return np.full(len(texts), self.prior)
        return np.round(_sigmoid(self._logits(self._held(texts))), 6)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def fitted(docs: DataFrame, labels: DataFrame) -> Model:
    sample = in_sample(docs, labels, "toxic", held_out(3, 1), ROWS)
    return Model(sample.toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")]))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fitted(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model, threshold=THRESHOLD).select("doc_id", held_out(3, 1).alias("held_out"), "score", "predicted")


QUERIES = {"op10_toxicity": op10_toxicity}

SQL: dict[str, str] = {}
