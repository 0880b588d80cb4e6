"""Quality classifier: random-indexing word vectors, pooled, under a two-layer network.

Every token has a fixed sparse random vector; the vector of a token is what its
neighbours' random vectors add up to over the training sample. Tokens are the most
frequent words of the sample and, for every word, its shape: which kinds of characters it has and
whether it repeats the word before, so that words never seen in training count as well. A document is the mean of its word
vectors and the mean of its shape vectors. The network gives a probability, its
temperature is set on rows it was not trained on.

The fit takes at most ``ROWS`` labelled documents, drawn by hash, whole, to the driver; the
model is a few MB, broadcast. Scoring is one pass
over the texts without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklane.llm.common import Words, mix, pieces, ship, table, text_of

ROWS = 4000
VOCABULARY = 8192
DIM = 48  # of a vector
NONZERO = 6  # of a random vector
HIDDEN = 24
EPOCHS = 60
THRESHOLD = 0.7
PIECE = 1 << 17  # words whose vectors are gathered at once

# kinds of characters of a word, one bit each
_KIND = np.zeros(256, dtype=np.uint16)
_KIND[97:123] = 1
_KIND[65:91] = 2
_KIND[48:58] = 4
_KIND[128:] = 8
for _bit, _marks in enumerate((b".,;:", b"!?", b"'\"()[]{}-", b"|<>=/\\_+", b"#$%&*@^~`")):
    _KIND[list(_marks)] = 16 << _bit
SHAPES = 1 << 10  # nine bits of kinds, one for a repeated word


def in_sample(docs: DataFrame, labels: DataFrame, target: str, held_out: Column, rows: int) -> DataFrame:
    """(doc_id, text, label): at most ``rows`` labelled documents outside ``held_out``, drawn by hash of the key.

    Drawn among the labels whose document is there, by key and hash of the text, so that whole texts
    are neither shuffled nor compared. Rows that repeat id and text count once. A key with several
    labels takes the majority, a tie counts as 0.
    """
    one = labels.filter(F.col(target).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        (F.avg(target) > 0.5).cast("int").alias("label")
    )
    texts = docs.select("doc_id", text_of().alias("text")).withColumn("_text", F.xxhash64("text"))
    there = texts.select("doc_id", "_text").join(one.filter(~held_out), "doc_id").distinct()
    drawn = there.orderBy(F.xxhash64("doc_id"), "doc_id", "_text").limit(rows)
    found = texts.join(F.broadcast(drawn), ["doc_id", "_text"])  # ``rows`` short rows
    return found.dropDuplicates(["doc_id", "_text"]).select("doc_id", "text", "label")


def random_vectors(tokens: np.ndarray, dim: int = DIM) -> np.ndarray:
    """The sparse +1/-1 vector of each 64-bit token, the same everywhere."""
    out = np.zeros((len(tokens), dim), dtype=np.float32)
    rows = np.arange(len(tokens))
    for k in range(NONZERO):
        draw = mix(tokens + np.uint64(0xA24BAED4963EE407 * (k + 1) % 2**64))
        out[rows, (draw >> np.uint64(8)) % np.uint64(dim)] += np.where(draw & np.uint64(1), 1.0, -1.0)
    return out


def shapes_of(words: Words) -> np.ndarray:
    if not len(words.begin):
        return np.zeros(0, dtype=np.int64)
    # between two words stand only separators, whose kind is 0
    kinds = np.bitwise_or.reduceat(_KIND[words.data], words.begin).astype(np.int64)
    repeated = np.zeros(len(kinds), dtype=bool)
    repeated[1:] = words.hashes[1:] == words.hashes[:-1]
    repeated[words.first[:-1][words.counts() > 0]] = False
    return kinds | (repeated.astype(np.int64) << 9)


def _context(ids: np.ndarray, random: np.ndarray, words: Words, size: int) -> np.ndarray:
    """Sum of the random vectors of the two words on either side, for each token, scaled to length 1."""
    out = np.zeros((size, random.shape[1]), dtype=np.float64)
    text = words.text_index()
    for step in (1, 2):
        for a in range(0, len(ids) - step, PIECE):
            b = min(a + PIECE, len(ids) - step)
            same = text[a + step : b + step] == text[a:b]
            left, right = ids[a:b][same], ids[a + step : b + step][same]
            for token, other in ((left, right), (right, left)):
                if len(token):
                    order = np.argsort(token, kind="stable")
                    starts = np.flatnonzero(np.diff(token[order], prepend=-1))
                    out[token[order][starts]] += np.add.reduceat(random[other[order]], starts, axis=0)
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(length == 0, 1, length)).astype(np.float32)


class Vectors:
    """Word and shape vectors learned from a sample of texts."""

    def __init__(self, texts: pa.Array):
        words = Words(texts, lower=True)
        known, count = np.unique(words.hashes, return_counts=True)
        often = np.lexsort((known, -count))[:VOCABULARY]
        self.known = np.sort(known[often[count[often] >= 3]])
        shapes = shapes_of(words)
        ids = self.ids(words, shapes)
        n = len(self.known)
        tokens = np.concatenate([self.known, mix(np.arange(SHAPES, dtype=np.uint64) + np.uint64(1))])
        random = random_vectors(tokens)
        self.word = _context(ids, random, words, n + SHAPES)
        self.shape = _context(shapes, random[n:], words, SHAPES)
        self.shape += 0.5 * random[n:] / np.sqrt(NONZERO)  # its own vector parts rare shapes of like company

    def ids(self, words: Words, shapes: np.ndarray) -> np.ndarray:
        """The token of each word: the word if known, else its shape."""
        if not len(self.known):
            return shapes
        at = np.searchsorted(self.known, words.hashes)
        at[at == len(self.known)] = 0
        return np.where(self.known[at] == words.hashes, at, len(self.known) + shapes)

    def pooled(self, words: Words) -> np.ndarray:
        """One row per text; a text without words is all zeros but for the last column."""
        n = words.counts()
        shapes = shapes_of(words)
        ids = self.ids(words, shapes)
        out = np.zeros((len(n), 2 * DIM + 2), dtype=np.float32)
        full = np.flatnonzero(n)
        for a in range(0, len(full), 64):  # a few texts at a time bounds the memory of the gathered vectors
            some = full[a : a + 64]
            low, high = words.first[some[0]], words.first[some[-1] + 1]
            starts = words.first[some] - low
            out[some, :DIM] = np.add.reduceat(self.word[ids[low:high]], starts, axis=0)
            out[some, DIM : 2 * DIM] = np.add.reduceat(self.shape[shapes[low:high]], starts, axis=0)
        out /= np.maximum(n, 1)[:, None]
        out[:, 2 * DIM] = np.log1p(n) / 10
        out[:, 2 * DIM + 1] = n == 0
        return out


class Network:
    """Two layers with a temperature, fitted by Adam on the whole sample at once."""

    def __init__(self, x: np.ndarray, y: np.ndarray, calibrate: np.ndarray):
        draw = np.random.default_rng(7)
        self.mean, self.scale = x[~calibrate].mean(0), x[~calibrate].std(0) + 1e-3
        z, t = (x - self.mean) / self.scale, y.astype(np.float64)
        parts = [draw.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), draw.normal(0, 0.3, HIDDEN), np.zeros(1)]
        speed, pull = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
        train = np.flatnonzero(~calibrate)
        step = 0
        for _ in range(EPOCHS):
            for rows in np.array_split(draw.permutation(train), max(1, len(train) // 128)):
                step += 1
                hidden = np.maximum(0, z[rows] @ parts[0] + parts[1])
                error = (_sigmoid(hidden @ parts[2] + parts[3]) - t[rows]) / max(1, len(rows))
                back = np.outer(error, parts[2]) * (hidden > 0)
                slopes = [z[rows].T @ back, back.sum(0), hidden.T @ error, error.sum(keepdims=True)]
                for k, slope in enumerate(slopes):
                    slope = slope + 1e-4 * parts[k]
                    speed[k] = 0.9 * speed[k] + 0.1 * slope
                    pull[k] = 0.999 * pull[k] + 0.001 * slope**2
                    parts[k] = parts[k] - 3e-3 * (speed[k] / (1 - 0.9**step)) / (np.sqrt(pull[k] / (1 - 0.999**step)) + 1e-8)
        self.parts, self.temperature = parts, 1.0
        if calibrate.any():
            raw, truth = self.logits(x[calibrate]), t[calibrate]
            grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
            loss = [np.logaddexp(0, -(2 * truth - 1) * raw / g).mean() for g in grid]
            self.temperature = float(grid[int(np.argmin(loss))])

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return np.maximum(0, z @ self.parts[0] + self.parts[1]) @ self.parts[2] + self.parts[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(x) / self.temperature)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class Model:
    """Vectors and network; without labelled rows of both classes every score is the share of label 1."""

    def __init__(self, sample: pa.Table):
        texts, labels = sample["text"].combine_chunks(), sample["label"].to_numpy()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
        self.prior = float(labels.mean()) if len(labels) else 0.5
        self.network = None
        if len(set(labels.tolist())) == 2:
            self.vectors = Vectors(texts)
            keys = sample["doc_id"].to_numpy().astype(np.uint64)
            self.network = Network(self.vectors.pooled(Words(texts, lower=True)), labels, mix(keys) % np.uint64(5) == 0)

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.network is None:
            return np.full(len(texts), self.prior)
        return np.round(self.network.score(self.vectors.pooled(Words(texts, lower=True)).astype(np.float64)), 6)


def scored(docs: DataFrame, model, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: its key, ``score`` and ``predicted``. A null text is empty."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in pieces(batches):
            score = sent.value.score(batch["text"])
            predicted = pa.array((score >= threshold).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch["key"], pa.array(score), predicted], ["key", "score", "predicted"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["key"]
    return rows.mapInArrow(run, f"key {kind}, score double, predicted int").withColumnRenamed("key", key)


def held_out(divisor: int, remainder: int) -> Column:
    """Rows that no fit may see; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % divisor == remainder, F.lit(True))


def fitted(docs: DataFrame, labels: DataFrame) -> Model:
    sample = in_sample(docs, labels, "quality", held_out(4, 2), ROWS)
    return Model(sample.toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")]))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fitted(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model).select("doc_id", held_out(4, 2).alias("held_out"), "score", "predicted")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier accepts, with their own columns."""
    model = fitted(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    ship(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in pieces(batches):
            yield batch.filter(pa.array(sent.value.score(batch["text"]) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


QUERIES = {"op5_quality": op5_quality}

SQL: dict[str, str] = {}
