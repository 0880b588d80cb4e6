"""What the operators of this subpackage share: tables, scratch space, word hashing."""

from __future__ import annotations

import gc
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklane.runtime import new_path

SPACES = "\t\n\x0b\f\r"  # with the blank: what separates words


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Let the Python workers of a local session import this package from any working folder.

    On a cluster the package is installed or passed with ``--py-files``.
    """
    sc = spark.sparkContext
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster") or getattr(sc, "_tracklane", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="tracklane-code-")) / "tracklane.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(package.rglob("*.py")):
            z.write(path, path.relative_to(package.parent))
    sc.addPyFile(str(archive))
    sc._tracklane = True


def text_of(column: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def row_key(key: str = "doc_id", text: str = "text") -> Column:
    """What tells rows apart that share a key: the key, then a hash of the text. Ordered as the keys are."""
    return F.struct(F.col(key).alias("key"), F.xxhash64(text_of(text)).alias("text"))


def collapsed(text: Column) -> Column:
    """Each run of blanks, tabs and line ends as one blank.

    Byte-wise replacement of the five rarer separators, and the pattern only for
    texts that hold two blanks in a row: a pattern over every text costs more.
    """
    for mark in SPACES:
        text = F.replace(text, F.lit(mark), F.lit(" "))
    return F.when(F.contains(text, F.lit("  ")), F.regexp_replace(text, " +", " ")).otherwise(text)


class Scratch:
    """Tables an operator writes to the shared folder on its way.

    ``store`` cuts lineage; ``drop`` removes a table that nothing lazy reads any more.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root, self.made = spark, new_path(spark, label), 0

    def store(self, df: DataFrame, partition_by: str | None = None) -> DataFrame:
        self.made += 1
        path = f"{self.root}/{self.made}"
        writer = df.write if partition_by is None else df.write.partitionBy(partition_by)
        writer.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def release(self) -> None:
        """Let Spark delete the shuffle files of what has been stored; else they stay until the driver's next collection."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, df: DataFrame) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


# Word hashing over whole Arrow buffers ------------------------------------------------

BLANKS = np.zeros(256, dtype=bool)  # what parts words [^\x20\x09-\x0D]+
BLANKS[[9, 10, 11, 12, 13, 32]] = True
MARKS = np.zeros(256, dtype=bool)  # what parts words of ASCII letters, digits and all beyond ASCII
MARKS[:128] = [not chr(i).isalnum() for i in range(128)]
_GRAM = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# The term of a byte at a place of its word; a word's hash is the sum of its terms. The terms of
# different places are unrelated, so no pattern of bytes cancels as it does in a polynomial modulo 2^64.
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_NEAR = 48  # places whose terms are looked up, the others are computed


def _terms(byte: np.ndarray, place: np.ndarray) -> np.ndarray:
    return mix(_BYTE[byte] + place.astype(np.uint64) * _STEP)


_TABLE = _terms(np.arange(256)[None, :], np.arange(_NEAR)[:, None])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_IN_LENGTH = mix(np.arange(64, dtype=np.uint64))  # parts beginnings of different length

_known_powers: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    known = _known_powers.get(int(base))
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        known[0] = 1
        known = _known_powers[int(base)] = np.cumprod(known, dtype=np.uint64)
    return known[:n]


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes of text, so that memory does not follow the batch."""
    for batch in batches:
        length = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy()
        cell = np.cumsum(length, dtype=np.int64) // size
        cuts = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(length)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


class Words:
    """Words of a column of texts, as 64-bit hashes; null counts as empty.

    ``hashes`` holds the words of all texts one after another, ``first[i]`` to
    ``first[i + 1]`` those of text ``i``; ``begin`` and ``end`` are byte positions in
    ``data``. The bytes never become Python strings. ``prefixes[k]`` are hashes of the
    first ``k`` bytes, 0 where a word is shorter.
    """

    def __init__(self, texts: pa.Array, lower: bool, apart: np.ndarray = BLANKS, prefixes: tuple[int, ...] = ()):
        texts = texts.fill_null("").cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        low, high = int(offsets[0]), int(offsets[-1])
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8)[low:high] if raw is not None else np.zeros(0, np.uint8)
        offsets = offsets - low
        solid = ~apart[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        before = np.zeros(len(data), dtype=bool)
        before[1:] = solid[:-1]
        begin = np.flatnonzero(solid & (~before | edge[:-1]))
        after = np.zeros(len(data), dtype=bool)
        after[:-1] = solid[1:]
        end = np.flatnonzero(solid & (~after | edge[1:])) + 1
        hashes = np.zeros(len(begin), dtype=np.uint64)
        heads = {k: np.zeros(len(begin), dtype=np.uint64) for k in prefixes}
        piece = 1 << 20  # words are hashed about a MB at a time
        at = 0
        while at < len(begin):
            base = begin[at]
            upto = max(at + 1, int(np.searchsorted(end, base + piece)))
            span = data[base : end[upto - 1]]
            b, e = begin[at:upto] - base, end[at:upto] - base
            # separators after a word count on as its places; nothing reads their terms
            place = np.arange(len(span), dtype=np.int32) - np.repeat(b, np.diff(b, append=len(span))).astype(np.int32)
            if lower:
                span = _LOWER[span]
            terms = _TABLE.ravel()[(np.minimum(place, _NEAR - 1) << 8) | span]
            far = np.flatnonzero(place >= _NEAR)
            terms[far] = _terms(span[far], place[far])
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
            hashes[at:upto] = sums[e] - sums[b]
            for k, head in heads.items():
                long = e - b >= k
                head[at:upto] = np.where(long, sums[np.minimum(b + k, e)] - sums[b], 0)
            at = upto
        self.data, self.begin, self.end = data, begin, end
        self.hashes = mix(hashes + (end - begin).astype(np.uint64))
        self.prefixes = {k: np.where(head == 0, np.uint64(0), mix(head + _IN_LENGTH[k])) for k, head in heads.items()}
        self.first = np.searchsorted(begin, offsets)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_index(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def text_hashes(texts: pa.Array) -> np.ndarray:
    """A 64-bit hash of each whole text."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw, size = texts.buffers()[2], np.diff(offsets)
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    place = np.arange(len(data)) - np.repeat(offsets[:-1], size)
    terms = _TABLE.ravel()[(np.minimum(place, _NEAR - 1) << 8) | data]
    far = np.flatnonzero(place >= _NEAR)
    terms[far] = _terms(data[far], place[far])
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
    return mix(sums[offsets[1:]] - sums[offsets[:-1]] + size.astype(np.uint64))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each position; runs past the end of a text too."""
    if len(hashes) < n:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(len(hashes) - n + 1, dtype=np.uint64)
    for i in range(n):
        out = out * _GRAM + hashes[i : len(hashes) - n + 1 + i]
    return mix(out)


_GRAM_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 2**64))


def spans(hashes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the words from ``begin`` to ``end``, for many spans at once."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * _powers(_GRAM, len(hashes)), dtype=np.uint64)])
    return mix((sums[end] - sums[begin]) * _powers(_GRAM_INVERSE, len(hashes) + 1)[begin] + (end - begin).astype(np.uint64))
