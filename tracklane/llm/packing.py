"""Packing: lexical retrieval fills the training window of each seed document.

A document's ids are cut into whole windows and a rest shorter than a window; whole
windows are sequences already. The rests are placed by content over the whole corpus: each
document's BM25 vector, taken to ``DIMS`` principal directions, runs down a tree whose leaves
lie in order, and ranges of that order are cut into shards of about ``SHARD`` documents. Copies
get the same place, and a group that is larger than a shard is cut by document number.
Each shard has its own BM25 inverted index over all ids of its documents, with the frequencies
of the corpus. The rest of a seed opens a window, the index returns its unused neighbours in order
of score over all of the seed's ids, and they fill the window one after another; what no longer fits
of the last one opens the next window. What a shard has left at its end is cut into powers of two,
which need no padding. A neighbour in another shard is not found.

One pass over the texts, whose ids (two bytes each) are stored; the passes after it read those.
"""

from __future__ import annotations

import os
import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklane.llm.common import pieces as cut_batches
from tracklane.llm.common import Scratch, ship, table, text_hashes, text_of

WINDOW = 2048
END = 1  # closes each document
SHARD = 2048  # documents of a shard
SHARD_BYTES = 1 << 24  # and bytes of their ids
IDS = 1 << 16  # the vocabulary has to fit two bytes
DIMS = 32  # principal directions by which documents are placed
FITTED = 4000  # documents the directions are taken from
PLACED = 32  # documents a shard by which the tree is cut
K1, B = 1.2, 0.75
OFTEN = 8  # an id that one document of so many holds has a row of weights
BEST = 64  # neighbours that are put in order at first
CACHED = 1 << 22  # pieces of text whose ids a worker remembers, some 26 bytes each
CACHED_IDS = 1 << 25  # and their ids
ALONE = np.uint64(0x5851F42D4C957F2D)  # parts a piece that follows no blank from one that does
LEARNED = 1 << 8  # pieces that are encoded at once: an encoding takes some hundred bytes an id
LOT = 1 << 18  # bytes of ids and terms that are counted at once
LETTERS = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+"
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # after letters, they are encoded apart from them
VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of whole texts by a byte-level BPE file; each distinct piece is encoded once while remembered, by a 64-bit hash.

    The tokenizer never joins across a single blank or line end between two other characters:
    a text is cut before each and the ids of the pieces follow one another.
    """

    _by_path: dict[str, Encoder] = {}
    _space = r"[\x09-\x0D\x1C-\x20\x{85}\p{Z}]"  # whatever a pattern takes for white space
    _gap = f"{_space}{_space}|^{_space}|{_space}$"  # a text without gaps is cut before every blank
    _cut = re.compile(r"(?<=\S) (?=\S)")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # the file's pattern leaves letters after a blank whole, as this one does, which costs less
        self.letters = Tokenizer(self.tokenizer.model)
        parts = pre_tokenizers.Split(" ", "merged_with_next"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters.pre_tokenizer = pre_tokenizers.Sequence(list(parts))
        self._empty()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.blank = np.zeros(max(vocabulary.values()) + 1, dtype=bool)  # ids that begin with a blank
        self.blank[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True

    @classmethod
    def at(cls, path: str) -> Encoder:
        if path not in cls._by_path:
            cls._by_path[path] = cls(path)
        return cls._by_path[path]

    @classmethod
    def forget(cls) -> None:
        """Give back what a reused worker remembers, once the texts have been read."""
        cls._by_path.clear()
        pa.default_memory_pool().release_unused()

    def _empty(self) -> None:
        self.hash, self.pool = np.zeros(0, np.uint64), np.zeros(0, "<u2")  # ascending hashes of pieces; the ids of all pieces
        self.begin, self.size = np.zeros(0, np.int32), np.zeros(0, np.int32)  # where those of a piece are

    def _ids(self, pieces: pa.Array, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces one after another, and how many each has; ``blank`` tells which follow one."""
        ids, sizes = [np.zeros(0, "<u2")], [np.zeros(0, np.int64)]
        blank = blank & ~pc.starts_with(pieces, "\n").to_numpy(zero_copy_only=False)
        letters = blank & pc.match_substring_regex(pieces, f"{LETTERS}$").to_numpy(zero_copy_only=False)
        words, rest = np.flatnonzero(letters), np.flatnonzero(~letters)
        lots = np.append(np.arange(0, len(words), LEARNED), len(words)).astype(np.int32)
        lots = pc.binary_join(pa.ListArray.from_arrays(lots, pieces.take(pa.array(words))), " ").to_pylist()
        texts = [" " * b + t for b, t in zip(blank[rest].tolist(), pieces.take(pa.array(rest)).to_pylist())]
        joined = [k for k, t in enumerate(texts) if t.rfind(" ") == 0]
        other = [k for k, t in enumerate(texts) if t.rfind(" ") != 0]
        lots = [(self.letters, " " + t) for t in lots]
        lots += [(self.tokenizer, "".join([texts[i] for i in joined[k : k + LEARNED]])) for k in range(0, len(joined), LEARNED)]
        # a piece whose only blank is its first character shows where it begins: such pieces are one text
        for tokenizer, text in lots:
            ids.append(np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u2"))
            sizes.append(np.diff(np.flatnonzero(self.blank[ids[-1]]), append=len(ids[-1])))
        for k in range(0, len(other), LEARNED):
            some = [texts[i] for i in other[k : k + LEARNED]]
            encoded = [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            ids += [np.array(e, dtype="<u2") for e in encoded]
            sizes.append(np.array([len(e) for e in encoded], np.int64))
        flat, size = np.concatenate(ids), np.concatenate(sizes)
        place = np.empty(len(pieces), np.int64)
        place[np.concatenate([words, rest[np.array(joined + other, np.int64)]])] = np.arange(len(pieces))
        begin = (np.cumsum(size) - size)[place]
        return gathered(flat, begin, size[place]), size[place]

    def _learn(self, hashes: np.ndarray, pieces: pa.Array, blank: np.ndarray) -> None:
        """Remember pieces by their ascending hashes."""
        ids, size = self._ids(pieces, blank)
        at = np.searchsorted(self.hash, hashes)
        begin = len(self.pool) + np.cumsum(size) - size
        self.hash, self.pool = np.insert(self.hash, at, hashes), np.concatenate([self.pool, ids])
        self.begin, self.size = np.insert(self.begin, at, begin), np.insert(self.size, at, size)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text, without the closing one."""
        gaps = pc.match_substring_regex(texts, self._gap)
        uneven = [self._cut.split(t) for t in texts.filter(gaps).to_pylist()]
        even = pc.replace_substring(texts.filter(pc.invert(gaps)), "\n", " \n")
        cut = pa.concat_arrays([pc.split_pattern(even, " "), pa.array(uneven, pa.list_(pa.string()))])
        gaps = gaps.to_numpy(zero_copy_only=False)
        place = np.argsort(np.concatenate([np.flatnonzero(~gaps), np.flatnonzero(gaps)]))
        first = np.concatenate([[0], np.cumsum(cut.value_lengths().to_numpy(), dtype=np.int64)])
        flat = cut.flatten()
        pieces, opening = flat.dictionary_encode(), flat.take(pa.array(first[:-1])).dictionary_encode()
        code = pieces.indices.to_numpy().astype(np.int64)
        code[first[:-1]] = opening.indices.to_numpy() + np.int64(len(pieces.dictionary))
        distinct = pa.concat_arrays([pieces.dictionary, opening.dictionary])
        ids, begin, size = self._encoded(distinct, len(pieces.dictionary))
        size = size[code]
        end = np.concatenate([[0], np.cumsum(size)])
        out = gathered(ids, begin[code], size)
        return [out[end[first[i]] : end[first[i + 1]]] for i in place]

    def _encoded(self, distinct: pa.Array, opening: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the pieces one after another, where those of each begin, and how many. From ``opening`` on they begin a text.

        Marks after letters are a part of their own in the tokenizer's pattern: letters are known whatever follows.
        """
        stem = pc.utf8_rtrim(distinct, characters=MARKS)
        apart = pc.match_substring_regex(stem, f"{LETTERS}$")
        stem = pc.if_else(apart, stem, distinct)
        tail = pc.if_else(apart, pc.replace_substring_regex(distinct, LETTERS, ""), "")
        after = stem.slice(0, opening).dictionary_encode()
        alone = pa.concat_arrays([stem.slice(opening), tail]).dictionary_encode()
        first = len(after.dictionary)
        begin, size = self._found(pa.concat_arrays([after.dictionary, alone.dictionary]), first)
        code = np.concatenate([after.indices.to_numpy(), alone.indices.to_numpy() + np.int64(first)]).reshape(2, -1).T
        ids, size = gathered(self.pool, begin[code].ravel(), size[code].ravel()), size[code].sum(axis=1)
        return ids, np.cumsum(size) - size, size

    def _found(self, distinct: pa.Array, opening: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the pool holds each piece; those before ``opening`` follow a blank. New pieces are encoded."""
        hashes = text_hashes(distinct)
        hashes[opening:] ^= ALONE
        order = np.argsort(hashes)
        hashes = hashes[order]
        at = np.searchsorted(self.hash, hashes)
        new = np.ones(len(hashes), dtype=bool)
        inside = np.flatnonzero(at < len(self.hash))
        new[inside] = self.hash[at[inside]] != hashes[inside]
        if new.sum() + len(self.hash) > CACHED or len(self.pool) > CACHED_IDS:
            self._empty()
            new[:] = True
        if new.any():
            unseen = order[new]
            self._learn(hashes[new], distinct.take(pa.array(unseen)), unseen < opening)
            at = np.searchsorted(self.hash, hashes)
        begin, size = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        begin[order], size[order] = self.begin[at], self.size[at]
        return begin, size


def gathered(values: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The spans of ``values`` one after another."""
    before = np.cumsum(size) - size
    return values[np.repeat(begin - before, size) + np.arange(size.sum())]


def terms_of(rests: list[np.ndarray], terms: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, id, count) of whole documents, in this order: from the rest, or from ``packed_terms`` where given."""
    long = [k for k, t in enumerate(terms) if t]
    size = np.array([0 if t else len(r) for r, t in zip(rests, terms)], dtype=np.int64)
    ids = np.concatenate([*(r for r, t in zip(rests, terms) if not t), np.zeros(0, np.int64)]).astype(np.int64)
    pairs, count = np.unique(np.repeat(np.arange(len(rests)), size) * IDS + ids, return_counts=True)
    if long:
        found = [(np.frombuffer(t, "<u2", len(t) // 6), np.frombuffer(t, "<u4", len(t) // 6, len(t) // 6 * 2)) for t in map(terms.__getitem__, long)]
        pairs = np.concatenate([pairs, *(k * IDS + i.astype(np.int64) for k, (i, _) in zip(long, found))])
        count = np.concatenate([count, *(c.astype(np.int64) for _, c in found)])
        order = np.argsort(pairs, kind="stable")
        pairs, count = pairs[order], count[order]
    return pairs // IDS, pairs % IDS, count


def packed_terms(ids: np.ndarray) -> bytes:
    found, count = np.unique(ids, return_counts=True)
    return found.astype("<u2").tobytes() + count.astype("<u4").tobytes()


class Corpus:
    """What BM25 needs of the whole corpus: documents that hold each id, and the mean length."""

    def __init__(self, documents: int, ids: int, held: np.ndarray):
        self.idf = np.log1p((documents - held + 0.5) / (held + 0.5))
        self.mean = max(ids / max(documents, 1), 1)

    def weights(self, n: int, document: np.ndarray, ids: np.ndarray, count: np.ndarray) -> np.ndarray:
        size = np.bincount(document, weights=count, minlength=n)
        norm = K1 * (1 - B + B * size / self.mean)
        return self.idf[ids] * count * (K1 + 1) / (count + norm[document])


class Index:
    """BM25 over all ids of a shard's documents: postings in order of id, with their weights."""

    def __init__(self, rests: list[np.ndarray], terms: list[bytes | None] | None = None, corpus: Corpus | None = None):
        self.n = len(rests)
        document, ids, count = terms_of(rests, terms or [None] * self.n)
        corpus = corpus or Corpus(self.n, int(count.sum()), np.bincount(ids, minlength=IDS))
        weight = corpus.weights(self.n, document, ids, count)
        self.ids, self.own = ids, np.searchsorted(document, np.arange(self.n + 1))
        order = np.argsort(ids, kind="stable")
        self._post(np.arange(self.n), ids[order], document[order], weight[order])

    def _post(self, left: np.ndarray, ids: np.ndarray, document: np.ndarray, weight: np.ndarray) -> None:
        """Weights of the documents left, in order of id; an id in more than one of ``OFTEN`` has a row with a place for each."""
        self.left, self.id, self.document, self.weight = left, ids, document, weight
        often = np.flatnonzero(OFTEN * np.bincount(ids, minlength=IDS) > len(left))
        self.row = np.full(IDS, -1)
        self.row[often] = np.arange(len(often))
        place = np.empty(self.n, np.int64)
        place[left] = np.arange(len(left))
        row, place = self.row[ids], place[document]
        wide = row >= 0
        self.rows = np.zeros((len(often), len(left)))
        self.rows[row[wide], place[wide]] = weight[wide]
        self.place, self.rare = place[~wide], weight[~wide]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(ids[~wide], minlength=IDS))])

    def ids_of(self, k: int) -> np.ndarray:
        """The distinct ids of a whole document."""
        return self.ids[self.own[k] : self.own[k + 1]]

    def keep(self, unused: np.ndarray) -> None:
        """Forget documents that are used."""
        kept = unused[self.document]
        self._post(self.left[unused[self.left]], self.id[kept], self.document[kept], self.weight[kept])

    def scores(self, ids: np.ndarray, unused: np.ndarray) -> np.ndarray:
        """Score of each document left by a seed's distinct ids; 0 for used ones."""
        row = self.row[ids]
        score, rare = self.rows[row[row >= 0]].sum(axis=0), ids[row < 0]
        size = self.first[rare + 1] - self.first[rare]
        at = np.repeat(self.first[rare] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        score += np.bincount(self.place[at], weights=self.rare[at], minlength=len(self.left))
        score[~unused[self.left]] = 0
        return score

    def neighbours(self, ids: np.ndarray, unused: np.ndarray) -> np.ndarray:
        """Unused documents that share ids with a seed's distinct ones, best first, ties by number."""
        return np.concatenate([*self.ranked(ids, unused), np.zeros(0, np.int64)])

    def ranked(self, ids: np.ndarray, unused: np.ndarray):
        """``neighbours`` in two parts: a window rarely takes more than the first."""
        score = self.scores(ids, unused)
        bound = -np.partition(-score, BEST)[BEST] if len(score) > BEST else 0.0
        for part in (score >= bound, score < bound):
            found = np.flatnonzero(part & (score > 0))
            yield self.left[found[np.argsort(-score[found], kind="stable")]]


class Places:
    """The order in which documents are dealt to shards: leaves of a tree over principal directions."""

    def __init__(self, corpus: Corpus, rests: list[np.ndarray], terms: list[bytes | None]):
        """The directions, by subspace iteration over the given documents."""
        self.corpus, self.tree = corpus, None
        n = len(rests)
        document, ids, weight = self._unit(rests, terms)
        first = np.searchsorted(document, np.arange(n + 1))
        self.basis = np.random.default_rng(7).standard_normal((IDS, DIMS)).astype(np.float32)
        for _ in range(3):
            vectors, _r = np.linalg.qr(self._sums(first, ids, weight))
            basis = np.zeros((IDS, vectors.shape[1]), dtype=np.float32)
            for k in range(n):
                own = slice(first[k], first[k + 1])
                basis[ids[own]] += np.outer(weight[own], vectors[k])
            self.basis, _r = np.linalg.qr(basis)

    def _unit(self, rests, terms) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        document, ids, count = terms_of(rests, terms)
        weight = self.corpus.weights(len(rests), document, ids, count)
        norm = np.sqrt(np.bincount(document, weights=weight**2, minlength=len(rests)))
        return document, ids, (weight / np.maximum(norm[document], 1e-12)).astype(np.float32)

    def _sums(self, first: np.ndarray, ids: np.ndarray, weight: np.ndarray) -> np.ndarray:
        out = np.zeros((len(first) - 1, self.basis.shape[1]), dtype=np.float32)
        for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
            out[k] = weight[a:b] @ self.basis[ids[a:b]]
        return out

    def vectors(self, rests: list[np.ndarray], terms: list[bytes | None]) -> np.ndarray:
        document, ids, weight = self._unit(rests, terms)
        return self._sums(np.searchsorted(document, np.arange(len(rests) + 1)), ids, weight)

    def cut(self, vectors: np.ndarray, shards: int) -> None:
        """Halve the shards, and the vectors along their main direction with them, down to one shard."""
        self.leaves = 0
        self.tree = self._node(vectors.astype(np.float64), shards)

    def _node(self, x: np.ndarray, shards: int):
        spread = x - x.mean(axis=0) if len(x) else x
        direction = np.linalg.eigh(spread.T @ spread)[1][:, -1]
        at = x @ direction
        if shards > 1 and len(x) > 1:
            bound = np.sort(at)[len(at) * (shards // 2) // shards]
            low = at < bound
            if low.any():
                return direction, bound, self._node(x[low], shards // 2), self._node(x[~low], shards - shards // 2)
        self.leaves += 1
        return direction, None, self.leaves, None

    def of(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaf of each vector, and its place along the leaf's main direction."""
        leaf, along = np.zeros(len(vectors), dtype=np.int64), np.zeros(len(vectors))
        todo = [(self.tree, np.arange(len(vectors)))]
        while todo:
            (direction, bound, left, right), rows = todo.pop()
            at = vectors[rows] @ direction
            if bound is None:
                leaf[rows], along[rows] = left, at
            else:
                todo += [(left, rows[at < bound]), (right, rows[at >= bound])]
        return leaf, along


def windows(
    rests: list[np.ndarray], terms: list[bytes | None] | None = None, corpus: Corpus | None = None
) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, begin, end) pieces that hold every rest once; all but the last are full."""
    index, unused = Index(rests, terms, corpus), np.array([len(r) > 0 for r in rests], dtype=bool)
    indexed = len(rests)
    out, carried, scan = [], None, 0
    while True:
        if carried is None:
            while scan < len(rests) and not unused[scan]:
                scan += 1
            if scan == len(rests):
                break
            carried, unused[scan] = (scan, 0), False
        seed, begin = carried
        pieces, room = [(seed, begin, len(rests[seed]))], WINDOW - (len(rests[seed]) - begin)
        carried = None
        if 4 * np.count_nonzero(unused) < 3 * indexed:
            index.keep(unused)
            indexed = np.count_nonzero(unused)
        queue = chain.from_iterable(p.tolist() for p in index.ranked(index.ids_of(seed), unused)) if room > 0 else iter(())
        while room > 0:
            k = next(queue, None)
            if k is None:  # nothing shares an id: the next unused document
                while scan < len(rests) and not unused[scan]:
                    scan += 1
                if scan == len(rests):
                    break
                k = scan
            if not unused[k]:
                continue
            unused[k] = False
            size = len(rests[k])
            taken = min(size, room)
            pieces.append((int(k), 0, taken))
            room -= taken
            if taken < size:
                carried = (int(k), taken)
        out.append(pieces)
    return out


def powers_of_two(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The pieces of an unfilled sequence, cut into sequences whose lengths are powers of two."""
    out, left = [], sum(e - b for _, b, e in pieces)
    current, room = [], 0
    for k, b, e in pieces:
        while b < e:
            if not room:
                room = 1 << (left.bit_length() - 1)
                current = []
                out.append(current)
            taken = min(room, e - b)
            current.append((k, b, b + taken))
            b, room, left = b + taken, room - taken, left - taken
    return out


PIECES = "key {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _lots(batches):
    """The same rows in batches of about ``LOT`` bytes of rests and terms: counting them takes some 40 times as much."""
    Encoder.forget()
    for batch in batches:
        rest, terms = (pc.fill_null(pc.binary_length(batch[c]), 0).to_numpy() for c in ("rest", "terms"))
        lot = np.cumsum(rest.astype(np.int64) + terms) // LOT
        cuts = [0, *(np.flatnonzero(np.diff(lot)) + 1).tolist(), len(lot)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def _rests(batch) -> tuple[list[np.ndarray], list[bytes | None]]:
    return [np.frombuffer(r, dtype="<u2") for r in batch["rest"].to_pylist()], batch["terms"].to_pylist()


def _shards(batches, with_ids: bool):
    """Rows in their order, as tables of about one shard; the last is between a half and one and a half if more came."""
    Encoder.forget()
    held, load = None, np.zeros(0)
    for batch in batches:
        rest, terms = (pc.fill_null(pc.binary_length(batch[c]), 0).to_numpy().astype(np.int64) for c in ("rest", "terms"))
        size = rest + terms + with_ids * (2 * batch["size"].to_numpy() - rest) // 4
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        load = np.concatenate([load, np.maximum(1 / SHARD, size / SHARD_BYTES)])
        while load.sum() > 1.5 and len(load) > 1:
            cut = max(1, int(np.searchsorted(np.cumsum(load), 1 + 1e-9)))
            yield held.slice(0, cut).combine_chunks()
            held, load = held.slice(cut), load[cut:]
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def tokenized(docs: DataFrame, key: str, text: str, path: str | None, with_ids: bool) -> DataFrame:
    """One row per document: its number, key, size, and its ids as whole windows and rest."""
    rows = docs.select(F.col(key).alias("key"), text_of(text).alias("text"))

    def cut(batches):
        encoder = Encoder.at(path or vocabulary_path())
        task = TaskContext.get()
        number = (task.partitionId() if task else 0) << 33
        for batch in cut_batches(batches):
            out = []
            for ids in encoder.encode(batch["text"]):
                ids = np.append(ids, np.uint16(END))
                whole = len(ids) // WINDOW * WINDOW
                # whole windows are sequences already: their checksums (and ids, if asked for) are all that travels
                crcs = [zlib.crc32(ids[a : a + WINDOW].astype("<u4").tobytes()) for a in range(0, whole, WINDOW)]
                kept = ids[:whole].tobytes() if with_ids else None
                out.append((number, len(ids), crcs, kept, ids[whole:].tobytes(), packed_terms(ids) if whole else None))
                number += 1
            numbers, size, crcs, kept, rest, terms = zip(*out) if out else [()] * 6
            columns = [
                pa.array(numbers, pa.int64()), batch["key"], pa.array(size, pa.int64()), pa.array(crcs, pa.list_(pa.int64())),
                pa.array(kept, pa.binary()), pa.array(rest, pa.binary()), pa.array(terms, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["number", "key", "size", "crcs", "whole", "rest", "terms"])

    kind = dict(rows.dtypes)["key"]
    return rows.mapInArrow(
        cut, f"number long, key {kind}, size long, crcs array<long>, whole binary, rest binary, terms binary"
    )


def frequencies(stored: DataFrame, with_ids: bool) -> tuple[Corpus, int, int]:
    """The corpus, its documents and the shards they make; at most one row per id reaches the driver."""

    def count(batches):
        held, documents, ids, size = np.zeros(IDS, dtype=np.int64), 0, 0, 0
        for batch in _lots(batches):
            rests, terms = _rests(batch)
            held += np.bincount(terms_of(rests, terms)[1], minlength=IDS)
            rest = sum(r.nbytes for r in rests)
            documents, ids = documents + len(rests), ids + pc.sum(batch["size"]).as_py()
            size += rest + sum(len(t or b"") for t in terms) + with_ids * (2 * pc.sum(batch["size"]).as_py() - rest) // 4
        found = np.flatnonzero(held)
        keys, values = np.append(found, [-1, -2, -3]), np.append(held[found], [documents, ids, size])
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(values, pa.int64())], ["id", "n"])

    rows = stored.select("size", "rest", "terms").mapInArrow(count, "id long, n long")
    found = {r.id: r.n for r in rows.groupBy("id").agg(F.sum("n").alias("n")).collect()}
    documents, ids, size = (found.pop(k, 0) for k in (-1, -2, -3))
    held = np.zeros(IDS, dtype=np.int64)
    held[list(found)] = list(found.values())
    return Corpus(documents, ids, held), documents, max(1, -(-documents // SHARD), -(-size // SHARD_BYTES))


def places(stored: DataFrame, corpus: Corpus, documents: int, shards: int) -> Places:
    """The order of the corpus, fitted on documents drawn by hash; every document is placed by it."""

    def drawn(n: int) -> DataFrame:
        one_in = max(1, documents // n)
        return stored.filter(F.pmod(F.xxhash64("number"), F.lit(one_in)) == 0).select("number", "rest", "terms")

    rows = sorted(drawn(FITTED).collect())
    found = Places(corpus, [np.frombuffer(r.rest, dtype="<u2") for r in rows], [r.terms and bytes(r.terms) for r in rows])

    def project(batches):
        for batch in _lots(batches):
            vectors = found.vectors(*_rests(batch)).astype("<f4")
            column = pa.array([v.tobytes() for v in vectors], pa.binary())
            yield pa.RecordBatch.from_arrays([batch["number"], column], ["number", "vector"])

    rows = sorted(drawn(max(FITTED, PLACED * shards)).mapInArrow(project, "number long, vector binary").collect())
    found.cut(np.array([np.frombuffer(r.vector, dtype="<f4") for r in rows]), shards)
    return found


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ``ids`` on demand.

    A null or empty text is the closing id alone. Rows that repeat a key or a text are
    documents of their own. An empty table gives no row. ``ids`` are unsigned little-endian 32-bit integers.
    """
    spark = docs.sparkSession
    ship(spark)
    stored = Scratch(spark, "packing").store(tokenized(docs, key, text, path, with_ids))
    kind = dict(stored.dtypes)["key"]
    corpus, documents, shards = frequencies(stored, with_ids)
    order = places(stored, corpus, documents, shards) if shards > 1 else None

    def place(batches):
        for batch in _lots(batches):
            leaf, along = order.of(order.vectors(*_rests(batch)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(leaf), pa.array(along), *batch.columns], ["leaf", "along", *batch.schema.names]
            )

    def fill(shard: pa.Table, number: int) -> tuple[pa.Table, int]:
        size = shard["size"].to_pylist()
        crcs, whole = shard["crcs"].to_pylist(), shard["whole"].to_pylist() if with_ids else None
        rests, terms = _rests(shard)
        out = []
        for k, found in enumerate(crcs):
            for i, crc in enumerate(found):
                ids = whole[k][2 * i * WINDOW : 2 * (i + 1) * WINDOW] if with_ids else None
                out.append((k, i * WINDOW, WINDOW, crc, number, 0, ids))
                number += 1
        sequences = windows(rests, terms, corpus)
        if sequences and sum(e - b for _, b, e in sequences[-1]) < WINDOW:
            sequences[-1:] = powers_of_two(sequences[-1])
        for pieces in sequences:
            offset = 0
            for k, b, e in pieces:
                ids = rests[k][b:e].astype("<u4").tobytes()
                before = len(crcs[k]) * WINDOW
                out.append((k, before + b, e - b, zlib.crc32(ids), number, offset, rests[k][b:e].tobytes() if with_ids else None))
                offset += e - b
            number += 1
        k, start, length, crc, sequence, offset, ids = zip(*out) if out else [()] * 7
        longs = lambda x: pa.array(x, pa.int64())
        names = ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        columns = [shard["key"].take(pa.array(k, pa.int64())), longs(start), longs(length), longs(crc)]
        columns += [longs([size[i] for i in k]), longs(sequence), longs(offset)]
        if with_ids:
            wide = [np.frombuffer(i, dtype="<u2").astype("<u4").tobytes() for i in ids]
            columns, names = [*columns, pa.array(wide, pa.binary())], [*names, "ids"]
        return pa.Table.from_arrays(columns, names), number

    def fill_all(batches):
        task = TaskContext.get()
        number = (task.partitionId() if task else 0) << 33
        for shard in _shards(batches, with_ids):
            table, number = fill(shard, number)
            yield from table.to_batches()

    schema = PIECES.format(kind=kind) + (", ids binary" if with_ids else "")
    if order is None:
        dealt = stored.repartition(1).sortWithinPartitions("number")
    else:
        placed = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stored.schema)
        rows = stored.mapInArrow(place, f"leaf long, along double, {placed}")
        dealt = rows.repartitionByRange(shards, "leaf", "along", "number").sortWithinPartitions("leaf", "along", "number")
        dealt = dealt.drop("leaf", "along")
    return dealt.mapInArrow(fill_all, schema).withColumnRenamed("key", key)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces with their ids: the corpus as it goes into training."""
    return pack(docs, with_ids=True)


QUERIES = {"op1_packing": op1_packing}

SQL: dict[str, str] = {}
