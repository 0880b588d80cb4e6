"""Classifiers by held-out accuracy; packing by round trip; alignment and filters against plain code."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracklane.llm import decontaminate, packing, quality, toxicity, url_filter

TABLES = "/root/testdata/sf0.01"


def test_align_equals_plain_dynamic_programming():
    def plain(a, b):
        h, best = [[0] * (len(a) + 1) for _ in range(len(b) + 1)], 0
        for i in range(1, len(b) + 1):
            for j in range(1, len(a) + 1):
                diagonal = h[i - 1][j - 1] + (2 if a[j - 1] == b[i - 1] else -1)
                h[i][j] = max(0, diagonal, h[i - 1][j] - 1, h[i][j - 1] - 1)
                best = max(best, h[i][j])
        return best

    draw = random.Random(3)
    for _ in range(200):
        a = np.array([draw.randint(0, 4) for _ in range(draw.randint(1, 12))])
        b = np.array([draw.randint(0, 4) for _ in range(draw.randint(1, 20))])
        score, first, end = decontaminate.align(a, b)
        assert score == plain(a, b)
        assert not score or plain(a, b[first:end]) == score


def test_contaminated(spark):
    draw = random.Random(2)
    words = lambda n: [f"w{draw.randint(0, 500)}" for _ in range(n)]
    items = [words(draw.randint(14, 50)) for _ in range(20)] + [["solo"]]
    docs, want = [], set()
    for i in range(120):
        text = words(draw.randint(0, 80))
        if i % 3 == 0:
            k = draw.randrange(20)
            copy = [w if draw.random() > 0.12 else "edit" for w in items[k]]
            at = draw.randint(0, len(text))
            text[at:at] = copy
            if sum(a == b for a, b in zip(copy, items[k])) >= 0.8 * len(copy):
                want.add((i, k))
        docs.append((i, " ".join(text).upper() if i % 2 else ", ".join(text), "x"))
    docs += [(500, None, None), (501, "", None), (502, "a solo b", None)]
    benchmark = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)] + [(99, None)], "item_id long, text string")
    table = spark.createDataFrame(docs, "doc_id long, text string, score string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(table, benchmark).collect()}
    assert want | {(502, 20)} <= got and {d for d, _ in got} <= {i for i in range(0, 120, 3)} | {502}
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(table, none).count() == 0
    assert decontaminate.contaminated(table.limit(0), benchmark).count() == 0


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    draw = random.Random(6)
    parts = ["a", "b ", " ", "  ", "\n", " \n", "é", "'s", " don't", "<|endoftext|>", "\xa0", "\t", "12", "!!", " x", "😀", "\x1c"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 400))) for _ in range(200)] + [None, "", "word " * 9000]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), with_ids=True).collect()
    for key, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        own = sorted((r for r in got if r.doc_id == key), key=lambda r: r.start)
        assert [i for r in own for i in np.frombuffer(r.ids, "<u4").tolist()] == ids
        assert all(r.doc_tokens == len(ids) and zlib.crc32(r.ids) == r.ids_crc32 for r in own)
    sequences: dict[int, list] = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == 2048 or at & (at - 1) == 0
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_neighbours_share_terms_best_first():
    rests = [np.array(x) for x in ([5, 6, 7], [5, 6, 9], [5, 1, 1], [8, 8, 8])]
    found = packing.Index(rests).neighbours(rests[0], np.array([False, True, True, True]))
    assert found.tolist() == [1, 2]


def test_neighbours_are_found_over_the_whole_corpus(spark):
    draw = random.Random(8)
    words = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(3000)]
    texts = [" ".join(draw.sample(words, 12)) for _ in range(3001)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(i + 3001, t + " again") for i, t in enumerate(texts)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    held: dict[int, set] = {}
    for r in got:
        held.setdefault(r.doc_id, set()).add(r.sequence_id)
    assert len(held) == 6002
    assert sum(bool(held[i] & held[i + 3001]) for i in range(3001)) > 0.8 * 3001


def test_memory_of_counting_does_not_follow_the_batch(spark, monkeypatch):
    known = packing.terms_of

    def bounded(rests, terms):
        assert sum(len(r) for r in rests) < 300_000
        return known(rests, terms)

    monkeypatch.setattr(packing, "terms_of", bounded)
    stored = packing.tokenized(spark.range(900).selectExpr("id", "repeat('word ', 1500) AS text").coalesce(1), "id", "text", None, False)
    _, documents, _ = packing.frequencies(stored.localCheckpoint(), False)
    assert documents == 900


def test_an_encoder_takes_letters_once_whatever_follows_them():
    encoder, seen = packing.Encoder(packing.vocabulary_path()), []

    class Watched:
        def __init__(self, known):
            self.known = known

        def encode_batch_fast(self, texts, **how):
            seen.extend(texts)
            return self.known.encode_batch_fast(texts, **how)

    known = encoder.tokenizer
    encoder.tokenizer, encoder.letters = Watched(known), Watched(encoder.letters)
    ends = ["", ".", ",", "!?", "&&&", "$%", "'s", "'.", "-", "_", "7", "\u00b7"]
    texts = [f"{w}{e} {w}{e}\n{w}{e} x{e}" for w in ("unseen", "\u00dcbung", "\u00e9t\u00e9", "na\u0131ve", "\u4e2d") for e in ends]
    for _ in range(2):
        got = encoder.encode(pa.array(texts))
        assert [g.tolist() for g in got] == [known.encode(t, add_special_tokens=False).ids for t in texts]
    assert "".join(seen).count(" unseen") == 5  # alone, and before a sign that may not be apart


def test_scores_of_frequent_and_rare_ids_are_the_sum_of_their_weights():
    rng = np.random.default_rng(3)
    rests = [np.minimum(rng.geometric(0.02, 60), 400) for _ in range(80)]
    index, unused = packing.Index(rests), rng.random(80) < 0.6
    document, ids, weight = index.document, index.id, index.weight
    for _ in range(2):
        for k in range(0, 80, 9):
            own = np.isin(ids, rests[k])
            plain = np.bincount(document[own], weights=weight[own], minlength=80) * unused
            assert np.allclose(index.scores(index.ids_of(k), unused), plain[index.left])
            best = index.neighbours(index.ids_of(k), unused)
            assert len(best) == np.count_nonzero(plain) and (np.diff(plain[best]) < 1e-9).all()
        index.keep(unused)


def test_an_encoder_takes_few_pieces_at_once_and_is_forgotten():
    encoder, most = packing.Encoder(packing.vocabulary_path()), []

    class Watched:
        def encode_batch_fast(self, texts, **how):
            most.append(max(len(texts), *(t.count(" ") for t in texts)))
            return known.encode_batch_fast(texts, **how)

    known, encoder.tokenizer = encoder.tokenizer, Watched()
    text = " ".join(f"w{i}x" for i in range(9000)) + "  y" * 9000
    (got,) = encoder.encode(pa.array([text]))
    assert got.tolist() == known.encode(text, add_special_tokens=False).ids and max(most[:-1]) <= 4096
    packing.Encoder.at(packing.vocabulary_path())
    assert list(packing._lots(iter(()))) == [] and not packing.Encoder._by_path


def test_a_seed_asks_with_all_ids_of_the_whole_document():
    long = np.arange(100, 100 + packing.WINDOW)
    rests = [np.array([7, 8]), np.array([150, 151]), np.array([9])]
    index = packing.Index(rests, [packing.packed_terms(np.append(long, [7, 8])), None, None])
    assert index.neighbours(index.ids_of(0), np.array([False, True, True])).tolist() == [1]
    assert index.neighbours(index.ids_of(1), np.array([True, False, True])).tolist() == [0]
    common = np.arange(40)
    index = packing.Index([np.append(common, range(50, 80)), np.arange(50, 60), common, np.arange(50, 80)])
    best = index.neighbours(index.ids_of(0), np.array([False, True, True, True]))
    assert sorted(best.tolist()) == [1, 2, 3]


@pytest.mark.parametrize(
    ("query", "target", "least"), [(quality.op5_quality, "quality", 0.95), (toxicity.op10_toxicity, "toxic", 0.93)]
)
def test_held_out_accuracy(spark, query, target, least):
    rows = {r.doc_id: r for r in query(spark, TABLES).collect()}
    labels = {r.doc_id: r[target] for r in spark.read.parquet(f"{TABLES}/labels.parquet").collect()}
    tested = [(rows[i].predicted, y) for i, y in labels.items() if rows[i].held_out]
    assert len(rows) == spark.read.parquet(f"{TABLES}/documents.parquet").count()
    assert all(0 <= r.score <= 1 for r in rows.values())
    assert sum(p == y for p, y in tested) / len(tested) >= least


def test_classifiers_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, None), (None, ""), (2, "z" * 50_000)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for module in (quality, toxicity):
        got = quality.scored(docs, module.fitted(docs, labels)).collect()
        assert [r.score for r in got] == [0.5] * 3
        assert quality.scored(docs.limit(0), module.fitted(docs, labels)).count() == 0


def test_sample_of_labelled_documents(spark):
    """Long documents count whole, labels without a document take no place, repeated rows count once."""
    docs = spark.range(0, 400, 2).selectExpr("id AS doc_id", "repeat(concat('w', id, ' '), 9000) AS text")
    docs = docs.unionByName(docs.limit(1).selectExpr("doc_id", "text", "explode(sequence(1, 500)) AS n").drop("n"))
    labels = spark.range(20_000).selectExpr("id AS doc_id", "cast(id % 4 = 0 AS int) AS quality")
    out = F.col("doc_id") < 0
    drawn = quality.in_sample(docs, labels, "quality", out, 150).collect()
    assert len(drawn) == len({r.doc_id for r in drawn}) == 150
    assert all(r.text == f"w{r.doc_id} " * 9000 and r.label == int(r.doc_id % 4 == 0) for r in drawn)
    assert quality.in_sample(docs, labels, "quality", out, 4000).count() == 200


def test_identity_swap_does_not_move_scores():
    draw = random.Random(1)
    word = lambda: f"n{draw.randint(0, 60)}"
    texts, y = [], []
    for i in range(400):  # the named group goes with the label in this sample
        text = [word() for _ in range(20)]
        text[draw.randrange(20)] = "women" if i % 2 else "men"
        if i % 2:
            text[draw.randrange(20)] = "vileword"
        texts.append(" ".join(text))
        y.append(i % 2)
    sample = pa.table({"doc_id": list(range(400)), "text": texts, "label": y})
    fair, plain = toxicity.Model(sample), toxicity.Model(sample, penalty=0.0)
    neutral = pa.array(["n1 n2 women n3", "n1 n2 men n3"])
    gap = lambda m: abs(np.diff(m.score(neutral))[0])
    assert gap(fair) < gap(plain) / 2 and fair.score(pa.array(["n1 vileword men n3"]))[0] > 0.5


def test_toxicity_is_fitted_on_some_texts_at_a_time(monkeypatch):
    draw = random.Random(2)
    texts = [" ".join(f"n{draw.randint(0, 300)}" for _ in range(2000)) + " vileword" * (i % 2) for i in range(600)]
    sample = pa.table({"doc_id": list(range(600)), "text": texts, "label": [i % 2 for i in range(600)]})
    asked, words = [], toxicity._words
    monkeypatch.setattr(toxicity, "_words", lambda t: asked.append(sum(len(x) for x in t.to_pylist())) or words(t))
    piecewise = toxicity.Model(sample)
    assert sum(asked) > 10_000_000 and max(asked) < 3_000_000
    monkeypatch.setattr(toxicity, "_parts", lambda t: iter([(0, t)]))
    whole = toxicity.Model(sample)
    assert (piecewise.known == whole.known).all() and (piecewise.weights == whole.weights).all() and piecewise.bias == whole.bias


def test_url_filter(spark):
    rows = [
        (1, "http://A.com/x"), (2, "http://www.example.com/en/1"), (3, "http://b.example.com/en/1?x"), (4, "http://m.net/es/"),
        (5, "http://m.net/de/"), (6, None), (7, "no scheme"), (8, "http://notcom/en/"), (9, "http://x.com"), (9, "http://x.com"),
        (10, "ftp://h.net?/es/"), (11, "http://example.com/en/" + "y" * 20_000),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labelled = spark.createDataFrame([("http://good.org/a", 0), ("http://bad.net/spam", 1), (None, 1)], "url string, label int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.url_filter(pages, labelled).collect()}
    assert got[1] == ("a.com", "/x", "com/", "allow") and got[2][2:] == ("www.example.com/en/", "allow")
    assert got[3][1:] == ("/en/1", "example.com/en/", "block") and got[4][2:] == ("net/es/", "block")
    assert got[5][2] is None and got[6][:3] == ("", "", None) and got[7][:3] == ("", "", None) and got[8][2] is None
    assert got[9][:3] == ("x.com", "", None) and got[10][:2] == ("h.net", "") and got[11][2] == "example.com/en/"
    weights, bias = url_filter.fit(labelled)
    assert any(weights)
    none = spark.createDataFrame([], "url string, label int")
    assert not any(url_filter.fit(none)[0]) and url_filter.url_filter(pages.limit(0), none).count() == 0
