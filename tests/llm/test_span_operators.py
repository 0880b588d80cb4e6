"""Personal data, whitening and runs against brute force, on small odd tables too."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

from tracklane.llm import private_data, runs, whitening

TABLES = "/root/testdata/sf0.001"

# Personal data --------------------------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m.group().split(".")),
                "card": lambda: 16 <= len(digits) <= 19 and private_data.luhn(digits),
                "phone": lambda: 8 <= len(digits) <= 15,
            }[kind]()
            if good:
                out.append((kind, *m.span()))
    return out


def test_base_spans_equal_the_patterns():
    draw = random.Random(2)
    for _ in range(20_000):
        text = "".join(draw.choice(draw.choice(["0123456789", "a.@-+ ()", "é "])) for _ in range(draw.randint(0, 45)))
        assert private_data.base_spans(text) == plain_spans(text)
    for text in ("4111 1111 1111 1111 x", "a@b.c@d.e", "300.1.1.1.1", "000000001.2.3.4", "+1 (2) 3-4 5678 90"):
        assert private_data.base_spans(text) == plain_spans(text)


def test_dynamic_programmes_equal_enumeration():
    draw = random.Random(7)
    for _ in range(200):
        spans = {(a, a + draw.randint(1, 4)) for a in (draw.randint(0, 8) for _ in range(draw.randint(1, 7)))}
        segments = [private_data.Candidate(a, b, []) for a, b in sorted(spans)]
        scores = [draw.uniform(-2, 2) for _ in segments]
        total, shares, top = 0.0, [0.0] * len(segments), (-1.0, ())
        for k in range(len(segments) + 1):
            for chosen in itertools.combinations(range(len(segments)), k):
                ordered = [segments[i] for i in chosen]
                if any(x.end > y.start for x, y in zip(ordered, ordered[1:])):
                    continue
                weight = math.exp(sum(scores[i] for i in chosen))
                total += weight
                for i in chosen:
                    shares[i] += weight
                top = max(top, (weight, chosen))
        first, last, m = private_data.lattice(segments)
        whole, got = private_data.marginals(first, last, m, scores)
        assert whole == pytest.approx(math.log(total))
        assert got == pytest.approx([s / total for s in shares])
        assert tuple(sorted(private_data.best(first, last, m, scores))) == top[1]


def test_field_finds_spans_it_has_not_seen():
    field, right, wrong, missed = private_data.trained(), 0, 0, 0
    for text, spans in private_data.sentences(800, seed=5):
        got, want = set(field.spans(text)), set(spans)
        right, wrong, missed = right + len(got & want), wrong + len(got - want), missed + len(want - got)
    assert right / (right + wrong) > 0.97 and right / (right + missed) > 0.97
    found = private_data.all_spans("mail jo.doe at example dot org or call (512) 555-4564, ssn 123-45-6789", field)[1]
    assert [k for k, _, _ in found] == ["email", "phone", "ssn"]
    for clean in ("Apache License, Version 2.0.", "on 2024-01-15 at 10:30", "order 1234567", "look at this. dot dot", "p. 12-34"):
        assert private_data.all_spans(clean, field) == ([], [])


def test_private_data_over_a_table(spark):
    texts = ["x jo@a.bc é +1 (512) 555-4564", None, "", "x jo@a.bc é +1 (512) 555-4564", "1" * 50_000, "a" * 50_000 + "@"]
    rows = [(k if k else None, t, "x", 1) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, base int")
    got = private_data.private_data(docs).collect()
    assert len(got) == 6 and {tuple(s) for s in got[0].base} == set(plain_spans(texts[0]))
    assert got[0].doc_id is None and got[3].spans == got[0].spans and not any(got[k].spans for k in (1, 2, 4, 5))
    assert private_data.private_data(docs.limit(0)).count() == 0


def test_op11_digests(spark):
    texts = dict(spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text").collect())
    for r in private_data.op11_private_data(spark, TABLES).collect():
        base = plain_spans(texts[r.doc_id] or "")
        said = [f"{k}:{a}:{b}" for k, a, b in base]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in PATTERNS]
        assert r.base_sha256 == hashlib.sha256(",".join(said).encode()).hexdigest()
        assert set(said) <= set(r.spans.split(",")) | (set() if said else {""})


# Whitening ---------------------------------------------------------------------------------


def plain_whitening(vectors, k=4):
    x = np.floor(256 * np.array(vectors, dtype=float)).astype(int)
    fit = np.unique(x, axis=0)
    e, u = np.linalg.eigh(np.cov(fit.T, bias=True).reshape(x.shape[1], -1))
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    total = fit.sum(axis=0)
    deviation = [sum((len(fit) * int(a) - int(b)) ** 2 for a, b in zip(row, total)) for row in x]
    return len(fit), deviation, ((x - total / len(fit)) @ u) / np.sqrt(e), e / np.trace(np.cov(fit.T, bias=True).reshape(x.shape[1], -1))


@pytest.mark.parametrize("shift", [0.0, 1e6])
def test_whitening_equals_a_plain_decomposition(spark, shift):
    draw = np.random.default_rng(4)
    vectors = (draw.normal(size=(300, 9)) * np.arange(1, 10) + shift).tolist()
    vectors += vectors[:7] * 30  # a hot vector counts once
    rows = [(k, v, "x") for k, v in enumerate(vectors)]
    odd = [(1000, None, ""), (1001, [], ""), (1002, [None] + [1.0] * 8, ""), (1003, [float("nan")] * 9, ""), (1004, [float("inf")] * 9, "")]
    schema = "vec_id long, embedding array<double>, n string"
    got = whitening.whiten(spark.createDataFrame(rows + odd, schema)).toPandas()
    n, deviation, white, explained = plain_whitening(vectors)
    assert len(got) == 4 * len(vectors) and set(got["n"]) == {n}
    one = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    for k in range(4):
        assert np.abs(one[:, k] * np.sign(one[:, k] @ white[:, k]) - white[:, k]).max() < 1e-8
    assert got[got.component == 1].sort_values("vec_id").deviation.tolist() == deviation
    assert np.allclose(got.groupby("component").explained.first(), explained, rtol=1e-9)
    assert got.identity_error.max() < 1e-9


def test_factor_and_rotations():
    draw = np.random.default_rng(1)
    for rank in (1, 3, 8):
        b = draw.normal(size=(8, rank)) * 10.0 ** draw.integers(-3, 4, rank)
        factor, order = whitening.pivoted_cholesky(b @ b.T)
        assert np.allclose(factor @ factor.T, (b @ b.T)[np.ix_(order, order)], rtol=1e-10, atol=1e-12 * np.trace(b @ b.T))
        values, unit = whitening.one_sided_jacobi(factor)
        assert np.allclose(values[:rank], np.linalg.eigvalsh(b @ b.T)[::-1][:rank], rtol=1e-6)
        assert np.allclose(unit.T @ unit, np.eye(unit.shape[1]), atol=1e-12)


def test_whitening_of_degenerate_tables(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    same = whitening.whiten(spark.createDataFrame([(1, [2.0, 3.0]), (None, [2.0, 3.0])], schema)).collect()
    assert len(same) == 4 and {(r.n, r.deviation, r.whitened, r.explained) for r in same} == {(1, 0, None, None)}
    line = whitening.whiten(spark.createDataFrame([(k, [float(k), 2.0 * k, 5.0]) for k in range(5)], schema)).collect()
    first = {r.vec_id: r.whitened for r in line if r.component == 1}
    assert [abs(first[k]) for k in (0, 4)] == pytest.approx([math.sqrt(2)] * 2)
    assert {(r.whitened, r.explained) for r in line if r.component > 1} == {(None, 0.0)}
    ragged = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 1.0]), (3, [1.0])], schema)).collect()
    assert {r.vec_id for r in ragged} == {1, 2}
    far = whitening.whiten(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 5.0])], schema)).collect()
    assert len(far) == 6 and all(r.whitened is not None for r in far if r.component == 1)


# Runs ----------------------------------------------------------------------------------------


def plain_runs(words):
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length, w = i - s + q, words[s : i + q]
            if length >= max(12, 2 * q) and not any(w[r:] == w[: length - r] for r in range(1, q)):
                out.append((s, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_lyndon_array():
    draw = random.Random(1)
    for _ in range(400):
        a = [draw.randint(0, draw.choice([1, 2, 5])) for _ in range(draw.randint(1, 22))]
        want = [
            max(k for k in range(1, len(a) - i + 1) if all(a[i : i + k] < a[i + j : i + k] for j in range(1, k)))
            for i in range(len(a))
        ]
        assert runs.lyndon_array(np.array(a)).tolist() == want


def test_runs_equal_brute_force():
    draw = random.Random(6)
    for _ in range(600):
        k, words = draw.choice([1, 2, 3, 50]), []
        while len(words) < draw.randint(0, 90):
            words += [b"%d" % draw.randint(0, k) for _ in range(draw.randint(1, 12))] * draw.choice([1, 1, 2, 3, 7])
            if draw.random() < 0.2:
                words[draw.randrange(len(words))] = b"x"
        assert runs.text_runs(words) == plain_runs(words)
    thue = [bin(i).count("1") % 2 for i in range(2048)]
    words = [b"%d" % b for b in thue]
    assert runs.text_runs(words) == plain_runs(words)


def test_periodic_runs_over_a_table(spark):
    texts = ["a b " * 10, None, "", " \t\n", "a b " * 10, "w " * 30_000, "é ü " * 12, "a b c"]
    rows = [(k if k else None, t, 1, "c") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int, collapsed string")
    got = [(r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in runs.periodic_runs(docs).collect()]
    assert got[0] == (None, [(0, 20, 2)], "a b") and got[4][1:] == got[0][1:]
    assert got[1][1:] == got[2][1:] == got[3][1:] == ([], "")
    assert got[5][1:] == ([(0, 30_000, 1)], "w") and got[6][1:] == ([(0, 12, 1)], "é ü") and got[7][1:] == ([], "a b c")
    assert runs.periodic_runs(docs.limit(0)).count() == 0


def test_op13_digests(spark):
    texts = dict(spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text").collect())
    seen = 0
    for r in runs.op13_runs(spark, TABLES).collect():
        words = (texts[r.doc_id] or "").encode().split()
        n, h = len(words), zlib.crc32(str(r.doc_id).encode())
        if n > 1500:
            continue
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        want = plain_runs(words)
        drop = {i for s, length, q in want for i in range(s + q, s + length)}
        best = max(want, key=lambda x: (x[1], -x[0], -x[2]), default=(None,) * 3)
        assert (r.n_runs, r.start, r.length, r.period) == (len(want), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if want else None)
        assert r.runs_sha256 == hashlib.sha256("".join("%d,%d,%d\n" % x for x in want).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in drop)).hexdigest()
        seen += 1
    assert seen > 50
