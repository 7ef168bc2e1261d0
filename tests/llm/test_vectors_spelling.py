"""Vector codes, near vectors and spelling variants against brute force, with nulls, ties, repeats and empty tables."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from claimloom.llm import near_vectors, spelling, vector_codes

ODD = [(None, [1.0] * 16), (9000, None), (9001, []), (9002, [0.0] * 16), (9003, [None] + [1.0] * 15), (9004, [float("nan")] * 16),
       (9005, [float("inf")] + [1.0] * 15), (9006, [1.0] * 3), (9006, [1.0] * 3), (9007, [1e300] * 8 + [-1e300] * 8), (9008, [1e-300] * 8 + [-1e-300] * 8)]


def vectors(spark, rows):
    """With columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, v, None if i is None or i % 7 == 0 else i % 3, 1, "x") for i, v in rows],
                                 "vec_id long, embedding array<double>, label int, no long, key string")


def fine(v):
    return bool(v) and all(c is not None and np.isfinite(c) for c in v)


def test_nearest_equals_all_distances():
    r = np.random.default_rng(1)
    for width, spread in ((1, 3), (4, 2), (16, 400), (3, 1 << 26)):
        entries = r.integers(-spread, spread + 1, (40, width))
        x = np.concatenate([r.integers(-spread, spread + 1, (300, width)), entries, np.full((2, width), 1 << 26)])
        every = np.square(x[:, None] - entries[None]).sum(axis=2)
        for bits in (1, 5):
            index, error = vector_codes.nearest(x, entries, bits)
            assert (index == every.argmin(axis=1)).all() and (error == every.min(axis=1)).all()


def coded(rows, parts, entries, rounds):
    most = vector_codes.MOST
    kept = sorted(((i is None, i or 0, [int(max(-most, min(most, np.floor(1024 * c)))) for c in v]) for i, v in rows if fine(v) and len(v) == 16))
    x = np.array([k[2] for k in kept], np.int64).reshape(len(kept), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()
    for k in range(rounds + 1):
        every = np.square(x[:, :, None] - books[None]).sum(axis=3)
        to = every.argmin(axis=2)
        if k < rounds:
            for p in range(parts):
                for e in set(to[:, p].tolist()):
                    own = x[to[:, p] == e, p]
                    books[p, e] = own.sum(axis=0) // len(own)
    return Counter((None if k[0] else k[1], tuple(t.tolist()), int(m)) for k, t, m in zip(kept, to, every.min(axis=2).sum(axis=1), strict=True)), books


def test_vector_codes(spark):
    r = np.random.default_rng(2)
    rows = [(int(i), r.standard_normal(16).round(1).tolist()) for i in r.permutation(300)] + ODD
    rows += rows[:3]
    got, books = vector_codes.compress(vectors(spark, rows), entries=20)
    want, want_books = coded(rows, 4, 20, 4)
    assert Counter((r.vec_id, tuple(r.indexes), r.error) for r in got.collect()) == want
    assert (books == want_books).all()
    none, books = vector_codes.compress(vectors(spark, [(1, None), (2, [])]))
    assert none.count() == 0 and books.size == 0


def test_vector_code_query_sums_by_label(spark, tmp_path):
    r = np.random.default_rng(3)
    vectors(spark, [(i, r.standard_normal(16).tolist()) for i in range(50)]).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = vector_codes.op11_vector_codes(spark, str(tmp_path)).collect()
    label = lambda i: None if i % 7 == 0 else i % 3
    sums = Counter()
    for row in got:
        sums[label(row.vec_id)] += row.error
    assert all(row.label_error == sums[label(row.vec_id)] for row in got)
    assert all(re.fullmatch("[0-9a-f]{8}", row.code) for row in got)
    _, books = coded([(r.vec_id, r.embedding) for r in spark.read.parquet(f"{tmp_path}/embeddings.parquet").collect()], 4, 256, 4)
    assert {row.codebooks_sha256 for row in got} == {hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()}


def near(rows, cosine=0.95):
    ok = [k for k, (_, v) in enumerate(rows) if fine(v) and any(v) and len(v) == 16]
    x = np.array([rows[k][1] for k in ok])
    x = x / np.abs(x).max(axis=1)[:, None]
    norm = np.sqrt(np.square(x).sum(axis=1))
    link = x @ x.T / norm[:, None] / norm >= cosine
    np.fill_diagonal(link, False)
    parent = np.arange(len(rows))
    for a, b in np.argwhere(link):
        p, q = parent[ok[a]], parent[ok[b]]
        parent[parent == max(p, q)] = min(p, q)
    count = dict(zip(ok, link.sum(axis=1).tolist(), strict=True))
    least = {}
    for k, p in enumerate(parent.tolist()):
        least[p] = min(least.get(p, (True, 0)), (rows[k][0] is None, rows[k][0] or 0))
    first = lambda k: None if least[parent[k]][0] else least[parent[k]][1]
    return sorted(((rows[k][0], count.get(k, 0), first(k), rows[k][0] == first(k)) for k in range(len(rows))), key=str)


@pytest.fixture(scope="module")
def crowd():
    r = np.random.default_rng(5)
    like = lambda v, s: (v + r.standard_normal(16) * s).tolist()
    rows = [like(b, r.choice([0.02, 0.1, 0.2, 0.25])) for b in r.standard_normal((60, 16)) for _ in range(int(r.integers(1, 14)))]
    hot, other = r.standard_normal((2, 16))
    rows += [like(hot, 0.03) for _ in range(300)] + [like(hot, 0.2) for _ in range(40)] + [hot.tolist()] * 50 + [like(other, 0.01) for _ in range(200)]
    return [*enumerate(rows), *ODD, (3, rows[4])]


@pytest.mark.parametrize(("leaf", "task", "block", "crowd_of"), [(4096, 16384, 8, 5), (64, 100, 4, 3), (64, 10**6, 8, 10**9)])
def test_near_vectors(spark, monkeypatch, crowd, leaf, task, block, crowd_of):
    """Balls open and closed or none, leaves with guests, leaves cut into chunks."""
    for name, value in (("LEAF", leaf), ("TASK", task), ("BLOCK", block), ("CROWD", crowd_of)):
        monkeypatch.setattr(near_vectors, name, value)
    got = near_vectors.near_duplicates(vectors(spark, crowd)).collect()
    assert sorted(map(tuple, got), key=str) == near(crowd)


def test_near_vectors_of_nothing(spark):
    assert near_vectors.near_duplicates(vectors(spark, [])).collect() == []
    assert [tuple(r) for r in near_vectors.near_duplicates(vectors(spark, [(1, None), (None, [])])).orderBy("vec_id").collect()] == [(None, 0, None, True), (1, 0, 1, True)]


def spelled(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}

    def one(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(a) + 1 == len(b) and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    form, out = {}, []
    around = {w: [v for v in n if abs(len(v) - len(w)) < 2 and v != w and one(v, w)] for w in n}
    for w, near_words in around.items():
        best = min(near_words, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(around[w]), n.get(form[w])))
    return sorted(out, key=str)


@pytest.mark.parametrize(("long", "piece"), [(256, 1 << 16), (7, 9)])
def test_spelling_variants(spark, monkeypatch, long, piece):
    monkeypatch.setattr(spelling, "LONG", long)
    monkeypatch.setattr(spelling, "PIECE", piece)
    r = np.random.default_rng(6)
    words = ["".join(r.choice(list("abéÿ×"), int(r.integers(4, 8)))) for _ in range(150)] + ["aaaaaaaa", "aaaaaaaaa", "aaaaaaaaaa", "b" * 300, "b" * 299, "b" * 150 + "c" + "b" * 149, "b" * 256, "b" * 257]
    rows = [(int(i), " ".join(r.choice(words, 60)) + r.choice([".", " Été 12x", "_"])) for i in range(60)]
    rows += [(None, " ".join(words)), (None, None), (61, ""), (61, "aaaaa-AAAAA\tÀaaaa"), (62, "-" * 50), rows[0], rows[0], (63, "aaaaaaaaa " * 40)]
    frame = spark.createDataFrame([(*x, "w", 1, 1) for x in rows], "doc_id long, text string, word string, n long, no long")
    assert sorted(map(tuple, spelling.variants(frame).collect()), key=str) == spelled(rows)
    assert spelling.variants(frame.limit(0)).collect() == []
