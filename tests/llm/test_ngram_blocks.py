"""Candidates of the n-gram join: told apart without texts, in blocks of any size, by tables that workers share."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from claimloom.llm import ngram_join as N


def edges(sets):
    return np.concatenate([[0], np.cumsum([len(s) for s in sets])])


def test_parities_lose_no_link_and_tell_others_apart():
    r = random.Random(3)
    for percent in (50, 80, 90):
        base = [r.getrandbits(64) for _ in range(120)]
        sets = [np.array(sorted({*r.sample(base, r.randint(60, 120)), *(r.getrandbits(64) for _ in range(r.randint(0, 20)))}), np.uint64) for _ in range(30)]
        side = np.array([r.randint(0, 1) for _ in sets])
        bits = N.parities(np.concatenate(sets), edges(sets))
        got, crossed = N.likely(np.diff(edges(sets)), bits, percent), N.likely(np.diff(edges(sets)), bits, percent, side)
        for i in range(len(sets)):
            for j in range(i):
                a, b = set(sets[i].tolist()), set(sets[j].tolist())
                if 100 * len(a & b) >= percent * len(a | b):
                    assert got[i] == got[j] and (side[i] == side[j] or crossed[i] == crossed[j])
    apart = [np.array(sorted(r.getrandbits(64) for _ in range(300)), np.uint64) for _ in range(10)]
    assert N.likely(np.diff(edges(apart)), N.parities(np.concatenate(apart), edges(apart)), 80).tolist() == list(range(10))


def test_texts_that_share_rare_words_alone_are_not_dealt(spark, monkeypatch):
    """All texts end with the same passage, of which their rarest shingles are; two are near copies."""
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(k, f"{words(k)} {' '.join(f'same{i}' for i in range(25))}") for k in range(12)]
    rows.append((12, rows[3][1] + " more"))
    for most in (2048, 4):
        monkeypatch.setattr(N, "MARKED", most)
        monkeypatch.setattr(N, "NAMED", most)
        wanted, real = [], N.written

        def written(df, name, wanted=wanted, real=real):
            out = real(df, name)
            if name == "wanted":
                wanted.append(out)
            return out

        monkeypatch.setattr(N, "written", written)
        got = {r.doc_id: r.component_id for r in N.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), size=5, percent=80).collect()}
        monkeypatch.setattr(N, "written", real)
        assert got == {k: 3 if k == 12 else k for k in range(13)}
        assert sum(w.count() for w in wanted) == 2


def test_blocks_share_tables():
    assert N.tables() is N.tables()


def test_counts_hold_one_table_and_send_parts(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(40))) for _ in range(700)] + [None, "x"]
    value = N.shingle_sets([(t or "").encode() for t in texts], 5, N.Rolling())[0]
    want = np.bincount((value >> np.uint64(64 - N.SKETCH_BITS)).astype(np.int64), minlength=1 << N.SKETCH_BITS)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert (N.shingle_counts(docs, 5) == want).all()
    tracemalloc.start()
    sent = [b.nbytes for b in N.counted(iter([pa.RecordBatch.from_pylist([{"doc_id": i, "text": t} for i, t in enumerate(texts)], pa.schema([("doc_id", pa.int64()), ("text", pa.string())]))]), 5)]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(sent) == N.COUNT_PARTS and max(sent) < 1 << 20 and most < 40 << 20
