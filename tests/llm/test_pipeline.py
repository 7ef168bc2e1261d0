"""The stages of corpus_pipeline on rows with null and repeated ids, and the whole of it against brute force."""

import hashlib
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from claimloom.llm import toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture
def tables(spark, tmp_path):
    """A folder of tables whose one benchmark item has ten words, and whose labels teach one word."""
    item = "a b c d e f g h i j"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    labels = [(k, int(k % 2)) for k in range(200)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(k, f"page {k} " + "vile" * (k % 2)) for k in range(200)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "s", 1, 2, 3) for r in rows], "doc_id long, text string, source string, copy int, target int, toxicity int")


def kept(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_leaks_go_by_row(spark, tables):
    item = "a b c d e f g h i j"
    rows = [(None, item), (1, item), (2, item), (2, "clean words here"), (None, "clean"), (3, None), (4, "")]
    want = sorted([(2, "clean words here"), (None, "clean"), (3, None), (4, "")], key=str)
    assert kept(corpus_pipeline.drop_leaks(spark, frame(spark, rows), tables)) == want
    frame(spark, rows).write.parquet(f"{tables}/given")
    assert kept(corpus_pipeline.drop_leaks(spark, spark.read.parquet(f"{tables}/given"), tables)) == want


def test_near_copies_go_by_row(spark, tables):
    text = " ".join(f"w{k}" for k in range(60))
    near = text.replace("w59", "x")
    rows = [(None, text), (7, near), (7, "quite another text of seven words"), (9, text), (None, "alone"), (None, "alone"), (3, None), (4, "")]
    want = sorted([(7, near), (7, "quite another text of seven words"), (None, "alone"), (3, None), (4, "")], key=str)
    assert kept(corpus_pipeline.drop_near_copies(spark, frame(spark, rows), tables)) == want


def test_copies_and_toxic_rows(spark, tables):
    rows = [(1, "Same"), (None, "same"), (5, "SAME"), (5, "other"), (6, None), (7, ""), (8, "you are V1LE"), (None, "vile"), (9, "reviled")]
    assert kept(corpus_pipeline.drop_copies(spark, frame(spark, rows[:6]), tables)) == sorted([(5, "SAME"), (5, "other"), (7, "")], key=str)
    assert kept(corpus_pipeline.drop_toxic(spark, frame(spark, rows), tables)) == sorted([*rows[:6], (9, "reviled")], key=str)


def test_stages_of_no_rows(spark, tables):
    docs = frame(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, tables)
        assert out.count() == 0
        assert out.columns == docs.columns + (["copy_"] if name == "mixing" else [])


def shingles(text):
    w = text.lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_pipeline_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]
    items = [r.text or "" for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    given = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    scored = toxicity.score(given, toxicity.learn(given, spark.read.parquet(f"{SF}/labels.parquet"))).collect()
    toxic = {r.doc_id for r in scored if r.toxicity.predicted}
    left = [d for d in docs if d[0] not in toxic]
    groups = defaultdict(list)
    for d in left:
        groups[hashlib.sha256((d[1] or "").encode().lower()).digest()].append(d)
    left = [max(g) for g in groups.values()]
    sets = [shingles(d[1] or "") for d in left]
    root = list(range(len(left)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, x in enumerate(sets):
        for b, y in enumerate(sets[:a]):
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                root[find(a)] = find(b)
    first = {}
    for k, d in enumerate(left):
        first[find(k)] = min(first.get(find(k), d[0]), d[0])
    left = [d for k, d in enumerate(left) if first[find(k)] == d[0]]

    import re

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate({c: c + 32 for c in range(65, 91)}))
    windows = {tuple(w[k : k + 10]) for w in map(words, items) for k in range(max(1, len(w) - 9)) if w}
    sizes = {len(w) for w in windows}
    clean = lambda w: not any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))
    left = {d[0]: d for d in left if clean(words(d[1] or ""))}
    got = corpus_pipeline.run(spark, SF).collect()
    copies = Counter(r.doc_id for r in got)
    assert set(copies) <= set(left)
    size = defaultdict(int)
    for d in left.values():
        size[d[2]] += len((d[1] or "").split())
    taken = defaultdict(int)
    for i, n in copies.items():
        assert n <= 3
        taken[left[i][2]] += n * len((left[i][1] or "").split())
    target = {r.source: r.target for r in corpus_pipeline.mixing.source_targets(spark.createDataFrame(list(size.items()), "source string, size long")).collect()}
    for s, t in target.items():
        rate = t / size[s]
        for d in left.values():
            if d[2] == s:
                assert int(rate) <= copies[d[0]] <= int(rate) + 1


def test_toxicity_sends_texts_once(spark):
    docs = spark.createDataFrame([(1, "a plain text"), (2, None)], "doc_id long, text string")
    made = toxicity.score(docs, {"terms": {" bad ": 2.0}, "exceptions": [], "curve": [-3.0, 1.0, 1.0]})
    assert "toxicity_text" not in made._jdf.queryExecution().toString() and made.columns == ["doc_id", "text", "toxicity"]
    assert sorted((r.doc_id, r.text, r.toxicity.predicted) for r in made.collect()) == [(1, "a plain text", 0), (2, None, 0)]
