"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lower-cases, maps homoglyphs and digit substitutions to the letters they stand for,
drops zero-width characters and turns all else into single spaces. The lexicon holds whole
words whose log-odds for toxic documents are high and whose likelihood ratio passes a Bonferroni bound
over all words tested, so few labels give few terms but no chance ones; a beginning of four to seven
letters joins it only if it is in clearly more toxic documents than any one of its words. Exception
phrases are a term with a neighbour, or phrases given by the caller, that occur in clean documents only.
A document's evidence is the weight of its hits outside exception phrases, per length. A
logistic curve over that density and over having any hit gives the score.

Labels are learned from a sample of at most about ``train_rows`` labelled rows, drawn by
doc_id (of repeated labels the greatest counts); what they teach has no other limit, and everything
else covers whole texts. Null and empty texts have no hits and get the curve's lowest score; repeated rows
each get their result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, written
from .mixing import draw

#: Letters that look like Latin ones (fixed values).
HOMOGLYPHS = dict(zip("аеорсухіјѕһԁԛԝвкмнтαεορτυνικχβγ", "aeopcyxijshdqwbkmhtaeoptuvikxby", strict=True))
#: Digits and signs written for letters (fixed values).
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
FOLD = str.maketrans(HOMOGLYPHS | SUBSTITUTES | dict.fromkeys("​‌‍⁠﻿­", ""))
GAP = re.compile(r"[\W_]+")
TRAIN_ROWS, LEAST_ODDS, CHANCE, MORE = 12_000, 2.0, 0.05, 1.25
#: Clean documents that an exception phrase needs.
LEAST_CLEAN = 3


def fold(text: str | None) -> str:
    """Folded words, each with a space before it, and one at the end."""
    return f" {GAP.sub(' ', (text or '').lower().translate(FOLD)).strip()} "


def features(folded: str) -> set[str]:
    """Words with both spaces, beginnings of four to seven letters with the one before."""
    out = set()
    for w in set(folded.split()):
        out.add(f" {w} ")
        out.update(f" {w[:k]}" for k in range(4, min(len(w), 8)))
    return out


def likelihood_ratio(toxic: int, clean: int, bad: int, good: int) -> float:
    """ln of how much likelier the counts are with a rate for each label than with one rate."""
    def ln(k: int, n: int, p: float) -> float:
        return (k * math.log(p) if k else 0.0) + ((n - k) * math.log(1 - p) if n > k else 0.0)

    p = (toxic + clean) / (bad + good)
    return ln(toxic, bad, toxic / bad) + ln(clean, good, clean / good) - ln(toxic, bad, p) - ln(clean, good, p)


def lexicon(rows: list[tuple[str, int, int]], tested: int, bad: int, good: int) -> dict[str, float]:
    """Terms with weights, of (term, toxic, clean) documents."""
    bound = math.log(max(1, tested) / CHANCE)
    odds = {t: math.log((x + 0.5) / (bad + 1)) - math.log((c + 0.5) / (good + 1)) for t, x, c in rows}
    sure = [(t, x) for t, x, c in rows if odds[t] >= LEAST_ODDS and bad and good and likelihood_ratio(x, c, bad, good) >= bound]
    terms = {t: odds[t] for t, _ in sure if t.endswith(" ")}
    most: dict[str, int] = {}
    for t, x in sure:
        if t.endswith(" "):
            for k in range(5, len(t) - 1):
                most[t[:k]] = max(x, most.get(t[:k], 0))
    for t, x in sorted(sure):
        if not t.endswith(" ") and x > MORE * most.get(t, 0) and not any(t[:k] in terms for k in range(5, len(t))):
            terms[t] = odds[t]
    return terms


def machine(terms: dict[str, float], exceptions: list[str]) -> ahocorasick.Automaton | None:
    found = ahocorasick.Automaton()
    for t, w in terms.items():
        found.add_word(t, (len(t), w))
    for t in exceptions:
        found.add_word(t, (len(t), None))
    if not len(found):
        return None
    found.make_automaton()
    return found


def hits(folded: str, found: ahocorasick.Automaton | None) -> list[tuple[int, int, float]]:
    """(start, end, weight) outside exception phrases, one (the heaviest) for each word."""
    all_ = [(end + 1 - size, end + 1, w) for end, (size, w) in found.iter(folded)] if found else []
    best: dict[int, tuple[int, int, float]] = {}
    reach = -1  # of the exception phrases that begin here or before
    for s, e, w in sorted(all_, key=lambda h: (h[0], h[2] is not None)):
        if w is None:
            reach = max(reach, e)
        elif e > reach and w > best.get(s, (0, 0, 0.0))[2]:
            best[s] = (s, e, w)
    return list(best.values())


def evidence(text: str | None, found: ahocorasick.Automaton | None) -> tuple[float, float, int, list[tuple[int, int]]]:
    """Having a hit, hit weight per length, words, spans of hits in folded text."""
    folded = fold(text)
    n = len(folded.split())
    got = hits(folded, found)
    total = sum(w for _, _, w in got)
    return float(total > 0), math.log1p(100 * total / (n + 50)), n, [(s, e) for s, e, _ in got]


def labelled_sample(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    one = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(crc_mod(F.col("doc_id"), 4) != 2)
    share = train_rows / max(1, one.count())
    return docs.join(one.where(draw(F.col("doc_id"), "toxic") < share), "doc_id").select("text", "toxic")


def learn(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, exceptions: tuple[str, ...] = ()) -> dict:
    """The model: terms with weights, exception phrases and the curve."""
    sample = written(labelled_sample(docs, labels, train_rows), "labelled")
    n = {int(r["toxic"] > 0): r["n"] for r in sample.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    bad, good = n.get(1, 0), n.get(0, 0)

    def tally(batches: Iterator[pa.RecordBatch], of) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())
        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                counts[toxic > 0].update(of(fold(text)))
        names = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[x] for x in names], pa.int64()) for c in counts)], names=["term", "clean", "toxic"])

    def totals(of) -> DataFrame:
        return sample.mapInArrow(lambda it: tally(it, of), "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))

    counted = written(totals(features), "terms")
    # less than a term can't reach the bound with: a word in k toxic documents has at most k * ln(1 + good / bad)
    tested = counted.where(F.col("term").endswith(" ")).count()
    least = math.log(max(1, tested) / CHANCE) / max(1e-9, math.log(1 + good / max(1, bad)) + 1)
    rows = counted.where((F.col("toxic") >= least) & (F.col("toxic") * (good + 1) > F.col("clean") * (bad + 1))).collect()  # of a bounded sample
    terms = lexicon([(r["term"], r["toxic"], r["clean"]) for r in rows], tested, bad, good)
    plain = machine(terms, [])

    def around(folded: str) -> set[str]:
        out = set()
        for s, e, _ in hits(folded, plain):
            end = folded.find(" ", s + 1)
            out.add(folded[folded.rfind(" ", 0, s) : end + 1] if s else "")
            after = folded.find(" ", end + 1)
            out.add(folded[s : after + 1] if after > 0 else "")
        return {x for x in out if x.count(" ") == 3}

    spared = [r["term"] for r in totals(around).where((F.col("toxic") == 0) & (F.col("clean") >= LEAST_CLEAN)).orderBy("term").collect()]
    model = {"terms": terms, "exceptions": [*spared, *(fold(x) for x in exceptions)]}
    model["curve"] = fit(np.array([[r[0], r[1], r[2]] for r in sample.mapInArrow(_evidence(model), "any double, density double, toxic double").collect()]).reshape(-1, 3))
    return model


def _evidence(model: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = machine(model["terms"], model["exceptions"])
        for b in batches:
            got = [(*evidence(t, found)[:2], float(y > 0)) for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in zip(*got, strict=True)] or [pa.array([], pa.float64())] * 3, names=["any", "density", "toxic"])
    return run


def fit(rows: np.ndarray, rounds: int = 30, ridge: float = 0.05) -> list[float]:
    """Logistic regression by Newton's method."""
    x, y = np.column_stack([np.ones(len(rows)), rows[:, :2]]), rows[:, 2]
    w = np.zeros(3)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(3), x.T @ (y - p) - ridge * w)
        w = w + np.clip(step, -4, 4)
    return w.tolist()


def score(docs: DataFrame, model: dict, cut: float = 0.3, name: str = "toxicity") -> DataFrame:
    """``docs`` and, last, a struct of score, predicted, n_words and spans (start and end in folded text); it is
    called ``name``, with underscores after it where ``docs`` has that name."""
    columns = docs.columns
    while name in columns:
        name += "_"
    plain = dict(docs.dtypes).get("text") == "string"  # then whole texts don't go to workers twice
    given, at = (docs, columns.index("text")) if plain else (docs.select("*", F.col("text").cast("string").alias(f"{name}_text")), len(columns))
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = machine(model["terms"], model["exceptions"])
        a, b, c = model["curve"]
        for batch in batches:
            got = [evidence(t.as_py(), found) for t in batch.column(at)]
            p = [1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * any_ + c * dense)))) for any_, dense, _, _ in got]
            out = pa.StructArray.from_arrays(
                [pa.array(p, pa.float64()), pa.array([int(x >= cut) for x in p], pa.int32()), pa.array([g[2] for g in got], pa.int64()),
                 pa.array([[{"start": s, "end": e} for s, e in g[3]] for g in got], span)], ["score", "predicted", "n_words", "spans"])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], out], names=[*columns, name])

    made = T.StructType().add("score", T.DoubleType()).add("predicted", T.IntegerType()).add("n_words", T.LongType()).add(
        "spans", T.ArrayType(T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType())))
    return given.mapInArrow(run, T.StructType([*docs.schema.fields]).add(name, made))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False))
    return score(docs, model).select("doc_id", held.alias("held_out"), "toxicity.score", "toxicity.predicted")
