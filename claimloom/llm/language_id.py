"""Language identification in two steps: family first, then one-versus-one linear SVMs.

Features are relative frequencies of hashed two- and three-byte strings of the lower-cased
letters of the whole text. One-versus-one linear support vector machines (squared hinge)
separate the families; within a family another set separates its languages.

The classifiers are fitted on at most ``TRAIN_ROWS`` labelled rows, shared out evenly among
languages and drawn by doc_id. Null texts and texts without a letter are ``und`` with score 0;
with one language it is the answer, with none ``und``. Repeated rows each get their result; very long texts are
read in parts of half a megabyte.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod
from .mixing import draw

#: Families of common languages (fixed values); any other language is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk pl cs sk bg sr hr sl mk be",
    "indic": "hi bn mr gu pa ur ne",
    "turkic": "tr az kk uz",
    "finnic": "fi et",
}
FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}
BITS = 13
TRAIN_ROWS = 2_000
PIECE = 1 << 19
LETTER = re.compile(r"[^\W\d_]")
#: ASCII letters stay, other ASCII becomes a space, bytes of other characters stay.
KEPT = np.array([c if c > 127 or 97 <= c <= 122 else 32 for c in range(256)], np.uint8)


def cells(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Feature cells of all places of all texts, and each text's number of places."""
    data = KEPT[np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)]
    begin = np.cumsum([1, *(len(t) + 1 for t in texts)])
    doc = np.repeat(np.arange(len(texts)), np.diff(begin))
    inner, before = data[1:], data[:-1]
    keep = (inner != 32) | (before != 32)
    own, data = doc[keep], inner[keep].astype(np.uint32)
    two = (data[:-2] << 8) | data[1:-1]
    three = (two << 8) | data[2:]
    a = (two * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    b = ((three * np.uint32(2246822519)) >> np.uint32(32 - BITS)) + np.uint32(1 << BITS)
    same = own[:-2] == own[2:]
    return np.stack([a[same], b[same]], 1).astype(np.int32), np.bincount(own[:-2][same], minlength=len(texts))


def parts_of(text: bytes) -> Iterator[list[bytes]]:
    """A long text in parts of PIECE bytes that end at a space where there is one, which a string of three bytes doesn't cross."""
    at = 0
    while at < len(text) or not at:
        to = min(len(text), at + PIECE)
        if to < len(text):
            to = max(text.rfind(b" ", at + 1, to) + 1, 0) or to
        yield [text[at:to]]
        if to >= len(text):
            return
        at = to


def svm(x: np.ndarray, y: np.ndarray, cost: float = 5.0, rounds: int = 150) -> np.ndarray:
    """Squared-hinge linear SVM by accelerated gradient descent; the last weight is the bias."""
    x = np.column_stack([x, np.ones(len(x), np.float32)])
    w = np.zeros(x.shape[1], np.float32)
    ahead, t = w, 1.0
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    step = 1.0 / (1.0 / cost + 2 * float((weight * (x * x).sum(1)).sum()))
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        new = ahead - step * (ahead / cost - 2 * (x.T @ (weight * y * slack)))
        t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return w


def dense(texts: list[bytes]) -> np.ndarray:
    out = np.zeros((len(texts), 2 << BITS), np.float32)
    for k, t in enumerate(texts):
        n = 0
        for part in parts_of(t):
            c, m = cells(part)
            out[k] += np.bincount(c.ravel(), minlength=2 << BITS)
            n += int(m[0])
        out[k] /= max(1, n)
    return out


def learn(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> dict:
    """Fits on rows (doc_id, text, lang) whose crc32(doc_id) mod 5 is not 0."""
    rows = docs.where("lang is not null and text is not null").where(crc_mod(F.col("doc_id"), 5) != 0)
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return {"langs": [], "families": {}, "sides": [], "weights": np.zeros((2 << BITS, 0), np.float32), "bias": np.zeros(0), "scale": 1.0}
    share = F.create_map(*[F.lit(v) for k in langs for v in (k, min(1.0, train_rows / len(langs) / counts[k]))])
    sample = sorted((r["lang"], r["text"]) for r in rows.where(draw(F.col("doc_id"), "lang") < F.element_at(share, F.col("lang"))).select("lang", "text").collect())
    y = np.array([k for k, _ in sample])
    x = dense([t.lower().encode() for _, t in sample])
    scale = 1 / max(1e-9, float(np.sqrt((x * x).sum(1)).mean()))
    x *= scale
    families = {k: FAMILY.get(k, k) for k in langs}
    kin = np.array([families[k] for k in y]) if len(y) else y
    sides, weights = [], []
    jobs = [("family", a, b) for a, b in combinations(sorted(set(families.values())), 2)]
    jobs += [(families[a], a, b) for a, b in combinations(langs, 2) if families[a] == families[b]]
    for group, a, b in jobs:
        names = kin if group == "family" else y
        pick = (names == a) | (names == b)
        sides.append((group, a, b))
        weights.append(svm(x[pick], np.where(names[pick] == a, 1, -1).astype(np.float32)))
    w = np.array(weights, np.float32).reshape(len(jobs), -1).T if jobs else np.zeros(((2 << BITS) + 1, 0), np.float32)
    return {"langs": langs, "families": families, "sides": sides, "weights": w[:-1] * scale, "bias": w[-1], "scale": scale}


def vote(margins: np.ndarray, model: dict, group: str, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Winner's number and its confidence. Each pair's machine gives both sides a share of its vote by a logistic curve
    over its margin; the greatest sum wins, the first name of equal ones. Confidence is the winner's least sure vote."""
    total = np.zeros((len(margins), len(names)))
    surest = np.ones((len(margins), len(names)))
    for k, (g, a, b) in enumerate(model["sides"]):
        if g == group:
            p = 1 / (1 + np.exp(-np.clip(3 * margins[:, k], -30, 30)))
            i, j = names.index(a), names.index(b)
            total[:, i] += p
            total[:, j] += 1 - p
            surest[:, i] = np.minimum(surest[:, i], p)
            surest[:, j] = np.minimum(surest[:, j], 1 - p)
    best = total.argmax(1)
    return best, surest[np.arange(len(margins)), best]


def predict(texts: list[str | None], model: dict) -> tuple[list[str], list[float]]:
    raw = [(t or "").lower().encode() for t in texts]
    margins = np.zeros((len(raw), len(model["sides"])))
    places = np.zeros(len(raw), np.int64)
    at = 0
    while at < len(raw):
        to, held = at, 0
        while to < len(raw) and (to == at or held + len(raw[to]) <= PIECE):
            held, to = held + len(raw[to]), to + 1
        for part in ([raw[at:to]] if to > at + 1 else parts_of(raw[at])):
            c, n = cells(part)
            places[at:to] += n
            if len(c) and margins.shape[1]:
                each = model["weights"][c[:, 0]] + model["weights"][c[:, 1]]
                full = np.flatnonzero(n)
                margins[at + full] += np.add.reduceat(each, (np.cumsum(n) - n)[full], axis=0)
        at = to
    margins /= np.maximum(places, 1)[:, None]
    margins += model["bias"]
    groups = sorted(set(model["families"].values()))
    family, sure = vote(margins, model, "family", groups) if groups else (np.zeros(len(raw), int), np.zeros(len(raw)))
    lang, score = ["und"] * len(raw), [0.0] * len(raw)
    for k, g in enumerate(groups):
        names = [x for x in model["langs"] if model["families"][x] == g]
        best, inner = vote(margins, model, g, names)
        for i in np.flatnonzero(family == k):
            if texts[i] and LETTER.search(texts[i]):
                lang[i], score[i] = names[best[i]], float(sure[i] * inner[i])
    return lang, score


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, lang_pred, score) of rows (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score = predict(b.column(1).to_pylist(), model)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    return identify(docs, learn(docs)).select("doc_id", held.alias("held_out"), "lang_pred", "score")
