"""Gated recurrent language model.

Token counts of the whole training corpus give the vocabulary: the most frequent tokens, at least
``SHORT`` and the square root of the number of distinct tokens, are modelled word by word, in classes of
about equal mass; the others fall into ``RARE`` classes by their last letters and length. The softmax
has two levels: P(token | history) = P(class | state) * P(token | class, state); in a rare class the second
factor is the token's share, (count + 1) / (count of the class + 1 per token + 1 for unseen), a proper
distribution over every token.

The network (embedding, one GRU layer, class-factored softmax) is trained in numpy by backpropagation
through time, truncated after ``STEPS`` tokens with the state carried over. Every training document is trained
on in one of ``ROUNDS`` rounds, by the worker that holds it, and after each round the weights are averaged by
tokens, so the model learns from the whole training corpus and no task or driver holds it. Scoring runs
documents in parallel lanes and carries each one's state from its first token to its end.

Null texts are empty and have one token, the end. A null doc_id counts as training. Repeated rows are counted and
scored one by one. A very long text is held whole by the task that scores it.
"""

from __future__ import annotations

import heapq
import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, ranges_for, written
from .ngram_join import LOWERED, SPACE
from .slabs import Rolling, Slab, by_bucket, each_slab, pack, slab_table, unpack, with_replies

SHORT, RARE, EMBED, HIDDEN = 1023, 64, 24, 32
ROUNDS, LANES, STEPS = 3, 256, 24
#: Learning rates of the first rounds; later ones take the last.
RATES = (0.02, 0.01, 0.005)
#: Tokens whose softmax is taken at once, so that its cells stay in the processor's cache, and lanes of scoring.
OUTPUT, SCORED = 4096, 384
#: Pieces that weights are sent in, and partitions whose sums are added first.
PARTS, TREE = 16, 64
#: The end's key; words are hashed.
END = np.uint64(1)
PIECE = 1 << 19


def named(print_: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A word's key: its hash with its rare class in the six low bits; never END."""
    last, before = data[end - 1].astype(np.uint64), np.where(end - start > 1, data[end - 2], 0).astype(np.uint64)
    kin = ((last * np.uint64(31) + before * np.uint64(7) + (end - start > 7)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(58)
    return ((print_ | np.uint64(RARE)) & ~np.uint64(RARE - 1)) | kin


def tokens(texts: list[bytes], rolling: Rolling) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all tokens, each text's end included, and the number in each text."""
    keys, counts, at = [], [], 0
    while at < len(texts):
        to, held = at, 0
        while to < len(texts) and (to == at or held + len(texts[to]) <= PIECE):
            held, to = held + len(texts[to]), to + 1
        part = texts[at:to]
        data = LOWERED[np.frombuffer(b" ".join([*part, b""]), np.uint8)]
        begin = np.cumsum([0, *(len(t) + 1 for t in part)])
        edge = np.diff(np.concatenate([[True], SPACE[data], [True]]).astype(np.int8))
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        n = np.bincount(np.searchsorted(begin, start, "right") - 1, minlength=len(part))[: len(part)]
        words = named(rolling.of(rolling.sums(data), start, end), data, start, end)
        keys.append(np.insert(words, np.cumsum(n), END))
        counts.append(n + 1)
        at = to
    return (np.concatenate(keys), np.concatenate(counts)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def held_out(slab: Slab) -> np.ndarray:
    return np.array([i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i in slab.ids], bool)


def slab_texts(slab: Slab) -> list[bytes]:
    return [slab.data[a:b] for a, b in zip(slab.start[:-1].tolist(), slab.start[1:].tolist(), strict=True)]


def count_tokens(slabs: DataFrame, buckets: int) -> DataFrame:
    """Written: each slab's counts, in the order of its sorted keys by bucket (slab, kind, blob);
    every bucket's sums by rare class (kind, tokens, kinds); its most frequent training tokens (key, tokens)."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for slab, _ in each_slab(batches):
            key, n = tokens(slab_texts(slab), rolling)
            train = np.repeat(~held_out(slab), n)
            names, of = np.unique(key, return_inverse=True)
            count = np.bincount(of, weights=train, minlength=len(names)).astype(np.uint64)
            bucket = ((names >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            cuts = np.searchsorted(bucket, np.arange(buckets + 1))
            full = np.flatnonzero(cuts[1:] > cuts[:-1])
            blobs = [pack([(names[cuts[b] : cuts[b + 1]], 8), (count[cuts[b] : cuts[b + 1]], 5)]) for b in full]
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([slab.slab] * len(full), pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "slab", "blob"])

    def add(table: pd.DataFrame) -> pd.DataFrame:
        parts = [unpack(b, [8, 5]) for b in table["blob"]]
        names, of = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        total = np.bincount(of, weights=np.concatenate([p[1] for p in parts]).astype(np.float64), minlength=len(names)).astype(np.uint64)
        out, at = [], 0
        for slab, p in zip(table["slab"], parts, strict=True):
            out.append((slab, int(table["bucket"].iloc[0]), pack([(total[of[at : at + len(p[0])]], 6)]), None, None, None))
            at += len(p[0])
        kin = (names & np.uint64(RARE - 1)).astype(np.int64)
        tokens_, kinds = np.bincount(kin, total, RARE).astype(np.int64), np.bincount(kin, total > 0, RARE).astype(np.int64)
        out += [(None, k, None, None, int(tokens_[k]), int(kinds[k])) for k in range(RARE)]
        most = max(SHORT, 2 * int((buckets * len(names)) ** 0.5)) + 1  # of all buckets' tokens together the model takes fewer
        top = np.argsort(total)[::-1][:most]
        out += [(None, None, None, k, c, None) for k, c in zip(names[top].view(np.int64).tolist(), total[top].tolist(), strict=True) if c]
        cols = dict(zip(["slab", "kind", "blob", "key", "tokens", "kinds"], zip(*out, strict=True), strict=True))
        return pd.DataFrame({c: list(x) if c == "blob" else pd.array(x, "Int64") for c, x in cols.items()})  # floats would round keys

    return written(by_bucket(slabs.mapInArrow(send, "bucket int, slab long, blob binary"), add,
                             "slab long, kind int, blob binary, key long, tokens long, kinds long"), "counts")


class Model:
    """Weights in float32. ``keys`` sorted; ids of words go by class, those from len(keys) on are of rare classes.
    ``tokens`` and ``kinds``: sums of all training tokens by rare class."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, tokens: np.ndarray, kinds: np.ndarray, seed: int = 5):
        order = np.argsort(keys)
        self.keys, count = keys[order], counts[order].astype(np.float64)
        n = len(keys)
        self.total, self.kinds = int(tokens.sum()), int(kinds.sum())
        own = (self.keys & np.uint64(RARE - 1)).astype(np.int64)
        rare = np.maximum(tokens - np.bincount(own, count, RARE), 0)
        self.rest = rare + np.maximum(kinds - np.bincount(own, minlength=RARE), 0) + 1
        by = np.argsort(-count, kind="stable")
        self.number = np.empty(n, np.int64)
        self.number[by] = np.arange(n)
        count = count[by]
        share = np.cumsum(np.sqrt(count)) / max(1e-9, np.sqrt(count).sum())
        many = max(32, int(n**0.5))
        used, cls = np.unique(np.minimum((share * many).astype(np.int64), many - 1), return_inverse=True)  # a class without words would hold probability
        self.classes = len(used)
        self.cls = np.concatenate([cls, self.classes + np.arange(RARE)])
        self.edge = np.searchsorted(cls, np.arange(self.classes + 1)).tolist()
        r = np.random.default_rng(seed)
        f = lambda *s: (r.standard_normal(s) * 0.1).astype(np.float32)
        self.p = {"emb": f(n + RARE, EMBED), "wx": f(EMBED, 3 * HIDDEN), "wh": f(HIDDEN, 3 * HIDDEN), "b": np.zeros(3 * HIDDEN, np.float32),
                  "wc": f(HIDDEN, self.classes + RARE), "bc": np.zeros(self.classes + RARE, np.float32), "ww": f(n + RARE, HIDDEN), "bw": np.zeros(n + RARE, np.float32)}
        self.p["bw"][:n] = np.log(count + 1)
        self.p["bc"][:] = np.log(np.concatenate([np.bincount(cls, count, self.classes), rare]) + 1)

    def ids(self, key: np.ndarray) -> np.ndarray:
        rare = len(self.keys) + (key & np.uint64(RARE - 1)).astype(np.int64)
        if not len(self.keys):
            return rare
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.number[at], rare)

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.p.values()])

    def put(self, flat: np.ndarray) -> None:
        at = 0
        for k, x in self.p.items():
            self.p[k] = flat[at : at + x.size].reshape(x.shape).astype(np.float32)
            at += x.size

    def step(self, gates_x: np.ndarray, h: np.ndarray) -> tuple:
        gh = h @ self.p["wh"]
        zr = gates_x[:, : 2 * HIDDEN] + gh[:, : 2 * HIDDEN]
        np.negative(zr, out=zr)
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        c = r * gh[:, 2 * HIDDEN :]
        c += gates_x[:, 2 * HIDDEN :]
        np.tanh(c, out=c)
        new = c - h
        new *= z
        new += h
        return new, z, r, c, gh[:, 2 * HIDDEN :]

    @staticmethod
    def softmax(logit: np.ndarray, at: np.ndarray, grad: bool) -> tuple[np.ndarray, np.ndarray]:
        """ln P of the columns ``at``, and all P for ``grad``. Rows whose sum of powers leaves float32 take their greatest off first."""
        rows = np.arange(len(at))
        own = logit[rows, at]
        with np.errstate(over="ignore"):
            e = np.exp(logit)
            total = e @ np.ones(logit.shape[1], e.dtype)
        if not (total.min() > 1e-30 and total.max() < 1e30):
            most = logit.max(1)
            own, e = own - most, np.exp(logit - most[:, None])
            total = e.sum(1)
        if grad:
            e /= total[:, None]
        return own - np.log(total), e

    def output(self, h: np.ndarray, target: np.ndarray, grad: bool = False):
        """log P of targets (of rare ones: of their class), and gradients."""
        p = self.p
        order = np.argsort(self.cls[target].astype(np.int16 if self.classes + RARE < 1 << 15 else np.int64), kind="stable")
        hs, ts = h[order], target[order]
        cls = self.cls[ts]
        out = np.empty(len(h), h.dtype)
        g = {k: np.zeros_like(p[k]) for k in ("wc", "bc", "ww", "bw")} if grad else None
        dh = np.empty_like(hs) if grad else None
        for a in range(0, len(hs), OUTPUT):
            x, c = hs[a : a + OUTPUT], cls[a : a + OUTPUT]
            logit = x @ p["wc"]
            logit += p["bc"]
            out[a : a + OUTPUT], d = self.softmax(logit, c, grad)
            if grad:
                d[np.arange(len(c)), c] -= 1
                g["wc"] += x.T @ d
                g["bc"] += d.sum(0)
                dh[a : a + OUTPUT] = d @ p["wc"].T
        cuts = np.searchsorted(cls, np.arange(self.classes + 1)).tolist()
        for c in range(self.classes):
            lo, hi = self.edge[c], self.edge[c + 1]
            for a in range(cuts[c], cuts[c + 1], OUTPUT) if hi > lo + 1 else ():
                s = np.s_[a : min(a + OUTPUT, cuts[c + 1])]
                logit = hs[s] @ p["ww"][lo:hi].T
                logit += p["bw"][lo:hi]
                at = ts[s] - lo
                more, d = self.softmax(logit, at, grad)
                out[s] += more
                if grad:
                    d[np.arange(len(at)), at] -= 1
                    g["ww"][lo:hi] += d.T @ hs[s]
                    g["bw"][lo:hi] += d.sum(0)
                    dh[s] += d @ p["ww"][lo:hi]
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return (out[back], g, dh[back]) if grad else out[back]

    def window(self, source: np.ndarray, target: np.ndarray, first: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, dict, np.ndarray]:
        """ln P of the targets (lane, step), the gradients of minus their sum, and the state that is carried on.
        ``first``: tokens that begin a document, before which the state is emptied."""
        lanes, steps = source.shape
        past, hs = [], []
        x = self.p["emb"][source]
        gx = x @ self.p["wx"] + self.p["b"]
        for k in range(steps):
            if first[:, k].any():
                h = h * ~first[:, k, None]
            new, *rest = self.step(gx[:, k], h)
            past.append((h, *rest))
            hs.append(new)
            h = new
        out, g, dh = self.output(np.stack(hs, 1).reshape(-1, HIDDEN), target.ravel(), True)
        dh = dh.reshape(lanes, steps, HIDDEN)
        dgx, dgh, back, turned = np.empty_like(gx), np.empty_like(gx), np.zeros((lanes, HIDDEN), gx.dtype), self.p["wh"].T.copy()
        for k in reversed(range(steps)):
            h0, z, r, c, ghc = past[k]
            d = dh[:, k] + back
            dz = d * z
            keep = d - dz
            dc = dz * (1 - c * c)
            keep_z = (c - h0) * keep
            keep_z *= z
            dr = dc * r
            dgx[:, k, :HIDDEN], dgx[:, k, HIDDEN : 2 * HIDDEN], dgx[:, k, 2 * HIDDEN :] = keep_z, dr * ghc * (1 - r), dc
            dgh[:, k, : 2 * HIDDEN], dgh[:, k, 2 * HIDDEN :] = dgx[:, k, : 2 * HIDDEN], dr
            back = dgh[:, k] @ turned
            back += keep
            if first[:, k].any():
                back *= ~first[:, k, None]
        g["wh"] = np.stack([step[0] for step in past], 1).reshape(-1, HIDDEN).T @ dgh.reshape(-1, 3 * HIDDEN)
        flat = dgx.reshape(-1, 3 * HIDDEN)
        g["wx"], g["b"] = x.reshape(-1, EMBED).T @ flat, flat.sum(0)
        cells = (source.reshape(-1, 1) * EMBED + np.arange(EMBED)).ravel()
        g["emb"] = np.bincount(cells, (flat @ self.p["wx"].T).ravel(), self.p["emb"].size).reshape(-1, EMBED).astype(gx.dtype)
        return out, g, h

    def train(self, docs: list[np.ndarray], rate: float, moments: dict) -> int:
        """One pass over ``docs``, ids of each document's tokens, the end last; returns the tokens trained on.
        ``moments``: Adam's, kept from call to call."""
        if not docs:
            return 0
        end = int(self.ids(np.array([END]))[0])
        target, first = np.concatenate(docs), np.concatenate([np.arange(len(d)) == 0 for d in docs])
        source = np.where(first, end, np.concatenate([[end], target[:-1]]))
        lanes = min(LANES, max(1, len(target) // STEPS))
        seen, n = len(target), -(-len(target) // lanes)
        cut = lambda x: np.resize(x, (lanes, n))  # noqa: E731  (what the last lane lacks is filled from the first one)
        target, first, source = cut(target), cut(first), cut(source)
        h = np.zeros((lanes, HIDDEN), np.float32)
        for at in range(0, n, STEPS):
            s = np.s_[:, at : at + STEPS]
            _, g, h = self.window(source[s], target[s], first[s], h)
            for k, x in g.items():
                x = np.clip(x / np.float32(lanes), -1, 1)
                m, v = moments.setdefault(k, (np.zeros_like(x), np.zeros_like(x)))
                m += np.float32(0.1) * (x - m)
                v += np.float32(0.01) * (x * x - v)
                self.p[k] -= np.float32(rate) * m / (np.sqrt(v) + np.float32(1e-4))
        return seen

    def score(self, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
        """ln P of every token (of rare ones: of their class); ``n``: tokens of each document."""
        end = int(self.ids(np.array([END]))[0])
        base = np.cumsum(n) - n
        lanes = max(1, min(SCORED, len(n)))
        load, where, begin = [0] * lanes, np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        heap = [(0, k) for k in range(lanes)]
        for d in np.argsort(-n, kind="stable").tolist():
            have, k = heapq.heappop(heap)
            where[d], begin[d] = k, have
            heapq.heappush(heap, (have + int(n[d]), k))
            load[k] = have + int(n[d])
        order = np.argsort(-np.array(load), kind="stable")  # long lanes first, so that the live ones are a prefix
        rank = np.empty(lanes, np.int64)
        rank[order] = np.arange(lanes)
        live = np.array(load)[order]
        height = int(live[0])
        # tokens by time and, within it, by lane: cells are as many as tokens, however long one lane is
        wide = np.searchsorted(-live, -np.arange(height)).tolist()  # lanes longer than t
        edge = np.cumsum([0, *wide])
        place = edge[np.repeat(begin - base, n) + np.arange(len(ids))] + np.repeat(rank[where], n)
        source = np.concatenate([[end], ids[:-1]])
        source[base] = end
        fed, aim = np.empty_like(ids), np.empty_like(ids)
        fed[place], aim[place] = source, ids
        fresh = np.zeros(height, bool)
        fresh[begin] = True
        starts = np.zeros(len(ids), bool)
        starts[place[base]] = True
        table = self.p["emb"] @ self.p["wx"] + self.p["b"]
        out = np.empty(len(ids), np.float32)
        h = np.zeros((lanes, HIDDEN), np.float32)
        edge, fresh, t = edge.tolist(), fresh.tolist(), 0
        while t < height:
            first, hs = edge[t], []
            while t < height and edge[t] - first < 4 * OUTPUT:
                s = np.s_[edge[t] : edge[t + 1]]
                h = h[: wide[t]]
                if fresh[t]:
                    h = h * ~starts[s, None]
                h = self.step(table[fed[s]], h)[0]
                hs.append(h)
                t += 1
            out[first : edge[t]] = self.output(np.concatenate(hs), aim[first : edge[t]])
        return out[place]


def round_of(slab: Slab, rounds: int) -> np.ndarray:
    """The round that each training document is trained in; -1: held out."""
    return np.where(held_out(slab), -1, np.array([zlib.crc32(f"{i}:lm".encode()) % rounds for i in slab.ids], np.int64))


def averaged(slabs: DataFrame, model: Model, number: int, rounds: int) -> np.ndarray | None:
    """The weights after round ``number``, averaged over partitions by the tokens that each trained on."""
    shared = slabs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))  # by value: a broadcast is pickled by reference

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rolling, seen, moments = pickle.loads(shared.value), Rolling(), 0, {}
        for slab, _ in each_slab(batches):
            texts = [t for t, r in zip(slab_texts(slab), round_of(slab, rounds).tolist(), strict=True) if r == number]
            key, n = tokens(texts, rolling)
            seen += own.train(np.split(own.ids(key), np.cumsum(n)[:-1]) if len(n) else [], RATES[min(number, len(RATES) - 1)], moments)
        if seen:
            pieces = [x.astype("<f8").tobytes() for x in np.array_split(own.flat().astype(np.float64) * seen, PARTS)]
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([task] * PARTS, pa.int32()), pa.array([seen] * PARTS, pa.int64()), pa.array(pieces, pa.binary())],
                                             names=["part", "task", "seen", "blob"])

    def add(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("task")
        total = sum(np.frombuffer(b, "<f8") for b in table["blob"])
        return pd.DataFrame({"part": table["part"].iloc[:1], "task": table["task"].iloc[:1], "seen": [table["seen"].sum()], "blob": [total.tobytes()]})

    schema = "part int, task int, seen long, blob binary"
    sums = slabs.mapInArrow(train, schema)
    for keys in (["part", F.pmod("task", F.lit(TREE))], ["part"]):
        sums = sums.groupBy(*keys).applyInPandas(add, schema)
    got = sorted(sums.collect(), key=lambda r: r["part"])  # one model's weights
    return np.concatenate([np.frombuffer(r["blob"], "<f8") / r["seen"] for r in got]) if got else None


def learn(slabs: DataFrame, counts: DataFrame, rounds: int = ROUNDS) -> Model:
    """The vocabulary from ``counts`` and weights trained on all training documents, each in one of ``rounds``."""
    by = {r["kind"]: (r["t"], r["k"]) for r in counts.where("slab is null and key is null").groupBy("kind").agg(F.sum("tokens").alias("t"), F.sum("kinds").alias("k")).collect()}
    sums, kinds = (np.array([int(by.get(k, (0, 0))[j] or 0) for k in range(RARE)], np.int64) for j in (0, 1))
    short = max(SHORT, int(kinds.sum() ** 0.5))
    top = counts.where("key is not null").select("key", "tokens").orderBy(F.col("tokens").desc(), "key").limit(short).collect()
    model = Model(np.array([r[0] for r in top], np.int64).view(np.uint64), np.array([r[1] for r in top], np.int64), sums, kinds)
    for number in range(rounds if len(top) else 0):
        weights = averaged(slabs, model, number, rounds)
        if weights is not None:
            model.put(weights)
    return model


def score_documents(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10)."""
    docs = docs.select("doc_id", "text")
    own = buckets_for(docs)
    slabs = slab_table(docs)
    counts = count_tokens(slabs, ranges_for(docs))
    shared = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(learn(slabs, counts, rounds)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, model = Rolling(), pickle.loads(shared.value)
        for slab, more in each_slab(batches):
            key, n = tokens(slab_texts(slab), rolling)
            names, of = np.unique(key, return_inverse=True)
            replies = sorted(more["replies"] or (), key=lambda r: r["kind"])
            count = np.concatenate([unpack(r["blob"], [6])[0] for r in replies]).astype(np.float64)[of]
            at = np.cumsum(n) - n
            base = np.add.reduceat(np.log10((count + 1) / (model.total + model.kinds + 1)), at)
            ids = model.ids(key)
            each = model.score(ids, n).astype(np.float64) / np.log(10)
            rare = ids >= len(model.keys)
            each[rare] += np.log10((count[rare] + 1) / model.rest[ids[rare] - len(model.keys)])
            cols = [pa.array(slab.ids, pa.int64()), pa.array(held_out(slab)), pa.array(n, pa.int64()), pa.array(np.add.reduceat((count > 0).astype(np.int64), at), pa.int64()),
                    pa.array(np.full(len(n), model.total), pa.int64()), pa.array(base), pa.array(np.add.reduceat(each, at))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    replies = counts.where("slab is not null").select("slab", "kind", "blob")
    return with_replies(slabs, replies, own).mapInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op6_gru_lm(spark, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
