"""Suffix-array dedup by prefix-free parsing.

A rolling hash marks triggers: of the 18-byte strings inside a 50-byte window, the one with
the least hash (the leftmost of equal ones). Equal windows have equal triggers wherever they
stand, and every window has one. A phrase is a maximal run of windows with one trigger, with
the bytes they cover; phrases cut a text as rolling-hash triggers cut it in prefix-free
parsing, save that no stretch is left without a trigger.

1. Parse. Every slab sends its distinct phrases (trigger, phrase fingerprint, least doc_id). A
   worker sorts a range of triggers, so occurrences of a phrase stand together and each learns
   whether a smaller document holds it whole.
2. Dictionary and parse meet. Phrases that share a trigger but differ (the ends of a repeat) are
   sent once from the first document that holds each. A phrase's dictionary part ends with the
   trigger, its parse part begins there. The suffix array of the dictionary parts (all their suffixes
   that hold the trigger, by a sort of the reversed parts and its LCP array) tells which suffixes
   are equal; the suffix array of the parse parts (a sort and its LCP array) gives the order of
   what follows. For each suffix, its occurrences in the order of the parse are the corpus order;
   neighbours whose suffix and common continuation reach 50 bytes are one repeated string, and
   its least doc_id decides. All of this compares bytes.
   A trigger with over ``many`` different phrases is parted by the 16 bytes beside it: of the
   windows that hold it, those with 16 bytes before it go by these, the others by the 16 after it.
3. The spans of both steps meet in the slab and are merged.

Phrases are equal when 88 bits of hashes modulo a prime are, which isn't verified on bytes.
Null texts are empty; texts under 50 bytes lose nothing; rows with the same doc_id do
not make each other repeats; a null doc_id counts as larger than any other. Very long texts are
parsed in overlapping parts of 4 MB.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, ranges_for, written
from .slabs import Rolling, Slab, by_bucket, each_slab, mix, pack, signed, slab_table, unpack, with_replies

GRAM = 18
PIECE = 1 << 19
LONGEST = 4 << 20
LOW = np.uint64((1 << 26) - 1)
#: Different phrases of one trigger beyond which they are dealt by the bytes beside it.
MANY, BESIDE = 2048, 16
PARSE, DICTIONARY, CROWD = 0, 1, 2
#: The windows of a phrase that a record is for: all, those with BESIDE bytes before the trigger, the others.
WHOLE, BEFORE, AFTER = 0, 1, 2
RECORD = [4, 1, 1, 4, 4, 8]  # bytes of size, left, half, doc, start, number


def pieces(slab: Slab, depth: int) -> Iterator[list[tuple[int, int, int]]]:
    """(document, from, to) in lists of about PIECE bytes; very long documents in overlapping parts."""
    out, held = [], 0
    for d, n in enumerate(slab.size.tolist()):
        for at in range(0, n, LONGEST):
            to = min(n, at + LONGEST + depth - 1)
            if to - at < depth:
                continue
            if out and held + to - at > PIECE:
                yield out
                out, held = [], 0
            out.append((d, at, to))
            held += to - at
    if out:
        yield out


def phrases(slab: Slab, rolling: Rolling, depth: int) -> Iterator[dict]:
    """For each list of pieces: its bytes, hash sums and phrases (trigger, key, document, span)."""
    width = depth - GRAM + 1
    for part in pieces(slab, depth):
        data = np.frombuffer(b"".join(slab.data[slab.start[d] + a : slab.start[d] + b] for d, a, b in part), np.uint8)
        sizes = np.array([b - a for _, a, b in part])
        starts = np.concatenate([[0], np.cumsum(sizes)])
        sums = rolling.sums(data)
        n = len(data) - GRAM + 1
        grams = mix(rolling.lane(0, sums, slice(0, n), slice(GRAM, n + GRAM)) * np.uint64(0x9E3779B97F4A7C15))
        value = (grams & ~LOW) | np.arange(n, dtype=np.uint64)
        least, step = value, 1
        while step * 2 <= width:
            least, step = np.minimum(least[:-step], least[step:]), step * 2
        n = len(value) - width + 1
        trigger = (np.minimum(least[:n], least[width - step : width - step + n]) & LOW).astype(np.int64)
        where = np.repeat(np.arange(len(part)), sizes)[:n]
        whole = np.arange(n) + depth <= starts[where + 1]
        cut = np.empty(n, bool)
        cut[0] = True
        cut[1:] = (trigger[1:] != trigger[:-1]) | (where[1:] != where[:-1]) | (whole[1:] != whole[:-1])
        first = np.flatnonzero(cut)
        last = np.append(first[1:], n)
        keep = whole[first]
        first, last = first[keep], last[keep]
        fingerprint = rolling.of(sums, first, last + depth - 1)
        doc = np.array([d for d, _, _ in part])[where[first]]
        shift = (np.array([a for _, a, _ in part]) - starts[:-1])[where[first]]
        at = trigger[first]
        high = rolling.of(sums, at, at + GRAM) >> np.uint64(24)
        yield {"data": data, "sums": sums, "trigger": high, "at": at, "doc": doc, "first": first, "last": last, "shift": shift,
               "key": (fingerprint & ~np.uint64(0xFFFF)) | (high & np.uint64(0xFFFF))}


def joined(parts: list[dict], name: str) -> np.ndarray:
    return np.concatenate([p[name] for p in parts]) if parts else np.zeros(0, np.int64)


def groups(*keys: np.ndarray) -> np.ndarray:
    """True where a sorted row differs from the one before it in any key."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def rows(table: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    columns = list(zip(*table, strict=True)) if table else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def dealt(bucket: np.ndarray, n: int) -> Iterator[tuple[int, slice]]:
    """The slices of a sorted array of buckets."""
    edges = np.searchsorted(bucket, np.arange(n + 1))
    for b in np.flatnonzero(edges[1:] > edges[:-1]):
        yield int(b), slice(edges[b], edges[b + 1])


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal spans; spans that touch become one."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    if not len(doc):
        return doc, start, end
    base = doc * (1 << 40)
    reach = np.maximum.accumulate(base + end)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (base[1:] + start[1:] > reach[:-1])
    at = np.flatnonzero(new)
    return doc[at], start[at], np.maximum.reduceat(reach, at) - base[at]


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of bytes, and how many leading bytes each shares with the one before it (0 for the first)."""
    words = np.zeros((len(text), -(-text.shape[1] // 8) * 8), np.uint8)
    words[:, : text.shape[1]] = text
    order = np.lexsort(words.view(">u8").astype(np.uint64).T[::-1])
    text = text[order]
    differ = text[1:] != text[:-1]
    common = np.where(differ.any(1), differ.argmax(1), text.shape[1])
    return order, np.concatenate([[0], common])


def repeats(data: np.ndarray, size: np.ndarray, left: np.ndarray, half: np.ndarray, number: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of ``depth`` bytes that also stand in a phrase of a smaller number: (phrase, place in it).

    Phrases are consecutive in ``data``; the first ``left`` bytes of each end with its trigger.
    """
    begin = np.cumsum(size) - size

    def part(first: np.ndarray, step: int, n: np.ndarray) -> np.ndarray:
        """Up to ``depth`` bytes from ``first`` on, in either direction, zeros after ``n``."""
        out = np.zeros((len(n), depth), np.uint8)
        for k in range(depth):
            rows = np.flatnonzero(n > k)
            out[rows, k] = data[first[rows] + step * k]
        return out

    dictionary = part(begin + left - 1, -1, left)
    parse = part(begin + left - GRAM, 1, size - left + GRAM)
    d_order, d_common = suffix_array(dictionary)
    p_order, p_common = suffix_array(parse)
    suffix, following = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
    found, at = [], []
    for r in range(GRAM, depth + 1):  # the suffix's length: a window has r bytes up to the trigger's end
        suffix[d_order] = np.cumsum(d_common < r)
        following[p_order] = np.cumsum(p_common < depth - r + GRAM)
        ok = (r <= left) & (left - r + depth <= size) & ((half == WHOLE) | ((half == BEFORE) == (r >= GRAM + BESIDE)))
        own = p_order[ok[p_order]]
        own = own[np.argsort(suffix[own], kind="stable")]  # the corpus order of these suffixes
        if not len(own):
            continue
        new = groups(suffix[own], following[own])
        least = np.minimum.reduceat(number[own], np.flatnonzero(new))
        later = own[number[own] > least[np.cumsum(new) - 1]]
        found.append(later)
        at.append(left[later] - r)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *found]), np.concatenate([none, *at])


def repeated_spans(slabs: DataFrame, own: int, buckets: int, depth: int = 50, many: int = MANY) -> DataFrame:
    """(slab, kind, blob): packed spans of each slab that a smaller document holds. ``own``: the
    slab table's buckets; ``buckets``: ranges of triggers."""
    fields = [pa.int32(), pa.int64(), pa.binary()]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for slab, _ in each_slab(batches):
            parts = [{k: p[k] for k in ("trigger", "key", "doc")} for p in phrases(slab, rolling, depth)]
            if not parts:
                continue
            trigger, key, doc = (joined(parts, k) for k in ("trigger", "key", "doc"))
            doc = slab.order_id[doc]
            order = np.lexsort((doc, key, trigger))
            trigger, key, doc = trigger[order], key[order], doc[order]
            new = groups(trigger, key)
            trigger, key, doc = trigger[new], key[new], doc[new]
            bucket = (trigger * np.uint64(buckets)) >> np.uint64(40)
            yield rows([(b, slab.slab, pack([(trigger[s], 5), (key[s] >> np.uint64(16), 6), (doc[s].view(np.uint64), 8)]))
                        for b, s in dealt(bucket, buckets)], ["bucket", "slab", "blob"], fields)

    def parse_order(table: pd.DataFrame) -> pd.DataFrame:
        cols = [unpack(b, [5, 6, 8]) for b in table["blob"]]
        slab = np.repeat(table["slab"].to_numpy(), [len(c[0]) for c in cols])
        trigger, key, doc = (np.concatenate(c) for c in zip(*cols, strict=True))
        doc = signed(doc)
        order = np.lexsort((doc, key, trigger))
        trigger, key, doc, slab = trigger[order], key[order], doc[order], slab[order]
        new = groups(trigger, key)
        at = np.flatnonzero(new)
        phrase = np.cumsum(new) - 1
        least = doc[at]  # of each phrase
        top = groups(trigger[at])
        of = np.cumsum(top) - 1
        edge = np.flatnonzero(top)
        differ = np.minimum.reduceat(least, edge) != np.maximum.reduceat(least, edge)
        count = np.diff(np.append(edge, len(at)))
        later = doc > least[phrase]
        ask = ~later & differ[of][phrase]
        crowd = (count > many)[of][phrase]
        out = []
        for kind, pick in ((PARSE, later), (DICTIONARY, ask & ~crowd), (CROWD, ask & crowd)):
            pick = np.flatnonzero(pick)
            pick = pick[np.argsort(slab[pick], kind="stable")]
            for s in np.split(pick, np.flatnonzero(np.diff(slab[pick])) + 1):
                if len(s):
                    out.append((slab[s[0]], kind, pack([(trigger[s] & np.uint64(0xFFFF), 2), (key[s], 6), (least[phrase[s]].view(np.uint64), 8)])))
        return pd.DataFrame(out, columns=["slab", "kind", "blob"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for slab, more in each_slab(batches):
            told = {PARSE: [], DICTIONARY: [], CROWD: []}
            for r in more["replies"] or ():
                low, key, doc = unpack(r["blob"], [2, 6, 8])
                told[r["kind"]].append(((key << np.uint64(16)) | low, signed(doc)))
            told = {k: [np.concatenate(x) for x in zip(*v, strict=True)] or [np.zeros(0, np.uint64), np.zeros(0, np.int64)] for k, v in told.items()}
            parts = list(phrases(slab, rolling, depth))
            if not parts:
                continue
            key, doc = joined(parts, "key"), joined(parts, "doc")
            number = slab.order_id[doc]
            names, of = np.unique(key, return_inverse=True)
            least = np.full(len(names), (1 << 63) - 1, np.int64)
            np.minimum.at(least, of, number)
            if len(told[PARSE][0]):
                at = np.searchsorted(names, told[PARSE][0])
                np.minimum.at(least, at, told[PARSE][1])
            later = number > least[of]
            shift, first, last = (joined(parts, k) for k in ("shift", "first", "last"))
            start, end = first + shift, last + shift + depth - 1
            d, a, b = merged(doc[later], start[later], end[later])
            out = [(-1, slab.slab, pack([(d, 4), (a, 4), (b, 4)]), PARSE)] if len(d) else []
            source = np.repeat(np.arange(len(parts)), [len(p["first"]) for p in parts])
            for kind in (DICTIONARY, CROWD):
                if not len(told[kind][0]):
                    continue
                wanted = np.zeros(len(names), bool)
                wanted[np.searchsorted(names, told[kind][0])] = True
                pick = np.flatnonzero(wanted[of] & ~later)
                for p in np.unique(source[pick]):
                    own = pick[source[pick] == p]
                    out += [(b, slab.slab, x, kind) for b, x in records(parts[p], rolling, own, kind, own - np.flatnonzero(source == p)[0], doc, start, number)]
            if out:
                yield rows([(b, s, k, x) for b, s, x, k in out], ["bucket", "slab", "kind", "blob"], [pa.int32(), pa.int64(), pa.int32(), pa.binary()])

    def records(part: dict, rolling: Rolling, own: np.ndarray, kind: int, at: np.ndarray, doc: np.ndarray, start: np.ndarray, number: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """(bucket, blob) of the phrases ``own``, which are ``at`` in their part."""
        first, last, mark, text = part["first"][at], part["last"][at], part["at"][at], part["data"].tobytes()
        if kind == DICTIONARY:
            halves = [(np.arange(len(own)), WHOLE, part["trigger"][at])]
        else:
            before, after = np.flatnonzero(first <= mark - BESIDE), np.flatnonzero(last > mark - BESIDE + 1)
            halves = [(k, half, rolling.of(part["sums"], mark[k] - (BESIDE if half == BEFORE else 0), mark[k] + GRAM + (BESIDE if half == AFTER else 0)) >> np.uint64(24))
                      for k, half in ((before, BEFORE), (after, AFTER))]
        for k, half, key in halves:
            bucket = ((key * np.uint64(buckets)) >> np.uint64(40)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            for b, s in dealt(bucket[order], buckets):
                o = k[order[s]]
                head = pack([(last[o] - first[o] + depth - 1, 4), (mark[o] + GRAM - first[o], 1), (np.full(len(o), half), 1), (doc[own[o]], 4), (start[own[o]], 4), (number[own[o]].view(np.uint64), 8)])
                yield b, len(o).to_bytes(4, "little") + head + b"".join(text[x : y + depth - 1] for x, y in zip(first[o].tolist(), last[o].tolist(), strict=True))

    def combine(table: pd.DataFrame) -> pd.DataFrame:
        heads, bytes_ = [], []
        for blob in table["blob"]:
            n, width = int.from_bytes(blob[:4], "little"), sum(RECORD)
            heads.append([c.astype(np.int64) for c in unpack(blob[4 : 4 + width * n], RECORD)])
            bytes_.append(np.frombuffer(blob, np.uint8, offset=4 + width * n))
        slab = np.repeat(table["slab"].to_numpy(), [len(h[0]) for h in heads])
        size, left, half, doc, start, number = (np.concatenate(c) for c in zip(*heads, strict=True))
        data = np.concatenate(bytes_)
        hit, at = repeats(data, size, left, half, number, depth)
        out = []
        hit, at = (x[np.argsort(slab[hit], kind="stable")] for x in (hit, at))
        for s in np.split(np.arange(len(hit)), np.flatnonzero(np.diff(slab[hit])) + 1):
            if len(s):
                d, a, b = merged(doc[hit[s]], start[hit[s]] + at[s], start[hit[s]] + at[s] + depth)
                out.append((slab[hit[s[0]]], PARSE, pack([(d, 4), (a, 4), (b, 4)])))
        return pd.DataFrame(out, columns=["slab", "kind", "blob"])

    sent = slabs.mapInArrow(send, "bucket int, slab long, blob binary")
    told = by_bucket(sent, parse_order, "slab long, kind int, blob binary")
    answers = written(with_replies(slabs, told, own).mapInArrow(answer, "bucket int, slab long, kind int, blob binary"), "phrases")
    spans = by_bucket(answers.where("bucket >= 0"), combine, "slab long, kind int, blob binary")
    return answers.where("bucket < 0").select("slab", "kind", "blob").unionByName(spans)


def suffix_dedup(docs: DataFrame, depth: int = 50, kept: bool = True, buckets: int | None = None, many: int = MANY) -> DataFrame:
    """Removes every byte covered by a ``depth``-byte string that also starts in a document
    with a smaller doc_id.

    Returns doc_id, n_bytes, n_removed, n_spans, spans (start and end in bytes), kept_sha256
    and, if ``kept``, the bytes that stay. One row for each row of ``docs``.
    """
    slabs = slab_table(docs)
    own = buckets_for(docs)
    spans = repeated_spans(slabs, own, buckets or 4 * ranges_for(docs), depth, many)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab, more in each_slab(batches):
            got = [unpack(r["blob"], [4, 4, 4]) for r in more["replies"] or ()]
            doc, start, end = (np.concatenate(x).astype(np.int64) for x in zip(*got, strict=True)) if got else (np.zeros(0, np.int64),) * 3
            doc, start, end = merged(doc, start, end)
            edge = np.searchsorted(doc, np.arange(len(slab.ids) + 1))
            out = []
            for d, i in enumerate(slab.ids):
                base, to = slab.start[d], slab.start[d + 1]
                s, e = start[edge[d] : edge[d + 1]].tolist(), end[edge[d] : edge[d + 1]].tolist()
                left = b"".join(slab.data[base + x : base + y] for x, y in zip([0, *e], [*s, to - base], strict=True))
                out.append((i, int(to - base), int(to - base) - len(left), len(s), [{"start": x, "end": y} for x, y in zip(s, e, strict=True)], hashlib.sha256(left).hexdigest(), left if kept else None))
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield rows(out, ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept_sha256", "kept"],
                       [pa.int64(), pa.int64(), pa.int64(), pa.int64(), span, pa.string(), pa.binary()])

    return with_replies(slabs, spans, own).mapInArrow(
        cut, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept_sha256 string, kept binary")


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return suffix_dedup(docs, kept=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
