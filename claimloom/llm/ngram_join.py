"""N-gram Jaccard join over a prefix tree.

1. Every document becomes its set of word shingles; equal sets are one class, carried on by
   its smallest doc_id. A table of fixed size counts shingles over all documents (by hash), which
   gives the global order.
2. Candidates by the pigeonhole principle: sets that link differ in at most d shingles, so of
   more than d parts, dealt by hash, one is equal in both (``part_tokens``). Such a part holds
   several shingles, so a passage shared by otherwise different texts brings none together.
   Below a threshold of ``PARTS_FROM`` parts get too small; there the tokens are the rarest
   shingles instead, one of which sets that overlap enough share (``prefix_tokens``).
   Workers chain the classes that share a token, in order of size, as long as neighbours'
   sizes allow a link. A slab chains its own and sends the ends of each chain and, between them,
   the least and the greatest size of each band of sizes that allow a link, so a class of another
   slab that may link with any of them finds a neighbour, and a token's load is bounded by the
   number of slabs and bands. Chains connect into blocks of classes that may link.
   Candidates that can't link are told apart without their texts: a set's shingles, dealt by hash, leave an
   even or odd number in each place, and sets differ in at least as many shingles as there are places that
   differ. Classes of a block that such bits (``parities``) leave together are the blocks of what follows.
3. In a block, sets go into a prefix tree in global order, most frequent shingle first, which
   is what near copies share. A set walks the tree with the overlap so far; a subtree is
   left when the shingles that remain on either side can't reach the threshold, or when it
   belongs to the set's component already. The first sets walk alone, the later ones together.
   Texts that link are compared by their words' bytes too; hashes only name words and shingles.
4. A block beyond ``block_rows`` classes or ``block_shingles`` shingles is split into parts, each with
   a few representatives of the block, so most of a group of near copies is one component after
   this round. A second round compares the classes outside the block's largest component, which are
   few as a rule, with all others in parts, knowing the components; so no link is lost. Texts
   travel twice for a group of near copies of any size, and once more for each ``block_rows`` loose classes.
5. Components of all links; every member of a class gets the smallest doc_id. Classes are told apart
   by 128 bits of hashes modulo a prime, and numbered, so nothing rests on fewer bits.

A link needs 100 * intersection >= percent * union. Fewer words than a shingle make one
shingle of them all; null texts and texts without words have an empty set and link with
nothing. Rows with equal doc_id are one document each; a null doc_id counts as the largest.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, ranges_for, salted_join, settings, written
from .graph import components
from .slabs import NO_ID, Rolling, mix, pack, unpack

#: A fine table tells rare shingles from common ones and keeps blocks small: 2^22 counts are 16 MB.
SKETCH_BITS = 22
#: Pieces that a task's table of counts is sent in, and groups of tasks whose counts are added first.
COUNT_PARTS, COUNT_TREE = 64, 16
#: Texts that go to a worker at once: Spark's 10,000 are tens of MB in the worker and, as an Arrow batch, beside the executor's heap.
ROWS_AT_ONCE = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500"}
#: From this similarity on, parts hold enough shingles to tell more than the rarest ones do.
PARTS_FROM = 85
#: Ways to deal a set's shingles into parts, tried in turn where one leaves many parts empty.
SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
PIECE = 1 << 19
#: Sets that walk the prefix tree together, the cells of their table, and the shingles looked up at once.
WALKERS, WALK_CELLS, STEP_CELLS = 128, 1 << 25, 1 << 20
#: Classes of a split block that every part of it holds.
REPRESENTATIVES = 4
#: Whitespace (fixed values).
SPACE = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
LOWERED = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


#: Ids of texts that blocks need, 8 bytes each, that are broadcast at once so that no other text is shuffled.
NAMED = 1 << 20
#: Least and greatest places of ``parities`` (as powers of two), and classes that are told apart in one group.
PLACES, MARKED = (6, 16), 2048


@functools.cache
def _tables() -> Rolling:
    return Rolling()


def tables() -> Rolling:
    """A worker's tables of powers: blocks are many and small, so they share them unless a long text has made them large."""
    if _tables().up.shape[1] > 4 * PIECE:
        _tables.cache_clear()
    return _tables()


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[True], SPACE[data], [True]]).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def shingled(word: np.ndarray, size: int) -> np.ndarray:
    """Hash of the shingle that begins at each word; the last ``size - 1`` have none."""
    value = word.copy()
    for k in range(1, size):
        value[: len(word) - k] = mix(value[: len(word) - k] * np.uint64(0x9E3779B97F4A7C15) + word[k:])
    return value


def shingle_sets(texts: list[bytes], size: int, rolling: Rolling) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, and where each text's begin (sorted within a text)."""
    data = LOWERED[np.frombuffer(b" ".join([*texts, b""]), np.uint8)]
    begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    start, end = word_bounds(data)
    word = rolling.of(rolling.sums(data), start, end)
    doc = np.searchsorted(begin, start, "right") - 1
    n = np.bincount(doc, minlength=len(texts))
    value = shingled(word, size)
    last = np.arange(len(word)) - (np.cumsum(n) - n)[doc]
    keep = last <= np.maximum(n[doc] - size, 0)
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        at = (np.cumsum(n) - n)[short]
        value[at] = [_whole(word[a : a + m]) for a, m in zip(at, n[short], strict=True)]
    value, doc = value[keep & ((n[doc] >= size) | (last == 0))], doc[keep & ((n[doc] >= size) | (last == 0))]
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    return value[new], np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=len(texts)))])


def same_strings(data: np.ndarray, start: np.ndarray, end: np.ndarray, name: np.ndarray) -> tuple[bool, np.ndarray]:
    """Whether strings of one name are equal, eight bytes at a time; and a string of each name."""
    order = np.argsort(name)
    again = name[order[1:]] == name[order[:-1]]
    first = order[np.append(True, ~again)] if len(name) else order
    a, b = order[1:][again], order[:-1][again]
    n, at = end - start, start.copy()
    if (n[a] != n[b]).any():
        return False, first
    words = np.ndarray(len(data), "<u8", np.append(data, np.zeros(8, np.uint8)).tobytes(), strides=(1,))
    left = n[a]
    while len(a):
        mask = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(8) * (np.uint64(8) - np.minimum(left, 8).astype(np.uint64)))
        if ((words[at[a]] ^ words[at[b]]) & mask).any():
            return False, first
        more = left > 8
        a, b, left = a[more], b[more], left[more] - 8
        at += 8
        at[at >= len(data)] = 0  # of strings that have ended
    return True, first


def same_rows(name: np.ndarray, rows: np.ndarray) -> tuple[bool, np.ndarray]:
    """Whether rows of one name are equal; and a row of each name."""
    order = np.argsort(name)
    again = name[order[1:]] == name[order[:-1]]
    return bool((rows[order[1:][again]] == rows[order[:-1][again]]).all()), order[np.append(True, ~again)] if len(name) else order


def names_hold(texts: list[bytes], size: int, rolling: Rolling) -> bool:
    """Whether in these texts equal hashes mean equal words, and equal shingle hashes equal words in turn."""
    kept, names, rows = [], [], []
    for _, group in pieces_of(texts):
        data = LOWERED[np.frombuffer(b" ".join([*group, b""]), np.uint8)]
        start, end = word_bounds(data)
        word = rolling.of(rolling.sums(data), start, end)
        ok, first = same_strings(data, start, end, word)
        if not ok:
            return False
        kept += [data[a:b].tobytes() for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
        n = len(word) - size + 1
        if n > 0:  # shingles over the edge of two texts do no harm
            name, row = shingled(word, size)[:n], np.stack([word[k : n + k] for k in range(size)], 1)
            ok, first = same_rows(name, row)
            if not ok:
                return False
            names.append(name[first])
            rows.append(row[first])
    if len(names) < 2:
        return True
    data = np.frombuffer(b" ".join([*kept, b""]), np.uint8)
    start, end = word_bounds(data)
    return same_strings(data, start, end, rolling.of(rolling.sums(data), start, end))[0] and same_rows(np.concatenate(names), np.concatenate(rows))[0]


def plain_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Shingle sets by numbers given to the words themselves, for texts whose hashes collide."""
    names: dict = {}
    out = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0d]+", t.translate(LOWERED.tobytes()))
        grams = [tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))] if w else []
        out.append(np.unique(np.array([names.setdefault(g, len(names)) for g in grams], np.uint64)))
    return out


def set_prints(value: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit fingerprints of each set."""
    out = []
    for factor in (1, 0xC2B2AE3D27D4EB4F):
        total = np.zeros(len(value) + 1, np.uint64)
        np.cumsum(mix(value * np.uint64(factor)), out=total[1:])
        out.append(mix(total[edge[1:]] - total[edge[:-1]]) + np.diff(edge).astype(np.uint64))
    return out[0], out[1]


def _whole(words: np.ndarray) -> np.uint64:
    out = np.array([len(words)], np.uint64)
    for w in words:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + w)
    return out[0]


def size_bands(percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower bounds of bands of set sizes; for links whose smaller set is in a band, the number
    of parts and how many of them may be empty: their difference exceeds what such sets differ in."""
    ratio, low = max((100 / percent) ** 2, 1.1), [1]
    while low[-1] < 1 << 31:
        low.append(max(low[-1] + 1, int(low[-1] * ratio)))
    low = np.array(low, np.int64)
    differ = (low[1:] - 1) * (100 - percent) // percent
    empty = np.exp(-low[:-1] / (differ + 1)) * (differ + 1)
    spare = np.where(differ == 0, 0, 1 + np.ceil(1.5 * (empty + np.sqrt(empty)))).astype(np.int64)
    return low, differ + 1 + spare, spare


def part_tokens(value: np.ndarray, edge: np.ndarray, percent: int, bands: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(number of the set, token) such that any two sets that link share a token.

    A set deals its shingles into the parts of its own band and, where a smaller set in the band
    below may link with it, of that one. A token is the hash of a non-empty part. Sets that link
    share more parts than may be empty; a set with more empty ones deals them again by the next
    seed, and after the last one has a token that all such sets of the band share.
    """
    low, parts, spare = bands
    n = np.diff(edge)
    band = np.searchsorted(low, n, "right") - 1
    below = (band > 0) & (100 * (low[band] - 1) >= percent * n)
    own, tokens = [], []
    for doc, k in ((np.flatnonzero(n > 0), band), (np.flatnonzero(below), band - 1)):
        for seed in SEEDS:
            if not len(doc):
                break
            many, base = parts[k[doc]], n[doc]
            at = np.repeat(np.arange(len(doc)), base)
            v = value[np.arange(len(at)) + np.repeat(edge[:-1][doc] - (np.cumsum(base) - base), base)]
            part = ((mix(v ^ np.uint64(seed)) >> np.uint64(32)) * many[at].astype(np.uint64)) >> np.uint64(32)
            slot = (np.cumsum(many) - many)[at] + part.astype(np.int64)
            order = np.argsort(slot, kind="stable")
            slot = slot[order]
            first = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
            total = np.add.reduceat(mix(v + np.uint64(seed))[order], first)
            which = at[order][first]
            name = part[order][first] * np.uint64(SEEDS[0]) + k[doc][which].astype(np.uint64)
            own.append(doc[which])
            tokens.append(mix(total ^ mix(name ^ np.uint64(seed))))
            doc = doc[many - np.bincount(which, minlength=len(doc)) > spare[k[doc]]]
        own.append(doc)
        tokens.append(mix(k[doc].astype(np.uint64) + np.uint64(SEEDS[2])))
    return np.concatenate(own), np.concatenate(tokens)


def prefix_tokens(value: np.ndarray, edge: np.ndarray, percent: int, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the set, token): the rarest shingles, as many as leave too few for a link."""
    n = np.diff(edge)
    own, need = np.repeat(np.arange(len(n)), n), -(-n * percent // 100)
    rank = np.lexsort((value, counts[value >> np.uint64(64 - SKETCH_BITS)], own))
    pick = rank[np.arange(len(value)) - edge[:-1][own] < (n - need + 1)[own]]
    return own[pick], value[pick]


def parities(value: np.ndarray, edge: np.ndarray) -> list[bytes]:
    """For each set a bit for each place that its shingles are dealt into: whether their number is odd. A set has as many
    places as shingles, or up to twice as many."""
    n = np.diff(edge)
    places = np.int64(1) << np.clip(np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64), *PLACES)
    begin = np.concatenate([[0], np.cumsum(places)])
    at = np.repeat(begin[:-1], n) + (value & np.repeat(places - 1, n).astype(np.uint64)).astype(np.int64)
    bits = np.packbits(np.bincount(at, minlength=begin[-1]) & 1, bitorder="little").tobytes()
    return [bits[a // 8 : b // 8] for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]


def likely(n: np.ndarray, bits: list[bytes], percent: int, side: np.ndarray | None = None) -> np.ndarray:
    """For each set, by its size and ``parities``, the number of the first one that it may be linked with, if over others.
    With ``side`` only sets of different sides are compared. No link is lost."""
    root = np.arange(len(n))
    order = np.lexsort((np.array([len(b) for b in bits]), n))
    size, words, apart = n[order], np.array([len(bits[k]) // 8 for k in order]), None if side is None else side[order]
    last = np.searchsorted(percent * size, 100 * size, "right")  # sizes up to there allow a link
    for level in np.unique(words).tolist():
        own = np.flatnonzero(words == level)
        to = int(last[own[-1]])
        folded = np.empty((to - own[0], level), np.uint64)
        for k in range(own[0], to):
            x = np.frombuffer(bits[order[k]], np.uint64)
            while len(x) > level:
                x = x[: len(x) // 2] ^ x[len(x) // 2 :]
            folded[k - own[0]] = x
        for i in own.tolist():
            j = np.arange(i + 1, last[i])
            j = j[(root[j] != root[i]) & (True if apart is None else apart[j] != apart[i])]
            if len(j):
                differ = np.bitwise_count(folded[j - own[0]] ^ folded[i - own[0]]).sum(1, dtype=np.int64)
                j = j[(100 + percent) * differ <= (100 - percent) * (size[j] + size[i])]
                for r in np.unique(root[j]).tolist():
                    root[root == r] = root[i]
    least = np.full(len(n), len(n))
    np.minimum.at(least, root, order)
    out = np.empty(len(n), np.int64)
    out[order] = least[root]
    return out


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    ids, texts, held = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
            t = t.as_py() or b""
            if texts and held + len(t) > PIECE:
                yield ids, texts
                ids, texts, held = [], [], 0
            ids.append(NO_ID if i is None else i)
            texts.append(t)
            held += len(t)
    if texts:
        yield ids, texts


def counted(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """A task's counts of its shingles by hash in ``COUNT_PARTS`` parts (part, task, blob), one part in a batch: a worker holds its table
    once, beside the executor's heap, and a part of it packed."""
    rolling, total, held = Rolling(), np.zeros(1 << SKETCH_BITS, np.uint32), 0
    context = TaskContext.get()
    task, wide = context.partitionId() if context else 0, len(total) // COUNT_PARTS

    def parts() -> Iterator[pa.RecordBatch]:
        for k in range(COUNT_PARTS if held else 0):
            blob = pack([(total[k * wide : (k + 1) * wide], 6)])
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([task], pa.int32()), pa.array([blob], pa.binary())], names=["part", "task", "blob"])

    for _, texts in pieces(batches):
        value, _ = shingle_sets(texts, size, rolling)
        if held + len(value) >= 1 << 32:  # a count could pass its 32 bits
            yield from parts()
            total[:], held = 0, 0
        np.add.at(total, (value >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), np.uint32(1))
        held += len(value)
    yield from parts()
    del total, rolling
    give_back()


def shingle_counts(docs: DataFrame, size: int) -> np.ndarray:
    """Shingles of all documents counted by hash: 2^SKETCH_BITS numbers, however large the input. Tasks' counts are added
    in groups of up to about one in ``COUNT_TREE`` of them first, so that no group grows with all tasks at once."""
    def add(table: pd.DataFrame) -> pd.DataFrame:
        total = sum(unpack(b, [6])[0].astype(np.int64) for b in table["blob"])
        return pd.DataFrame({"part": table["part"].iloc[:1], "task": table["task"].iloc[:1], "blob": [pack([(total, 6)])]})

    schema = "part int, task int, blob binary"
    sums = docs.mapInArrow(lambda batches: counted(batches, size), schema)
    for keys in (["part", F.pmod("task", F.lit(COUNT_TREE))], ["part"]):
        sums = sums.groupBy(*keys).applyInPandas(add, schema)
    with settings(docs.sparkSession, ROWS_AT_ONCE):
        got = sums.collect()
    total = np.zeros((COUNT_PARTS, (1 << SKETCH_BITS) // COUNT_PARTS), np.int64)
    for r in got:
        total[r["part"]] = unpack(r["blob"], [6])[0]
    return np.minimum(total.ravel(), (1 << 32) - 1).astype(np.uint32)


def chain(token: np.ndarray, size: np.ndarray, node: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows sorted by token and size, True where a chain begins, with the edges inside chains."""
    order = np.lexsort((node, size, token))
    token, size, node = token[order], size[order], node[order]
    head = np.ones(len(token), bool)
    head[1:] = (token[1:] != token[:-1]) | (100 * size[:-1] < percent * size[1:])
    inner = np.flatnonzero(~head)
    pair = np.stack([node[inner - 1], node[inner]], 1)
    pair = np.unique(pair[pair[:, 0] != pair[:, 1]], axis=0) if len(pair) else pair
    return order, head, pair[:, 0], pair[:, 1]


def link_bands(percent: int) -> np.ndarray:
    """Lower bounds of bands of set sizes; any two sizes of a band allow a link."""
    low = [1]
    while low[-1] < 1 << 31:
        low.append(low[-1] * 100 // percent + 1)
    return np.array(low, np.int64)


def sent(size: np.ndarray, head: np.ndarray, low: np.ndarray) -> np.ndarray:
    """True for the rows of ``chain`` that stand for all: each chain's first and last of every band.

    Neighbours among a chain's sent rows allow a link, so where sizes of two chains do, either the ranges
    of the chains meet or their nearest ends allow it: their sent rows form one chain again.
    """
    band = np.searchsorted(low, size, "right")
    first = head.copy()
    first[1:] |= band[1:] != band[:-1]
    return first | np.append(first[1:], True)


def trie_links(sets: list[np.ndarray], percent: int, known: np.ndarray | None = None) -> np.ndarray:
    """For each set (arrays of ranks in global order) the number of its component's first set.
    ``known``: labels of components that are known already."""
    n = len(sets)
    root = np.arange(n)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def union(a: int, b: int) -> None:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)

    length = np.array([len(s) for s in sets])
    flat, edge = np.concatenate(sets), np.concatenate([[0], np.cumsum(length)])
    width = int(flat.max()) + 1
    for first in ([] if known is None else np.unique(known, return_index=True)[1].tolist()):
        for y in np.flatnonzero(known == known[first]).tolist():
            union(first, y)
    # The tree: sets sorted by their sequences; a node is a range of them with a common prefix.
    order = sorted(range(n), key=lambda x: flat[edge[x] : edge[x + 1]].astype(">u4").tobytes())
    seq = [flat[edge[x] : edge[x + 1]] for x in order]
    size = length[order]
    lcp = np.zeros(n + 1, np.int64)
    for i in range(1, n):
        m = min(size[i], size[i - 1])
        d = np.flatnonzero(seq[i][:m] != seq[i - 1][:m])
        lcp[i] = d[0] if len(d) else m
    # Nodes level by level: range of sets, depth before and after, least and greatest size, children.
    rows: list[tuple] = [(0, n, 0, 0, int(size.min()), int(size.max()))]
    first, many = [], []
    for lo, hi, _, depth, _, _ in rows:
        first.append(len(rows))
        cuts = [lo, *(lo + 1 + np.flatnonzero(lcp[lo + 1 : hi] <= depth)).tolist(), hi] if hi > lo + 1 else []
        for c, d in zip(cuts[:-1], cuts[1:], strict=True):
            to = int(size[c]) if d == c + 1 else int(lcp[c + 1 : d].min())
            rows.append((c, d, depth, to, int(size[c:d].min()), int(size[c:d].max())))
        many.append(len(rows) - first[-1])
    lo, hi, since, to, low, high = np.array(rows, np.int64).T
    first, many, step = np.array(first), np.array(many), to - since
    flat = np.concatenate(seq)
    begin = np.concatenate([[0], np.cumsum(size)])
    source, last = begin[lo] + since, flat[np.maximum(begin[lo] + to - 1, 0)].astype(np.int64)

    def runs(start: np.ndarray, count: np.ndarray) -> np.ndarray:
        return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())

    batch = max(1, min(WALKERS, WALK_CELLS // width))
    at = 0
    while at < n:
        # The batch's sets walk together; a step is a set at a node, with the overlap on the way there.
        # Batches grow, since what the first sets link is left by the later ones.
        i = np.arange(at, min(n, at + min(batch, 1 + at // 2)))
        at += len(i)
        own = np.array([find(x) for x in order])
        change = np.append(np.flatnonzero(own[1:] != own[:-1]) + 1, n)
        whole = np.where(change[np.minimum(np.searchsorted(change, lo, "right"), len(change) - 1)] >= hi, own[lo], -1)
        mask = np.zeros((len(i), width), bool)
        where = np.repeat(np.arange(len(i)), size[i])
        mask[where, flat[begin[i[0]] : begin[i[-1] + 1]]] = True
        place = where * width + flat[begin[i[0]] : begin[i[-1] + 1]]  # ascending
        stack = [(np.arange(len(i)), np.zeros(len(i), np.int64), np.zeros(len(i), np.int64))]
        while stack:
            w, node, have = stack.pop()
            x, nx = i[w], size[i[w]]
            ok = (hi[node] > x + 1) & (100 * high[node] >= percent * nx) & (100 * nx >= percent * low[node]) & (whole[node] != own[x])
            w, node, have, x, nx = w[ok], node[ok], have[ok], x[ok], nx[ok]
            if len(w) > 1 and step[node].sum() > STEP_CELLS:
                half = len(w) // 2
                stack += [(w[:half], node[:half], have[:half]), (w[half:], node[half:], have[half:])]
                continue
            length_ = step[node]
            hits = np.concatenate([[0], np.cumsum(mask[np.repeat(w, length_), flat[runs(source[node], length_)]])])
            ends = np.cumsum(length_)
            got = have + hits[ends] - hits[ends - length_]
            left = np.where(length_ > 0, nx - (np.searchsorted(place, w * width + last[node], "right") - (begin[x] - begin[i[0]])), nx - got)
            need = -(-percent * (nx + np.maximum(low[node], to[node])) // (100 + percent))
            ok = got + np.minimum(high[node] - to[node], left) >= need
            leaf = hi[node] == lo[node] + 1
            found = np.flatnonzero(ok & leaf & (lo[node] != x) & (100 * got >= percent * (nx + to[node] - got)))
            for c, d in zip(x[found].tolist(), lo[node[found]].tolist(), strict=True):
                union(order[c], order[d])
            w, node, got = w[ok & ~leaf], node[ok & ~leaf], got[ok & ~leaf]
            if len(w):
                stack.append((np.repeat(w, many[node]), runs(first[node], many[node]), np.repeat(got, many[node])))
    return np.array([find(x) for x in range(n)])


def refined(inside: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """``inside`` (node, other, n, doc_id, class, block) with the parts of its blocks that ``bits`` (node, other, bits) leave together as blocks.
    Blocks of up to ``MARKED`` classes are told apart many in a group; of larger ones, all pairs of parts."""
    sizes = written(inside.groupBy("block").agg(F.count("*").alias("rows")).where("rows > 1"), "sizes")
    some = salted_join(inside.select("node", "other", "n", "class", "block"), sizes, ["block"])
    total = sizes.agg(F.sum("rows"), F.max("rows")).first()
    if not total[0]:
        return inside.where("false")
    named_ = written(some.join(bits.groupBy("node", "other").agg(F.max("bits").alias("bits")), ["node", "other"]).select("class", "n", "block", "rows", "bits"), "bits")
    bins = max(12, int(total[0]) // MARKED)
    parts = F.ceil(F.col("rows") / MARKED).cast("int")
    small = named_.where(F.col("rows") <= MARKED).select(F.concat(F.lit("bin"), F.pmod(F.xxhash64("block"), F.lit(bins))).alias("meet"), "block", F.lit(None).cast("int").alias("side"), "class", "n", "bits")

    def told(table: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, block in table.groupby("block", sort=False):
            side, ids = block["side"], block["class"].to_numpy()
            got = likely(block["n"].to_numpy(), list(block["bits"]), percent, None if side.isna().any() or side.nunique() < 2 else side.to_numpy())
            out.append(pd.DataFrame({"a": ids, "b": ids[got]}))
        return pd.concat(out)

    new = written(small.groupBy("meet").applyInPandas(told, "a long, b long"), "told")
    if total[1] > MARKED:
        own, other = F.pmod(F.xxhash64("class"), parts).cast("int"), F.col("other")
        large = named_.where(F.col("rows") > MARKED).withColumn("side", own).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
        meet = F.concat_ws(":", "block", F.least("side", other), F.greatest("side", other))
        edges = large.select(meet.alias("meet"), "block", "side", "class", "n", "bits").groupBy("meet").applyInPandas(told, "a long, b long").where("a != b")
        new = new.unionByName(components(written(edges, "told")).withColumnRenamed("id", "a").withColumnRenamed("component", "b"))
    return inside.drop("block").join(new.withColumnRenamed("a", "class").withColumnRenamed("b", "block"), "class")


def ngram_components(docs: DataFrame, size: int = 3, percent: int = 90, block_rows: int = 600, block_shingles: int = 400_000) -> DataFrame:
    """For each row of ``docs``: doc_id, n_shingles, component_id."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = spark.sparkContext.broadcast(shingle_counts(docs, size)) if percent < PARTS_FROM else None
    buckets, bands, low = 2 * ranges_for(docs), size_bands(percent), link_bands(percent)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for ids, texts in pieces(batches):
            value, edge = shingle_sets(texts, size, rolling)
            n = np.diff(edge)
            node, other = set_prints(value, edge)
            _, first = np.unique(node, return_index=True)
            ok = np.zeros(len(n), bool)
            ok[first] = True
            doc, token = part_tokens(value, edge, percent, bands) if percent >= PARTS_FROM else prefix_tokens(value, edge, percent, counts.value)
            token, doc = token[ok[doc]] >> np.uint64(16), doc[ok[doc]]
            order, head, a, b = chain(token, n[doc], node[doc], percent)
            ends = order[sent(n[doc][order], head, low)]
            bucket = (token[ends] * np.uint64(buckets)) >> np.uint64(48)
            out = [(None, pack([(a, 8), (b, 8)]))] if len(a) else []
            cuts = np.searchsorted(bucket, np.arange(buckets + 1))
            for k in np.flatnonzero(cuts[1:] > cuts[:-1]):
                s = ends[cuts[k] : cuts[k + 1]]
                out.append((int(k), pack([(token[s], 6), (n[doc[s]], 5), (node[doc[s]], 8)])))
            bits = [b if k else None for b, k in zip(parities(value, edge), ok.tolist(), strict=True)]
            rows = [(i, int(m), int(x), int(y), None, b) for i, m, x, y, b in zip(ids, n.tolist(), node.view(np.int64).tolist(), other.view(np.int64).tolist(), bits, strict=True)]
            rows += [(None, None, None, None, k, x) for k, x in out]
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4 + [pa.int32(), pa.binary()], strict=True)],
                                             names=["doc_id", "n", "node", "other", "bucket", "blob"])
        give_back()

    with settings(spark, ROWS_AT_ONCE):
        made = written(docs.mapInArrow(prefixes, "doc_id long, n long, node long, other long, bucket int, blob binary"), "prefixes")
    members = made.where("n is not null").select("doc_id", "n", "node", "other")

    def pairs(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    def meet(table: pd.DataFrame) -> pd.DataFrame:
        token, n, node = (np.concatenate(x) for x in zip(*(unpack(b, [6, 5, 8]) for b in table["blob"]), strict=True))
        return pairs(*chain(token, n.astype(np.int64), node, percent)[2:])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                yield pa.RecordBatch.from_pandas(pairs(*unpack(blob.as_py(), [8, 8])), preserve_index=False)

    edges = made.where("n is null and bucket is null").select("blob").mapInArrow(local, "a long, b long").unionByName(
        made.where("bucket is not null").select("bucket", "blob").groupBy("bucket").applyInPandas(meet, "a long, b long"))
    blocks = components(edges).withColumnRenamed("id", "node").withColumnRenamed("component", "block")
    numbered = members.groupBy("node", "other", "n").agg(F.min("doc_id").alias("doc_id"))
    classes = written(numbered.withColumn("class", F.monotonically_increasing_id()), "classes")
    inside = refined(classes.where("n > 0").join(blocks, "node"), made.where("blob is not null and n > 0").select("node", "other", F.col("blob").alias("bits")), percent)
    sizes = inside.groupBy("block").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles")).where("rows > 1")
    many = lambda rows, shingles: F.greatest(F.ceil(F.col(rows) / F.lit(block_rows)), F.ceil(F.col(shingles) / F.lit(block_shingles))).cast("int")
    inside = written(salted_join(inside, sizes, ["block"]).withColumn("parts", many("rows", "shingles")).select(
        "doc_id", "node", "class", "n", "block", "parts", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int").alias("part")), "inside")
    keyed = docs.withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))

    def join(table: pd.DataFrame) -> pd.DataFrame:
        rolling, sets, keys = tables(), [], []
        raw = [(t or "").encode() for t in table.pop("text")]
        at, nodes = 0, table["node"].to_numpy()
        for _, group in pieces_of(raw):
            value, edge = shingle_sets(group, size, rolling)
            node = set_prints(value, edge)[0].view(np.int64)
            for k in np.flatnonzero(node == nodes[at : at + len(group)]).tolist():  # a repeated doc_id may bring another text
                keys.append(at + k)
                sets.append(value[edge[k] : edge[k + 1]])
            at += len(group)
        if len(sets) < 2:
            return pd.DataFrame({"a": [], "b": []}).astype("int64")

        def links(sets: list[np.ndarray]) -> np.ndarray:
            names, count = np.unique(np.concatenate(sets), return_counts=True)  # what most sets of the block hold comes first
            rank = np.empty(len(names), np.uint32)
            rank[np.lexsort((names, -count))] = np.arange(len(names))
            return trie_links([np.sort(rank[np.searchsorted(names, s)]) for s in sets], percent, table["known"].to_numpy()[keys])

        got = links(sets)
        linked = np.flatnonzero(np.bincount(got, minlength=len(got))[got] > 1)
        if not names_hold([raw[keys[k]] for k in linked], size, rolling):
            got = links(plain_sets([raw[k] for k in keys], size))
        if sum(map(len, raw)) > PIECE:  # of small blocks there are many
            del raw, sets
            give_back()
        ids = table["class"].to_numpy()[keys]
        return pd.DataFrame({"a": ids, "b": ids[got]})

    def compared(wanted: DataFrame) -> DataFrame:
        """Components of the links of ``wanted`` (doc_id, node, class, known, block, meet): classes that meet in a task."""
        wanted = written(wanted, "wanted")
        turns, links = max(1, -(-wanted.count() // NAMED)), []
        for turn in range(turns):  # the documents are read once for each so many rows, and their texts dealt once in all
            now = wanted.where(F.pmod(F.xxhash64("block", "meet"), F.lit(turns)) == turn) if turns > 1 else wanted
            ids = written(now.select("doc_id").distinct(), "ids")
            texts = keyed.join(F.broadcast(ids), "doc_id", "left_semi").join(now, "doc_id").select("block", "meet", "node", "class", "known", "text")
            links.append(written(texts.groupBy("block", "meet").applyInPandas(join, "a long, b long").where("a != b"), "links"))
        return functools.reduce(DataFrame.unionByName, links)

    draw = F.xxhash64("class", F.lit(7))
    chosen = inside.where("parts > 1").groupBy("block", F.pmod(draw, F.lit(REPRESENTATIVES)).alias("k")).agg(F.min_by(F.struct("doc_id", "node", "class", "parts", "part"), draw).alias("r"))
    spread = chosen.select("block", "r.*").withColumn("meet", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("meet != part")
    columns = ["doc_id", "node", "class", F.col("class").alias("known"), "block", F.col("meet").cast("string").alias("meet")]
    links = compared(inside.withColumn("meet", F.col("part")).select(*columns).unionByName(spread.select(*columns)))

    # Of split blocks: what is outside the largest component, against all.
    state = inside.where("parts > 1").join(components(links).withColumnRenamed("id", "class"), "class", "left").withColumn("known", F.coalesce("component", "class"))
    state = written(state.drop("component", "part", "parts"), "state")
    main = state.groupBy("block", "known").agg(F.count("*").alias("rows")).groupBy("block").agg(F.max_by("known", "rows").alias("main"))
    state = state.join(main, "block").withColumn("loose", F.col("known") != F.col("main"))
    half = state.groupBy("block", "loose").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles")).withColumn("parts", F.ceil(many("rows", "shingles") * 2).cast("int"))
    parts = written(half.groupBy("block").agg(F.max(F.when(F.col("loose"), F.col("parts"))).alias("few"), F.coalesce(F.max(F.when(~F.col("loose"), F.col("parts"))), F.lit(0)).alias("rest")).where("few > 0"), "parts")
    if not parts.isEmpty():
        own = F.pmod(F.xxhash64("class"), F.when(F.col("loose"), F.col("few")).otherwise(F.col("rest"))).cast("int")
        to = lambda n: F.sequence(F.lit(0), n - 1)
        with_loose = F.transform(to(F.col("few")), lambda k: F.concat_ws("-", F.least(k, own), F.greatest(k, own)))
        with_rest = F.when(F.col("rest") > 0, F.transform(to(F.greatest(F.col("rest"), F.lit(1))), lambda k: F.concat_ws("+", own, k))).otherwise(F.array().cast("array<string>"))
        meets = F.when(F.col("loose"), F.concat(with_loose, with_rest)).otherwise(F.transform(to(F.col("few")), lambda k: F.concat_ws("+", k, own)))
        links = links.unionByName(compared(salted_join(state, parts, ["block"]).select("doc_id", "node", "class", "known", "block", F.explode(meets).alias("meet"))))
    joined = components(links)
    classes = classes.join(joined.withColumnRenamed("id", "class"), "class", "left")
    classes = classes.withColumn("component", F.coalesce("component", "class"))
    least = classes.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    ids = written(salted_join(classes.select("node", "other", "component"), least, ["component"]).select("node", "other", "component_id"), "components")
    out = salted_join(members, ids, ["node", "other"])
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(real("doc_id").alias("doc_id"), F.col("n").alias("n_shingles"),
                      F.when(F.col("n") > 0, real("component_id")).otherwise(real("doc_id")).alias("component_id"))


def pieces_of(raw: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    out, held, at = [], 0, 0
    for k, t in enumerate(raw):
        if out and held + len(t) > PIECE:
            yield at, out
            out, held, at = [], 0, k
        out.append(t)
        held += len(t)
    if out:
        yield at, out


def op9_ngram_join(spark, sf_dir: str) -> DataFrame:
    return ngram_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
