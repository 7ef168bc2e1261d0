"""Embedding near-dedup: a subspace pigeonhole join.

Unit vectors with cosine of at least c are at most eps = sqrt(2 - 2c) apart. After a rotation, which spreads any
direction over all coordinates, vectors are split into blocks of about ``BLOCK`` coordinates, and a block gets
the share of eps^2 that it has of the coordinates. A pair that keeps the whole budget keeps one block's at least,
so range joins within blocks find every pair; what they find is verified by the cosine in double precision. A
pair counts in the first block whose budget it keeps, so none counts twice and no pairs are put out: a task returns
for each of its vectors the number of links and one vector that it is connected with.

A block's range join deals vectors by a tree of median splits. A vector is at home in one leaf, and a guest in the leaves
before it that its ball reaches. The tree comes from a bounded sample and only balances; leaves of more than
``TASK`` vectors are cut into chunks that meet in pairs.

Equal vectors are one class from the start. Crowded balls, around vectors that many of a bounded sample
are near, are found first: all within eps / 2 of a centre are linked with one another, so their number tells their
links. If no other vector comes near such a ball, its vectors take no part in the join; else they only meet others.

Null, empty and zero vectors and those with null or non-finite components link with nothing, and neither do vectors
of another length than the most frequent (of equally frequent ones, the shortest). Each is a component of its own, by
its vec_id. A null vec_id counts as greatest; rows with equal ids are judged one by one. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import salted_join, written
from .graph import components

BLOCK = 8
#: Vectors at home in a leaf, vectors in a task, levels of splits, and vectors that go to the driver to find splits and centres.
LEAF, TASK, LEVELS, SAMPLE, CENTRES = 16384, 49152, 12, 16384, 1024
#: Vectors of the sample near a centre, from which on its ball is crowded.
CROWD = 5
SLACK = 1e-9


def usable(column: str = "embedding") -> F.Column:
    x = F.col(column)
    return F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(x, lambda c: c != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors as doubles, scaled by powers of two so that no square overflows."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None]) if len(x) else x


def units(x: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Rotated unit vectors; the same sums in the same order for a vector wherever it is."""
    x = x / np.sqrt(np.square(x).sum(axis=1))[:, None]
    out = np.zeros_like(x)
    for k in range(x.shape[1]):
        out += x[:, k : k + 1] * turn[k]
    return out


def rotation(length: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(7).standard_normal((length, length)))[0]


def tree(points: np.ndarray, levels: int, radius: float) -> list:
    """(dimension, place, left, right) or a leaf, ``None``."""
    if not levels or len(points) < 2:
        return None
    spread = points.std(axis=0)
    d = int(spread.argmax())
    if spread[d] < radius / 2:
        return None
    at = float(np.median(points[:, d]))
    left = points[:, d] < at
    if not left.any() or left.all():
        return None
    return [d, at, tree(points[left], levels - 1, radius), tree(points[~left], levels - 1, radius)]


def dealt(points: np.ndarray, node: list, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(point, leaf, at home) for each leaf that a point is at home in, or before it within ``reach`` (a squared distance)."""
    rows, leaves, homes, number = [], [], [], 0

    def walk(node: list, at: np.ndarray, gaps: np.ndarray, home: np.ndarray) -> None:
        """gaps: how far outside a point is, by dimension; 0 where it is inside."""
        nonlocal number
        if node is None:
            rows.append(at)
            leaves.append(np.full(len(at), number))
            homes.append(home)
            number += 1
            return
        d, place, left, right = node
        x = points[at, d]
        inside = x < place
        beyond = np.where(inside, gaps[:, d], np.maximum(x - place, gaps[:, d]))
        total = np.square(gaps).sum(axis=1) - gaps[:, d] ** 2 + beyond**2
        go = (inside & home) | (total <= reach) & ((~inside & home) | ~home)
        moved = gaps[go]
        moved[:, d] = beyond[go]
        walk(left, at[go], moved, (home & inside)[go])
        beyond = np.where(inside, np.maximum(place - x, gaps[:, d]), gaps[:, d])
        total = np.square(gaps).sum(axis=1) - gaps[:, d] ** 2 + beyond**2
        go = np.where(home, ~inside, total <= reach)  # guests go to leaves before their home alone
        moved = gaps[go]
        moved[:, d] = beyond[go]
        walk(right, at[go], moved, home[go])

    walk(node, np.arange(len(points)), np.zeros_like(points), np.ones(len(points), bool))
    return np.concatenate(rows), np.concatenate(leaves), np.concatenate(homes)


class Plan:
    """Everything the workers need: plain numbers and arrays."""

    def __init__(self, length: int, cosine: float):
        blocks = max(1, round(length / BLOCK))
        self.cosine, self.turn = cosine, rotation(length)
        self.bounds = [round(k * length / blocks) for k in range(blocks + 1)]
        self.budgets = np.array([(2 - 2 * cosine) * (b - a) / length for a, b in zip(self.bounds, self.bounds[1:], strict=False)]) * (1 + SLACK)
        self.trees: list = [None] * blocks


def crowded(sample: np.ndarray, radius: float) -> np.ndarray:
    """Centres, no two within ``radius``, near which at least ``CROWD`` of ``sample`` (unit vectors) are."""
    near = sample @ sample.T >= 1 - radius**2 / 2
    centres: list[int] = []
    for k in np.argsort(-near.sum(axis=1), kind="stable"):
        if near[k].sum() >= CROWD and not near[k, centres].any():
            centres.append(int(k))
    return sample[centres]


def in_balls(points: DataFrame, plan: Plan, centres: np.ndarray, radius: float) -> DataFrame:
    """(no, ball or -1, near: other balls that it comes near)."""
    eps = (2 - 2 * plan.cosine) ** 0.5

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            apart = np.sqrt(np.maximum(2 - 2 * (units(matrix(batch.column(1)), plan.turn) @ centres.T), 0))
            ball = apart.argmin(axis=1)
            ball[apart[np.arange(len(ball)), ball] > radius] = -1
            touches = apart <= eps + radius + SLACK
            touches[np.flatnonzero(ball >= 0), ball[ball >= 0]] = False
            lists = pa.array([np.flatnonzero(t) for t in touches], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ball), lists], names=["no", "ball", "near"])

    return written(points.select("no", "embedding").mapInArrow(work, "no long, ball long, near array<long>"), "balls")


def joined_rows(plan: Plan, parts: dict, points: DataFrame, count_only: bool) -> DataFrame:
    """Rows of ``points`` (no, size, ball, embedding) for each task (block, leaf, one, two) they go to; or counts of leaves."""
    kind = dict(points.dtypes)["embedding"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            turned = units(matrix(batch.column("embedding")), plan.turn)
            no = batch.column("no").to_numpy()
            for b, node in enumerate(plan.trees):
                row, leaf, home = dealt(turned[:, plan.bounds[b] : plan.bounds[b + 1]], node, plan.budgets[b] * (1 + SLACK) + SLACK)
                if count_only:
                    n = np.bincount(leaf)
                    full = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(full), b)), pa.array(full), pa.array(n[full])], names=["block", "leaf", "n"])
                    continue
                cut = np.array([parts.get((b, k), 1) for k in range(int(leaf.max()) + 1)])[leaf]
                own = (no[row] * 0x9E3779B1 >> 8) % cut
                again = np.repeat(np.arange(len(row)), cut)
                other = np.arange(len(again)) - np.repeat(np.cumsum(cut) - cut, cut)
                row, leaf, home, own = row[again], leaf[again], home[again], own[again]
                sent = batch.take(pa.array(row))
                made = {"block": np.full(len(row), b), "leaf": leaf, "one": np.minimum(own, other), "two": np.maximum(own, other), "chunk": own, "home": home}
                yield pa.RecordBatch.from_arrays([*[pa.array(x) for x in made.values()], *sent.columns], names=[*made, *sent.schema.names])

    schema = "block long, leaf long, n long" if count_only else f"block long, leaf long, one long, two long, chunk long, home boolean, no long, size long, ball long, embedding {kind}"
    return points.select("no", "size", "ball", "embedding").mapInArrow(work, schema)


def union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``parent`` after joining the sets of ``a`` and ``b``; every entry is its set's least."""
    while True:
        x, y = parent[a], parent[b]
        if (x == y).all():
            return parent
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while (parent != parent[parent]).any():
            parent = parent[parent]


def linked(block: int, split: bool, home: np.ndarray, chunk: np.ndarray, ball: np.ndarray, size: np.ndarray, x: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """(links, parent) of a task's vectors, homes first, each sorted by ball."""
    turned, norm = units(x, plan.turn), np.sqrt(np.square(x).sum(axis=1))
    near = turned[:, plan.bounds[block] : plan.bounds[block + 1]].astype(np.float32)
    square, most = np.square(near).sum(axis=1), np.float32(plan.budgets[block] + 1e-5)
    links, parent, homes = np.zeros(len(x), np.int64), np.arange(len(x)), int(home.sum())
    at = 0
    while at < homes:
        others = np.arange(at, len(x))
        if ball[at] >= 0:  # the ball's own pairs are known
            others = others[ball[at:] != ball[at]]
        end = min(homes, at + max(1, (1 << 21) // max(1, len(others))), at + int(np.argmin(np.append(ball[at:homes] == ball[at], False))) if ball[at] >= 0 else homes)
        rows = np.arange(at, end)
        found = square[rows, None] + square[others] - 2 * near[rows] @ near[others].T <= most
        r, c = np.nonzero(found)
        r, c = rows[r], others[c]
        ok = (c > r) & ((ball[r] != ball[c]) | (ball[r] < 0))
        if split:
            ok &= chunk[r] != chunk[c]
        r, c = r[ok], c[ok]
        for k in range(0, len(r), 1 << 15):
            i, j = r[k : k + (1 << 15)], c[k : k + (1 << 15)]
            ok = np.einsum("ij,ij->i", x[i], x[j]) / (norm[i] * norm[j]) >= plan.cosine
            i, j = i[ok], j[ok]
            if len(i):
                spent = np.add.reduceat(np.square(turned[i] - turned[j]), plan.bounds[:-1], axis=1)
                first = (spent <= plan.budgets).argmax(axis=1) == block
                i, j = i[first], j[first]
                np.add.at(links, i, size[j])
                np.add.at(links, j, size[i])
                parent = union(parent, i, j)
        at = end
    return links, parent


def near_links(points: DataFrame, plan: Plan) -> DataFrame:
    """(no, other, links): how many rows a vector of ``points`` links with in one task, and one it is connected with."""
    n = points.count()
    radius = plan.budgets**0.5
    levels = min(LEVELS, max(0, int(np.ceil(np.log2(max(1, n / LEAF))))))
    if levels:
        sample = points.orderBy(F.xxhash64("no")).limit(SAMPLE).select("embedding").toArrow().column(0).combine_chunks()
        turned = units(matrix(sample), plan.turn)
        plan.trees = [tree(turned[:, a:b], levels, r) for a, b, r in zip(plan.bounds, plan.bounds[1:], radius, strict=False)]
    counts = joined_rows(plan, {}, points, True).groupBy("block", "leaf").agg(F.sum("n").alias("n")).collect()
    parts = {(r["block"], r["leaf"]): -(-r["n"] // TASK) for r in counts if r["n"] > TASK}
    tasks = sum(p * (p + 1) // 2 for p in parts.values()) + len(counts) - len(parts)
    keys = ["block", "leaf", "one", "two"]

    def work(table: pa.Table) -> pa.Table:
        get = lambda c: table.column(c).combine_chunks()
        home, ball = get("home").to_numpy(zero_copy_only=False), get("ball").to_numpy()
        order = np.lexsort((ball, ~home))
        block, split = get("block")[0].as_py(), get("one")[0].as_py() != get("two")[0].as_py()
        no = get("no").to_numpy()[order]
        links, parent = linked(block, split, home[order], get("chunk").to_numpy()[order], ball[order], get("size").to_numpy()[order], matrix(get("embedding"))[order], plan)
        some = np.flatnonzero(links)
        return pa.table({"no": no[some], "other": no[parent[some]], "links": links[some]})

    partitions = int(min(max(tasks, 1), max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), sum(r["n"] for r in counts) // TASK)))
    return joined_rows(plan, parts, points, False).repartition(partitions, *keys).groupBy(*keys).applyInArrow(work, "no long, other long, links long")


def near_duplicates(vectors: DataFrame, cosine: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of ``vectors`` (vec_id, embedding)."""
    rows = vectors.select("vec_id", "embedding")
    lengths = rows.where(usable()).groupBy(F.size("embedding").alias("length")).count().orderBy(F.col("count").desc(), "length").limit(1).collect()
    length = lengths[0]["length"] if lengths else 0
    fit = usable() & (F.size("embedding") == length)
    single = rows.where(~F.coalesce(fit, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not length:
        return single
    plan = Plan(length, cosine)
    kinds = dict(rows.dtypes)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            keys = pa.array([hashlib.sha256(v.tobytes()).digest() for v in x], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, keys], names=["vec_id", "embedding", "key"])

    keyed = rows.where(fit).mapInArrow(digest, f"vec_id {kinds['vec_id']}, embedding {kinds['embedding']}, key binary")
    least = F.min(F.struct(F.col("vec_id").isNull().alias("none"), F.col("vec_id").alias("id")))
    classes = keyed.groupBy("key").agg(F.first("embedding").alias("embedding"), F.count("*").alias("size"), least.alias("least"))
    classes = written(classes.withColumn("no", F.monotonically_increasing_id()), "classes")

    radius = (2 - 2 * cosine) ** 0.5 / 2 * (1 - 1e-6)
    sample = classes.orderBy(F.xxhash64("no", F.lit(1))).limit(CENTRES).select("embedding").toArrow().column(0).combine_chunks()
    centres = crowded(units(matrix(sample), plan.turn), radius)
    points = classes.select("no", "size", F.lit(-1).cast("long").alias("ball"), "embedding")
    known = None
    if len(centres):
        balls = in_balls(classes, plan, centres, radius)
        reached = [r[0] for r in balls.select(F.explode("near").alias("ball")).distinct().collect()]  # centres at most
        points = classes.join(balls.select("no", "ball"), "no").where((F.col("ball") < 0) | F.col("ball").isin(reached)).select("no", "size", "ball", "embedding")
        members = classes.select("no", "size").join(balls.where("ball >= 0").select("no", "ball"), "no")
        totals = written(members.groupBy("ball").agg(F.sum("size").alias("total"), F.min("no").alias("other")), "totals")
        known = written(members.join(F.broadcast(totals), "ball").select("no", "other", (F.col("total") - F.col("size")).alias("links")), "known")
        points = written(points, "points")
    found = written(near_links(points, plan), "links")
    if known is not None:
        found = found.unionByName(known)
    met = components(found.select(F.col("no").alias("a"), F.col("other").alias("b")))
    links = found.groupBy("no").agg(F.sum("links").alias("links"))
    member = written(classes.select("no", "least").join(met.select(F.col("id").alias("no"), "component"), "no", "left").select("no", "least", F.coalesce("component", "no").alias("component")), "members")
    first = member.groupBy("component").agg(F.min("least").alias("first"))
    of_class = salted_join(member.select("no", "component"), first, ["component"]).join(links, "no", "left")
    told = written(classes.select("key", "size", "no").join(of_class, "no").select(
        "key", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), F.col("first.id").alias("component_id")), "told")
    out = salted_join(keyed.select("vec_id", "key"), told, ["key"])
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")).unionByName(single)


def op12_near_vectors(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP12_SQL = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings),
     ok AS (SELECT * FROM v WHERE x IS NOT NULL AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
     links AS MATERIALIZED (SELECT a.rid AS a, b.rid AS b FROM ok a JOIN ok b ON a.rid <> b.rid
              WHERE list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))) >= 0.95),
     way AS (SELECT rid, rid AS other FROM v UNION SELECT way.rid, links.b FROM way JOIN links ON way.other = links.a),
     least AS (SELECT way.rid, min(v.vec_id) AS component_id FROM way JOIN v ON way.other = v.rid GROUP BY way.rid),
     n AS (SELECT a AS rid, count(*)::BIGINT AS n_links FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, v.vec_id = component_id AS kept FROM v JOIN least USING (rid) LEFT JOIN n USING (rid)
"""
