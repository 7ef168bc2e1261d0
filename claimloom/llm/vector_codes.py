"""Vector code compression: product codes whose nearest entries are found as in a VA-file.

Vectors are cut into ``parts``; each part has a codebook of integer entries that ``rounds`` of assigning and
averaging move. To assign, an entry's coordinates are quantised into cells of ``bits`` bits. For each vector and
coordinate a lookup table over the cells holds the least and the greatest squared distance; an entry's bounds are
sums of looked-up numbers. Only entries whose lower bound reaches the least upper bound are measured exactly,
in integers, with ties to the lower index.

Every round is one pass over a written table of integers. A task sums the parts of each entry for all its rows,
so the shuffle has a row for each task, part and entry, and the driver gets ``parts * entries`` rows at most.

Rows whose vector is null or holds null or non-finite components are dropped; so are those without components and
those whose length isn't the smallest kept vec_id's or doesn't divide by ``parts``. A null vec_id counts as greatest, equal vec_ids
go by their vectors, repeated rows are coded one by one. Components beyond 2^16 are held at 2^16, so that sums fit a
long. An empty table gives no rows; other columns than the three that are named are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import salted_join, written

PARTS, ENTRIES, ROUNDS, BITS = 4, 256, 4, 5
SCALE, MOST = 1024, 1 << 26
#: Cells of bounds held at once by a task: entries times vectors.
HELD = 1 << 19


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, v): the kept rows, components as integers."""
    x = F.col("embedding")
    kept = vectors.select("vec_id", "label", "embedding").where(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & (F.size(x) > 0))
    whole = F.transform(x, lambda c: F.floor(F.greatest(F.least(c.cast("double") * scale, F.lit(float(MOST))), F.lit(-float(MOST)))).cast("int"))
    return kept.select("vec_id", "label", whole.alias("v"))


def nearest(x: np.ndarray, entries: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest of ``entries`` and the squared distance to it, for every row of ``x`` (both int64)."""
    cells = 1 << bits
    low = entries.min(axis=0)
    width = (entries.max(axis=0) - low) // cells + 1
    of = (entries - low) // width
    index, error = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    step = max(1, HELD // len(entries))
    for at in range(0, len(x), step):
        q = x[at : at + step]
        least = np.zeros((len(entries), len(q)), np.int64)
        most = np.zeros_like(least)
        for d in range(x.shape[1]):  # tables: a row for each cell
            first = low[d] + np.arange(cells)[:, None] * width[d]
            below, above = first - q[:, d], q[:, d] - (first + width[d] - 1)
            near = np.maximum(np.maximum(below, above), 0)
            far = np.maximum(np.abs(below), np.abs(above))
            least += (near * near)[of[:, d]]
            most += (far * far)[of[:, d]]
        row, entry = np.nonzero((least <= most.min(axis=0)).T)  # every row has one at least, entries ascend
        exact = np.square(q[row] - entries[entry]).sum(axis=1)
        begin = np.searchsorted(row, np.arange(len(q)))
        best = np.minimum.reduceat(exact, begin)
        hit = np.flatnonzero(exact == best[row])
        index[at : at + step] = entry[hit[np.searchsorted(row[hit], np.arange(len(q)))]]
        error[at : at + step] = best
    return index, error


def _matrix(column: pa.Array, parts: int) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, parts, -1)


def _sums(table: DataFrame, books: np.ndarray, bits: int) -> list[tuple]:
    """(part, entry, count, sums) of every entry that is some part's nearest."""
    parts, entries, width = books.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), parts)
            for p in range(parts if len(x) else 0):
                to, _ = nearest(x[:, p], books[p], bits)
                count[p] += np.bincount(to, minlength=entries)
                np.add.at(total[p], to, x[:, p])
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(count[p, e]), *[pa.array(total[p, e, k]) for k in range(width)]],
                                         names=["part", "entry", "n", *[f"s{k}" for k in range(width)]])

    names = ["n", *[f"s{k}" for k in range(width)]]
    made = table.select("v").mapInArrow(work, ", ".join(f"{c} long" for c in ("part", "entry", *names)))
    return [tuple(r) for r in made.groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in names]).collect()]


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, bits: int = BITS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, indexes: array, error) and the codebooks (part, entry, position)."""
    table = written(integers(vectors), "integers")
    order = [F.col("vec_id").isNull(), F.col("vec_id"), F.col("v")]
    size = F.size("v")
    first = table.where(size % parts == 0).orderBy(*order).select("v").first()
    length = len(first["v"]) if first else parts
    table = table.where(size == length)
    seeds = [r["v"] for r in table.orderBy(*order).limit(entries).select("v").collect()]
    if not seeds:
        return table.select("vec_id", "label", F.array().cast("array<int>").alias("indexes"), F.lit(0).cast("long").alias("error")), np.zeros((parts, 0, 0), np.int64)
    books = np.array(seeds, np.int64).reshape(len(seeds), parts, -1).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        for p, e, n, *sums in _sums(table, books, bits):
            books[p, e] = [s // n for s in sums]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(2), parts)
            if not len(x):
                continue
            found = [nearest(x[:, p], books[p], bits) for p in range(parts)]
            index = np.stack([f[0] for f in found], axis=1).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, index.size + 1, parts, dtype=np.int32)), pa.array(index.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists, pa.array(sum(f[1] for f in found))], names=["vec_id", "label", "indexes", "error"])

    kinds = dict(table.dtypes)
    coded = table.select("vec_id", "label", "v").mapInArrow(code, f"vec_id {kinds['vec_id']}, label {kinds['label']}, indexes array<int>, error long")
    return written(coded, "codes"), books


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    coded, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    key = F.struct(F.col("label").isNull().alias("none"), F.col("label").alias("label"))
    hexed = F.array_join(F.transform("indexes", lambda k: F.lower(F.lpad(F.hex(k), 2, "0"))), "")
    rows = coded.select("vec_id", hexed.alias("code"), "error", F.coalesce(F.col("label").cast("string"), F.lit("")).alias("name"), key["none"].alias("none"))
    totals = rows.groupBy("none", "name").agg(F.sum("error").alias("label_error"))
    return salted_join(rows, totals, ["none", "name"]).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _round_sql(k: int) -> str:
    """CTEs a<k> (assignment by codebook b<k>) and b<k+1>."""
    return f"""
     a{k} AS MATERIALIZED (SELECT rid, part, min({{'d': list_dot_product(x, x) + list_dot_product(c, c) - 2 * list_dot_product(x, c), 'e': e}}) AS near
             FROM p JOIN b{k} USING (part) GROUP BY rid, part),
     m{k} AS (SELECT part, e, list(floor(s / n)::DOUBLE ORDER BY place) AS c
              FROM (SELECT a.part, a.near.e AS e, place, sum(x[place])::DOUBLE AS s, count(*)::DOUBLE AS n
                    FROM a{k} a JOIN p ON a.rid = p.rid AND a.part = p.part, (SELECT unnest(generate_series(1, (SELECT max(len(x)) FROM p))) AS place) GROUP BY ALL) GROUP BY part, e),
     b{k + 1} AS MATERIALIZED (SELECT b.part, b.e, coalesce(m{k}.c, b.c) AS c FROM b{k} b LEFT JOIN m{k} ON b.part = m{k}.part AND b.e = m{k}.e),"""


OP11_SQL = f"""
WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS rid, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::DOUBLE) AS v
              FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     p AS MATERIALIZED (SELECT rid, part, v[part * len(v) // {PARTS} + 1:(part + 1) * len(v) // {PARTS}] AS x FROM kept, (SELECT unnest(range({PARTS})) AS part)),
     b0 AS (SELECT part, rid AS e, x AS c FROM p WHERE rid < {ENTRIES}),{''.join(_round_sql(k) for k in range(ROUNDS))}
     a AS MATERIALIZED (SELECT rid, part, min({{'d': list_dot_product(x, x) + list_dot_product(c, c) - 2 * list_dot_product(x, c), 'e': e}}) AS near FROM p JOIN b{ROUNDS} USING (part) GROUP BY rid, part),
     r AS (SELECT rid, string_agg(lower(printf('%02x', near.e)), '' ORDER BY part) AS code, sum(near.d)::BIGINT AS error FROM a GROUP BY rid),
     s AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: x::BIGINT::VARCHAR), ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN r USING (rid), s
"""
