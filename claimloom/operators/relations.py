"""Relations of evidence items: duplicates, syndication, derivation, independence.

Retrieval bounds a claim's items, so its pairs are bounded too, and a worker compares a claim at a time.
What a pair needs of one item (similarity form, words, n-grams, agencies) is computed once an item.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructField, StructType

from claimloom.functions import similarity as M
from claimloom.functions import text as T
from claimloom.operators import verification as V

#: Thresholds and confidences (fixed values).
SAME_CONTENT, SAME_LEAST = 0.90, 0.95
NEAR_TITLE, NEAR_TITLE_WITH, NEAR_CONTENT_WITH = 0.82, 0.65, 0.50
CROSS_TITLE, CROSS_CONTENT = 0.88, 0.80
SYNDICATED_CONTENT, SYNDICATED_TITLE, SYNDICATED_PHRASES = 0.60, 0.60, 2
INDEPENDENT_BELOW = 0.40
DEPENDENT = ("EXACT_DUPLICATE", "NEAR_DUPLICATE", "SYNDICATED", "LIKELY_DERIVED")
CITING = "according to|citing|reported by"
#: Publishers of fewer characters are not looked for in other texts (fixed value).
PUBLISHER_CHARS = 4
#: Texts of an item that are compared besides its title (fixed values).
LONG = ("own", "all", "brief")
#: Cells of a table of what items share that is made at once.
CELLS = 1 << 20
#: Words of a claim from which numbers of three in a row would not fit a long.
MANY_WORDS = 1 << 21
STOP = frozenset(T.STOP_WORDS)


def _blank(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def initials(pattern: str) -> str:
    """First letters of its alternatives: looked at before an edge, they spare most places of a text the dearer look."""
    return "".join(sorted({p[0] for p in pattern.split("|")}))


def prepared(evidence: DataFrame) -> DataFrame:
    """(claim_id, ord, url, domain, publisher, publishers, title, content, snippet) of ``evidence`` with what pairs compare: texts in similarity form,
    agencies, and which of the claim's publishers the item names as its source. Most texts name no agency and no source, which one look tells."""
    own = F.when(_blank("content") != "", F.col("content")).otherwise(_blank("snippet"))
    whole = F.concat_ws(" ", _blank("title"), _blank("snippet"), _blank("content"))
    wired, none = F.concat_ws(" ", _blank("publisher"), whole), F.array().cast("array<string>")
    return evidence.select(
        "claim_id", "ord", F.lower("canonical_url").alias("url"), F.lower("domain").alias("domain"), "publisher", T.similarity_form(_blank("title")).alias("title"), T.similarity_form(_blank("snippet")).alias("snippet"),
        T.similarity_form(own).alias("own"), (_blank("content") != "").alias("has_content"), (own != "").alias("has_own"),
        F.when(wired.rlike(rf"(?i)(?=[{initials('|'.join(V.WIRES.values()))}])\b({'|'.join(V.WIRES.values())})\b"), V.wire_agencies(wired)).otherwise(none).alias("wires"),
        F.when(whole.rlike(rf"(?i)(?=[{initials(CITING)}])\b({CITING})\s"), F.filter("publishers", lambda p: cites(whole, p))).otherwise(none).alias("cited"))


def cites(text: Column, publisher: Column) -> Column:
    """Whether ``text`` names ``publisher`` as its source, in any case, as whole words."""
    quoted = F.concat(F.lit(r"\Q"), F.replace(publisher, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    return F.coalesce((F.length(publisher) >= PUBLISHER_CHARS) & F.regexp_like(text, F.concat(F.lit(rf"(?i)\b({CITING})\s+"), quoted, F.lit(r"\b"))), F.lit(False))


def met(cells: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How many distinct values each two of ``n`` items share, and how many each has; ``cells``: value * n + item."""
    cells = np.sort(cells)
    value, item = np.divmod(cells[np.diff(cells, prepend=-1) > 0], n)
    sizes, shared = np.bincount(item, minlength=n), np.zeros((n, n))
    again = value[1:] == value[:-1]
    often = np.append(again, False) | np.insert(again, 0, False)[: len(value)] if len(value) else np.zeros(0, bool)
    value, item = value[often], item[often]
    row = np.cumsum(np.diff(value, prepend=-1) > 0) - 1
    step = max(1, CELLS // n)
    for k in range(0, int(row[-1]) + 1 if len(row) else 0, step):
        i, j = np.searchsorted(row, (k, k + step))
        held = np.zeros((step if k + step <= row[-1] else int(row[-1]) + 1 - k, n))
        held[row[i:j] - k, item[i:j]] = 1.0
        shared += held.T @ held
    return shared, sizes


def shares(cells: np.ndarray, n: int) -> np.ndarray:
    """Jaccard similarity of each two items; 0 where one has nothing."""
    shared, sizes = met(cells, n)
    either = sizes[:, None] + sizes[None, :] - shared
    return np.where(shared > 0, shared / np.maximum(either, 1.0), 0.0)


def told(rows: list[dict]) -> dict[str, np.ndarray]:
    """What decides of each pair of a claim's items, as square tables of figures.

    Words are numbered once for the claim. Title, beginning and own text are parts of the whole text, so their word sequences are some of its."""
    n = len(rows)
    parts = [[r["title"], r["snippet"], r["own"] if r["has_content"] else ""] for r in rows]
    texts = {"title": [r["title"] for r in rows], "own": [r["own"] for r in rows], "all": [" ".join(filter(None, p)) for p in parts], "brief": [" ".join(filter(None, p[:2])) for p in parts]}
    numbers: dict[str, int] = {}
    words = [[numbers.setdefault(w, len(numbers)) for w in t.split()] for t in texts["all"]]
    sizes = np.array([len(w) for w in words])
    title, brief = (np.array([t.count(" ") + 1 if t else 0 for t in texts[k]]) for k in ("title", "brief"))
    content = np.array([r["has_content"] for r in rows])
    spans = {"title": (np.zeros(n, int), title), "own": (np.where(content, brief, title), sizes), "all": (np.zeros(n, int), sizes), "brief": (np.zeros(n, int), brief)}
    flat = np.fromiter((w for ws in words for w in ws), np.int64, int(sizes.sum()))
    item, place = np.repeat(np.arange(n), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    plain = np.fromiter((len(w) > 1 and w not in STOP for w in numbers), bool, len(numbers))[flat] if numbers else np.zeros(0, bool)

    def within(k: str, long: int) -> np.ndarray:
        low, high = spans[k]
        return (place >= low[item]) & (place + long <= high[item])

    def chained(one: np.ndarray, two: np.ndarray, by: int) -> np.ndarray:
        """A number for what ``one`` has at a place together with what ``two`` has ``by`` places later; without sense where texts end."""
        out = np.zeros(len(flat), np.int64)
        out[: max(len(flat) - by, 0)] = one[: max(len(flat) - by, 0)] * (int(two.max(initial=0)) + 1) + two[by:]
        return out

    pairs = chained(flat, flat, 1)
    pairs = pairs if len(numbers) < MANY_WORDS else np.unique(pairs, return_inverse=True)[1]
    three = np.unique(chained(pairs, flat, 2), return_inverse=True)[1]
    phrases = [met((chained(three, three, long - 3) * n + item)[within("all", long)], n)[0] for long in M.PHRASE_WORDS]
    out = {"n_phrases": np.minimum(sum(phrases), M.MOST_PHRASES)}

    def equal(c: str, unlike: bool = False) -> np.ndarray:
        named = np.array([bool(r[c]) for r in rows])
        codes = {v: i for i, v in enumerate({r[c] for r in rows})}
        code = np.array([codes[r[c]] for r in rows])
        return named[:, None] & named[None, :] & ((code[:, None] != code[None, :]) if unlike else (code[:, None] == code[None, :]))

    own = np.array([r["has_own"] for r in rows])
    out |= {"same_url": equal("url"), "same_domain": equal("domain"), "apart": equal("domain", True), "both": own[:, None] & own[None, :]}
    cited = np.array([[q["publisher"] is not None and q["publisher"] in r["cited"] for q in rows] for r in rows])
    out["derived"] = cited | cited.T
    out["wired"] = np.array([[not set(r["wires"]).isdisjoint(q["wires"]) for q in rows] for r in rows])
    whole = ~out["same_domain"] & (out["derived"] | out["wired"] | (out["n_phrases"] >= SYNDICATED_PHRASES))
    for k in ("title", *LONG):
        blank = np.array([not t for t in texts[k]])
        out[k + "_none"] = blank[:, None] | blank[None, :]
        code = np.unique(np.array(texts[k], object), return_inverse=True)[1]
        out[k + "_same"] = code[:, None] == code[None, :]
        asked = k != "all" or whole.any()
        out[k + "_jaccard"] = shares((flat * n + item)[within(k, 1) & plain], n) if asked else np.zeros((n, n))
        if k != "title":
            out[k + "_three"] = shares((three * n + item)[within(k, 3)], n) if asked else np.zeros((n, n))
        begun = texts[k] if k == "title" else [t[: M.SEQUENCE_CHARS] for t in texts[k]]
        wanted = ~out[k + "_none"] & ~out[k + "_same"]
        if k == "own":
            wanted &= out["both"]
        if k == "all":
            wanted &= whole
        if k == "brief":
            as_title = np.array([x == y for x, y in zip(begun, texts["title"], strict=True)])
            as_title = as_title[:, None] & as_title[None, :]
            out["brief_seq"] = np.where(as_title, out["title_seq"], M.ratios(begun, wanted & ~as_title))
        else:
            out[k + "_seq"] = M.ratios(begun, wanted)
    out["whole"] = whole
    return out


def compared(evidence: DataFrame) -> DataFrame:
    """A row for each pair of a claim's items, a before b, with title, content, whole and brief similarity and what else decides; whole
    similarity is null where no relation asks for it: in one domain, and without a citation, an agency of both or shared phrases.

    Items are dealt and sorted by claim as they are, beside the claim's publishers; a claim's items go to a worker once, not once a pair."""
    publishers = evidence.groupBy(F.col("claim_id").alias("_claim")).agg(F.collect_set("publisher").alias("publishers"))
    items = evidence.select("claim_id", "ord", "canonical_url", "domain", "publisher", "title", "snippet", "content").repartition("claim_id").sortWithinPartitions("claim_id")
    e = prepared(items.hint("merge").join(publishers, F.col("claim_id") == F.col("_claim")))
    flags = ["both", "same_url", "same_domain", "apart", "derived", "wired", "whole", *[k + end for k in ("title", *LONG) for end in ("_none", "_same")]]
    figures = [k + end for k in ("title", *LONG) for end in ("_jaccard", "_seq")] + [k + "_three" for k in LONG]
    claim, ord_ = evidence.schema["claim_id"].dataType, evidence.schema["ord"].dataType
    out = StructType([StructField("claim_id", claim), StructField("a", ord_), StructField("b", ord_), *[StructField(c, BooleanType()) for c in flags], StructField("n_phrases", IntegerType()), *[StructField(c, DoubleType()) for c in figures]])
    arrow = to_arrow_schema(out)

    def pairs(table: pa.Table) -> pa.Table:
        rows = [r for r in table.to_pylist() if r["ord"] is not None]
        i, j = (np.array(x, int) for x in zip(*[(x, y) for x, r in enumerate(rows) for y, q in enumerate(rows) if r["ord"] < q["ord"]], strict=True)) if len({r["ord"] for r in rows}) > 1 else (np.zeros(0, int),) * 2
        if not len(i):
            return arrow.empty_table()
        got, ids = told(rows), pa.array([r["ord"] for r in rows], arrow.field("a").type)
        first = [pa.array([rows[0]["claim_id"]] * len(i), arrow.field("claim_id").type), ids.take(pa.array(i)), ids.take(pa.array(j))]
        return pa.Table.from_arrays([*first, *[pa.array(got[f.name][i, j].astype("int32" if f.name == "n_phrases" else got[f.name].dtype), f.type) for f in list(arrow)[3:]]], schema=arrow)

    p = e.groupBy("claim_id").applyInArrow(pairs, out)
    shared = {"title": M.TITLE_SHARES, **dict.fromkeys(LONG, M.CONTENT_SHARES)}
    for k, (one, two, *three) in shared.items():
        mixed = one * F.col(k + "_jaccard") + two * F.col(k + "_seq")
        mixed = mixed + three[0] * F.col(k + "_three") if three else mixed
        p = p.withColumn(k, F.when(F.col(k + "_none"), 0.0).when(F.col(k + "_same"), 1.0).otherwise(F.round(mixed, 3)))
    return p.select("claim_id", "a", "b", "title", F.when(F.col("both"), F.col("own")).otherwise(0.0).alias("content"), F.when(F.col("whole"), F.col("all")).alias("all"), "brief", "both",
                    "same_url", "same_domain", "apart", F.col("title_same").alias("same_title"), "derived", "wired", "n_phrases")


def relation() -> Column:
    """(kind, similarity, confidence) of a row of ``compared``: duplicates, then syndication, then independence."""
    def row(kind: str, similarity: Column, confidence: float) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.round(similarity, 3).alias("similarity"), F.lit(confidence).alias("confidence"))

    t, c, whole, brief, n = (F.col(x) for x in ("title", "content", "all", "brief", "n_phrases"))
    other = ~F.col("same_domain")
    return (
        F.when(F.col("same_url"), row("EXACT_DUPLICATE", F.lit(1.0), 0.98))
        .when(F.col("same_title") & ((c >= SAME_CONTENT) | ~F.col("both")), row("EXACT_DUPLICATE", F.greatest(t, c, F.lit(SAME_LEAST)), 0.95))
        .when(F.col("same_domain") & ((t >= NEAR_TITLE) | ((t >= NEAR_TITLE_WITH) & (c >= NEAR_CONTENT_WITH))), row("NEAR_DUPLICATE", F.greatest(t, c), 0.90))
        .when((t >= CROSS_TITLE) & (c >= CROSS_CONTENT), row("NEAR_DUPLICATE", (t + c) / 2, 0.88))
        .when(other & F.col("derived"), row("LIKELY_DERIVED", F.greatest(whole, t), 0.88))
        .when(other & F.col("wired") & ((whole >= SYNDICATED_CONTENT) | (t >= SYNDICATED_TITLE) | (n >= SYNDICATED_PHRASES)), row("SYNDICATED", F.greatest(whole, t), 0.92))
        .when(other & (whole >= SYNDICATED_CONTENT) & (n >= SYNDICATED_PHRASES), row("SYNDICATED", whole, 0.85))
        .when(F.col("apart") & (brief < INDEPENDENT_BELOW), row("LIKELY_INDEPENDENT", F.greatest(t, brief), 0.85))
        .otherwise(row("UNKNOWN", F.greatest(t, brief), 0.50))
    )


def relations(evidence: DataFrame) -> DataFrame:
    """(claim_id, a, b, kind, similarity, confidence, title, content) of all pairs of a claim's items."""
    return compared(evidence).withColumn("r", relation()).select("claim_id", "a", "b", "r.*", "title", "content")


def source_clusters(evidence: DataFrame, pairs: DataFrame) -> DataFrame:
    """Clusters of the items that dependent ``pairs`` (a result of ``relations``) join."""
    bound = pairs.where(F.col("kind").isin(*DEPENDENT)).select("claim_id", "a", "b", F.col("kind").endswith("DUPLICATE").alias("duplicate"))
    return V.clusters(evidence.select("claim_id", "ord"), bound)
