"""Secret scans: fixed patterns, and a battery of randomness tests with false-discovery control.

Pattern kinds are ``assign``, ``access`` and ``hex``. Beside them, every run of 20 or more
token characters is a candidate. Its encoding is inferred (decimal, hex, letters of one case, base32,
base36, letters, base62, base64), its characters become numbers of that alphabet, and three tests
ask whether these look drawn at random: chi-squared for uniformity (Wilson-Hilferty; of single characters and of
the alphabet's quarters), runs about the middle of the alphabet and serial correlation. Fisher's method joins them.

Long strings give the tests more power, so candidates are banded by length. What must not be called a
secret is ordinary text, so in each band the null distribution of the joint value is that of ordinary text of
such a length, read in such an encoding: from every document one stretch of its own letters, candidates left
out, and windows of a plain paragraph besides, for small inputs. A candidate's p-value is the share of ordinary text that looks as
random; Benjamini-Hochberg (level ``fdr``) over all documents bounds the share of ordinary text among the
spans of kind ``random``. Both distributions are histograms of fixed size, so nothing is ranked row by row.

Null texts are empty and have no spans; repeated rows each get theirs, told apart by a row number. Spans are in
code points, ends exclusive. Very long texts are matched whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Patterns (fixed values). Short hex and access runs are dropped by their length, which the pattern states.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"
KINDS = ["assign", "access", "hex", "random"]
#: Alphabets (fixed values), the first that fits is taken.
ALPHABETS = {
    "decimal": "0123456789",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "BASE36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "letters": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
BINS, BANDS, LEVELS = 200, 12, (1.5, 0.1)
#: Ordinary text for inputs that have little of their own.
PLAIN = (
    "the keeper of the small harbour wrote down every ship that came in and every barrel that was carried ashore because his father had done the same before him "
    "when the winter storms kept the boats away he read the old books again and found that the price of salt had changed far less than the names of the people who sold it "
    "some of the pages were missing and others had been damaged by water but most of what remained could still be copied by anyone with patience and a good lamp"
)


def parts(text: Column, kind: int, pattern: str) -> Column:
    """(kind, place, gap, value) of a pattern's matches; ``gap`` is the length of text before each."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    rows = F.transform(found, lambda v, i: F.struct(F.lit(kind).alias("kind"), i.alias("place"), F.length(F.get(gaps, i)).alias("gap"), v.alias("value")))
    return F.when(text.rlike(pattern), rows)


def matches(docs: DataFrame) -> DataFrame:
    """(row, doc_id, kind, start, end, value), with a row of null kind for each document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    mark = F.array(F.struct(F.lit(None).cast("int").alias("kind"), F.lit(0).alias("place"), F.lit(0).alias("gap"), F.lit("").alias("value")))
    found = [F.coalesce(parts(text, k, p), F.array().cast("array<struct<kind:int,place:int,gap:int,value:string>>")) for k, p in enumerate((ASSIGN, ACCESS, HEX, CANDIDATE))]
    numbered = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    rows = numbered.select("row", "doc_id", F.explode(F.concat(mark, *found)).alias("m")).select("row", "doc_id", "m.*")
    before = Window.partitionBy("row", "kind").orderBy("place")
    end = F.sum(F.col("gap") + F.length("value")).over(before)
    placed = rows.withColumn("end", end).withColumn("start", F.col("end") - F.length("value"))
    return placed.select("row", "doc_id", "kind", "start", "end", "value")


def log_tail(z: Column) -> Column:
    """ln P(N > z), for z of at least 0 (Chernoff-like fit by Abramowitz and Stegun 26.2.17)."""
    t = 1 / (1 + 0.2316419 * z)
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return -z * z / 2 + F.log(series / 2.5066282746310002)


def battery(value: Column, given: Column) -> Column:
    """(encoding, its size, length, numbers) of a candidate; ``given``: an encoding that is known."""
    body = F.regexp_replace(value, "=+$", "")
    fits = F.coalesce(given, *[F.when(body.rlike("^[" + a.replace("-", r"\-") + "]+$"), F.lit(name)) for name, a in ALPHABETS.items()], F.lit("base64"))
    alphabet = F.element_at(F.create_map(*[F.lit(x) for kv in ALPHABETS.items() for x in kv]), fits)
    return F.struct(fits.alias("encoding"), F.length(body).cast("double").alias("n"), F.length(alphabet).cast("double").alias("k"),
                    F.transform(F.split(body, ""), lambda c: F.greatest(F.instr(alphabet, c) - 1, F.lit(0)).cast("double")).alias("x"))


#: Encodings whose candidates are compared with the same ordinary text, which is read in the last one of each.
ORDINARY = [["upper", "lower"], ["letters"], [*ALPHABETS]]


def kin(encoding: Column) -> Column:
    return F.when(encoding.isin(ORDINARY[0]), 0).when(encoding.isin(ORDINARY[1]), 1).otherwise(2)


def tested(candidates: DataFrame) -> DataFrame:
    """Adds encoding, kin (of encodings), band and log_p, the ln of the joint p-value; an encoding that rows have is kept."""
    given = F.col("encoding") if "encoding" in candidates.columns else F.lit(None).cast("string")
    c = candidates.withColumn("b", battery(F.col("value"), given)).drop("encoding").select("*", "b.*").drop("b").withColumn("kin", kin(F.col("encoding")))
    n, k, x = F.col("n"), F.col("k"), F.col("x")
    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda a, v: a + v)
    squares = total(F.transform(F.array_distinct(x), lambda v: F.pow(F.size(F.filter(x, lambda y: y == v)).cast("double"), F.lit(2.0))))
    c = c.withColumn("chi", squares * k / n - n).withColumn("mean", total(x) / n).withColumn("pairs", F.arrays_zip(F.slice(x, 1, F.size(x) - 1).alias("u"), F.slice(x, 2, F.size(x)).alias("v")))
    chi, df = F.col("chi"), k - 1
    within = lambda c: F.size(F.filter(x, lambda v: (v * 4 >= c * k) & (v * 4 < (c + 1) * k))).cast("double")
    quarter = [within(c) for c in range(4)]
    share = [(F.ceil((c + 1) * k / 4) - F.ceil(c * k / 4)) / k * n for c in range(4)]
    coarse = sum(((o - e) * (o - e) / e for o, e in zip(quarter, share, strict=True)), F.lit(0.0))
    wilson = lambda chi, df: (F.pow(F.greatest(chi, F.lit(1e-9)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    z1 = wilson(chi, df)
    z0 = wilson(coarse, F.lit(3.0))
    half = (k - 1) / 2
    ups = F.size(F.filter(x, lambda v: v > half)).cast("double")
    downs = n - ups
    runs = 1 + F.size(F.filter("pairs", lambda p: (p["u"] > half) != (p["v"] > half))).cast("double")
    mean_runs = 1 + 2 * ups * downs / n
    var_runs = F.greatest((mean_runs - 1) * (mean_runs - 2) / (n - 1), F.lit(1e-9))
    z2 = F.abs(runs - mean_runs) / F.sqrt(var_runs)
    spread = F.greatest(total(F.transform(x, lambda v: (v - F.col("mean")) * (v - F.col("mean")))), F.lit(1e-9))
    serial = total(F.transform("pairs", lambda p: (p["u"] - F.col("mean")) * (p["v"] - F.col("mean")))) / spread
    z3 = F.abs(serial + 1 / (n - 1)) * F.sqrt(n)
    clip = lambda z: F.least(F.greatest(z, F.lit(0.0)), F.lit(30.0))
    two = F.log(F.lit(2.0))
    one = lambda z: F.when(z > 0, log_tail(clip(z))).otherwise(-two)
    c = c.withColumns({"z0": z0, "z1": z1, "z2": z2, "z3": z3})
    sides = F.least(log_tail(clip(F.col("z2"))) + two, F.lit(0.0)) + F.least(log_tail(clip(F.col("z3"))) + two, F.lit(0.0))
    c = c.withColumn("fisher", -(one(F.col("z0")) + one(F.col("z1")) + sides))
    f = F.col("fisher")
    log_p = -f + F.log(1 + f + f * f / 2 + f * f * f / 6)  # chi-squared tail with eight degrees of freedom
    band = F.least(F.floor(F.log(n / 20) / F.log(F.lit(LEVELS[0]))), F.lit(BANDS - 1)).cast("int")
    return c.withColumn("log_p", log_p).withColumn("band", band).withColumn("bin", F.least(F.floor(-F.col("log_p") / LEVELS[1]), F.lit(BINS - 1)).cast("int")).drop("x", "pairs", "chi", "mean", "z0", "z1", "z2", "z3", "fisher")


def ordinary(docs: DataFrame, places: list[tuple[int, int]]) -> DataFrame:
    """(value, encoding): a stretch of each document's letters for one of ``places`` (band, kin of encodings), as long as
    its candidates and read in its encoding, and windows of PLAIN."""
    length = F.element_at(F.array(*[F.lit(int(20 * LEVELS[0] ** (b + 0.4))) for b, _ in places]), F.col("pick") + 1)
    encoding = F.element_at(F.array(*[F.lit(("lower", "letters", "base36")[k]) for _, k in places]), F.col("pick") + 1)
    text = F.coalesce(F.col("text"), F.lit(""))
    letters = F.lower(F.regexp_replace(F.regexp_replace(text, CANDIDATE, " "), "[^A-Za-z]+", ""))
    own = docs.select(letters.alias("letters"), F.pmod(F.xxhash64("text"), F.lit(len(places))).cast("int").alias("pick"))
    plain = PLAIN.replace(" ", "")
    more = docs.sparkSession.range(len(plain) * len(places)).select(
        F.substring(F.lit(plain * 12), (F.col("id") % len(plain) + 1).cast("int"), F.lit(len(plain) * 10)).alias("letters"), F.floor(F.col("id") / len(plain)).cast("int").alias("pick"))
    both = own.unionByName(more).withColumn("n", length).withColumn("encoding", encoding).where(F.length("letters") >= F.col("n"))
    at = F.pmod(F.xxhash64("letters"), F.length("letters") - F.col("n") + 1).cast("int")
    return both.select(F.substring("letters", at + 1, F.col("n")).alias("value"), "encoding")


def random_bins(found: DataFrame, null: DataFrame, fdr: float) -> list[tuple[int, int, int]]:
    """(band, kin, last bin, of falling p, whose candidates Benjamini-Hochberg calls random): three for each band at most."""
    count = lambda df, name: df.groupBy("band", "kin", "bin").agg(F.count("*").alias(name))
    both = count(found, "n").join(count(null, "k"), ["band", "kin", "bin"], "full").fillna(0, ["n", "k"])
    all_ = Window.partitionBy("band", "kin")
    up = all_.orderBy("bin")
    ranked = both.select("band", "kin", "bin", F.sum("n").over(up).alias("rank"), F.sum("n").over(all_).alias("m"), F.sum("k").over(up).alias("as_random"), F.sum("k").over(all_).alias("nulls"))
    ok = (F.col("rank") > 0) & ((F.col("as_random") + 1) / (F.col("nulls") + 1) <= fdr * F.col("rank") / F.col("m"))
    return [tuple(r) for r in ranked.where(ok).groupBy("band", "kin").agg(F.max("bin").alias("cut")).collect()]


def scan(docs: DataFrame, fdr: float = 0.05) -> DataFrame:
    """For each document: doc_id and ``found``, its sorted spans (start, kind, end, value)."""
    docs = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    both = written(matches(docs), "matches")
    base = both.where("kind is null or kind < 3").where((F.coalesce("kind", F.lit(1)) != 0) | (F.length(F.regexp_extract("value", ASSIGN, 2)) >= 6))
    found = written(tested(both.where("kind = 3")), "tested")
    places = sorted((r[0], r[1]) for r in found.select("band", "kin").distinct().collect())
    # written apart: with the windows that rank the bins, the plan of both would take most of a small driver's heap
    null = written(tested(written(ordinary(docs, places), "ordinary")).select("band", "kin", "bin"), "null") if places else found
    cuts = random_bins(found, null, fdr) if places else []
    cut = F.coalesce(*[F.when((F.col("band") == b) & (F.col("kin") == k), F.lit(c)) for b, k, c in cuts], F.lit(-1))
    kept = found.where(F.col("bin") <= cut).select(base.columns)
    span = F.when(F.col("kind").isNotNull(), F.struct("start", "kind", "end", "value"))
    return base.unionByName(kept).groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(span)).alias("found")).drop("row")


def named(found: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def op8_secret_scan(spark, sf_dir: str) -> DataFrame:
    got = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    return got.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                      F.sha2(named(F.filter("found", lambda s: s["kind"] < 3)).cast("binary"), 256).alias("base_sha256"), named(F.col("found")).alias("spans"))
