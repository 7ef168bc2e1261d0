"""Quantities and places of matches, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimloom.functions import text as T

#: Patterns of quantities, in order, and names of units (fixed values).
QUANTITIES = [
    r"(?i)(?:(?:₹|rs\.?|inr|\$|usd)\s*)?(\d+(?:,\d+)*(?:\.\d+)?)\s*(crore|cr|lakh|million|mn|billion|bn|trillion|percent|%|rupees?|dollars?|jobs?|workers?|employees?|bps|basis\s+points?)\b",
    r"(?i)(?:(?:₹|rs\.?|inr|\$)\s*)(\d+(?:,\d+)*(?:\.\d+)?)",
    r"(?i)(\d+(?:,\d+)*(?:\.\d+)?)\s*(?:rupees?|dollars?|per\s+cent|percent|%)",
]
UNITS = {
    "cr": "crore", "mn": "million", "bn": "billion", "%": "percent", "per cent": "percent", "rs": "currency",
    "rupee": "currency", "rupees": "currency", "dollars": "currency", "dollar": "currency",
}


def located(text: Column, pattern: str) -> Column:
    """Matches as an array of (start, end, value), in code points, ends exclusive."""
    gaps = F.split(text, pattern, -1)
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda v, i: F.struct(F.length(F.get(gaps, i)).alias("gap"), v.alias("value")))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return F.aggregate(found, F.struct(F.lit(0).alias("at"), none.alias("out")), lambda a, x: F.struct(
        (a["at"] + x["gap"] + F.length(x["value"])).alias("at"),
        F.concat(a["out"], F.array(F.struct((a["at"] + x["gap"]).alias("start"), (a["at"] + x["gap"] + F.length(x["value"])).alias("end"), x["value"].alias("value")))).alias("out")), lambda a: a["out"])


def number(text: Column) -> Column:
    """With commas; what is no number is 0."""
    return F.coalesce(F.regexp_replace(F.trim(text), ",", "").try_cast("double"), F.lit(0.0))


def quantities(text: Column) -> Column:
    """(start, end, value, unit, phrase) by three patterns in order; a match inside one that is there already is left out."""
    patterns = [T.ascii_edges(p) for p in QUANTITIES]
    currency = lambda v: F.lit("currency")
    kept = F.transform(located(text, patterns[0]), _row(patterns[0], lambda v: F.lower(F.regexp_extract(v, patterns[0], 2))))
    for p in patterns[1:]:
        kept = T.once(kept, _with(F.transform(located(text, p), _row(p, currency))))
    return kept


def _with(rows: Column):
    return lambda kept: F.concat(kept, F.filter(rows, _outside(kept)))


def _row(pattern: str, unit):
    return lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), number(F.regexp_extract(m["value"], pattern, 1)).alias("value"), unit(m["value"]).alias("unit"), F.trim(m["value"]).alias("phrase"))


def _outside(kept: Column):
    return lambda m: ~F.exists(kept, lambda k: (m["start"] >= k["start"]) & (m["end"] <= k["end"]))


def unit_name(unit: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv]), unit), unit)


def numeric_conflicts(claim: Column, evidence: Column) -> Column:
    """(unit, claim_value, evidence_value) of claim quantities that the evidence has with other numbers only: the first of these."""
    def conflict(c: Column, found: Column) -> Column:
        unit = unit_name(c["unit"])
        near = F.filter(found, lambda e: (unit_name(e["unit"]) == unit) | (unit == "currency"))
        same = lambda near: F.exists(near, lambda e: F.abs(e["value"] - c["value"]) < 1e-4)
        return T.once(near, lambda near: F.when((F.size(near) > 0) & ~same(near), F.struct(unit.alias("unit"), c["phrase"].alias("claim_value"), F.get(near, F.lit(0))["phrase"].alias("evidence_value"))))

    return T.once(evidence, lambda found: F.array_compact(F.transform(claim, lambda c: conflict(c, found))))


def snippet(text: Column, target: Column, window: int = 100) -> Column:
    """The text around the first ``target`` in either case, with dots where it is cut; null where there is none."""
    at = F.instr(F.lower(text), F.lower(target)) - 1
    start, end = F.greatest(at - window, F.lit(0)), F.least(at + F.length(target) + window, F.length(text))
    inner = F.trim(F.substring(text, start + 1, end - start))
    return F.when(at >= 0, F.concat(F.when(start > 0, "...").otherwise(""), inner, F.when(end < F.length(text), "...").otherwise("")))
