"""URL and domain functions, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query keys that track visitors (fixed values).
TRACKING = (
    "utm_source utm_medium utm_campaign utm_term utm_content utm_cid utm_reader utm_name fbclid gclid gclsrc dclid zanpid msclkid _ga _gl "
    "mc_cid mc_eid ref ref_src source sr_share"
).split()
#: Hosts of personal blogs (fixed values).
BLOG_HOSTS = "substack.com medium.com blogspot.com wordpress.com blogger.com tumblr.com wixsite.com weebly.com".split()


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.trim(url), r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def netloc(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def canonical(url: Column) -> Column:
    """Lower-case scheme and host, no default port, fragment, parameters, tracking or blank keys;
    keys sorted; no trailing slash but the root's. Escapes in the query are left as they are."""
    host = F.when(scheme(url) == "http", F.regexp_replace(netloc(url), ":80$", "")).otherwise(
        F.when(scheme(url) == "https", F.regexp_replace(netloc(url), ":443$", "")).otherwise(netloc(url)))
    path = F.regexp_replace(F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), r";[^/]*$", "")
    path = F.when(F.length(path) > 1, F.regexp_replace(path, "/+$", "")).otherwise(path)
    pairs = F.transform(F.split(F.regexp_extract(F.trim(url), r"\?([^#]*)", 1), "&"), lambda p, i: F.struct(
        F.regexp_extract(p, "^([^=]*)", 1).alias("key"), i.alias("at"), F.regexp_extract(p, "^[^=]*=(.*)$", 1).alias("value")))
    kept = F.filter(pairs, lambda p: (p["value"] != "") & ~F.lower(p["key"]).isin(TRACKING))
    query = F.array_join(F.transform(F.array_sort(kept), lambda p: F.concat(p["key"], F.lit("="), p["value"])), "&")
    return F.concat(scheme(url), F.lit("://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def domain(url: Column) -> Column:
    return F.regexp_replace(netloc(url), r"^www\.", "")


def domain_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(name)), r"^www\.", "")


def category(name: Column, hint: Column | None = None) -> Column:
    """Category by structure; a registry's category goes before it (``coalesce``)."""
    d = domain_key(name)
    blog = F.lit(False)
    for b in BLOG_HOSTS:
        blog = blog | (d == b) | d.endswith("." + b)
    out = (F.when(F.coalesce(d, F.lit("")) == "", "UNKNOWN").when(d.rlike(r"(\.gov(\.[a-z]{2})?$)|(\.nic\.in$)|(\.mil(\.[a-z]{2})?$)"), "GOVERNMENT")
           .when(d.rlike(r"(\.edu(\.[a-z]{2})?$)|(\.ac\.[a-z]{2,}$)"), "ACADEMIC").when(d.rlike(r"\.int$"), "INTERNATIONAL_ORGANIZATION").when(blog, "PERSONAL_BLOG"))
    if hint is not None:
        out = out.when(F.upper(hint) == "FACT_CHECK", "FACT_CHECKER")
    return out.when(d.endswith(".org") | d.endswith(".org.in"), "ORGANIZATION").otherwise("UNKNOWN")


def content_id(prefix: str, *parts: Column, size: int = 12) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat(*parts).cast("binary"), 256), 1, size))


#: Hosts that no request may reach, and non-public IPv4 ranges as (first address, prefix length) (fixed values).
BLOCKED_HOSTS = ("localhost", "localhost.localdomain", "metadata.google.internal", "169.254.169.254", "instance-data", "metadata")
BLOCKED_NETS = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.168.0.0", 16),
    ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4),
)


def net_range(first: str, prefix: int) -> tuple[int, int]:
    at = sum(int(x) << s for x, s in zip(first.split("."), (24, 16, 8, 0), strict=True))
    return at, at + (1 << (32 - prefix)) - 1


def validity(url: Column) -> Column:
    """OK, EMPTY, BAD_SCHEME, NO_HOST, BLOCKED_IP or BLOCKED_HOST; of IPv6 hosts the local ranges are blocked."""
    host = F.regexp_replace(F.regexp_replace(netloc(url), "^.*@", ""), ":[0-9]*$", "")
    octet = r"(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    parts = F.split(host, r"\.")
    value = sum((F.get(parts, F.lit(k)).try_cast("long") * (1 << s) for k, s in enumerate((24, 16, 8, 0))), F.lit(0))
    inside = F.lit(False)
    for net in BLOCKED_NETS:
        inside = inside | value.between(*net_range(*net))
    local = host.rlike(r"^\[(::1?|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*|ff[0-9a-f]{2}:.*)\]$")
    return (F.when(F.coalesce(F.trim(url), F.lit("")) == "", "EMPTY").when(~scheme(url).isin("http", "https"), "BAD_SCHEME").when(host == "", "NO_HOST")
            .when((host.rlike(rf"^({octet}\.){{3}}{octet}$") & inside) | local, "BLOCKED_IP")
            .when(host.isin(*BLOCKED_HOSTS) | host.endswith(".local") | host.endswith(".internal"), "BLOCKED_HOST").otherwise("OK"))
