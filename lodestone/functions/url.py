"""URL rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query keys that start so are tracking keys.
TRACKING = r"(?i)^(utm_|spm|from|fr|share_|isapp|scene|subscene|refer|sharer|tdsourcetag)"
_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def domain_of(url: Column) -> Column:
    """Lower-case authority with its port; empty if there is none."""
    return F.lower(F.regexp_extract(url, r"^[^:/?#]+://([^/?#]*)", 1))


def canonicalize(url: Column) -> Column:
    """Lower-case scheme (http by default) and authority; no fragment, path parameters or tracking
    keys; keys keep their order and blanks; no slash at the end but for the root."""
    part = lambda k: F.regexp_extract(F.trim(url), _PARTS, k)
    scheme = F.when(part(1) == "", "http").otherwise(F.lower(part(1)))
    path = F.regexp_replace(part(3), ";[^/]*$", "")
    path = F.when(F.regexp_replace(path, "/+$", "") == "", "/").otherwise(F.regexp_replace(path, "/+$", ""))
    kept = F.array_join(F.filter(F.split(part(4), "&"), lambda x: (x != "") & ~x.rlike(TRACKING)), "&")
    return F.concat(scheme, F.lit("://"), F.lower(part(2)), path, F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)))


def safe_name(text: Column, most: int = 40, default: str = "untitled") -> Column:
    """Runs of characters that file names can't have become one ``_``; cut, and ``_`` stripped at the ends."""
    x = F.substring(F.regexp_replace(text, r'[\\/:*?"<>|\s]+', "_"), 1, most)
    x = F.regexp_replace(x, "^_+|_+$", "")
    return F.when(F.coalesce(x, F.lit("")) == "", default).otherwise(x)


def lake_safe(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^a-z0-9._-]", "_")


# Domains and suffixes of the source classes, as regular expressions; first match wins.
S_DOMAINS = r"^(www\.gov\.cn|www\.sach\.gov\.cn|www\.ncha\.gov\.cn|www\.whc\.unesco\.org)$"
ACADEMIC = r"(cnki\.net|wanfangdata\.com\.cn|cssn\.cn|cnki\.com\.cn|cqvip\.com)$"
MEDIA = r"(people\.com\.cn|xinhuanet\.com|news\.cn|cctv\.com|cntv\.cn|chinanews\.com|chinanews\.com\.cn|thepaper\.cn|gmw\.cn|cnr\.cn|legaldaily\.com\.cn|china\.com\.cn|china\.com|yicai\.com|caixin\.com|hubei\.gov\.cn)$"
REFERENCE = r"(wikipedia\.org|britannica\.com)$"
MUSEUM_LIB = r"(museum|bowuguan|library|archives|dangan)"
UGC = r"(baike\.baidu\.com|zhihu\.com|zhidao\.baidu\.com|wenku\.baidu\.com|douban\.com|tieba\.baidu\.com|weibo\.com|sohu\.com|163\.com|qq\.com|sina\.com\.cn|baijiahao\.baidu\.com|toutiao\.com|bilibili\.com|douyin\.com|36kr\.com|ifeng\.com)$"
LADDER = [
    (S_DOMAINS, "Government", "S", 1),
    (r"\.gov\.cn$", "Government", "S", 1),
    (r"\.edu\.cn$", "University", "A", 2),
    (ACADEMIC, "AcademicJournal", "A", 2),
    (MEDIA, "Newspaper", "B", 3),
    (REFERENCE, "GeneralWebsite", "B", 3),
    (MUSEUM_LIB, "Museum", "A", 2),
    (UGC, "GeneralWebsite", "C", 5),
]


def source_class(domain: Column) -> Column:
    """struct(source_type, authority, priority) by the first rung that fits; else an unknown website of priority 4."""
    def row(kind: str, level: str, rank: int) -> Column:
        return F.struct(F.lit(kind).alias("source_type"), F.lit(level).alias("authority"), F.lit(rank).alias("priority"))

    d, out = F.lower(domain), None
    for pattern, *values in LADDER:
        out = F.when(d.rlike(pattern), row(*values)) if out is None else out.when(d.rlike(pattern), row(*values))
    return out.otherwise(row("GeneralWebsite", "UNKNOWN", 4))
