"""Research plans as column expressions: names that a target goes by, waves of queries, and providers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Other names of targets, characters with a traditional form, query limits of source classes, source classes of
# fields, fields of gap types, topics with their words and classes, and site limits of classes.
ALIASES = {"汉口": ["武汉", "江汉"], "川盐济楚": ["川盐", "盐济楚岸", "自贡 盐 两湖"], "湖广填四川": ["麻城孝感", "移民四川", "江西填湖广"], "万里茶道": ["羊楼洞", "中俄茶叶之路"]}
SIMPLIFIED, TRADITIONAL = "汉门长广东峡盐济铁厂历", "漢門長廣東峽鹽濟鐵廠歷"
FILTERS = {
    "Government": ["site:gov.cn"], "Archive": ["site:gov.cn 档案", "档案馆"], "LocalChronicle": ["地方志", "县志", "府志", "省志"], "Museum": ["博物馆", "博物院"], "University": ["site:edu.cn"], "AcademicJournal": ["学报", "期刊论文", "cnki"],
    "AncientText": ["原文", "影印", "四库", "丛书"], "Gazetteer": ["水经注", "一统志", "地方志"], "Newspaper": ["申报", "大公报", "日报"], "CulturalInstitution": ["文化馆", "文旅"], "ICHDatabase": ["非物质文化遗产", "非遗 名录", "代表性传承人"],
    "WaterConservancyInstitution": ["水利", "长江水利委员会", "水文"], "PartyHistoryInstitution": ["党史", "党史研究室", "革命纪念馆"],
}
SOURCES = {
    "time": ["LocalChronicle", "AncientText", "AcademicJournal"], "origin": ["LocalChronicle", "AcademicJournal", "University"], "destination": ["LocalChronicle", "AcademicJournal"], "content": ["Newspaper", "LocalChronicle", "AcademicJournal"],
    "route": ["Gazetteer", "WaterConservancyInstitution", "LocalChronicle"], "mechanism": ["Government", "AcademicJournal", "PartyHistoryInstitution"], "core_practices": ["ICHDatabase", "CulturalInstitution", "Museum"], "carriers": ["LocalChronicle", "Archive", "University"], "outcomes": ["AcademicJournal", "University"],
}
TRADITION, PROCESS, FLOW = ["origin", "core_practices", "carriers", "time"], ["time", "origin", "destination", "carriers", "mechanism", "outcomes"], ["origin", "destination", "content", "time", "route", "mechanism"]
GAP_FIELDS = {"MISSING_SYSTEM_MEMBERSHIP": ["origin", "carriers"], "MISSING_PROCESS_STAGE": PROCESS, "MISSING_EVIDENCE": TRADITION, "SINGLE_SOURCE_STRUCTURE": list(dict.fromkeys(TRADITION + PROCESS)), "MISSING_CROSS_REGION_LINK": FLOW, "MISSING_HYDRO_LINK": ["route", "mechanism"]}
SITE_LIMITS = {"Government": "site:gov.cn", "University": "site:edu.cn", "Museum": "博物馆", "LocalChronicle": "地方志", "Archive": "档案", "AcademicJournal": "学报 OR 期刊", "ICHDatabase": "非物质文化遗产", "WaterConservancyInstitution": "水利", "PartyHistoryInstitution": "党史", "Gazetteer": "水经注 OR 建置沿革", "Newspaper": "申报 OR 近代报刊", "Wikipedia": "site:zh.wikipedia.org"}


def variants(name: Column) -> Column:
    """The name, other names of what it holds, and its traditional form; each once, in this order."""
    n = F.coalesce(name, F.lit(""))
    none = F.array().cast("array<string>")
    parts = [F.array(n), *(F.when(F.contains(n, F.lit(k)), F.array(*map(F.lit, v))).otherwise(none) for k, v in ALIASES.items()), F.array(F.translate(n, SIMPLIFIED, TRADITIONAL))]
    return F.array_distinct(F.filter(F.concat(*parts), lambda x: x != ""))


def limits_of(gap: str) -> list[str]:
    """Query limits of the sources of a gap's fields, each once; gaps of no known type are taken for flows."""
    return list(dict.fromkeys(f for field in GAP_FIELDS.get(gap, FLOW) for s in SOURCES[field] for f in FILTERS[s]))


def _by_gap(gap: Column, values: dict[str, list[str]], other: list[str]) -> Column:
    return reduce(lambda c, kv: c.when(gap == kv[0], F.array(*map(F.lit, kv[1]))), values.items(), F.when(F.lit(False), F.array(F.lit("")))).otherwise(F.array(*map(F.lit, other)))


def _said(terms: Column, most: int, endings: list[str]) -> Column:
    return F.flatten(F.transform(F.slice(terms, 1, most), lambda t: F.array(*(F.concat(t, F.lit(" " + e)) for e in endings))))


def waves(name: Column, gap: Column) -> Column:
    """array(struct(wave, purpose, queries)): an overview, what fills the gap's fields, and what contradicts."""
    limits = _by_gap(gap, {g: limits_of(g)[:6] for g in GAP_FIELDS}, limits_of("")[:6])
    fields = _by_gap(gap, {g: f[:3] for g, f in GAP_FIELDS.items()}, FLOW[:3])

    def of(terms: Column) -> Column:
        overview = F.concat(_said(terms, 4, ["历史"]), _said(terms, 2, ["起源", "沿革", "考证"]))
        limited = F.flatten(F.transform(F.slice(terms, 1, 3), lambda t: F.transform(limits, lambda x: F.concat(t, F.lit(" "), x))))
        filled = F.flatten(F.transform(F.slice(terms, 1, 2), lambda t: F.transform(fields, lambda x: F.concat(t, F.lit(" "), x, F.lit(" 史料")))))
        against = F.concat(_said(terms, 3, ["争议"]), _said(terms, 2, ["另一说"]), _said(terms, 2, ["质疑 考证"]))
        rows = [("overview", overview, 8), ("field_fill", F.concat(limited, filled), 10), ("contradiction", against, 6)]
        return F.array(*(F.struct(F.lit(i).alias("wave"), F.lit(p).alias("purpose"), F.slice(F.array_distinct(q), 1, n).alias("queries")) for i, (p, q, n) in enumerate(rows)))

    return F.get(F.transform(F.array(variants(name)), of), F.lit(0))


def providers(queries: Column, classes: Column, most: int = 6) -> Column:
    """array(struct(provider, query, source_class)): each query to the encyclopedia, to the web, and to sites of the
    source classes in order, ``most`` of the last in all; classes without a site limit are passed over."""
    sites = F.map_from_arrays(F.array(*map(F.lit, SITE_LIMITS)), F.array(*map(F.lit, SITE_LIMITS.values())))

    def row(provider: str, q: Column, c: Column) -> Column:
        return F.struct(F.lit(provider).alias("provider"), q.alias("query"), c.alias("source_class"))

    limited = F.flatten(F.transform(F.filter(classes, lambda c: c.isin(list(SITE_LIMITS))), lambda c: F.transform(queries, lambda q: row("web", F.concat(q, F.lit(" "), F.element_at(sites, c)), c))))
    return F.concat(F.transform(queries, lambda q: row("encyclopedia", q, F.lit("Wikipedia"))), F.transform(queries, lambda q: row("web", q, F.lit("GeneralWebsite"))), F.slice(limited, 1, most))
