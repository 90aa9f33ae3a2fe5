"""Calendar text to years: one ordered chain of column expressions over fixed dictionaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Dynasties and periods with their years, era names with first year and dynasty.
DYNASTIES = {
    "夏": (-2070, -1600), "商": (-1600, -1046), "西周": (-1046, -771), "周": (-1046, -256), "东周": (-770, -256), "春秋": (-770, -476), "战国": (-475, -221),
    "秦": (-221, -207), "西汉": (-202, 8), "汉": (-202, 220), "东汉": (25, 220), "三国": (220, 280), "魏": (220, 266), "蜀汉": (221, 263), "吴": (222, 280),
    "西晋": (266, 316), "晋": (266, 420), "东晋": (317, 420), "南北朝": (420, 589), "南朝": (420, 589), "北朝": (386, 581), "隋": (581, 618), "唐": (618, 907),
    "五代": (907, 979), "五代十国": (907, 979), "北宋": (960, 1127), "南宋": (1127, 1279), "宋": (960, 1279), "辽": (907, 1125), "金": (1115, 1234),
    "元": (1271, 1368), "明": (1368, 1644), "清": (1636, 1912), "民国": (1912, 1949),
}
PERIODS = {"先秦": (-2070, -221), "秦汉": (-221, 220), "两晋南北朝": (266, 589), "隋唐": (581, 907), "宋元": (960, 1368), "明清": (1368, 1912), "近代": (1840, 1949), "现代": (1949, 2100), "当代": (1978, 2100)}
ERAS = {
    "建元": (-140, "汉"), "元光": (-134, "汉"), "元朔": (-128, "汉"), "元狩": (-122, "汉"), "元鼎": (-116, "汉"), "元封": (-110, "汉"), "建武": (25, "东汉"), "永平": (58, "东汉"),
    "建安": (196, "东汉"), "黄初": (220, "三国"), "太康": (280, "晋"), "永嘉": (307, "晋"), "开皇": (581, "隋"), "大业": (605, "隋"), "武德": (618, "唐"), "贞观": (627, "唐"),
    "永徽": (650, "唐"), "开元": (713, "唐"), "天宝": (742, "唐"), "贞元": (785, "唐"), "会昌": (841, "唐"), "建隆": (960, "宋"), "庆历": (1041, "宋"), "熙宁": (1068, "宋"),
    "元祐": (1086, "宋"), "宣和": (1119, "宋"), "靖康": (1126, "宋"), "绍兴": (1131, "宋"), "淳熙": (1174, "宋"), "庆元": (1195, "宋"), "嘉定": (1208, "宋"), "至元": (1264, "元"),
    "元贞": (1295, "元"), "至正": (1341, "元"), "洪武": (1368, "明"), "建文": (1399, "明"), "永乐": (1403, "明"), "宣德": (1426, "明"), "正统": (1436, "明"), "成化": (1465, "明"),
    "弘治": (1488, "明"), "正德": (1506, "明"), "嘉靖": (1522, "明"), "隆庆": (1567, "明"), "万历": (1573, "明"), "泰昌": (1620, "明"), "天启": (1621, "明"), "崇祯": (1628, "明"),
    "顺治": (1644, "清"), "康熙": (1662, "清"), "雍正": (1723, "清"), "乾隆": (1736, "清"), "嘉庆": (1796, "清"), "道光": (1821, "清"), "咸丰": (1851, "清"), "同治": (1862, "清"),
    "光绪": (1875, "清"), "宣统": (1909, "清"),
}
STEMS, BRANCHES = "甲乙丙丁戊己庚辛壬癸", "子丑寅卯辰巳午未申酉戌亥"
ANCHORS = {"明": 1368, "清": 1636, "宋": 960, "唐": 618, "汉": -202, "元": 1271}

_NUMBER = "[一二三四五六七八九十百零0-9]"


def number(x: Column) -> Column:
    """Chinese or Arabic numeral from 1 to 999 to an integer; 元 is 1."""
    d = F.regexp_replace(F.translate(x, "一二三四五六七八九零", "1234567890"), "元", "1")
    hundreds = F.regexp_extract(d, "([0-9]?)百", 1)
    tens = F.regexp_extract(d, "([0-9]?)十", 1)
    ones = F.regexp_extract(d, "([0-9]?)$", 1)
    digit = lambda c, default: F.when(c == "", default).otherwise(c.cast("int"))
    spelled = F.when(d.contains("百"), 100 * digit(hundreds, 1)).otherwise(0) + F.when(d.contains("十"), 10 * digit(tens, 1)).otherwise(0) + digit(ones, 0)
    return F.when(d.rlike("^[0-9]+$"), d.try_cast("int")).otherwise(spelled)


def _span(lo: Column, hi: Column, approximate: bool, granularity: str, dynasty: Column | None = None, period: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(lo.cast("int").alias("valid_from"), hi.cast("int").alias("valid_to"), F.lit(approximate).alias("approximate"), F.lit(granularity).alias("granularity"),
                    (none if dynasty is None else dynasty).alias("dynasty"), (none if period is None else period).alias("period"))


def parse(text: Column) -> Column:
    """struct(valid_from, valid_to, approximate, granularity, dynasty, period), or null.

    In order: era year, republic year, year before or after Christ, sexagenary year (by
    dynasty, else nearest 1900), century, dynasty or period (longest name first), decade
    (two digits count as of the century from 1900).
    """
    t = F.trim(text)
    rules: list[Column] = []
    for era, (first, dynasty) in ERAS.items():
        n = F.regexp_extract(t, rf"{era}\s*(元|{_NUMBER}{{1,6}})\s*年", 1)
        y = F.lit(first - 1) + number(n)
        rules.append(F.when(n != "", _span(y, y, False, "year", F.lit(dynasty))))
    n = F.regexp_extract(t, rf"民国\s*(元|{_NUMBER}{{1,4}})\s*年", 1)
    rules.append(F.when(n != "", _span(1911 + number(n), 1911 + number(n), False, "year", F.lit("民国"))))
    bc = F.regexp_extract(t, r"公元前\s*([0-9]{1,4})", 1)
    rules.append(F.when(bc != "", _span(-bc.try_cast("int"), -bc.try_cast("int"), False, "year")))
    named = F.regexp_extract(t, r"公元\s*([0-9]{4})\s*年", 1)
    ad = F.when(named != "", named).otherwise(F.regexp_extract(t, r"(?:^|[^0-9A-Za-z_\x{0080}-\x{FFFF}])([0-9]{4})\s*年", 1)).try_cast("int")
    rules.append(F.when(ad.between(1000, 2100), _span(ad, ad, False, "year")))
    sign = F.regexp_extract(t, f"([{STEMS}][{BRANCHES}])", 1)
    place = reduce(lambda a, g: a.when(sign == g[1], g[0]), [(i, STEMS[i % 10] + BRANCHES[i % 12]) for i in range(1, 60)], F.when(sign == STEMS[0] + BRANCHES[0], 0))
    anchor = reduce(lambda a, d: a.when(t.contains(d), d), list(ANCHORS)[1:], F.when(t.contains("明"), "明"))
    low = reduce(lambda a, d: a.when(anchor == d, ANCHORS[d] - 60), ANCHORS, F.when(F.lit(False), 0))
    anchored = low + F.pmod(F.lit(1984) + place - low, F.lit(60))
    free = F.lit(1870) + F.pmod(F.lit(1984) + place - 1870, F.lit(60))
    rules.append(F.when(place.isNotNull(), _span(F.coalesce(anchored, free), F.coalesce(anchored, free), True, "year", anchor)))
    century = F.regexp_extract(t, r"([0-9]{1,2})\s*世纪", 1).try_cast("int")
    rules.append(F.when(century.isNotNull(), _span((century - 1) * 100, (century - 1) * 100 + 99, True, "era")))
    for name in sorted([*DYNASTIES, *PERIODS], key=len, reverse=True):
        lo, hi = DYNASTIES.get(name) or PERIODS[name]
        rules.append(F.when(t.contains(name), _span(F.lit(lo), F.lit(hi), True, "period", F.lit(name) if name in DYNASTIES else None, None if name in DYNASTIES else F.lit(name))))
    decade = F.regexp_extract(t, r"([0-9]{2,3})\s*年代", 1).try_cast("int")
    base = F.floor(F.when(decade < 100, 1900).otherwise(decade) / 10) * 10
    rules.append(F.when(decade.isNotNull(), _span(base, base + 9, True, "decade")))
    return F.coalesce(*rules)


AXIS = ["先秦", "秦汉", "两晋南北朝", "隋唐", "宋元", "明清", "近代", "现代"]


def period_of_year(year: Column) -> Column:
    """The first period of the axis that has the year; 秦汉 also from 220 to 266."""
    out = F.when((year > 220) & (year < 266), "秦汉")
    for name in AXIS:
        lo, hi = PERIODS[name]
        out = out.when((year >= lo) & (year <= hi), name)
    return out
