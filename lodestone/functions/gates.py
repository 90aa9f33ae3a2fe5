"""Fixed patterns of the gates and the small rules that clean a judge's answers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that no gate admits, words of disputes, enterprises, provinces that contain places, regions in
# the order in which names are searched for them, suffixes of provinces, punctuation of keys.
HARD_REJECT = r"停车|换乘|P\+R|收费站|高速公路|G\d+|S\d+省道|立交|高架|地铁线路|公交线路|查重|搬运|DNF|搬砖|bilibili|快手|抖音|APP|下载|安装|怎么读|的意思|的解释|的拼音|的笔顺|新华字典|汉典|官网|首页|订票|门票价格|导航|在线|系统说明|搬砖攻略|游戏|论坛"
DISPUTE = r"争议|另一说|一说|质疑|存疑|考证|或云|异说|分歧"
ENTERPRISE = r"(有限公司|股份有限公司|集团|责任公司|公司$)"
PROVINCES = ["四川", "湖北", "湖南", "江苏", "浙江", "安徽", "江西", "贵州", "云南", "青海", "西藏", "甘肃", "陕西", "河南", "广西", "广东", "福建"]
REGIONS = ["湖北", "湖南", "四川", "重庆", "江苏", "江西", "安徽", "云南", "贵州", "青海", "西藏", "甘肃", "河南", "陕西", "浙江", "上海"]
PROVINCE_SUFFIX = r"(省|自治区|特别行政区)$"
KEY_PUNCTUATION = r"""[\s，。、；：？！"'（）()\[\]【】《》<>—\-…·,.:;?!]+"""


def hard_negative(name: Column) -> Column:
    return F.coalesce(name.rlike("(?i)" + HARD_REJECT), F.lit(False))


def province_container(name: Column) -> Column:
    n = F.trim(F.coalesce(name, F.lit("")))
    return n.isin(PROVINCES) | n.rlike(PROVINCE_SUFFIX)


def verdict(name: Column, judged: Column) -> Column:
    """Hard negatives first, then the judge; an answer that is neither KEEP nor REJECT is REJECT."""
    return F.when(hard_negative(name), "REJECT").when(judged == "KEEP", "KEEP").otherwise("REJECT")


def unit_score(text: Column) -> Column:
    """A number from 0 to 1; what is no number is 0."""
    return F.least(F.greatest(F.coalesce(text.try_cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))


def norm_key(text: Column, most: int = 120) -> Column:
    return F.substring(F.regexp_replace(F.coalesce(text, F.lit("")), KEY_PUNCTUATION, ""), 1, most)


def pieces(text: Column, most: int = 20) -> Column:
    """The parts between enumerating commas and semicolons that aren't blank, the first ``most``."""
    cut = F.transform(F.split(F.coalesce(text, F.lit("")), "[、,，;；]"), lambda x: F.trim(x))
    return F.slice(F.filter(cut, lambda x: x != ""), 1, most)


def first_held(text: Column, names: list[str]) -> Column:
    """The first name of the list that the text holds; null if none."""
    return F.coalesce(*(F.when(F.contains(text, F.lit(n)), n) for n in names))
