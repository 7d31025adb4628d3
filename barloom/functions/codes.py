"""What a security's code tells: exchange, class, size."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: First match wins.
CLASSES = (
    ("8", "北交所股票"), ("399", "指数"), ("300", "创业板"), ("688", "科创板"), ("6", "沪市A股"), ("0", "深市主板"), ("1", "基金"), ("5", "ETF"), ("2", "债券"), ("9", "REITs"),
)
OTHER_CLASS = "其他"
#: What each category of a listing takes in.
CATEGORIES = {
    "stock": ("沪市A股", "深市主板", "创业板", "科创板", "北交所股票"),
    "fund": ("基金",),
    "etf": ("ETF",),
    "bond": ("债券",),
    "index": ("指数",),
    "gem": ("创业板",),
}
#: Prefixes of a bare code and their exchange, first match wins.
EXCHANGE_PREFIXES = (
    ("6", "sh"), ("0", "sz"), ("30", "sz"), ("510", "sh"), ("511", "sh"), ("512", "sh"), ("513", "sh"), ("515", "sh"), ("159", "sz"), ("8", "bj"), ("92", "bj"), ("43", "bj"), ("39", "sz"), ("9", "sh"),
)
#: Prefixes that are no stock's.
NOT_STOCKS = ("sh000", "sz399", "sh999", "sh888", "sh01", "sh02", "sz10", "sh11")
CAP_BY_PREFIX = {"600": "large_cap", "601": "large_cap", "603": "large_cap", "605": "large_cap", "000": "large_cap", "001": "large_cap", "002": "small_cap"}
#: Names of bar periods.
KTYPES = {"1m": 7, "minute": 7, "5m": 0, "15m": 1, "30m": 2, "60m": 3, "day": 9, "week": 5, "month": 6, "quarter": 10, "year": 11}
EXCHANGES = {"sh": 1, "shanghai": 1, "上海": 1, "sz": 0, "shenzhen": 0, "深圳": 0, "bj": 2, "beijing": 2, "北京": 2}
CAP_NAMES = {"large_cap": "large_cap", "大盘股": "large_cap", "mid_cap": "mid_cap", "中盘股": "mid_cap", "small_cap": "small_cap", "小盘股": "small_cap"}
#: Kinds of corporate action.
ACTION_NAMES = {
    1: "除权除息", 2: "送配股上市", 3: "非流通股上市", 4: "未知股本变动", 5: "股本变化", 6: "增发新股", 7: "股份回购", 8: "增发新股上市", 9: "转配股上市", 10: "可转债上市",
    11: "扩缩股", 12: "非流通股缩股", 13: "送认购权证", 14: "送认沽权证",
}


def _first(column: Column, pairs, otherwise) -> Column:
    """The value of the first pair whose prefix column has."""
    out = None
    for prefix, value in pairs:
        out = F.when(column.startswith(prefix), F.lit(value)) if out is None else out.when(column.startswith(prefix), F.lit(value))
    return out.otherwise(otherwise)


def lookup(column: Column, names: dict, otherwise) -> Column:
    """names[column], else otherwise."""
    out = None
    for key, value in names.items():
        out = F.when(column == key, F.lit(value)) if out is None else out.when(column == key, F.lit(value))
    return out.otherwise(otherwise)


def add_prefix(code: Column) -> Column:
    """A six-character code with its exchange in front, where that is known; any other code as it is."""
    exchange = _first(code, EXCHANGE_PREFIXES, F.lit(""))
    return F.when(F.length(code) == 6, F.concat(exchange, code)).otherwise(code)


def decoded(code: Column) -> tuple[Column, Column]:
    """Market and number of a code; both null if it has no known exchange."""
    full = F.lower(add_prefix(code))
    known = (F.length(full) == 8) & full.substr(1, 2).isin("sh", "sz", "bj")
    return F.when(known, full.substr(1, 2)), F.when(known, full.substr(3, 6))


def minute_market(code: Column) -> Column:
    """The market that minute requests use: a bare code that begins with 6 is Shanghai's, every other one
    Shenzhen's; a code of eight keeps its own prefix if that is known. Null for any other length."""
    own = code.substr(1, 2)
    return F.when(F.length(code) == 8, F.when(own.isin("sh", "sz", "bj"), own).otherwise("sz")).when(F.length(code) == 6, F.when(code.startswith("6"), "sh").otherwise("sz"))


def security_class(code: Column) -> Column:
    return _first(code, CLASSES, F.lit(OTHER_CLASS))


def in_category(code: Column, category: str) -> Column:
    """Whether a listing of the category has the code; "" and "all" have each, an unknown category none."""
    if category in ("", "all"):
        return F.lit(True)
    return security_class(code).isin(*CATEGORIES[category]) if category in CATEGORIES else F.lit(False)


def is_etf(code: Column) -> Column:
    """For codes with their exchange in front."""
    return (F.length(code) == 8) & F.lower(code).rlike("^(sh(51|56|58)|sz(15|16))")


def is_stock(code: Column) -> Column:
    full = F.lower(add_prefix(code))
    no = F.lit(False)
    for prefix in NOT_STOCKS:
        no = no | full.startswith(prefix)
    return full.rlike("^(sh|sz|bj)") & ~no & ~is_etf(full)


def cap_category(code: Column) -> Column:
    return F.when(F.length(code) < 3, "mid_cap").otherwise(lookup(code.substr(1, 3), CAP_BY_PREFIX, F.lit("mid_cap")))


def exchange_label(code: Column) -> Column:
    first = code.substr(1, 1)
    return F.when(first.isin("0", "3"), "深交所").when(first == "6", "上交所").when(first.isin("8", "9"), "北交所").otherwise("未知")


def exchange_label_short(code: Column) -> Column:
    """The label in text listings, which deals 3 to Beijing and every other unknown to Shenzhen."""
    first = code.substr(1, 1)
    return F.when(first == "6", "上交所").when(first.isin("8", "3"), "北交所").otherwise("深交所")


def ktype_of(name: Column) -> Column:
    return lookup(name, KTYPES, F.lit(9))


def exchange_id(name: Column) -> Column:
    return lookup(name, EXCHANGES, F.lit(0))


def action_name(category: Column) -> Column:
    return lookup(category, ACTION_NAMES, F.lit("未知"))
