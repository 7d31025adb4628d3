"""Indicator parameters: defaults, replaced by those of a code's size class, replaced by the code's own.

A part that is given replaces the whole part, so a partial one is rejected rather than filled with zeros."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.codes import CAP_NAMES, cap_category, lookup


@dataclass(frozen=True)
class Config:
    """ma and rsi: periods. macd: fast, slow, signal. kdj: n, m1, m2. boll: n, k."""

    ma: tuple[int, ...] = (5, 10, 20, 60, 120)
    macd: tuple[int, int, int] = (12, 26, 9)
    kdj: tuple[int, int, int] = (9, 3, 3)
    boll: tuple[int, float] = (20, 2.0)
    rsi: tuple[int, ...] = (6, 12, 24)

    def __post_init__(self):
        for f in fields(self):
            if not getattr(self, f.name) or any(x <= 0 for x in getattr(self, f.name)):
                raise ValueError(f"{f.name} needs positive numbers")


@dataclass(frozen=True)
class Partial:
    """Parts that replace those of a Config; None leaves a part as it is."""

    ma: tuple[int, ...] | None = None
    macd: tuple[int, int, int] | None = None
    kdj: tuple[int, int, int] | None = None
    boll: tuple[int, float] | None = None
    rsi: tuple[int, ...] | None = None

    def over(self, base: Config) -> Config:
        return replace(base, **{f.name: v for f in fields(self) if (v := getattr(self, f.name)) is not None})


#: Fixed values of the embedded default file.
CATEGORIES = {
    "large_cap": Partial(ma=(5, 10, 20, 60, 120), macd=(12, 26, 9)),
    "small_cap": Partial(ma=(5, 10, 20), macd=(8, 17, 9), kdj=(7, 3, 3)),
}
OVERRIDES = {"000001": Partial(kdj=(5, 3, 3))}


@dataclass(frozen=True)
class Params:
    defaults: Config = Config()
    categories: tuple[tuple[str, Partial], ...] = tuple(CATEGORIES.items())
    overrides: tuple[tuple[str, Partial], ...] = tuple(OVERRIDES.items())

    def resolve(self, code: str, category: str) -> Config:
        out = self.defaults
        for name, part in ((category, dict(self.categories)), (code, dict(self.overrides))):
            if name in part:
                out = part[name].over(out)
        return out

    def configs(self) -> dict[tuple[str, str], Config]:
        """By category and code, for each category and each code of an override ("" for all others): as many
        as the file has lines, however many codes there are."""
        names = ["large_cap", "mid_cap", "small_cap", *dict(self.categories)]
        return {(c, code): self.resolve(code, c) for c in dict.fromkeys(names) for code in ["", *dict(self.overrides)]}

    def numbered(self, spark: SparkSession) -> tuple[tuple[Config, ...], DataFrame]:
        """The distinct configurations, and which is whose: category, own, config."""
        held = self.configs()
        distinct = tuple(dict.fromkeys(held.values()))
        return distinct, spark.createDataFrame([(c, code, distinct.index(x)) for (c, code), x in held.items()], "category string, own string, config int")


def load(text: str) -> Params:
    """From the YAML of a parameter file; a file without text gives the defaults."""
    import yaml

    return from_mapping(yaml.safe_load(text) or {})


def from_mapping(m: dict) -> Params:
    def part(x: dict) -> dict:
        out = {k: tuple(x[k]) for k in ("ma", "rsi") if x.get(k) is not None}
        for name, inner in (("macd", ("fast", "slow", "signal")), ("kdj", ("n", "m1", "m2")), ("boll", ("n", "k"))):
            if x.get(name) is not None:
                missing = [k for k in inner if k not in x[name]]
                if missing:
                    raise ValueError(f"{name} lacks {', '.join(missing)}")
                out[name] = tuple(x[name][k] for k in inner)
        return out

    categories = {k: Partial(**part(v)) for k, v in (m.get("categories") or {}).items()}
    overrides = {str(k): Partial(**part(v)) for k, v in (m.get("overrides") or {}).items()}
    return Params(Partial(**part(m.get("defaults") or {})).over(Config()), tuple(categories.items()), tuple(overrides.items()))


def with_own(codes: DataFrame, params: Params) -> DataFrame:
    """codes with their category, and `own`: the code if it has parameters of its own, else empty."""
    own = [code for code, _ in params.overrides]
    return with_category(codes).withColumn("own", F.when(F.col("code").isin(*own), F.col("code")).otherwise("") if own else F.lit(""))


def with_category(codes: DataFrame) -> DataFrame:
    return codes.withColumn("category", cap_category(F.col("code")))


def parse_category(name):
    return lookup(name, CAP_NAMES, F.lit("mid_cap"))


def resolved(codes: DataFrame, params: Params = Params()) -> DataFrame:
    """Each code's parameters, as a row."""
    table = params_table(codes.sparkSession, params)
    return with_own(codes, params).join(F.broadcast(table), ["category", "own"]).drop("own")


def params_table(spark: SparkSession, params: Params) -> DataFrame:
    rows = [(category, code, list(c.ma), *c.macd, *c.kdj, c.boll[0], float(c.boll[1]), list(c.rsi)) for (category, code), c in params.configs().items()]
    return spark.createDataFrame(
        rows,
        "category string, own string, ma array<int>, macd_fast int, macd_slow int, macd_signal int, kdj_n int, kdj_m1 int, kdj_m2 int, boll_n int, boll_k double, rsi array<int>",
    )
