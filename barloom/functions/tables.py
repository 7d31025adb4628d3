"""Table functions of SQL: lines of a series' indicators, sections of a text.

    register(spark)
    spark.sql("SELECT * FROM indicator_lines(TABLE(bars) PARTITION BY code ORDER BY ts)")
    spark.sql("SELECT d.doc_id, s.* FROM documents d, LATERAL text_sections(d.text) s")

A partition of the table argument is a series; it is computed in parts, so a task holds a part of one."""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from barloom.deploy import ship
from barloom.operators import textsections
from barloom.operators.indicators import held_at_start, line_names, rsv_line, run_lines, shown_lines
from barloom.operators.params import Config

#: Bars that are computed at once.
PART_ROWS = 20_000
_BARS = ("high", "low", "close")


class IndicatorLines:
    """The table's columns with dif, dea, hist, k, d, j and rsi_* of its rows, which must come in order of time and need
    high, low and close."""

    @staticmethod
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        if not table.isTable:
            raise ValueError("indicator_lines needs a table")
        missing = [c for c in _BARS if c not in table.dataType.fieldNames()]
        if missing:
            raise ValueError(f"indicator_lines needs {', '.join(missing)}")
        out = StructType(list(table.dataType.fields))
        for name in IndicatorLines.shown():
            out = out.add(name, DoubleType())
        return AnalyzeResult(schema=out)

    @staticmethod
    def shown() -> list[str]:
        return [n for n in line_names(Config()) if not n.endswith("_before")]

    def __init__(self):
        self._c, self._rows, self._seen, self._tail = Config(), [], 0, np.zeros((2, 0))
        self._held = held_at_start(self._c)

    def eval(self, row):
        if len(self._rows) >= PART_ROWS:
            yield from self._part(self._seen + PART_ROWS + 1)
        self._rows.append(row)

    def terminate(self):
        if self._rows:
            yield from self._part(self._seen + len(self._rows))

    def _part(self, n: int):
        high, low, close = (np.array([r[c] for r in self._rows], dtype=float) for c in _BARS)
        rsv, self._tail = rsv_line(high, low, close, self._c.kdj[0], self._tail)
        lines, self._held = run_lines(self._c, (), self._seen, close[:, None], rsv[:, None], self._held)
        lines = shown_lines(lines, self._c, (), np.array([n]))
        made = [x[:, 0] for x, name in zip(lines, line_names(self._c), strict=True) if not name.endswith("_before")]
        for row, *values in zip(self._rows, *made, strict=True):
            yield (*row, *[None if v != v else float(v) for v in values])
        self._seen += len(self._rows)
        self._rows = []


class TextSections:
    """seq, type, content and text of each section of a text."""

    @staticmethod
    def analyze(text: AnalyzeArgument) -> AnalyzeResult:
        if not isinstance(text.dataType, StringType):
            raise ValueError("text_sections needs a text")
        return AnalyzeResult(schema=StructType().add("seq", IntegerType()).add("type", StringType()).add("content", ArrayType(ArrayType(StringType()))).add("text", StringType()))

    def eval(self, text):
        yield from textsections.of_text(text)


def register(spark: SparkSession) -> None:
    """Makes both known to the session's SQL."""
    from pyspark.sql.functions import udtf

    ship(spark)
    spark.udtf.register("indicator_lines", udtf(IndicatorLines))
    spark.udtf.register("text_sections", udtf(TextSections))
