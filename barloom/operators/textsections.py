"""Company texts: sections and tables of contents."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: What marks lines.
_BORDER = r"^\s*[┌├└─┬┼┴┘┐].*─|^\s*─"
#: What a line's edges lose.
_EDGES = " \t\n\x0b\f\r\u00a0\u3000\ufeff"
_HEADER, _LINK, _RULE = r"^【.*】$", r"^https?://\S+$", r"^─+$"


def _kind(line: Column) -> Column:
    return (
        F.when(line == "", "blank").when(line.rlike(_BORDER), "border").when(line.startswith("│"), "row").when(line.rlike(_HEADER), "header").when(line.rlike(_LINK), "link").otherwise("text")
    )


def sections(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, seq, type (table, paragraph, header, link), content (a table's rows of cells), text. A border line
    ends a paragraph but goes on with the table before it; blank lines end both. Lines are numbered and
    grouped by windows over one document, so long texts are rows and not one value."""
    lines = docs.select(F.col(key).alias("k"), F.posexplode(F.split(F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("\r"), F.lit("")), "\n")).alias("pos", "raw"))
    lines = lines.withColumn("line", F.regexp_replace("raw", r"^[\s 　﻿]+|[\s 　﻿]+$", "")).withColumn("kind", _kind(F.col("line")))
    cells = F.transform(F.split("line", "│"), lambda c: F.trim(c))
    inner = F.slice(cells, 2, F.greatest(F.size(cells) - 2, F.lit(0)))
    lines = lines.withColumn("cells", F.when(F.col("kind") == "row", inner))
    lines = lines.where(~((F.col("kind") == "row") & (F.size("cells") == 0)) | (F.col("kind") != "row"))
    # A row of a table goes on with the one before unless a line that ends tables lies between; likewise text.
    w = Window.partitionBy("k").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    table_breaks = F.count_if(F.col("kind").isin("blank", "header", "link", "text")).over(w)
    text_breaks = F.count_if(F.col("kind") != "text").over(w)
    marked = lines.withColumn("g", F.when(F.col("kind") == "row", table_breaks).when(F.col("kind") == "text", text_breaks).otherwise(F.col("pos")))
    parts = marked.where(F.col("kind").isin("row", "text", "header", "link")).groupBy("k", "kind", "g").agg(
        F.min("pos").alias("first"), F.array_sort(F.collect_list(F.struct("pos", "cells", "line"))).alias("rows")
    )
    kind = F.when(F.col("kind") == "row", "table").when(F.col("kind") == "text", "paragraph").otherwise(F.col("kind"))
    ends = F.when(F.col("kind") == "row", F.transform("rows", lambda r: r["cells"])).otherwise(F.array().cast("array<array<string>>"))
    body = F.when(F.col("kind") == "row", "").otherwise(F.array_join(F.transform("rows", lambda r: r["line"]), "\n"))
    return parts.select(F.col("k").alias(key), (F.row_number().over(Window.partitionBy("k").orderBy("first")) - 1).alias("seq"), kind.alias("type"), ends.alias("content"), body.alias("text"))


def of_text(text: str | None) -> Iterator[tuple]:
    """seq, type, content, text of each section of one text, as sections() has them."""
    kind_now, rows, seq = None, [], 0

    def made() -> tuple:
        return seq, "table" if kind_now == "row" else "paragraph", [r for r in rows] if kind_now == "row" else [], "" if kind_now == "row" else "\n".join(rows)

    for raw in (text or "").replace("\r", "").split("\n"):
        line = raw.strip(_EDGES)
        kind = "blank" if line == "" else "border" if re.search(_BORDER, line, re.A) else "row" if line.startswith("│") else "header" if re.search(_HEADER, line) else "link" if re.search(_LINK, line, re.A) else "text"
        cells = [c.strip(" ") for c in line.split("│")][1:-1] if kind == "row" else []
        if kind == "row" and not cells:
            continue
        if kind_now and kind != kind_now and not (kind_now == "row" and kind == "border"):
            yield made()
            kind_now, rows, seq = None, [], seq + 1
        if kind in ("header", "link"):
            yield seq, kind, [], line
            seq += 1
        elif kind in ("row", "text"):
            kind_now = kind
            rows.append(cells if kind == "row" else line)
    if kind_now:
        yield made()


def html(parts: DataFrame) -> DataFrame:
    """Each section as HTML, escaped."""
    def escaped(x: Column) -> Column:
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            x = F.replace(x, F.lit(a), F.lit(b))
        return x

    def row(cells: Column) -> Column:
        return F.concat(F.lit("<tr>"), F.array_join(F.transform(cells, lambda c: F.concat(F.lit("<td>"), escaped(c), F.lit("</td>"))), ""), F.lit("</tr>"))

    t, safe = F.col("type"), escaped(F.col("text"))
    made = (
        F.when(t == "table", F.concat(F.lit("<table>"), F.array_join(F.transform("content", row), ""), F.lit("</table>"))).when(t == "header", F.concat(F.lit("<h3>"), safe, F.lit("</h3>")))
        .when(t == "link", F.concat(F.lit('<a href="'), safe, F.lit('">'), safe, F.lit("</a>"))).otherwise(F.concat(F.lit("<p>"), F.replace(safe, F.lit("\n"), F.lit("<br>")), F.lit("</p>")))
    )
    return parts.withColumn("html", made)


def from_toc(toc: DataFrame, files: DataFrame, name: str) -> DataFrame:
    """The bytes that each code's entry of that name points to in its file (columns code, filename, content)."""
    entry = toc.where(F.col("name") == name).groupBy("code", "filename").agg(F.min(F.struct("start", "length")).alias("at"))
    return entry.join(files, ["code", "filename"]).select("code", "filename", F.substring(F.col("content"), F.col("at.start") + 1, F.col("at.length")).alias("part"))
