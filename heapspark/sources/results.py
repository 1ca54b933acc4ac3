"""Results as files: CSV, aligned text, HTML, and reports of several sections."""

from __future__ import annotations

import html
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

#: Rows that a page shows unless told otherwise.
PAGE = 25


def refine(df: DataFrame, filters: Sequence = (), sort: str = "", hide: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """Filters, then order, then limit, then hidden columns.  sort: `name=DESC,other`; nulls first ascending."""
    for condition in filters:
        df = df.where(condition)
    if sort:
        parts = [p.strip().partition("=") for p in sort.split(",")]
        df = df.orderBy(*[F.desc_nulls_last(n) if d.upper() == "DESC" else F.asc_nulls_first(n) for n, _, d in parts])
    if limit is not None:
        df = df.limit(limit)
    return df.drop(*hide)


def filtered_out(df: DataFrame, filters: Sequence = ()) -> DataFrame:
    """(shown, filtered) in one row: how many rows the filters leave, and how many they hide."""
    keep = F.lit(True)
    for condition in filters:
        keep = keep & F.coalesce(condition, F.lit(False))
    return df.agg(F.count_if(keep).alias("shown"), F.count_if(~keep).alias("filtered"))


def write_csv(df: DataFrame, path: str, separator: str = ",") -> None:
    """Distributed: a folder of files with headers."""
    df.write.mode("overwrite").option("header", True).option("sep", separator).csv(path)


def to_text(df: DataFrame, limit: int = PAGE) -> str:
    """Aligned columns of the first rows; numbers to the right."""
    shown = [[("" if v is None else str(v)) for v in r] for r in df.limit(limit).collect()]
    names = df.columns
    width = [max(len(n), *(len(r[i]) for r in shown), 0) if shown else len(n) for i, n in enumerate(names)]
    right = [t in ("int", "bigint", "double", "float") for _, t in df.dtypes]
    line = lambda cells: " | ".join(c.rjust(w) if r else c.ljust(w) for c, w, r in zip(cells, width, right)).rstrip()
    return "\n".join([line(names), "-+-".join("-" * w for w in width), *map(line, shown)])


def to_html(df: DataFrame, limit: int = PAGE, totals: Sequence[str] = ()) -> str:
    """A table of the first rows, and of all rows' totals where asked."""
    cell = lambda tag, v: f"<{tag}>{html.escape('' if v is None else str(v))}</{tag}>"
    head = "".join(cell("th", c) for c in df.columns)
    body = "".join("<tr>" + "".join(cell("td", v) for v in r) + "</tr>" for r in df.limit(limit).collect())
    foot = ""
    if totals:
        row = df.agg(*[F.sum(c).alias(c) for c in totals]).first()
        foot = "<tr>" + "".join(cell("td", row[c] if c in totals else "") for c in df.columns) + "</tr>"
    return f"<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody><tfoot>{foot}</tfoot></table>"


def report(sections: Mapping[str, DataFrame], folder: str, limit: int = PAGE) -> list[str]:
    """An HTML page with a table of contents, and each section's whole rows as CSV beside it, on any file system that Spark writes to."""
    toc = "".join(f'<li><a href="#s{i}">{html.escape(n)}</a></li>' for i, n in enumerate(sections))
    body = "".join(f'<h2 id="s{i}">{html.escape(n)}</h2>{to_html(df, limit)}' for i, (n, df) in enumerate(sections.items()))
    spark = next(iter(sections.values())).sparkSession
    page = f"{folder.rstrip('/')}/index.html"
    at = spark._jvm.org.apache.hadoop.fs.Path(page)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)  # folders too
    out.write(bytearray(f"<html><body><ol>{toc}</ol>{body}</body></html>".encode()))
    out.close()
    for i, df in enumerate(sections.values()):
        write_csv(df, f"{folder}/section-{i}")
    return [page, *[f"{folder}/section-{i}" for i in range(len(sections))]]
