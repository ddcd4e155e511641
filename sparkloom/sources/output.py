"""Results as text: JSON without nulls, aligned tables, a dependency matrix as a page, skipped files.

Renderers of whole results take a bounded number of rows to the driver (`most`); JSON lines are
written by the executors.
"""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame, functions as F

BEGIN, END = "---BEGIN---", "---END---"


def json_rows(df: DataFrame) -> DataFrame:
    """(value): a JSON object for each row, null fields left out."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "true"}).alias("value"))


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines by the executors."""
    json_rows(df).write.text(path)


def wrap(text: str, begin: str = BEGIN, end: str = END) -> str:
    return f"{begin}\n{text}\n{end}"


def _bounded(df: DataFrame, most: int) -> list:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: write them with write_json")
    return rows


def as_json(df: DataFrame, hints: list[str] | None = None, most: int = 10_000) -> str:
    """An array of objects between markers; without rows, an object with empty results and hints."""
    rows = _bounded(json_rows(df), most)
    return wrap("[" + ",".join(r.value for r in rows) + "]" if rows else json.dumps({"results": [], "hints": hints or []}, separators=(",", ":")))


def as_compact(df: DataFrame, most: int = 10_000) -> str:
    """A line for each row between markers: name=value, nulls left out."""
    rows = _bounded(df, most)
    return wrap("\n".join(" ".join(f"{k}={v}" for k, v in r.asDict().items() if v is not None) for r in rows))


def as_table(df: DataFrame, empty: str = "No rows found.", most: int = 10_000) -> str:
    """Columns as wide as their widest value, then the number of rows."""
    rows = [["" if v is None else str(v) for v in r] for r in _bounded(df, most)]
    if not rows:
        return empty
    wide = [max(len(c), *(len(r[i]) for r in rows)) for i, c in enumerate(df.columns)]
    line = lambda cells: " | ".join(c.ljust(w) for c, w in zip(cells, wide, strict=True)).rstrip()
    return "\n".join([line(df.columns), " | ".join("-" * w for w in wide), *map(line, rows), "", f"{len(rows)} rows."])


def matrix_page(cells: DataFrame, most: int = 10_000) -> str:
    """A dependency matrix (src, tgt, n) as an HTML page; cells below and above the diagonal differ, cycles stand out."""
    count = {(r[0], r[1]): r[2] for r in _bounded(cells.select("src", "tgt", "n"), most)}
    names = sorted({x for k in count for x in k})
    kind = lambda i, j, a, b: "own" if i == j else "" if (a, b) not in count else "cycle" if (b, a) in count else "down" if i > j else "up"
    head = "".join(f"<th title='{html.escape(n, True)}'>{i + 1}</th>" for i, n in enumerate(names))
    body = "".join(
        f"<tr><th>{i + 1} {html.escape(a)}</th>" + "".join(f"<td class='{kind(i, j, a, b)}'>{count.get((a, b), '')}</td>" for j, b in enumerate(names)) + "</tr>"
        for i, a in enumerate(names)
    )
    style = "td{border:1px solid #ccc;text-align:right}.own{background:#999}.cycle{background:#f99}.up{background:#fe9}.down{background:#9d9}"
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><style>{style}</style></head><body><table><tr><th></th>{head}</tr>{body}</table></body></html>"


def skipped_report(errors: DataFrame, path: str) -> str | None:
    """Write (path, reason) of files that could not be read as JSON lines; a warning with their number, None without any."""
    n = errors.count()
    if not n:
        return None
    write_json(errors, path)
    return f"{n} files could not be read; see {path}"
