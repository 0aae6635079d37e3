"""TOON, a compact text form of tables: name[n]{a,b}: and a line of comma-separated values for each row."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_HEAD = re.compile(r"^\s*([\w.-]+)?\[(\d+)\]\{([^}]*)\}:\s*$")
_CELL = re.compile(r'\s*(?:"((?:[^"\\]|\\.)*)"|([^,]*))\s*(?:,|$)')
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "\\": "\\"}


def _cells(line: str) -> list[str]:
    out, at, more = [], 0, True
    while more:
        m = _CELL.match(line, at)
        if m is None:
            raise ValueError(f"not a row: {line}")
        quoted = m[1] is not None
        out.append(re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), m[1]) if quoted else (m[2] or "").strip())
        more, at = m[0].endswith(","), m.end()
    return out


def parse(text: str) -> dict[str, tuple[list[str], list[list[str]]]]:
    """The tables of a document: name -> (columns, rows of text). A wrong number of rows or cells raises ValueError."""
    lines = [x for x in text.splitlines() if x.strip()]
    out: dict[str, tuple[list[str], list[list[str]]]] = {}
    at = 0
    while at < len(lines):
        m = _HEAD.match(lines[at])
        if not m:
            raise ValueError(f"not a table head: {lines[at]}")
        n, cols = int(m[2]), [c.strip() for c in m[3].split(",") if c.strip()]
        rows = [_cells(x.strip()) for x in lines[at + 1 : at + 1 + n]]
        if len(rows) != n or any(len(r) != len(cols) for r in rows):
            raise ValueError(f"table {m[1] or ''} hasn't {n} rows of {len(cols)} cells")
        out[m[1] or ""] = cols, rows
        at += 1 + n
    return out


def read_toon(spark: SparkSession, path: str, table: str | None = None) -> DataFrame:
    """One table of the TOON files at a path, all cells as text (the first of each file unless named).

    A file is one document and parsed whole by one task, so files, not their rows, are spread over the executors; the driver reads one
    file's head for the columns. Files without the named table have no rows; files whose table has other columns fail.
    """
    files = spark.read.text(path, wholetext=True)
    heads = files.select(F.regexp_extract_all("value", F.lit(r"(?m)^[ \t]*([\w.-]*\[\d+\]\{[^}\n]*\}:)[ \t]*$"), F.lit(1)).alias("h"))
    name = F.lit("" if table is None else table)
    wanted = F.filter("h", lambda h: F.substring_index(h, "[", 1) == name) if table is not None else F.slice("h", 1, 1)
    head = heads.select(wanted.alias("h")).where(F.size("h") > 0).select(F.col("h")[0]).first()
    if head is None:
        raise KeyError(f"no table {table or ''} in {path}")
    cols = [c.strip() for c in _HEAD.match(head[0])[3].split(",") if c.strip()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text in b.column(0).to_pylist():
                tables = parse(text)
                got, body = tables.get(table, (cols, [])) if table is not None else next(iter(tables.values()), (cols, []))
                if got != cols:
                    raise ValueError(f"a file has the columns {got}, another {cols}")
                for at in range(0, len(body), 10_000):
                    part = list(zip(*body[at : at + 10_000]))
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in part], names=cols)

    return files.mapInArrow(rows, ", ".join(f"`{c}` string" for c in cols))


def _render(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    text = str(value)
    plain = text != "" and text == text.strip() and not re.search(r'[,"\\\n\r\t:{}\[\]]', text) and text not in ("null", "true", "false")
    if plain and (not isinstance(value, str) or not re.fullmatch(r"-?\d+(\.\d+)?([eE][+-]?\d+)?", text)):
        return text
    if not isinstance(value, str):
        return text
    for raw, short in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = text.replace(raw, short)
    return f'"{text}"'


def encode_rows(name: str, columns: list[str], rows: Iterator | list) -> str:
    """A table as TOON, of rows already with the driver (results of a top-k, counts of a facet)."""
    body = ["  " + ",".join(_render(v) for v in r) for r in rows]
    return "\n".join([f"{name}[{len(body)}]{{{','.join(columns)}}}:", *body])


def to_toon(df: DataFrame, name: str, limit: int = 1000) -> str:
    """A result of at most ``limit`` rows as TOON; larger ones raise ValueError, for which write_toon() is there."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"over {limit} rows")
    return encode_rows(name, df.columns, rows)


def write_toon(df: DataFrame, name: str, path: str) -> None:
    """A table of any size as a folder of TOON lines: rows in parts, the head in a part of its own that sorts first."""
    quote = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(c.cast("string"), r'([\\"])', r"\\$1"), "\n", r"\\n"), F.lit('"'))
    cell = lambda f: F.coalesce(quote(F.col(f.name)) if f.dataType.simpleString() == "string" else F.col(f.name).cast("string"), F.lit("null"))
    lines = df.select(F.concat(F.lit("  "), F.concat_ws(",", *[cell(f) for f in df.schema.fields])).alias("value"))
    lines.write.mode("overwrite").text(f"{path}/rows")
    head = df.agg(F.count("*").alias("n")).select(F.concat(F.lit(f"{name}["), F.col("n").cast("string"), F.lit("]{" + ",".join(df.columns) + "}:")).alias("value"))
    head.coalesce(1).write.mode("overwrite").text(f"{path}/head")
