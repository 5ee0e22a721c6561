"""Sinks: delimited text with spreadsheet guards, project archives, configurations and reports as JSON."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterable
from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmask.functions.text import excel_safe, text
from quillmask.operators.actions import Policy

SCHEMA_VERSION, MOST_COLUMNS, MOST_TABLES = 3, 200, 50


def quoted(cell: str, delimiter: str) -> str:
    return f'"{cell.replace(chr(34), chr(34) * 2)}"' if any(c in cell for c in ('"', "\r", "\n", delimiter)) else cell


def serialised(headers: list[str], rows: Iterable, delimiter: str = ",", line_end: str = "\r\n", bom: bool = False) -> str:
    lines = (delimiter.join(quoted("" if c is None else str(c), delimiter) for c in row) for row in (headers, *rows))
    return ("﻿" if bom else "") + line_end.join(lines) + line_end


def guarded(df: DataFrame) -> DataFrame:
    """Every column as text that no spreadsheet runs."""
    return df.select(*[excel_safe(df[c]).alias(c) for c in df.columns])


def write_delimited(df: DataFrame, path: str, delimiter: str = ",", safe: bool = True, line_end: str = "\n") -> None:
    """Part files, written in parallel."""
    out = guarded(df) if safe else df.select(*[text(df[c]).alias(c) for c in df.columns])
    out.write.mode("overwrite").csv(path, header=True, sep=delimiter, quote='"', escape='"', lineSep=line_end, emptyValue="")


def csv_text(df: DataFrame, most: int = 100_000, safe: bool = True) -> str:
    """A small table as one CSV text with a byte order mark."""
    return _small(df, ",", True, most, safe)


def tsv_text(df: DataFrame, most: int = 100_000, safe: bool = True) -> str:
    return _small(df, "\t", False, most, safe)


def _small(df: DataFrame, delimiter: str, bom: bool, most: int, safe: bool) -> str:
    out = guarded(df) if safe else df
    rows = out.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: use write_delimited")
    return serialised(df.columns, rows, delimiter, bom=bom)


def archive(tables: dict[str, DataFrame], config: dict | None = None, readme: str = "Synthetic data.\n") -> bytes:
    """A store-only ZIP of small tables, a manifest, the configuration and a read-me."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        sizes = {}
        for name, df in tables.items():
            body = csv_text(df)
            sizes[name] = body.count("\r\n") - 1
            z.writestr(f"{name}.csv", body)
        z.writestr("manifest.json", json.dumps({"tables": sizes}, indent=2))
        z.writestr("config.json", json.dumps(config or {}, indent=2))
        z.writestr("README.txt", readme)
    return out.getvalue()


def config_text(policies: list[Policy], **more) -> str:
    return json.dumps({"schemaVersion": SCHEMA_VERSION, "policies": [asdict(p) for p in policies], **more}, indent=2)


def config_from(source: str) -> tuple[list[Policy], dict]:
    """Policies and other settings; versions 1 to 3."""
    said = json.loads(source)
    if said.get("schemaVersion") not in (1, 2, 3):
        raise ValueError("unknown schemaVersion")
    if len(said.get("policies", [])) > MOST_COLUMNS or len(said.get("tables", [])) > MOST_TABLES:
        raise ValueError("too many columns or tables")
    return [Policy(**p) for p in said.get("policies", [])], {k: v for k, v in said.items() if k not in ("schemaVersion", "policies")}


def preview(df: DataFrame, n: int = 100) -> DataFrame:
    return df.limit(n)


def difference(source: DataFrame, output: DataFrame, row_id: str, columns: list[str]) -> DataFrame:
    """row_id, column_name, before, after of changed cells."""
    o = output.select(F.col(row_id), *[text(output[c]).alias(f"o_{c}") for c in columns])
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), text(F.col(c)).alias("before"), F.col(f"o_{c}").alias("after")) for c in columns])
    return source.join(o, row_id).select(row_id, F.explode(cells).alias("c")).select(row_id, "c.*").where("before <> after")
