"""Sinks: partitioned upserts, delimited and Markdown reports."""

from __future__ import annotations

import html
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame

from ..operators.alignment import keep_last, upsert


def upsert_partitions(new: DataFrame, path: str, keys: Sequence[str], partition: str) -> None:
    """Merges ``new`` into a partitioned Parquet folder, the new row winning; only touched partitions are rewritten.

    The touched partition values (one for each partition, not row) are collected to prune the read.
    """
    spark = new.sparkSession
    touched = [r[0] for r in new.select(partition).distinct().collect()]
    try:
        old = spark.read.parquet(path)
        merged = upsert(old.where(old[partition].isin(touched)).select(*new.columns), new, keys)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        merged = keep_last(new, keys, [new[k] for k in keys])
    staged = f"{path.rstrip('/')}_staged"
    merged.write.mode("overwrite").partitionBy(partition).option("compression", "snappy").parquet(staged)
    spark.read.parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def refresh(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """One file of a small result."""
    df.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def markdown(rows: Sequence[dict]) -> str:
    """A table of small result rows; missing values are empty, pipes are escaped."""
    if not rows:
        return "(empty)\n"
    names = list(rows[0])
    show = lambda v: "" if v is None else (f"{v:.4f}" if isinstance(v, float) else str(v)).replace("|", "\\|")
    lines = [f"| {' | '.join(names)} |", f"|{'---|' * len(names)}", *(f"| {' | '.join(show(r.get(n)) for n in names)} |" for r in rows)]
    return "\n".join(lines) + "\n"


def html_report(title: str, tables: dict[str, Sequence[dict]], path: str) -> None:
    """A page of small tables; other pages in the folder go."""
    folder = Path(path).parent
    folder.mkdir(parents=True, exist_ok=True)
    for old in folder.glob("*.html"):
        old.unlink()
    parts = [f"<h1>{html.escape(title)}</h1>"]
    for name, rows in tables.items():
        names = list(rows[0]) if rows else []
        cells = "".join("<tr>" + "".join(f"<td>{html.escape(str(r[n]))}</td>" for n in names) + "</tr>" for r in rows)
        parts.append(f"<h2>{html.escape(name)}</h2><table><tr>{''.join(f'<th>{html.escape(n)}</th>' for n in names)}</tr>{cells}</table>")
    Path(path).write_text(f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title>{''.join(parts)}")
