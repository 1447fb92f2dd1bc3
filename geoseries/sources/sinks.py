"""Sinks: overwrite, append per entity, JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, fmt: str = "parquet", sort_by: tuple[str, str] | None = None,
                partition_by: list[str] | None = None) -> None:
    """Overwrite sink (S9); optional ascending time sort with NULLs last and an
    id tie-break (O1) - a range-partitioned sort, only at the sink."""
    if sort_by:
        ts, tie = sort_by
        df = df.orderBy(F.col(ts).asc_nulls_last(), F.col(tie))
    w = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def append_entities(frames: dict[str, DataFrame], base: str, batch_id: int | None = None,
                    fmt: str = "parquet", skip_empty: bool = True) -> None:
    """One table per entity (tweet, user, place), appended (S10); empty frames
    are skipped.  With a batch id each micro-batch lands in its own
    ``batch_id=`` folder, overwritten on replay, so a retried batch never
    duplicates rows."""
    for name, df in frames.items():
        if skip_empty and df.isEmpty():
            continue
        path = f"{base.rstrip('/')}/{name}"
        if batch_id is None:
            df.write.mode("append").format(fmt).save(path)
        else:
            df.write.mode("overwrite").format(fmt).save(f"{path}/batch_id={batch_id}")


def write_json_docs(df: DataFrame, path: str, doc_col: str | None = None) -> None:
    """JSON document sink (S11): one JSON text per row."""
    col = F.col(doc_col) if doc_col else F.to_json(F.struct(*df.columns))
    df.select(col.alias("value")).write.mode("overwrite").text(path)
