"""Where results go: split files, outboxes, reports, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.corpus import manifest


def write_splits(df: DataFrame, path: str, split: str = "split", mode: str = "errorifexists") -> None:
    """JSON lines, one folder a split."""
    df.write.mode(mode).partitionBy(split).json(path)


def append_outbox(df: DataFrame, path: str, channel: str, message: str) -> None:
    """Messages as rows with a stable id, so that a repeated task or run adds no second message to those
    who read distinct ids. Sending itself is left to whoever drains the table."""
    body = F.col(message).cast("string")
    rows = df.select(F.sha2(F.concat_ws("|", F.lit(channel), body), 256).alias("id"), F.lit(channel).alias("channel"), body.alias("message"))
    rows.dropDuplicates(["id"]).write.mode("append").parquet(path)


def write_manifest(df: DataFrame, path: str, by: list[str], mode: str = "errorifexists") -> None:
    manifest(df, by).coalesce(1).write.mode(mode).json(path)


def check_manifest(df: DataFrame, frozen: DataFrame, by: list[str]) -> DataFrame:
    """Groups whose count or fingerprint is not as frozen."""
    now = manifest(df, by)
    old = frozen.select(*by, F.col("n").alias("old_n"), F.col("sha256").alias("old_sha256"))
    both = now.join(old, by, "full_outer")
    return both.where("NOT (n <=> old_n AND sha256 <=> old_sha256)")


def markdown(df: DataFrame, limit: int = 100) -> str:
    """A small report as a Markdown table; more rows than the limit are refused, not cut."""
    rows = df.take(limit + 1)
    if len(rows) > limit:
        raise ValueError(f"a report has at most {limit} rows")
    line = lambda cells: "| " + " | ".join("" if c is None else str(c) for c in cells) + " |"
    return "\n".join([line(df.columns), line("-" for _ in df.columns), *map(line, rows)])
