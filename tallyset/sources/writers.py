"""Writers: JSON lines, relevance and run files, passages and index tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def jsonl(rows: DataFrame, path: str, mode: str = "error") -> None:
    rows.write.mode(mode).json(path)


def append(rows: DataFrame, path: str, by: str | None = None) -> None:
    """Adds rows to a table, in folders by key where one is named: what a resumed job reads back."""
    w = rows.write.mode("append")
    (w.partitionBy(by) if by else w).parquet(path)


def qrel_lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.concat_ws(" ", "query_id", F.lit("0"), "doc_id", F.col("relevance").cast("string")).alias("value"))


def run_lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.format_string("%s Q0 %s %d %.4f %s", "qid", "pid", "rank", "score", "run_id").alias("value"))


def qrels(rows: DataFrame, path: str) -> None:
    qrel_lines(rows.orderBy("query_id", "doc_id")).write.text(path)


def run(rows: DataFrame, path: str) -> None:
    run_lines(rows.orderBy("qid", "rank")).write.text(path)


def merged_runs(runs: list[DataFrame]) -> DataFrame:
    """Run rows (qid, pid, rank, score, run_id) of several runs as one, by query and rank; a query that several runs have is the
    last one's, as a resumed run writes it again."""
    out = runs[0]
    for later in runs[1:]:
        out = out.join(later.select("qid").distinct(), "qid", "left_anti").unionByName(later)
    return out.orderBy("qid", "rank")


def metrics(row: DataFrame, path: str) -> None:
    """A row of metrics as one JSON object."""
    row.coalesce(1).write.json(path)


def passages(rows: DataFrame, path: str, per_file: int = 1_000_000, file_bytes: int | None = None) -> None:
    """JSON lines in files of per_file rows at most; with file_bytes, of about so many bytes, by the length of the rows."""
    if file_bytes:
        size = rows.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*rows.columns))) + 1), F.lit(0)).alias("b")).first().b
        rows = rows.repartition(max(1, -(-size // file_bytes)))
    rows.write.option("maxRecordsPerFile", per_file).json(path)


def index_tables(tables: dict[str, DataFrame], path: str) -> None:
    """An index as Parquet tables by name."""
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}")


def pretty(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows as indented JSON texts."""
    return rows.select(F.to_json(F.struct(*columns), {"pretty": "true"}).alias("value"))
