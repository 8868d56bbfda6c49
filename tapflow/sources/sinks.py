"""Sinks (S7-S10): partitioned Parquet/CSV outputs and the per-cluster
output tree. Outputs are written by the executors in parallel; a single file
is produced only on request."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None,
                single_file: bool = False) -> None:
    """Overwrite ``path`` with ``df`` (Parquet by default, CSV with a
    header otherwise), optionally partitioned by columns. ``single_file``
    sends all rows through one task, whatever their number: meant for results
    a person opens."""
    if single_file:
        df = df.coalesce(1)
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def write_cluster_tree(labels: DataFrame, path: str, *tables: tuple[str, DataFrame],
                       key: str = "item", fmt: str = "parquet") -> None:
    """One folder per k and cluster (``k=<k>/cluster=<c>``) holding each
    member table (features, nodes, edges, ...) joined to the labels.
    ``labels`` has (k, cluster, key)."""
    for name, table in tables:
        write_table(table.join(labels, key), f"{path.rstrip('/')}/{name}", fmt, ["k", "cluster"])


def persisted(df: DataFrame) -> DataFrame:
    """Keep ``df`` for reuse across several actions (release with
    ``unpersist`` after the last one)."""
    return df.persist()
