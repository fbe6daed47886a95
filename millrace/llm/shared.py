"""Words, and tables written to the folder that driver and executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources.folders import discard, new_path

#: Words are the maximal runs without a space, tab, LF, VT, FF or CR.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"

#: Plan nodes whose partitions hold the same rows in the same order whenever they are computed.
_IN_ORDER = {"Project", "Filter", "LocalRelation", "LogicalRelation", "DataSourceV2ScanRelation", "LogicalRDD", "Range"}


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discarded(df: DataFrame) -> None:
    """Delete a table made by ``written`` that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        discard(df.sparkSession, path)


def repeatable(df: DataFrame) -> DataFrame:
    """``df`` with partitions that come out the same when a lost task runs again: as it is if it only reads files, else written."""
    plan = df._jdf.queryExecution().optimizedPlan()
    nodes = [plan]
    for node in nodes:
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
    if plan.deterministic() and all(n.nodeName().split(" ")[0] in _IN_ORDER for n in nodes):
        return df
    return written(df, "rows")
