"""millrace: a document and relational query engine expressed on Spark DataFrames."""

from __future__ import annotations

from pathlib import Path

__version__ = "0.1.0"


def importable(spark) -> None:
    """Let Python workers of ``spark`` import this package from where the driver has it."""
    root = str(Path(__file__).resolve().parent.parent)
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if root not in paths:
        env["PYTHONPATH"] = ":".join([*paths, root])
