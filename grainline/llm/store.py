"""Tables in the folder that driver and executors share, and names that no user column has."""

from __future__ import annotations

from pyspark.sql import DataFrame

from grainline.sources.shared import cut, new_dir, shared_dir

__all__ = ["cut", "free", "new_dir", "shared_dir"]


def free(df: DataFrame, name: str) -> str:
    """The name with as many underscores before it as no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
