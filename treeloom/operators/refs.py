"""References: a log of puts and deletes, of which the latest row of a name counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def current(log: DataFrame, order: list[str]) -> DataFrame:
    """The references that stand: by name the last row, unless it is a delete. Grouped with partial maxima, so a busy name is no hot task."""
    rest = [c for c in log.columns if c not in ("name", *order)]
    last = log.groupBy("name").agg(F.max(F.struct(*order, *rest)).alias("_r"))
    return last.where(F.col("_r.op") == "put").select("name", *[F.col(f"_r.{c}").alias(c) for c in (*order, *rest) if c != "op"])


def list_lines(refs: DataFrame) -> DataFrame:
    """name and line: name, key, time in UTC and user if there is one; refs: name, key (hex), created (timestamp), user."""
    when = F.date_format("created", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    line = F.concat_ws(" ", "name", "key", when, F.when(F.col("user") != "", F.col("user")))
    return refs.select("name", line.alias("line")).orderBy("name")
