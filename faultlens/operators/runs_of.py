"""Named collections of runs: per-node rows picked by fault, application and node
(X5), with the statistics that are read off them."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.operators import profile

NAME = "collection"


@dataclass(frozen=True)
class Runs:
    """Rows of several collections in one table: ``collection`` names theirs. A row
    may be in many; collections without rows have none in the results."""

    rows: DataFrame
    node: str = "node"

    def nodes(self) -> DataFrame:
        """The nodes of each collection and how many rows they have there."""
        return self.rows.groupBy(NAME, self.node).agg(F.count(F.lit(1)).alias("n"))

    def mean_std(self, column: str) -> DataFrame:
        """A7 per collection and node."""
        return profile.mean_std(self.rows, [NAME, self.node], column)

    def box(self, column: str) -> DataFrame:
        """A8 per collection and node."""
        return profile.box_stats(self.rows, [NAME, self.node], column)


def gather(table: DataFrame, collections: Mapping[str, Mapping], *, node: str = "node", fault: str = "fault", app: str = "app",
           extend: Callable[[DataFrame], DataFrame] | None = None) -> Runs:
    """Collections by name, each a mapping of optional ``faults``, ``apps`` and
    ``nodes`` (values that a row must have one of); what isn't given admits all rows,
    NULLs included. ``extend`` adds columns first (horizontal statistics, say). One
    scan serves all collections; a column already called ``collection`` is replaced."""

    def admits(rule: Mapping) -> Column:
        unknown = set(rule) - {"faults", "apps", "nodes"}
        if unknown:
            raise ValueError(f"unknown conditions {sorted(unknown)}")
        ok = F.lit(True)
        for column, values in ((fault, rule.get("faults")), (app, rule.get("apps")), (node, rule.get("nodes"))):
            if values is not None:
                ok = ok & F.coalesce(F.col(column).isin(list(values)), F.lit(False))
        return ok

    rows = extend(table) if extend else table
    names = F.array_compact(F.array(*(F.when(admits(rule), F.lit(name)) for name, rule in collections.items())))
    kept = rows.drop(NAME)
    return Runs(rows.withColumn("_in", names).select(*kept.columns, F.explode("_in").alias(NAME)), node)
