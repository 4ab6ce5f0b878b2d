"""The tables every operator works on, and checks of them.

A cohort of networks is two DataFrames.  Nodes: the key columns, ``node_id`` and attributes.
Edges: the key columns, ``source`` and ``target``.  The keys name a network (patient, sample);
they are part of every join and group, so one network, a batch and a cohort are one code path.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ("patient", "sample")


def truthy(column: str, kind: str) -> F.Column:
    """Whether an attribute holds: booleans as they are, numbers unless 0; null doesn't."""
    c = F.col(f"`{column}`")
    return F.coalesce(c if kind == "boolean" else c != 0, F.lit(False))


def label_sets(nodes: DataFrame, attributes: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, node_id, labels): the positions in ``attributes`` of those a node has, in order."""
    kinds = dict(nodes.dtypes)
    own = [F.when(truthy(a, kinds[a]), F.lit(i)) if a in kinds else F.lit(None).cast("int") for i, a in enumerate(attributes)]
    return nodes.select(*keys, "node_id", F.array_compact(F.array(*own)).alias("labels"))


def class_sets(nodes: DataFrame, column: str, attributes: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """The same from one categorical column; other values give no label."""
    place = F.array_position(F.array(*map(F.lit, attributes)), F.col(column)).cast("int") - 1
    return nodes.select(*keys, "node_id", F.when(place >= 0, F.array(place)).otherwise(F.array().cast("array<int>")).alias("labels"))


def orphans(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, node_id): endpoints of edges that no node has."""
    ends = edges.select(*keys, F.explode(F.array("source", "target")).alias("node_id")).distinct()
    return ends.join(nodes.select(*keys, "node_id"), [*keys, "node_id"], "left_anti")


def checked(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The edges, after a check that both ends of each exist."""
    if row := orphans(nodes, edges, keys).first():
        raise ValueError(f"an edge ends at a node that isn't there: {row.asDict()}")
    return edges
