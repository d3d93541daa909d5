"""Global order and sweeps over trees of bounded fan-out, for groups of any size.

Rows of a group are numbered by one range partitioning and prefix sums of what each partition holds.
A tree over the numbered rows of a group is swept upwards and back in rounds. Each round deals the
nodes, which meanwhile wait in a table as messages to the next label, to blocks of ``2**height``
neighbours, sorted by label: the sort and the staged tables are the external queue between rounds, and a
task holds one block at a time. A group holding a third of all rows is many blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, StructField, StructType

from seriesloom.sources.panels import stage

# Rows of one partition have consecutive ids; the partition is in the bits from here on.
PART = 33


def in_order(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Staged rows with ``row_id``, which ascends in the global order and has no hole within a partition."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return stage(placed.withColumn("row_id", F.monotonically_increasing_id()), name)


def numbered(rows: DataFrame, group: str) -> DataFrame:
    """Ordered rows with their ``index`` in their group, from 0, and the group's ``size``.

    Rows of a group must be neighbours in the order. Only partitions per group are summed, at most as
    many as groups and partitions together.
    """
    part = F.shiftright("row_id", PART)
    held = rows.groupBy(F.col(group).alias("_group"), part.alias("_part")).agg(F.min("row_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    own = Window.partitionBy("_group")
    before = F.coalesce(F.sum("_n").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = held.withColumns({"_before": before, "size": F.sum("_n").over(own)})
    joined = rows.join(held, F.col(group).eqNullSafe(F.col("_group")) & (part == F.col("_part")))
    index = F.col("row_id") - F.col("_first") + F.col("_before")
    return joined.select(*rows.columns, index.alias("index"), "size")


Combine = Callable[[list[bytes], int, int], bytes]
Split = Callable[[list[bytes], int, int, bytes], list[bytes]]


def _blocks(batches: Iterator[pa.RecordBatch], slice_rows: int = 4096) -> Iterator[list[dict]]:
    """Rows of one block after the other; rows come sorted by group and block."""
    held: list[dict] = []
    for whole in batches:
        for lo in range(0, whole.num_rows, slice_rows):
            for row in whole.slice(lo, slice_rows).to_pylist():
                if held and (row["_block"], row["_key"]) != (held[0]["_block"], held[0]["_key"]):
                    yield held
                    held = []
                held.append(row)
    if held:
        yield held


def _record(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in schema], schema=schema)


def _dealt(nodes: DataFrame, group: str, height: int) -> DataFrame:
    return nodes.withColumns({"_key": F.col(group), "_block": F.shiftright("index", height)})


def _by_block(df: DataFrame) -> DataFrame:
    return df.repartition("_key", "_block").sortWithinPartitions("_key", "_block", "index")


def _upward(nodes: DataFrame, group: str, height: int, combine: Combine) -> DataFrame:
    """One node per block: ``group, index, size, value``."""
    schema = StructType([nodes.schema[c] for c in (group, "index", "size", "value")])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for rows in _blocks(batches):
            first, size = rows[0]["index"], rows[0]["size"]
            value = combine([r["value"] for r in rows], first, size)
            out.append({group: rows[0][group], "index": first >> height, "size": -(-size >> height), "value": value})
            if len(out) >= 1024:
                yield _record(out, arrow)
                out = []
        if out:
            yield _record(out, arrow)

    plain = _dealt(nodes.select(group, "index", "size", "value"), group, height)
    return _by_block(plain).mapInArrow(run, schema)


def _downward(nodes: DataFrame, states: DataFrame, group: str, height: int, split: Split) -> DataFrame:
    """Nodes with the ``state`` each gets from its block's."""
    schema = StructType([*nodes.schema.fields, StructField("state", BinaryType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches):
            above, rows = rows[0]["state"], rows[1:]
            given = split([r["value"] for r in rows], rows[0]["index"], rows[0]["size"], above)
            for row, state in zip(rows, given):
                row["state"] = state
            yield _record(rows, arrow)

    # the block's own message comes before its nodes
    told = states.select(F.col(group), F.lit(-1).cast("long").alias("index"), "state", F.col(group).alias("_key"), F.col("index").alias("_block"))
    both = _dealt(nodes, group, height).unionByName(told, allowMissingColumns=True)
    return _by_block(both).mapInArrow(run, schema)


def sweep(nodes: DataFrame, group: str, height: int, combine: Combine, finish: Callable[[DataFrame], DataFrame], split: Split, name: str) -> DataFrame:
    """Values upwards to one root a group, states from there back to every node.

    ``nodes`` have ``group``, ``index`` (from 0, no hole), ``size`` of the group, ``value`` and whatever else.
    ``combine(values, first index, size)`` gives the value of a block, ``finish`` adds ``state`` to the
    roots, ``split(values, first index, size, state)`` the state of every node of a block.
    """
    levels = [stage(nodes, f"{name}-0")]
    most = nodes_size(levels[0])
    while most > 1:
        levels.append(stage(_upward(levels[-1], group, height, combine), f"{name}-{len(levels)}"))
        most = -(-most >> height)
    states = finish(levels.pop())
    for level in reversed(levels):
        states = _downward(level, states, group, height, split)
    return states


def nodes_size(nodes: DataFrame) -> int:
    """Nodes of the largest group: one number."""
    return nodes.agg(F.max("size")).first()[0] or 0
