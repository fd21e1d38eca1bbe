"""Long and wide forms, node features and numbering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rainweave.operators.partitioned import row_position


def to_wide(df: DataFrame, index: Sequence[str], columns: str, value: str, names: Sequence, unique: bool = True) -> DataFrame:
    """One column per name in ``names``; a second row for one cell raises when ``unique``, any other name always.

    The names are given, so no pass over the data is needed to find them. Keep data long
    inside a plan: the wide form is for hand-over to wide consumers.
    """
    unlisted = F.raise_error(F.concat(F.lit(f"a name in {columns} is not listed: "), F.coalesce(F.col(columns).cast("string"), F.lit("NULL"))))
    source = df.withColumn("_name", F.when(F.col(columns).isin(list(names)), F.col(columns)).otherwise(unlisted))
    repeated = F.raise_error(F.concat(F.lit("duplicate entries for "), F.lit(", ".join([*index, columns]))))

    def cell(name):
        found = F.col("_name") == F.lit(name)
        largest = F.max(F.when(found, F.col(value)))
        return F.when(F.count_if(found) > 1, repeated).otherwise(largest) if unique else largest

    # one aggregation for the check and all columns, so a task holds one hash table and rows are shuffled once
    return source.groupBy(*index).agg(*[cell(name).alias(str(name)) for name in names])


def to_long(df: DataFrame, index: Sequence[str], names: Sequence[str], variable: str, value: str) -> DataFrame:
    return df.unpivot(list(index), list(names), variable, value)


def station_variable_counts(df: DataFrame, station: str, variable: str, value: str, names: Sequence[str]) -> DataFrame:
    """Non-NULL counts as a station x variable table."""
    return df.groupBy(station).agg(
        *[F.count(F.when(F.col(variable) == name, F.col(value))).alias(name) for name in names]
    )


def classify_stations(counts: DataFrame, names: Sequence[str], out: str = "station_type") -> DataFrame:
    """``rainfall`` when some variable was never observed, else ``general``."""
    return counts.withColumn(
        out, F.when(F.least(*[F.col(n) for n in names]) == 0, "rainfall").otherwise("general")
    )


def assemble_features(
    df: DataFrame, index: Sequence[str], variable: str, value: str, names: Sequence[str], target: str
) -> DataFrame:
    """Feature array per (station, time) in the order of ``names``, and the target value."""
    cells = df.groupBy(*index).agg(
        *[F.max(F.when(F.col(variable) == n, F.col(value))).alias(n) for n in names]
    )
    return cells.select(*index, F.array(*[F.col(n) for n in names]).alias("x"), F.col(target).alias("y"))


def number_nodes(stations: DataFrame, gid: str, node_type: str, coarse: Column) -> DataFrame:
    """Node ids: general stations from 0, rainfall stations offset by their count; ``local`` per type.

    ``coarse`` must be non-decreasing in the station id.
    """
    per_type = row_position(stations, [node_type], coarse, [gid], "local")
    general = stations.agg(F.count_if(F.col(node_type) == "general").alias("n")).scalar()
    offset = F.when(F.col(node_type) == "general", F.lit(0)).otherwise(general)
    return per_type.withColumn("node", (F.col("local") + offset).cast("long"))
