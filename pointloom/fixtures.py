"""Localizations, truth and chain samples as views over the test tables' events, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_X = "((user_id {div} 2)%20)*0.3e0 + (user_id%2)*0.02e0"
_Y = "((user_id {div} 2) {div} 20)*0.3e0"
_LOCS = (
    "event_id as loc_id, user_id as track_id, "
    f"{_X} + (((event_id*7919)%1009)/1009e0 + ((event_id*104729)%997)/997e0 - 1e0)*0.012e0 as x, "
    f"{_Y} + (((event_id*1299709)%1013)/1013e0 + ((event_id*15485863)%991)/991e0 - 1e0)*0.012e0 as y, "
    "0.004e0 + 0.0002e0*(event_id%11) as sigma_x, 0.004e0 + 0.0002e0*(event_id%7) as sigma_y, "
    "0e0 as sigma_xy, cast(event_id as int) as frame, cast(100 + event_id%50 as double) as photons, user_id {div} 2 as pair"
)
_TRUTH = f"user_id as true_id, {_X} as x, {_Y} as y"

LOCS_SQL = f"locs as (select {_LOCS.format(div='//')} from events)"
TRUTH_SQL = f"truth as (select distinct {_TRUTH.format(div='//')} from events)"
SAMPLES_SQL = """samples as (select pair as partition_id, 0 as chain_id, iter, loc_id,
 case when (loc_id*31+iter*17)%19 = 0 then track_id + 1 - 2*(track_id%2) else track_id end as cluster
 from locs, (select unnest(range(1,13)) as iter))"""
TRACE_SQL = """trace as (select partition_id, chain_id, iter, 2 + (iter*7 + partition_id*3 + chain_id*5 + (iter*iter)%11) % 3 as k
 from (select distinct pair as partition_id from locs), (select unnest(range(0,2)) as chain_id), (select unnest(range(1,41)) as iter))"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def locs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).selectExpr(*_split(_LOCS.format(div="div")))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", "user_id").selectExpr(*_split(_TRUTH.format(div="div"))).distinct()


def _split(text: str) -> list[str]:
    return text.split(", ")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """iter 1 to 12 of one chain: each row in its source's cluster but for about one in nineteen, in its partner's."""
    return locs(spark, sf_dir).selectExpr("pair as partition_id", "0 as chain_id", "explode(sequence(1, 12)) as iter", "loc_id", "track_id").selectExpr(
        "partition_id", "chain_id", "iter", "loc_id", "case when (loc_id*31+iter*17)%19 = 0 then track_id + 1 - 2*(track_id%2) else track_id end as cluster"
    )


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number of clusters that moves, for two chains of forty iterations a partition."""
    parts = locs(spark, sf_dir).selectExpr("pair as partition_id").distinct()
    return parts.selectExpr("partition_id", "explode(sequence(0, 1)) as chain_id").selectExpr("*", "explode(sequence(1, 40)) as iter").selectExpr(
        "partition_id", "chain_id", "iter", "2 + (iter*7 + partition_id*3 + chain_id*5 + (iter*iter)%11) % 3 as k"
    )
