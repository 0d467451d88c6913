"""The tables that several queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleetspark.operators import grid, matching, states
from fleetspark.sources import fixtures

#: The derived pings are few and long apart: a cell counts with one trip, a trip with a third of its route.
SPARSE = grid.GridSettings(least_trips=1, full_cover=0.3)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return fixtures.view(spark, sf_dir, name)


def lead_pings(spark, sf_dir) -> DataFrame:
    return states.global_trips([matching.lead_vehicle(view(spark, sf_dir, "ping"))])


def moving_pings(spark, sf_dir) -> DataFrame:
    return states.drop_layovers(lead_pings(spark, sf_dir))


def state_pings(spark, sf_dir) -> DataFrame:
    return states.ping_states(moving_pings(spark, sf_dir), view(spark, sf_dir, "stop"))


def extents(spark, sf_dir) -> DataFrame:
    return states.trip_extents(moving_pings(spark, sf_dir), view(spark, sf_dir, "route_dir"))


def speed_grid(spark, sf_dir) -> DataFrame:
    return grid.speed_grid(states.interval_bins(moving_pings(spark, sf_dir)))


def delays(spark, sf_dir) -> DataFrame:
    cells = speed_grid(spark, sf_dir)
    return grid.delay_grid(cells, grid.reference_speed(cells, SPARSE))


def heat(spark, sf_dir) -> DataFrame:
    return grid.heat_cells(delays(spark, sf_dir), view(spark, sf_dir, "route_dir"), SPARSE)


def traversals(spark, sf_dir) -> DataFrame:
    return grid.bin_traversals(extents(spark, sf_dir))
