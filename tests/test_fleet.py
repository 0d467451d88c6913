import math
import os
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from fleetspark.jobs import corridor_queries, registry, tables
from fleetspark.functions import quantiles, search
from fleetspark.operators import corridors, grid, matching, network, scenarios, segmentation, signals, states, timelines
from fleetspark.sources import files
from fleetspark.streaming import follow, live

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_is_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    mine = registry.queries()[name](spark, sf_dir)
    columns = sorted(mine.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    text = lambda rows: sorted(re.sub(r"(?<=\d)\.0\b", "", str(tuple(r))) for r in rows)
    assert text(mine.select(columns).collect()) == text(want)


def trip(spark, rows):
    return spark.createDataFrame([(1, 1, *r) for r in rows], "day int, trip long, t int, along double, average_speed int").withColumns({"route_id": F.lit("R"), "direction_id": F.lit(0), "mode": F.lit("bus"), "vehicle_id": F.lit(1), "event_id": F.col("t")})


def test_interval_splits(spark):
    rows = [(0, 0.0, 5), (10, 0.2, 5), (20, 250.2, 5), (30, 300.0, 5), (250, 400.0, 5)]
    out = [tuple(r) for r in states.interval_bins(trip(spark, rows)).select("bin", "time", "dist").orderBy("bin", "time").collect()]
    # Hardly a move, then three bins by distance, then up to an edge; the last interval is too long.
    assert [(b, round(x, 6), round(y, 6)) for b, x, y in out] == [(0, 3.992, 99.8), (0, 10.0, 0.0), (1, 4.0, 100.0), (2, 2.008, 50.2), (2, 10.0, 49.8)]


def test_layover_loses_its_middle(spark):
    rows = [(0, 0.0, 0), (100, 10.0, 0), (200, 15.0, 0), (301, 20.0, 0), (320, 100.0, 0), (400, 101.0, 0)]
    assert [r.t for r in states.drop_layovers(trip(spark, rows)).orderBy("t").collect()] == [0, 301, 320, 400]


def test_trim_and_accept(spark):
    rows = [(0, 0.0, 0), (10, 20.0, 0), (20, 700.0, 0), (30, 690.0, 0), (40, 1600.0, 0), (50, 1610.0, 0), (60, 1620.0, 0)]
    kept = matching.trim_layover(trip(spark, rows))
    assert [(r.t, r.along) for r in kept.orderBy("t").collect()] == [(10, 20.0), (20, 700.0), (30, 700.0), (40, 1600.0)]
    routes = spark.createDataFrame([("R", 0, 3000.0)], "route_id string, direction_id int, length double")
    assert matching.accept_trips(kept, routes).count() == 0
    assert matching.accept_trips(kept, routes, matching.MatchSettings(least_pings=4)).count() == 4


def test_timeline_gap(spark):
    rows = [(1, 1, 0, 0, "a"), (1, 1, 20, 0, "a"), (1, 1, 40, 0, "a"), (1, 1, 700, 0, "a"), (1, 1, 710, 6, "")]
    coded = spark.createDataFrame(rows, "day int, vehicle_id long, t int, code int, label string")
    out = sorted((r.t0, r.t1, r.code) for r in timelines.timeline_segments(coded).collect())
    assert out == [(0, 40, 0), (40, 70, 0), (70, 700, 7), (700, 710, 0), (710, 740, 6)]


def test_thinning_depends_on_what_is_kept(spark):
    rows = [(1, 1, t, 0, float(t), 5) for t in (0, 10, 19, 20, 35, 41)] + [(1, 1, 100, 6, 0.0, 0), (1, 1, 70, 0, 41.0, 9), (1, 1, 75, 0, 42.0, 9)]
    coded = spark.createDataFrame(rows, "day int, vehicle_id long, t int, code int, x double, average_speed int").withColumn("y", F.lit(0.0))
    assert sorted(r.t for r in timelines.thin_positions(coded).collect()) == [0, 20, 41, 75]  # 70 repeats the place of 41


def test_thinning_is_the_plain_loop_over_chunks(spark):
    rng, rows, want = random.Random(6), [], []
    for vehicle in range(4):
        t, last = 0, None
        for k in range(400):
            t += rng.choice([1, 5, 15, 19, 20, 21, 300, 4000])
            rows.append((1, vehicle, t, 0, float(k), 5))
            if last is None or t - last >= 20:
                want.append((vehicle, t))
                last = t
    coded = spark.createDataFrame(rows, "day int, vehicle_id long, t int, code int, x double, average_speed int").withColumn("y", F.lit(0.0))
    for chunk in (60, 1800, 10**6):
        assert sorted((r.vehicle_id, r.t) for r in timelines.thin_positions(coded, chunk=chunk).collect()) == want


def test_playback_follows_the_reported_route_outside_trips(spark):
    rows = [
        (1, 1, 0, 1, 0, 7, "A_0", 12.4, "A_0", 12.0, "bus"), (1, 1, 30, 0, 5, 9, None, None, "B_1", 40.6, "bus"), (1, 1, 60, 0, 5, 9, None, None, "B_1", None, "bus"),
        (1, 2, 0, 0, 5, 9, None, None, "B_1", 1.0, "bus"), (1, 3, 0, 3, 0, 9, "A_0", 1.0, "A_0", 1.0, "other"),
    ]
    table = spark.createDataFrame(rows, "day int, vehicle_id long, t int, trip long, code int, average_speed int, label string, along double, route_key string, route_along double, vclass string").withColumns({"x": F.col("t") * 1.0, "y": F.lit(0.0)})
    shown = timelines.playback_positions(table)
    assert sorted((r.vehicle_id, r.t, r.label, r.along, r.mph, r.mode) for r in shown.collect()) == [(1, 0, "A_0", 12, 7, "bus"), (1, 30, "B_1", 41, 9, "bus"), (1, 60, "", -1, 9, "bus")]
    documents = timelines.tile_documents(timelines.hourly_tiles(shown)).collect()
    assert [(d.hour, d.mode, [(r.t, r.label_no, r.along, r.mph) for r in d.rows]) for d in documents] == [(0, "bus", [(0, 1, 12, 7), (30, 2, 41, 9), (60, 0, -1, 9)])]


def test_a_dump_with_broken_lines_goes_to_quarantine(spark, tmp_path):
    import gzip

    good = '{"gtfs_dataset_name": "a", "vehicle_id": "%s", "position_speed": 2.5}\n'
    for k, lines in enumerate(([good % 1, '{"gtfs_dataset_name": "a", "vehi\n', "\n"], [good % 2, good.replace('"a"', '"b"') % 3, '{"gtfs_dataset_name": "a", "position_speed": "x"}\n'])):
        with gzip.open(tmp_path / f"{k}.jsonl.gz", "wt") as f:
            f.writelines(lines)
    for _ in range(2):  # a second run replaces the first
        files.land_feed(spark, str(tmp_path / "*.gz"), "a", str(tmp_path / "rows"), str(tmp_path / "broken"))
    assert sorted((r.vehicle_id, r.position_speed) for r in spark.read.parquet(str(tmp_path / "rows")).collect()) == [("1", 2.5), ("2", 2.5)]
    lost = sorted((r.file[-10:], r.line) for r in spark.read.parquet(str(tmp_path / "broken")).collect())
    assert lost == [("0.jsonl.gz", '{"gtfs_dataset_name": "a", "vehi'), ("1.jsonl.gz", '{"gtfs_dataset_name": "a", "position_speed": "x"}')]


def test_a_crowded_cell_is_split_and_the_join_stays_the_same(spark):
    rng = random.Random(8)
    pings = [(k, *((100.0, 100.0) if k % 2 else (rng.uniform(0, 600), rng.uniform(0, 600)))) for k in range(2000)]
    points = [(k, rng.uniform(0, 600), rng.uniform(0, 600)) for k in range(300)] + [(300, 110.0, 95.0), (301, 80.0, 80.0)]
    left, right = spark.createDataFrame(pings, "k int, x double, y double"), spark.createDataFrame(points, "p int, px double, py double")
    one = lambda crowded: sorted((r.k, r.p) for r in matching.near_points(left, right, 30.0, crowded=crowded).collect())
    want = sorted((k, p) for k, x, y in pings for p, px, py in points if math.hypot(x - px, y - py) < 30)
    assert one(0) == one(50) == want
    keyed = left.withColumns({"cx": F.floor(F.col("x") / 30), "cy": F.floor(F.col("y") / 30)})
    dealt, _ = matching.split_crowded(keyed, keyed.select("cx", "cy").distinct(), ["cx", "cy"], 50)
    sizes = sorted(r["count"] for r in dealt.groupBy("cx", "cy", "_part").count().collect())
    assert sizes[-1] <= 75 and dealt.count() == 2000  # 1,000 pings in the cell, dealt to 20 parts by hash


def test_nearest_stop_by_growing_rings(spark):
    rng = random.Random(9)
    stops = [(k, f"Metro s{k}", rng.choice([10.0, 500.0, 90_000.0]) * rng.uniform(-1, 1), rng.uniform(-900, 900), rng.random() < 0.3) for k in range(60)]
    places = [(k, rng.uniform(-60_000, 60_000), rng.uniform(-2000, 2000), rng.random() < 0.5) for k in range(40)]
    found = scenarios.nearest_stop(spark.createDataFrame(places, "k int, x double, y double, underground boolean"), spark.createDataFrame(stops, "stop_id int, name string, x double, y double, underground boolean"), ["k"])
    for r in found.collect():
        best = min(stops, key=lambda s: (s[4] != r.underground, round(math.hypot(s[2] - r.x, s[3] - r.y), 6), s[0]))
        assert r["name"] == best[1].replace("Metro ", "") + (" (subway)" if r.underground else "")
    above = [s for s in stops if not s[4]]  # none of the place's level: any
    one = scenarios.nearest_stop(spark.createDataFrame([(1, 0.0, 0.0, True)], "k int, x double, y double, underground boolean"), spark.createDataFrame(above, "stop_id int, name string, x double, y double, underground boolean"), ["k"]).first()
    assert one["name"] == min(above, key=lambda s: math.hypot(s[2], s[3]))[1].replace("Metro ", "") + " (subway)"


def test_sketches_of_days_merge_to_quantiles_within_one_percent(spark):
    rows = spark.range(60_000).selectExpr("id % 3 AS k", "concat('d', id % 7) AS day", "CASE WHEN id % 100 > 0 THEN cast(hash(id) AS double) END AS v", "id")
    merged = quantiles.merged_quantiles(quantiles.daily_sketches(rows, ["k"], "v"), ["k"], {"a": 0.1, "b": 0.5, "c": 0.9})
    for r in merged.collect():
        own = sorted(v for v, in rows.where((F.col("k") == r.k) & F.col("v").isNotNull()).select("v").collect())
        assert r.n == len(own)
        for value, share in ((r.a, 0.1), (r.b, 0.5), (r.c, 0.9)):
            assert abs(sum(v <= value for v in own) / len(own) - share) < 0.01
    exact, near = (rows.groupBy("k").agg(quantiles.quantile("v", 0.5, size).alias("q")).orderBy("k").collect() for size in (0, 400))
    assert all(abs(a.q - b.q) < 0.02 * 2**32 for a, b in zip(exact, near)) and exact != near


def test_a_stage_is_built_once_and_again_when_its_source_changes(spark, tmp_path):
    built = []

    def table():
        rows = spark.range(3).selectExpr("id", "id % 2 AS day")
        built.append(1)
        return rows

    source = lambda: spark.read.parquet(str(tmp_path / "source"))
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "source"))
    for _ in range(2):
        assert files.stage("t", [source()], ("x",), table).count() == 3
    assert len(built) == 1
    files.stage("t", [source()], ("y",), table)
    spark.range(6).coalesce(1).write.mode("append").parquet(str(tmp_path / "source"))
    assert files.stage("t", [source()], ("y",), table).count() == 3 and len(built) == 3


def test_landings_are_cleared(spark, sf_dir):
    registry.queries()["parquet_by_day"](spark, sf_dir).count()
    assert [x for x in os.listdir(files.shared(spark)) if x.startswith("landing-")]
    files.clear_landings(spark)
    assert not [x for x in os.listdir(files.shared(spark)) if x.startswith("landing-")]


def test_segment_minutes_with_missing_cells_and_hours(spark):
    mph = 2.23694
    cells = spark.createDataFrame([("A", 0, 0, 8, 10.0 * mph), ("A", 0, 0, 10, 5.0 * mph), ("A", 0, 1, 10, 5.0 * mph), ("A", 0, 2, 10, 0.0), ("A", 0, 1, 23, 20.0 * mph), ("A", 0, 1, 5, 10.0 * mph)], "route_id string, direction_id int, bin int, hour int, mph double")
    parts = spark.createDataFrame([("k", "A", 0, 50.0, 250.0)], "key string, route_id string, direction_id int, d0 double, d1 double")
    out = {r.hour: round(r.minutes * 60, 4) for r in scenarios.segment_minutes(parts, cells, "key", (3, 4, 5, 7, 8, 9, 10, 23, 24, 25), slow_mph=2.0 * mph).collect()}
    # Hour 8: 50 m at 10, then two bins without a cell; 7 and 9, without any, are slow throughout, whatever their neighbours have; a still cell is slow.
    assert {h: out[h] for h in (7, 8, 9, 10)} == {7: 100.0, 8: 80.0, 9: 100.0, 10: 55.0}
    # Outside the grid's hours 4 takes 5 and 24 takes 23; 3 and 25 have none beside them.
    assert {h: out[h] for h in (3, 4, 5, 23, 24, 25)} == {3: 100.0, 4: 60.0, 5: 60.0, 23: 55.0, 24: 55.0, 25: 100.0}


def test_rides_by_observed_and_by_scheduled_rail(spark):
    bus = spark.createDataFrame([("b", p, 8, 20.0, 30.0) for p in ("both", "seen", "plan", "none")], "route_id string, pair string, hour int, median double, p90 double")
    seen = spark.createDataFrame([("both", 8, 6.0, 4.0), ("seen", 8, 7.0, 5.0)], "pair string, hour int, median double, per_hour double")
    plan = spark.createDataFrame([("both", 8, 10, 5.0), ("plan", 8, 6, 9.0), ("plan", 9, 6, 9.0)], "pair string, hour int, trips long, median double")
    ways = spark.createDataFrame([("b", 8, 10.0, 6.0)], "route_id string, hour int, headway double, new_headway double")
    found = {r.pair: (r.ride, r.measured, r.trains, r.via, r.gain, r.net) for r in scenarios.transfer_rides(bus, seen, plan, ways).collect()}
    assert found == {"both": (6.0, True, 10.0, 17.0, 2.0, -5.0), "seen": (7.0, True, 5.0, 21.0, 2.0, -1.0), "plan": (9.0, False, 6.0, 22.0, 2.0, 0.0)}
    alone = scenarios.transfer_rides(bus, seen, plan, ways.limit(0)).where("pair = 'plan'").first()
    assert (alone.gain, alone.net) == (0.0, 2.0)


def test_truncation_has_a_row_for_every_hour_with_service(spark, sf_dir):
    cuts = spark.createDataFrame([(r, h, 5.0) for r in ("a", "night") for h in (2, 8, 9, 24)], "route_id string, hour int, minutes double")
    service = spark.createDataFrame([("a", 2, 6, 50.0), ("a", 8, 12, 50.0), ("a", 9, 10, 50.0), ("a", 24, 6, 50.0), ("night", 2, 3, 50.0)], "route_id string, hour int, tph long, round_trip double")
    found = {(r.route_id, r.hour): (r.saved, r.freed, r.daily_hours) for r in scenarios.corridor_truncation(cuts, cuts, service).collect()}
    assert found == {("a", h): (6.0, f, 2.2) for h, f in ((2, 0.6), (8, 1.2), (9, 1.0), (24, 0.6))} | {("night", 2): (6.0, 0.3, 0.0)}
    trips = tables.extents(spark, sf_dir).where("direction_id = 1").selectExpr("route_id", "cast(floor(t0 / 3600) AS int) AS hour").distinct()
    hours = {tuple(r) for r in trips.collect()}
    assert 2 in {h for _, h in hours}
    assert {(r.route_id, r.hour) for r in corridor_queries.corridor_truncation(spark, sf_dir).collect()} == hours


def test_only_rail_has_tunnels(spark):
    stops = spark.createDataFrame([(r, 0, d, n) for r in ("bus", "rail") for d, n in ((100.0, "old a"), (900.0, "b"))], "route_id string, direction_id int, d double, name string")
    shape = spark.createDataFrame([(r, 0, 10.0 * k, 10.0 * k, 0.0) for r in ("bus", "rail") for k in range(100)], "route_id string, direction_id int, d double, x double, y double")
    portals = spark.createDataFrame([(1, 400.0, 10.0)], "portal_id int, x double, y double")
    routes = spark.createDataFrame([("bus", 0, 1000.0, "bus"), ("rail", 0, 1000.0, "rail")], "route_id string, direction_id int, length double, mode string")
    assert [tuple(r) for r in corridors.tunnel_ranges(stops, shape, portals, routes, ("old",)).collect()] == [("rail", 0, 0.0, 400.0)]


def test_a_stop_with_one_underground_name_of_several_is_underground(spark, tmp_path):
    """Parts 3 and 11 are one stop of route 3, direction 0: the first name in order isn't an underground one, the second is."""
    spark.createDataFrame([(3, "almond a", 10), (11, "old b", 10), (19, "blue c", 20), (8, "old d", 10), (4, "old e", 10)], "p_partkey long, p_name string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(5, "s", 1e6, 0)], "s_suppkey long, s_name string, s_acctbal double, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    assert [tuple(r) for r in corridor_queries.tunnel_ranges(spark, str(tmp_path)).collect()] == [("R3", 0, 0.0, 900.0)]


def test_binary_search_in_arrays(spark):
    rng = random.Random(1)
    rows = [(sorted(rng.choices([float(v) for v in range(12)], k=rng.randint(0, 9))), rng.choice([-1.0, 3.0, 5.5, 11.0, 12.0]), rng.choice([2.0, 6.0, 20.0])) for _ in range(300)]
    table = spark.createDataFrame(rows, "v array<double>, x double, y double")
    v, x, y = F.col("v"), F.col("x"), F.col("y")
    got = table.select("v", "x", "y", search.count_below(v, x).alias("a"), search.count_up_to(v, x).alias("b"), search.between(v, x, y).alias("c"), search.between(v, x, y, high_too=False).alias("d"))
    for r in got.collect():
        assert (r.a, r.b) == (sum(e < r.x for e in r.v), sum(e <= r.x for e in r.v))
        assert (r.c, r.d) == ([e for e in r.v if r.x <= e <= r.y], [e for e in r.v if r.x <= e < r.y])


def test_sweeps_count_what_each_trip_covers(spark):
    rng = random.Random(2)
    trips = [("A", d, float(a), float(a + rng.choice([0, 5, 60, 400])), 500.0) for d in (0, 1) for a in rng.sample(range(0, 500), 40)]
    points = [("A", d, 10 * d + k, float(50 * (k // 2))) for d in (0, 1) for k in range(10)]  # two at each place
    extents = spark.createDataFrame(trips, "route_id string, direction_id int, a0 double, a1 double, length double")
    found = states.covering_trips(extents, spark.createDataFrame(points, "route_id string, direction_id int, p int, d double"), "p", 20.0, 7.0)
    assert {r.p: r.trips for r in found.collect()} == {p: sum(t[1] == w and t[2] + 20 <= d <= t[3] - 7 for t in trips) for _, w, p, d in points}
    bins = {(r.direction_id, r.bin): r.traversals for r in grid.bin_traversals(extents).collect()}
    want = {(w, b): sum(t[1] == w and t[2] // 100 <= b <= min(t[3] // 100, 5) for t in trips) for w in (0, 1) for b in range(12)}
    assert bins == {k: n for k, n in want.items() if n}


def test_signals_by_mode_and_hour(spark):
    waits = spark.createDataFrame([("R", 0, 1, 10, 3600.0), ("S", 0, 1, 5, 1800.0), ("R", 0, 2, 4, 0.0), ("S", 0, 3, 50, 360.0)], "route_id string, direction_id int, signal_id int, passes long, wait double")
    hours = spark.createDataFrame([(1, 8, 0.6), (1, 9, 0.9), (3, 8, 0.1)], "signal_id int, hour int, hours double")
    modes = spark.createDataFrame([("R", 0, "rail"), ("S", 0, "bus")], "route_id string, direction_id int, mode string")
    at = lambda *a: {r.signal_id: (round(r.hours, 4), r.wait, r.passes) for r in signals.signals_seen(waits, hours, modes, *a).collect()}
    assert at() == {1: (1.5, 360.0, 15.0), 3: (0.1, 7.2, 50.0)}
    assert at("rail") == {1: (1.0, 360.0, 10.0), 3: (0.0, 0.0, 0.0)}
    assert at("bus", 8) == {1: (0.2, 360.0, 5.0), 3: (0.1, 7.2, 50.0)}
    assert at(None, 9) == {1: (0.9, 360.0, 15.0), 3: (0.0, 7.2, 50.0)}
    ranked = signals.signal_ranking(signals.signals_seen(waits, hours, modes, "bus", 8), by="wait", least_passes=3.0)
    assert [r.signal_id for r in ranked.orderBy("rank").collect()] == [1, 3]


def test_projected_stops_keep_their_order(spark):
    line = [("R", 0, 0, 0.0, 0.0, 100.0, 0.0, 0.0), ("R", 0, 1, 100.0, 0.0, 100.0, 50.0, 100.0), ("R", 0, 2, 100.0, 50.0, 0.0, 50.0, 150.0), ("R", 0, 3, 0.0, 50.0, 0.0, 0.0, 250.0)]
    segments = spark.createDataFrame(line, "route_id string, direction_id int, k int, x0 double, y0 double, x1 double, y1 double, c0 double")
    stops = spark.createDataFrame([("R", 0, 1, 10.0, 5.0), ("R", 0, 2, 50.0, 45.0), ("R", 0, 3, 1.0, 5.0)], "route_id string, direction_id int, seq int, x double, y double")
    assert [r.d for r in network.project_stops(stops, segments).orderBy("seq").collect()] == [10.0, 200.0, 295.0]


def polls(spark, path, rows, schema):
    """Rows (poll, ...) as a stream of one file per poll."""
    table = spark.createDataFrame(rows, "poll int, " + schema)
    for (k,) in table.select("poll").distinct().orderBy("poll").collect():
        table.where(F.col("poll") == k).coalesce(1).write.mode("append").parquet(f"{path}/in")
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def test_a_poll_lands_in_as_many_files_as_the_table_has_parts(spark, sf_dir, tmp_path):
    from fleetspark.jobs import more_queries

    given = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("poll", F.expr(more_queries.POLL))
    for at, some in enumerate(("poll < 2", "poll = 1 OR poll = 2", "poll > 2")):  # parts with rows of some polls only
        given.where(some).where("poll <> 1 OR event_id % 2 = " + str(at % 2)).drop("poll").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/events.parquet")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        stream = more_queries.events(spark, str(tmp_path / "in"), str(tmp_path / "out"))
        parts = spark.read.parquet(f"{tmp_path}/in/events.parquet").rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert parts > 2 and len(spark.read.parquet(f"{tmp_path}/out/polls").inputFiles()) == 6 * parts
    seen = {}
    stream.writeStream.foreachBatch(lambda batch, k: seen.update({k: sorted(batch.select("poll", "event_id").collect())})).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    rows = sorted(given.select("poll", "event_id").collect())
    assert seen == {k: [r for r in rows if r.poll == k] for k in range(6)}


def test_changed_positions_of_a_vehicle_that_expires_and_comes_back(spark, tmp_path):
    at = lambda h: f"2024-01-01 {h:02}:00:00"
    rows = [(0, 1, 10, 0, at(0)), (0, 1, 20, 1, at(0)), (0, 2, 5, 2, at(0)), (1, 1, 10, 3, at(1)), (1, 1, 10, 4, at(1)), (1, 3, 7, 5, at(1)), (2, 1, 10, 6, at(2)), (3, 1, 10, 7, at(5)), (4, 1, 10, 8, at(6)), (4, 2, 5, 9, at(6)), (4, 3, 7, 10, at(6))]
    stream = polls(spark, tmp_path, rows, "vehicle_id long, at long, seq long, time string").withColumn("polled", F.col("time").cast("timestamp"))
    forgotten = live.finished(live.live_changed_only(stream, forget_seconds=3 * 3600), str(tmp_path / "a"))
    # Vehicles 2 and 3 were last polled at 0 and 1 o'clock: the watermark of poll 4, 4:50, is three hours beyond both. Vehicle 1 is polled all the time.
    assert sorted(r.seq for r in forgotten.collect()) == [0, 1, 2, 3, 5, 9, 10]
    kept = live.finished(live.live_changed_only(stream, forget_seconds=24 * 3600), str(tmp_path / "b"))
    batch = spark.createDataFrame([r[1:4] for r in rows], "vehicle_id long, at long, seq long")
    assert sorted(r.seq for r in kept.collect()) == [0, 1, 2, 3, 5] == sorted(r.seq for r in live.changed_only_batch(batch).collect())


def test_changed_positions_keep_state_by_groups_of_vehicles(spark, tmp_path):
    """State has a value and a timer per group, however many vehicles: a call for each would take hours for a large fleet."""
    rows = [(k, 5 * v, (v * (k + 1)) % 3, 10_000 * k + v, f"2024-01-01 0{k}:00:00") for k in range(3) for v in range(4000)]
    stream = polls(spark, tmp_path, rows, "vehicle_id long, at long, seq long, time string").withColumn("polled", F.col("time").cast("timestamp"))
    spark.conf.set(*live.ROCKS)
    query = live.live_changed_only(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert all(p["stateOperators"][0]["numRowsTotal"] <= 3 * live.GROUPS for p in query.recentProgress)
    batch = live.changed_only_batch(spark.createDataFrame([r[1:4] for r in rows], "vehicle_id long, at long, seq long"))
    found = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, batch.select("vehicle_id", "at", "seq").collect()))


def test_changed_positions_of_groups_that_come_and_go(spark, tmp_path, monkeypatch):
    """Many vehicles a group, some polled late, forgotten or without id or time, against a loop over the polls."""
    rng, rows, hour = random.Random(4), [], [0, 1, 2, 6, 7, 12, 13, 14, 18, 19]
    big = 2**60  # ids that no double can tell apart
    for k in range(len(hour)):
        for vehicle in rng.sample([None, *range(big, big + 30)], 12 if k != 4 else 1):
            for _ in range(rng.choice([1, 1, 3])):
                when = hour[k - 1] if k and rng.random() < 0.2 else hour[k]
                rows.append((k, vehicle, rng.choice([None, 1, 1, 2, big]), len(rows) if rng.random() < 0.7 else -len(rows), f"2024-01-01 {when:02}:30:00"))
    want, state, newest = [], {}, 0
    for k in range(len(hour)):
        mark = newest - 600
        state = {v: s for v, s in state.items() if s[1] + 3 * 3600 > mark}
        for _, vehicle, at, seq, time in sorted((r for r in rows if r[0] == k), key=lambda r: r[3]):
            last, polled = state.get(vehicle, (None, 0))
            if last is None or (at is not None and at != last):
                want.append((vehicle, at, seq))
            seconds = int(time[11:13]) * 3600 + 1800
            state[vehicle], newest = (at, max(polled, seconds)), max(newest, seconds)
    monkeypatch.setattr(live, "GROUPS", 3)
    stream = polls(spark, tmp_path, rows, "vehicle_id long, at long, seq long, time string").withColumn("polled", F.col("time").cast("timestamp"))
    found = live.finished(live.live_changed_only(stream, forget_seconds=3 * 3600), str(tmp_path / "out"))
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))


def test_late_rows_are_dropped_and_told_of(spark, tmp_path):
    at = lambda h, m: f"2024-01-01 {h:02}:{m:02}:00"
    rows = [(0, 1, at(1, 0)), (0, 1, at(1, 0)), (1, 1, at(1, 0)), (1, 2, at(3, 0)), (2, 1, at(1, 5)), (3, 1, at(1, 6)), (3, 2, at(2, 55)), (3, 2, at(3, 0))]
    stream = polls(spark, tmp_path, rows, "vehicle_id long, time string").select("vehicle_id", F.col("time").cast("timestamp").alias("ts"))
    heard = live.Progress()
    out = live.finished(live.live_dedupe(stream), str(tmp_path / "out"), heard)
    assert sorted((r.vehicle_id, str(r.ts)[11:16]) for r in out.collect()) == [(1, "01:00"), (1, "01:05"), (2, "02:55"), (2, "03:00")]
    told = {r.batch: (r.rows, r.dropped_late) for r in heard.table(spark).where("rows > 0").collect()}
    assert told == {0: (2, 0), 1: (2, 0), 2: (1, 0), 3: (3, 1)}


def test_status_counts_polls_and_a_poll_again_replaces_its_row(spark, tmp_path):
    rows = [(0, 1, "2024-01-01 01:00:00"), (0, None, "2024-01-01 01:00:00"), (1, 2, None), (2, 1, "2024-01-01 00:30:00"), (2, 2, "2024-01-01 00:40:00")]
    stream = polls(spark, tmp_path, rows, "vehicle_id long, time string").select("vehicle_id", F.col("time").cast("timestamp").alias("ts"))
    for k in range(2):  # the second time all is done again
        live.live_status(stream, str(tmp_path / "status"), str(tmp_path / f"state{k}")).awaitTermination()
    found = live.status_so_far(spark.read.parquet(str(tmp_path / "status"))).orderBy("batch").collect()
    assert [(r.polls, r.rows, r.errors, str(r.last)[11:16], r.last_rows, r.last_vehicles) for r in found] == [(1, 2, 1, "01:00", 2, 1), (2, 3, 2, "01:00", 1, 1), (3, 5, 2, "01:00", 2, 2)]


def test_followed_live_with_late_pings_is_the_day(spark, tmp_path):
    rng, rows = random.Random(3), []
    for vehicle in (1, 2):
        t = 0
        for k in range(60):
            t += rng.choice([20, 20, 30, 400, 700])
            place = [(shape, float(t % 4000 + rng.choice([0, 0, 300, -200])), shape.lower(), "0", False, 0, 0, []) for shape in "Aab" if rng.random() < 0.7]
            rows.append((min(4, t // 3000 + (k % 5 == 0)), 1, vehicle, 1000 * vehicle + k, t, 5, place))
    rows.append((9, 1, 3, 1, 10**6, 5, []))
    stream = polls(spark, tmp_path, rows, f"day int, vehicle_id long, event_id long, t int, average_speed int, places array<{segmentation.PLACE}>")
    live_pieces = live.finished(follow.follow_live(stream.withColumn("at", F.timestamp_seconds("t")), late="2 hours"), str(tmp_path / "out"))
    whole = segmentation.fragments(spark.read.schema(stream.schema).parquet(str(tmp_path / "in")))
    one = lambda df: sorted(map(tuple, df.select("vehicle_id", "fragment", "event_id", "t", "shape_id", "along").collect()))
    assert one(live_pieces) == one(whole) and len({r[1] for r in one(whole)}) > 5


def test_live_rows(spark):
    rows = [("7", -122.4, 37.7, 359.6, 10.0, 0, 1_700_000_000, "N", None, "t"), ("x", 1.0, 1.0, 0.0, 0.0, 1, 1, "", 0, ""), ("8", None, 1.0, 0.0, 0.0, 1, 1, "", 0, "")]
    out = live.live_normalise(spark.createDataFrame(rows, live.ENTITY)).collect()
    assert [(r.vehicle_id, r.day, r.heading, r.average_speed, r.direction_id) for r in out] == [(7, "2023-11-14", 0, 22, -1)]


def test_files(spark, tmp_path):
    (tmp_path / "f.json").write_text('{"gtfs_dataset_name": "a", "vehicle_id": "1"}\n{"gtfs_dataset_name": "b"}\n')
    assert files.read_feed(spark, str(tmp_path / "f.json"), "a").first().vehicle_id == "1"
    (tmp_path / "s.json").write_text('[{"type": "S", "shape": {"coordinates": [1.5, 2.5]}}, {"type": "S", "shape": null}, {"type": "Z", "shape": {"coordinates": [1, 2]}}]')
    assert [(r.lon, r.lat) for r in files.read_signals(spark, str(tmp_path / "s.json"), ("S",)).collect()] == [(1.5, 2.5)]
    days = spark.createDataFrame([("d1", 1), ("d2", 2)], "day string, n int")
    files.write_by_day(days, str(tmp_path / "days"))
    files.write_by_day(days.where("day = 'd1'").withColumn("n", F.lit(9)), str(tmp_path / "days"))
    assert sorted((str(r.day), r.n) for r in spark.read.parquet(str(tmp_path / "days")).collect()) == [("d1", 9), ("d2", 2)]
    files.write_documents(days, str(tmp_path / "docs"), "day", "n")
    assert spark.read.text(str(tmp_path / "docs")).count() == 2


def places(*alongs, family="7", direction="0", rapid=False, stops=()):
    """A shape's places, ping by ping; None where the ping isn't on it."""
    near = lambda a: tuple(d for d in stops if abs(a - d) <= 30)
    return [a if a is None else segmentation.Place(a, family, direction, rapid, sum(d < a for d in stops), sum(d <= a for d in stops), near(a)) for a in alongs]


def day_of(**shapes):
    return [{name: row[k] for name, row in shapes.items() if row[k] is not None} for k in range(len(next(iter(shapes.values()))))]


def pieces(times, days, halted=()):
    taken = [segmentation.Ping(k, t, k in halted, day) for k, (t, day) in enumerate(zip(times, days))]
    return [(shape, [p.key for p, _ in own], [along for _, along in own]) for shape, own in segmentation.pieces(taken)]


def followed(times, days, halted=()):
    return [(shape, own) for shape, own, _ in pieces(times, days, halted)]


def sewn(spark, *parts):
    """Trips of pieces (shape, times, alongs) of one vehicle: for each, its shape and its pings' times."""
    rows = [(1, 1, k, 100 * k + i, t, shape, float(a)) for k, (shape, times, alongs) in enumerate(parts) for i, (t, a) in enumerate(zip(times, alongs))]
    out = {}
    for r in segmentation.stitch_fragments(spark.createDataFrame(rows, "day int, vehicle_id long, fragment long, event_id long, t int, shape_id string, along double")).orderBy("t").collect():
        out.setdefault((r.trip, r.shape_id), []).append(r.t)
    return [(shape, times) for (_, shape), times in out.items()]


def test_followed_shape_with_most_pings():
    times = list(range(0, 160, 20))
    a, b = places(0, 100, 200, 300, 400, 500, 600, 700), places(0, 100, 200, None, None, None, None, None, family="8")
    assert followed(times, day_of(a=a, b=b)) == [("a", list(range(8)))]
    # A jump too far ahead is a miss, and so is one back.
    jump = places(0, 100, 5000, 300, 100, 500, 600, 700)
    assert followed(times, day_of(a=jump)) == [("a", [0, 1, 3, 5, 6, 7])]


def test_pieces_end():
    times = [0, 20, 40, 700, 720, 740]
    assert followed(times, day_of(a=places(0, 100, 200, 250, 300, 400))) == [("a", [0, 1, 2]), ("a", [3, 4, 5])]
    # Five pings off the shape end a piece, unless another shape is followed meanwhile.
    times = list(range(0, 240, 20))
    hole = places(0, 100, 200, 300, None, None, None, None, None, None, 700, 800)
    away = places(None, None, None, None, 0, 0, 0, 0, 0, 0, None, None, family="9")
    assert [x for x, _ in followed(times, day_of(a=hole, b=away))] == ["b", "a"]
    assert followed([0, 20, 40, 60, 80, 100], day_of(a=places(0, 100, None, None, 300, 400))) == [("a", [0, 1, 4, 5])]
    lost = places(0, 100, 200, *[None] * 6, 300, 400, 500)
    assert followed(times, day_of(a=lost)) == [("a", [0, 1, 2]), ("a", [9, 10, 11])]


def test_pieces_are_stitched(spark):
    assert sewn(spark, ("a", [0, 20, 40], [0, 100, 200]), ("a", [180, 200], [300, 500])) == [("a", [0, 20, 40, 180, 200])]
    # A vehicle that stands makes no piece, and does not part the pieces around it.
    assert sewn(spark, ("a", [0, 20], [0, 100]), ("b", [40, 60], [5, 12]), ("a", [80, 90], [120, 300])) == [("a", [0, 20, 80, 90])]
    assert sewn(spark, ("a", [0, 20], [0, 100]), ("b", [40, 60], [5, 52]), ("a", [80, 90], [120, 300])) == [("a", [0, 20]), ("b", [40, 60]), ("a", [80, 90])]
    # Too late, and too far back; the farthest point starts anew with a new trip.
    assert sewn(spark, ("a", [0, 20], [0, 100]), ("a", [621, 640], [120, 300])) == [("a", [0, 20]), ("a", [621, 640])]
    assert sewn(spark, ("a", [0, 20], [0, 900]), ("a", [40, 60], [599, 700])) == [("a", [0, 20]), ("a", [40, 60])]
    assert sewn(spark, ("a", [0, 20], [0, 900]), ("a", [40, 60], [100, 200]), ("a", [80, 90], [150, 400])) == [("a", [0, 20]), ("a", [40, 60, 80, 90])]


def test_local_if_it_halts_at_local_stops():
    times, stops = list(range(0, 200, 20)), (100, 300, 500, 700)
    local = places(*range(0, 1000, 100), stops=stops)
    for direction in "01":  # siblings are of one family, in any direction
        rapid = places(*range(0, 1000, 100), rapid=True, direction=direction)
        assert followed(times, day_of(l=local, r=rapid), halted=(1, 3, 5)) == [("l", list(range(10)))]
        assert followed(times, day_of(l=local, r=rapid), halted=(1, 2, 4)) == [("r", list(range(10)))]
    # A stop near the first ping but before it is not passed, so a halt there does not count.
    early = places(*range(0, 1000, 100), stops=(-20, 300, 500))
    assert followed(times, day_of(l=early, r=places(*range(0, 1000, 100), rapid=True)), halted=(0, 3, 5)) == [("r", list(range(10)))]


def test_late_joiners_are_of_one_family_and_direction():
    times = list(range(0, 400, 20))
    main = places(*range(0, 2000, 100))
    late = [None] * 8
    same, other = (places(*late, *range(800, 2000, 100), direction=d, rapid=True) for d in "01")
    follower = segmentation.Follower()
    for k, day in enumerate(day_of(a=main, s=same, o=other)):
        assert not list(follower.step(segmentation.Ping(k, times[k], False, day)))
    assert set(follower.tracks) == {"a", "s"}


def test_a_day_in_any_cut_is_the_whole_day():
    """Stepping and closing give what a plain restatement over the whole day gives."""
    rng = random.Random(4)
    for _ in range(60):
        n, t, times, days = rng.randint(1, 60), 0, [], []
        for _k in range(n):
            t += rng.choice([5, 20, 20, 60, 200, 700])
            times.append(t)
            days.append({x: segmentation.Place(float(rng.choice([t, t, t + 30, t - 60, rng.randint(0, 9000)])), x.lower(), "0") for x in "ABa" if rng.random() < 0.6})
        got, k = [], 0
        while k < n:  # plain
            if not days[k]:
                k += 1
                continue
            begin = fit = k
            tracks = {x: [p.along, times[k], 0, [k], True] for x, p in days[k].items()}
            for j in range(begin + 1, n):
                if times[j] - times[fit] > 600:
                    break
                trial = {x: [*v[:3], list(v[3]), v[4]] for x, v in tracks.items()}
                fitted = False
                for x, v in trial.items():
                    if v[4]:
                        p = days[j].get(x)
                        if p and p.along >= v[0] - 120 and p.along - v[0] <= 25 * (times[j] - v[1]) + 200:
                            v[:3], fitted = [max(v[0], p.along), times[j], 0], True
                            v[3].append(j)
                        elif v[2] < 4:
                            v[2] += 1
                        else:
                            v[4] = False
                lines = {x.lower() for x, v in trial.items() if v[4]}
                for x, p in days[j].items():
                    if x not in tracks and (j - begin < 6 or x.lower() in lines):
                        trial[x], fitted = [p.along, times[j], 0, [j], True], True
                if not any(v[4] for v in trial.values()):
                    break
                tracks, fit = trial, j if fitted else fit
            best = min((x for x, v in tracks.items() if v[4]), key=lambda x: (-len(tracks[x][3]), x))
            got.append((best, tracks[best][3]))
            k = fit + 1
        assert followed(times, days) == got


def test_hours_next_to_a_gap(spark):
    rows = spark.createDataFrame([("a", 5, 1.0), ("a", 7, 2.0)], "k string, hour int, v double")
    assert sorted(tuple(r) for r in scenarios.near_hours(rows, ["k"], ["v"]).collect()) == [("a", 4, 1.0), ("a", 5, 1.0), ("a", 6, 2.0), ("a", 7, 2.0), ("a", 8, 2.0)]


def test_signals_over_tunnels_are_left_out(spark):
    from fleetspark.operators.signals import signal_positions

    shapes = spark.sql("SELECT 'A' AS route_id, direction_id, CAST(id * 10 AS DOUBLE) AS x, 0D AS y, CAST(id * 10 AS DOUBLE) AS d FROM range(100) CROSS JOIN (SELECT explode(array(0, 1)) AS direction_id)")
    routes = spark.sql("SELECT 'A' AS route_id, explode(array(0, 1)) AS direction_id, 990D AS length")
    lights = spark.createDataFrame([(1, 300.0, 5.0), (2, 500.0, 5.0), (3, 700.0, 5.0)], "signal_id int, x double, y double")
    tunnels = spark.createDataFrame([("A", 0, 400.0, 600.0), ("B", 1, 0.0, 990.0)], "route_id string, direction_id int, d0 double, d1 double")
    found = {(r.direction_id, r.signal_id) for r in signal_positions(lights, shapes, routes, tunnels=tunnels).collect()}
    assert found == {(0, 1), (0, 3), (1, 1), (1, 2), (1, 3)}
    assert signal_positions(lights, shapes, routes).count() == 6


def test_places_are_named_after_their_level(spark):
    stops = spark.createDataFrame([(1, "Metro A", 0.0, 0.0, True), (2, "B", 50.0, 0.0, False), (3, "C", 50.0, 0.0, False)], "stop_id int, name string, x double, y double, underground boolean")
    places = spark.createDataFrame([(1, 0.0, 0.0, False), (2, 60.0, 0.0, True)], "place int, x double, y double, underground boolean")
    name = lambda near: {r.place: r["name"] for r in scenarios.nearest_stop(places, near, ["place", "underground"]).collect()}
    assert name(stops) == {1: "B", 2: "A (subway)"}
    assert name(stops.where("not underground")) == {1: "B", 2: "B (subway)"}  # none of its level
    assert name(stops.limit(0)) == {1: None, 2: None}


def test_hotspots_of_a_mode(spark):
    kind = "cx long, cy long, heading int, underground boolean, name string, hours double, by_mode map<string,double>, routes map<string,array<string>>, crawl double, dwell double, stopped double"
    rows = [(0, 0, 2, False, "a", 3.0, {"bus": 1.0, "rail": 2.0}, {"bus": ["5", "1"], "rail": ["N"]}, 0.4, 0.2, 0.4), (1, 0, 2, False, "b", 2.0, {"bus": 2.0}, {"bus": ["2"]}, 0.5, 0.5, 0.0), (2, 0, 2, False, "c", 1.0, {"rail": 1.0}, {"rail": ["N"]}, 0.2, 0.5, 0.3)]
    places = spark.createDataFrame(rows, kind)
    out = lambda mode: [(r["name"], r.hours, r.cause, r.routes) for r in scenarios.hotspot_topk(places, mode).collect()]
    assert out(None) == [("a", 3.0, "stopped", "1,5,N"), ("b", 2.0, "crawl", "2"), ("c", 1.0, "dwell", "N")]
    assert [r[:2] for r in out("bus")] == [("b", 2.0), ("a", 1.0)]
    assert [r[3] for r in out("rail")] == ["N", "N"]


def test_places_of_rapid_routes(spark):
    rows = [("5", 0, "5", 10, False), ("5", 0, "5", 11, False), ("5", 1, "5", 10, False), ("5", 0, "5R", 10, True), ("7", 0, "7", 10, False)]
    stops = spark.createDataFrame(rows, "line string, direction_id int, route_id string, place int, rapid boolean")
    assert sorted((r.line, r.direction_id, r.place) for r in scenarios.also_rapid(stops).where("at_rapid").collect()) == [("5", 0, 10)]
