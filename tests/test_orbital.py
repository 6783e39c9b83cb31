"""Every orbital query against DuckDB, and fixtures with known values."""

import glob
import math
import os
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from orbitfold.functions import formulas as f
from orbitfold.operators import spatial
from orbitfold.plans import ORACLE_SQL, QUERIES
from orbitfold.sources import cdm_xml, tle

SF = "/root/testdata/sf0.001"
ISS = ("1 25544U 98067A   21001.00000000  .00001480  00000-0  34282-4 0  9990", "2 25544  51.6442 165.4300 0001363 118.2800 241.8400 15.48922536260000")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(None if pd.isna(v) else v for v in r) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in ORACLE_SQL:
        assert name in ("g3_propagate_catalog", "g4_propagate_in_chunks", "g6_sweep_catalog", "v3_passes")
        return
    want = duck.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def with_checksum(line):
    body = line[:68]
    return body + str((sum(int(c) for c in body if c.isdigit()) + body.count("-")) % 10)


def test_tle_reasons(spark):
    a, b = map(with_checksum, ISS)
    bad = a[:68] + str((int(a[68]) + 1) % 10)
    cases = {
        None: (a, b), "L1_LENGTH": (a[:60], b), "L2_LENGTH": (a, None), "L1_PREFIX": ("3" + a[1:], b), "L2_PREFIX": (a, "1" + b[1:]), "L1_CHECKSUM": (bad, b),
        "ID_MISMATCH": (a, with_checksum("2 25545" + b[7:])), "EPOCH_PARSE_ERROR": (with_checksum(a[:18] + "21xx1.00000000" + a[32:]), b), "BOUNDS_VIOLATION": (a, with_checksum(b[:8] + "190.0000" + b[16:])),
    }
    out = tle.parse(spark.createDataFrame([(k, *v) for k, v in cases.items()], "want string, line1 string, line2 string")).collect()
    assert all(r["want"] == r["reason"] for r in out), [(r["want"], r["reason"]) for r in out]
    ok = next(r for r in out if r["reason"] is None)
    assert (ok["norad_id"], ok["inclination"], ok["eccentricity"], ok["mean_motion"]) == ("25544", 51.6442, 0.0001363, 15.48922536)
    assert math.isclose(ok["bstar"], 0.34282e-4) and ok["epoch_us"] == 1609459200000000


def test_density_has_known_values(spark):
    got = spark.createDataFrame([(150.0,), (200.0,), (400.0,), (800.0,), (99.9,)], "h double").selectExpr("h", f"{f.bates_density('h', '150e0', '150e0', '15e0')} AS rho").collect()
    want = {150.0: 2.180568e-07, 200.0: 5.955770e-10, 400.0: 3.697213e-12, 800.0: 6.690386e-13, 99.9: 0.0}
    assert all(math.isclose(r["rho"], want[r["h"]], rel_tol=1e-6) for r in got)


def test_range_join_equals_brute_force(spark):
    import random

    r = random.Random(42)
    p = [(str(i), *(r.uniform(-500, 500) for _ in range(3))) for i in range(120)] + [("nan", float("nan"), 0.0, 0.0), ("null", None, 0.0, 0.0)]
    got = {(x["id_a"], x["id_b"]) for x in spatial.range_self_join(spark.createDataFrame(p, "id string, x double, y double, z double"), 150.0).collect()}
    assert got == {(a[0], b[0]) for a in p[:120] for b in p[:120] if a[0] < b[0] and math.dist(a[1:], b[1:]) <= 150}


def test_unknown_risk_is_not_critical(spark):
    got = spark.createDataFrame([(None,), (float("nan"),), (2e-4,), (1e-4,), (1e-9,)], "p double").select(F.expr(f.risk("p")).alias("r")).collect()
    assert [x["r"] for x in got] == ["UNKNOWN", "UNKNOWN", "CRITICAL", "HIGH", "LOW"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_range_join_is_shuffled_however_small_its_estimate(spark):
    points = spark.range(50).selectExpr("id", "id * 1e0 AS x", "0e0 AS y", "0e0 AS z")
    near = spatial.range_self_join(points, 1.5)
    assert "Broadcast" not in plan(near) and near.count() == 49


def test_closest_samples_are_shuffled(spark):
    tracks = spark.range(20).selectExpr("id", "explode(sequence(0, 2)) AS step").selectExpr("id", "step", "id * (3e0 - step) AS x", "0e0 AS y", "0e0 AS z")
    best = spatial.closest_samples(tracks, 1.5)
    assert "Broadcast" not in plan(best) and {tuple(r)[2:] for r in best.where("cast(id_b AS int) - cast(id_a AS int) IN (-1, 1)").collect()} == {(2, 1.0)}


def test_pairs_lost_by_a_smaller_reach_come_from_one_join(spark):
    points = spark.range(60).selectExpr("id", "id * id % 41 * 1e0 AS x", "id * 7 % 13 * 1e0 AS y", "0e0 AS z")
    pairs = lambda r: spatial.range_self_join(points, r).select("id_a", "id_b")
    want = sorted(map(tuple, pairs(9.0).exceptAll(pairs(5.0)).collect()))
    assert want and sorted(map(tuple, spatial.pairs_between(points, 5.0, 9.0).select("id_a", "id_b").collect())) == want
    assert plan(QUERIES["o5_pairs_lost_by_a_smaller_reach"](spark, SF)).count("SortMergeJoin") == 1


def equals_sql_beyond_five_digits(spark, tmp_path, name):
    import duckdb

    keys = [*range(100), *range(99_990, 100_030), *range(123_450, 123_470), *range(899_980, 900_000)]
    spark.createDataFrame([(k,) for k in keys], "c_custkey long").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    assert rows(QUERIES[name](spark, str(tmp_path)).toPandas()) == rows(con.execute(ORACLE_SQL[name]).df())


def test_messages_of_lines_beyond_five_digits(spark, tmp_path):
    equals_sql_beyond_five_digits(spark, tmp_path, "p8_lines_to_messages")


def test_loaded_lines_beyond_five_digits(spark, tmp_path):
    equals_sql_beyond_five_digits(spark, tmp_path, "s1_load_lines_relaxed")


def test_grouped_lines_beyond_five_digits(spark, tmp_path):
    equals_sql_beyond_five_digits(spark, tmp_path, "s2_group_tle_lines")


@pytest.mark.parametrize("name", ["s1_load_lines_relaxed", "s2_group_tle_lines"])
def test_lines_of_repeated_ids(spark, tmp_path, name):
    import duckdb

    keys = [*range(40), *range(30), *range(25), 15, 15]
    spark.createDataFrame([(k,) for k in keys], "c_custkey long").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    assert rows(QUERIES[name](spark, str(tmp_path)).toPandas()) == rows(con.execute(ORACLE_SQL[name]).df())


def test_stk_text_is_cut_once(spark):
    parsed = QUERIES["s5_stk_ephemeris"](spark, SF)
    assert parsed._jdf.queryExecution().optimizedPlan().toString().count("ScenarioEpoch[ ") == 1


def test_cdm_xml_is_scanned_once_for_all_keys(spark):
    parsed = cdm_xml.parse_xml(spark.createDataFrame([("<CDM><OBJECT1><X>1 <Z>3</Z> <X>2</X><Y></Y><Y>4</Y><OBJECT_NAME>A&amp;B</OBJECT_NAME></OBJECT1></CDM>",)], "xml string"))
    assert parsed._jdf.queryExecution().analyzed().toString().count("COLLISION_PROBABILITY") < 10
    r = parsed.first()
    assert r["reason"] == "BAD_NUMBER" and r["object_1"]["name"] == "A&B" and r["object_1"]["state"][:3] == [None, 0.0, 3.0]


def tracks_sent(spark, name):
    return re.findall(r"\bp#\d+", plan(QUERIES[name](spark, SF)))


def test_windows_are_found_without_sending_tracks(spark):
    assert not tracks_sent(spark, "w1_conjunction_windows")


def test_small_chunks_find_the_same_pairs_and_no_object_meets_itself(spark, monkeypatch):
    from orbitfold.operators import conjunctions as conj

    states = [(str(k % 90), [7000.0 + k * 7 % 31 + s * (k % 5), s * (k % 7), k * 11 % 37.0], [1.0, 0.0, 0.0]) for k in range(100) for s in (0.0,)]
    data = [(i, [c for s in range(4) for c in (p[0] + s * v[0], p[1] + s, p[2])], v * 4, True) for i, p, v in states]
    tracks = spark.createDataFrame(data, "id string, p array<double>, v array<double>, good boolean")
    found = lambda: sorted((r["id_a"], r["id_b"], round(r["miss_km"], 6)) for r in conj.find_conjunctions(tracks, [k * 1_000_000 for k in range(4)], 4.0, orbits=False).collect())
    want = found()
    at = [np.array(x[1]).reshape(4, 3) for x in data]
    near = [(i, j) for i in range(100) for j in range(i) if data[i][0] != data[j][0] and np.linalg.norm(at[i] - at[j], axis=1).min() <= 4.0]
    assert len(want) == len(near) > 50
    monkeypatch.setattr(conj, "CHUNK", 3), monkeypatch.setattr(conj, "MOST", 16), monkeypatch.setattr(conj, "TILE", 5)
    assert found() == want


def test_events_are_found_once_and_without_sending_tracks(spark):
    assert plan(QUERIES["c1_scored_events"](spark, SF)).count("MapInArrow") == 3 and not tracks_sent(spark, "c1_scored_events")


def test_conjunctions_of_lines_are_found_without_sending_tracks(spark):
    assert not tracks_sent(spark, "c1_conjunctions_of_lines")


def test_closest_approaches_by_splines_are_found_without_sending_tracks(spark):
    assert not tracks_sent(spark, "w3_closest_approach_by_splines")


def test_events_by_miss_are_found_without_sending_tracks(spark):
    assert not tracks_sent(spark, "o1_events_by_miss")


def test_catalog_is_swept_without_sending_tracks(spark):
    assert not tracks_sent(spark, "g6_sweep_catalog")


def both_ways(monkeypatch, find):
    """Rows of what ``find`` gives by the closed form of straight tracks, and by cubics."""
    from orbitfold.operators import conjunctions as conj

    used, lines = [], conj._Block._lines
    monkeypatch.setattr(conj._Block, "_lines", staticmethod(lambda b, t, made: used.append(x := lines(b, t, made)) or x))
    straight = sorted(map(tuple, find(conj)))
    assert used and all(x is not None for x in used)
    monkeypatch.setattr(conj._Block, "_lines", staticmethod(lambda b, t, made: None))
    return straight, sorted(map(tuple, find(conj)))


def in_one_process(monkeypatch, tracks):
    """``find_conjunctions`` and the like without Spark: one block of all tracks."""
    import pyarrow as pa

    from orbitfold.operators import conjunctions as conj

    ids, p, v = tracks
    off = lambda x: pa.ListArray.from_arrays(np.arange(len(ids) + 1, dtype=np.int32) * (p[0].size), pa.array(x.reshape(-1)))
    zero = pa.array(np.zeros(len(ids), np.int32))
    b = pa.RecordBatch.from_arrays([zero, zero, zero, zero, zero, pa.array(ids), off(p), off(v), pa.array(np.ones(len(ids), bool))], ["bin", "ci", "cj", "mine", "low", "id", "p", "v", "good"])

    class Rows:
        def mapInArrow(self, run, kinds):
            return [tuple(r.values()) for out in run(iter([b])) for r in out.to_pylist()]

    monkeypatch.setattr(conj, "_blocks", lambda *a: Rows())
    monkeypatch.setattr(conj, "_ready", lambda tracks, times, made: (np.asarray(times), (np.asarray(times) - times[0]) / 1e6, None, conj._of_columns))


def straight_lines():
    """400 lines with repeated ids, equal velocities, standing objects and copies, over uneven times."""
    rng = np.random.default_rng(3)
    times = [k * 1_000_000 for k in (0, 60, 120, 150, 240, 400)]
    x = 7000 + rng.integers(-60, 60, (400, 3)).astype(float)
    u = rng.integers(-3, 4, (400, 3)) / 10.0
    u[:40], u[40:60], x[60:70], u[60:70] = 0.0, u[60], x[70:80], u[70:80]
    t = np.array(times)[:, None] / 1e6
    return times, ([str(k % 390) for k in range(400)], x[:, None] + u[:, None] * t, np.repeat(u[:, None], 6, 1))


def close(found, want):
    assert len(found) == len(want) > 1000
    for x, y in zip(found, want, strict=True):
        assert x[:2] == y[:2] and np.allclose(x[2:], y[2:], rtol=0, atol=2e-5), (x, y)


def test_straight_tracks_give_the_same_events_as_cubics(monkeypatch):
    times, tracks = straight_lines()
    in_one_process(monkeypatch, tracks)
    # the time of the closest approach is open where there is no relative motion
    columns = dict.fromkeys(["id_a", "id_b", "miss_km", "coarse_km", "speed_km_s"])
    close(*both_ways(monkeypatch, lambda conj: conj.find_conjunctions(None, times, 15.0, orbits=False, columns=columns)))


def test_straight_tracks_give_the_same_windows_as_cubics(monkeypatch):
    times, tracks = straight_lines()
    in_one_process(monkeypatch, tracks)
    columns = dict.fromkeys(["id_a", "id_b", "miss_km", "entry_us", "exit_us"])
    found = lambda conj: [(a, b, m, x / 1e6, y / 1e6) for a, b, m, x, y in conj.find_windows(None, times, 15.0, columns=columns)]
    close(*both_ways(monkeypatch, found))


def test_events_of_straight_tracks_have_all_columns(monkeypatch):
    times, tracks = straight_lines()
    in_one_process(monkeypatch, tracks)
    straight, cubics = both_ways(monkeypatch, lambda conj: conj.find_conjunctions(None, times, 15.0, orbits=False))
    moving = lambda rows: [x for x in rows if x[6] > 1e-9 and x[5] > 1e-3]
    close([x[:2] + x[3:] for x in moving(straight)], [x[:2] + x[3:] for x in moving(cubics)])  # steps may tie


def test_closest_events_are_the_first_of_all(spark, monkeypatch):
    from orbitfold.operators import conjunctions as conj
    from orbitfold.plans import orbit_queries as oq

    best = conj.find_closest(oq.line_rows(spark, SF), oq.LINE_TIMES, 30, 175.0, orbits=False, made=oq.made_lines(), digits=-1).collect()
    every = conj.find_conjunctions(oq.line_rows(spark, SF), oq.LINE_TIMES, 175.0, orbits=False, made=oq.made_lines(), columns={"id_a": None, "id_b": None, "miss_km": -1})
    assert best == every.orderBy("miss_km", "id_a", "id_b").limit(30).select("id_a", "id_b", "miss_km").collect() and len({x["miss_km"] for x in best}) < 30


@pytest.mark.parametrize(("name", "sf"), [("c1_scored_events", SF), ("g6_sweep_catalog", SF.replace("sf0.001", "sf0.01"))])
def test_events_of_many_objects_are_not_shuffled(spark, monkeypatch, name, sf):
    from orbitfold.operators import conjunctions as conj

    want = sorted(map(tuple, QUERIES[name](spark, sf).collect()))
    monkeypatch.setattr(conj, "FEW", 10)
    many = QUERIES[name](spark, sf)
    after = plan(many).split("MapInArrow")[0]
    assert "Exchange" not in after and "Join" not in after
    assert sorted(map(tuple, many.collect())) == want and want


def test_windows_are_rounded_where_they_are_made(spark):
    assert "round(" not in plan(QUERIES["w1_conjunction_windows"](spark, SF))


@pytest.mark.parametrize("seconds", [(0, 60, 120, 180, 240, 300), (0, 60, 120, 150, 240, 300)])
def test_windows_of_straight_tracks_have_the_runs_of_their_samples(monkeypatch, seconds):
    from orbitfold.operators import conjunctions as conj

    rng, times = np.random.default_rng(5), [k * 1_000_000 for k in seconds]
    x, u = 7000 + rng.integers(-6, 7, (300, 3)) * 5.0, rng.integers(-1, 2, (300, 3)) / 4  # many samples are 15 km apart
    ids, p = [str(k) for k in range(300)], x[:, None] + u[:, None] * np.array(seconds, float)[:, None]
    in_one_process(monkeypatch, (ids, p, np.repeat(u[:, None], 6, 1)))
    columns = {"id_a": None, "id_b": None, "entry_s": 2, "tca_s": None, "exit_s": 2}
    found = {r[:2]: r[2:] for r in conj.find_windows(None, times, 15.0, columns=columns)}
    d = ((p[:, None] - p) ** 2).sum(3)
    assert (d == 225).sum() > 1000
    near = {tuple(sorted((ids[i], ids[j]))): np.array(seconds)[d[i, j] < 225] for i in range(300) for j in range(i) if (d[i, j] < 225).any()}
    assert found.keys() == near.keys()
    for k, (entry, tca, leave) in found.items():
        at, before, after = near[k], max([s for s in seconds if s < near[k][0]], default=0), min([s for s in seconds if s > near[k][-1]], default=300)
        assert before <= entry <= at[0] and at[-1] <= leave <= after and entry - 0.01 <= tca <= leave + 0.01
