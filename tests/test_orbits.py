"""Propagation, conjunctions, passes, numerical orbits and files against published vectors, brute force and invariants."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitfold.errors import EngineConfig, InvalidElementsError, LookupFailed, OrbitError, PropagationError, SpaceWeatherError
from orbitfold.kernels import approach, cowell, frames, sgp4
from orbitfold.operators import conjunctions as conj
from orbitfold.operators import numerical, propagation, visibility
from orbitfold.plans import orbit_queries as oq
from orbitfold.sources import catalogs, cdm_xml, environment, ephemerides

STRICT, RELAXED = EngineConfig(), EngineConfig(strict=False)
START = 2460324.5


def elements(spark, n, seed=1, low=500.0, high=560.0):
    r = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        a = 6378.137 + r.uniform(low, high)
        rows.append((str(k), 1_705_276_800_000_000, *map(float, (math.radians(r.uniform(40, 100)), r.uniform(0, 6.28), r.uniform(0, 0.002), r.uniform(0, 6.28), r.uniform(0, 6.28), math.sqrt(398600.8 / a**3) * 60, 1e-5))))
    return spark.createDataFrame(rows, "id string, epoch_us long, i double, node double, e double, argp double, m double, n double, bstar double")


def kernel(rows):
    return sgp4.Satellites(2440587.5 + np.array([r["epoch_us"] for r in rows]) / 86_400e6, *(np.array([r[c] for r in rows]) for c in propagation.FIELDS))


def test_published_vectors(spark):
    got = {(r["id"], r["minutes"]): r for r in oq.QUERIES["g2_published_vectors"](spark, None).collect()}
    for v in oq.VECTORS:
        assert all(math.isclose(got[v[0], v[1]][c], w, abs_tol=1e-4) for c, w in zip(propagation.STATE, v[2:], strict=True))


def test_errors_of_propagation(spark):
    e = elements(spark, 2).union(spark.createDataFrame([("low", 1_705_276_800_000_000, 0.9, 0.0, 0.0, 0.0, 0.0, 0.0757, 1e-2)], elements(spark, 1).schema))
    s = propagation.propagate(e, propagation.us_of_jd(START), 30, 864_000_000 * 10)
    bad = s.where("error_code > 0").collect()
    assert bad and {r["id"] for r in bad} == {"low"} and all(math.isnan(r["x"]) for r in bad)
    good = propagation.finite_only(s)
    assert {r["id"] for r in good.select("id").distinct().collect()} == {"0", "1"} and good.count() == 60
    with pytest.raises(PropagationError):
        propagation.finite_only(s, strict=True)
    tracks = {r["id"]: r for r in propagation.tracks(e, propagation.us_of_jd(START), 30, 864_000_000 * 10).collect()}
    assert not tracks["low"]["good"] and len(tracks["0"]["p"]) == 90
    assert propagation.propagate(e, 0, 0, 1).count() == 0 and propagation.propagate(e.limit(0), 0, 5, 1).count() == 0


def test_chunks_and_batches_agree(spark):
    e = elements(spark, 5)
    a = {(r["id"], r["step"]): r for r in propagation.propagate(e, propagation.us_of_jd(START), 50, 60_000_000, chunk=7).collect()}
    b = {(r["id"], r["step"]): r for r in propagation.propagate(e, propagation.us_of_jd(START), 50, 60_000_000).collect()}
    assert a == b and len(a) == 250
    one = propagation.propagate_at(e.withColumn("t_us", F.lit(propagation.us_of_jd(START) + 49 * 60_000_000))).collect()
    assert all(math.isclose(r["x"], b[r["id"], 49]["x"], abs_tol=1e-9) for r in one)
    two = e.where("id = '3'").withColumn("ordinal", F.lit(1)).union(e.where("id = '3'").withColumn("e", F.lit(0.5)).withColumn("ordinal", F.lit(2)))
    assert [r["e"] for r in propagation.last_by_id(two, "ordinal").collect()] == [0.5]


def dense_minimum(rows, a, b, t0, span, step=0.05):
    """Least distance of two orbits by SGP4 every so many seconds, then finer around it."""
    s = kernel([rows[a], rows[b]])
    at = np.arange(0, span, 2.0)
    d = lambda t: np.linalg.norm(np.diff(s.at((t0 - 1_705_276_800_000_000) / 60e6 + t / 60)[0], axis=0)[0], axis=1)
    k = at[d(at).argmin()]
    fine = np.arange(k - 3, k + 3, step)
    return d(fine).min()


def test_sweep_equals_brute_force(spark, monkeypatch):
    """200 orbits in one shell, chunks of 37: the same pairs and distances as SGP4 of all pairs, two seconds apart."""
    monkeypatch.setattr(conj, "CHUNK", 37)
    e = elements(spark, 200)
    rows, t0, n, step = e.collect(), *conj.sweep_grid(START, START + 1 / 24, 1.0)
    got = {(r["id_a"], r["id_b"]): r for r in conj.sweep(e, START, START + 1 / 24, 1.0, 15.0).collect()}
    t = np.arange(0, (n - 1) * step / 1e6 + 1, 2.0)
    p = kernel(rows).at((t0 - 1_705_276_800_000_000) / 60e6 + t / 60)[0]
    want = set()
    for i in range(200):
        d = np.linalg.norm(p[i + 1 :] - p[i], axis=2).min(1)
        want |= {tuple(sorted((str(i), str(i + 1 + j)))) for j in np.flatnonzero(d <= 30)}
    index = {r["id"]: k for k, r in enumerate(rows)}
    exact = {x: dense_minimum(rows, index[x[0]], index[x[1]], t0, (n - 1) * step / 1e6) for x in want}
    near = {x for x, d in exact.items() if d <= 15.0 - 0.05}
    assert near and near <= set(got) and all(exact.get(x, 0) <= 15.05 for x in got)
    # a pair that meets several times has its event at the closest sample, which need not be its closest meeting
    assert sum(abs(got[x]["miss_km"] - exact[x]) < 0.02 for x in near) >= 0.9 * len(near)


def test_deterministic_contract(spark):
    """Two lines that cross: miss 2.5 km, relative speed 2 km/s, one event, whatever the partitions; far ones give none."""
    t = [1_700_000_000_000_000 + k * 1_000_000 for k in range(121)]
    line = lambda s, y: [c for k in range(121) for c in (s * (k - 60.0), y, 6771.0)]
    rows = [("99999", line(-1, 2.5), [-1.0, 0.0, 0.0] * 121, True), ("25544", line(1, 0.0), [1.0, 0.0, 0.0] * 121, True), ("bad", line(1, 0.1), None, False), ("far", [c + 20000 for c in line(1, 0.0)], [1.0, 0.0, 0.0] * 121, True)]
    df = spark.createDataFrame(rows, "id string, p array<double>, v array<double>, good boolean")
    for parts in (1, 4):
        e = conj.find_conjunctions(df.repartition(parts), t, 5.0, orbits=False)
        (r,) = e.collect()
        assert (r["id_a"], r["id_b"]) == ("25544", "99999") and math.isclose(r["miss_km"], 2.5, abs_tol=1e-6) and math.isclose(r["speed_km_s"], 2.0)
        assert abs(r["tca_us"] - t[60]) < 1000
    objects = spark.createDataFrame([("25544", t[0]), ("99999", t[0])], "id string, epoch_us long")
    cov = objects.select("id", F.expr("array(1e-4, 0e0, 0e0, 0e0, 1e-4, 0e0, 0e0, 0e0, 1e-4)").alias("cov"))
    (s,) = conj.score(e, objects, cov).collect()
    assert s["source"] == "CDM" and s["pc"] is not None and s["risk"] == "LOW"
    (s,) = conj.score(e, objects).collect()
    assert s["source"] == "UNAVAILABLE" and s["pc"] is None and s["risk"] == "UNKNOWN"
    old = objects.withColumn("epoch_us", F.col("epoch_us") - 20 * 86_400_000_000)
    (s,) = conj.score(e, old, heuristic=True).collect()
    assert s["source"] == "SYNTHETIC" and s["pc"] > 0
    assert [x["id"] for x in conj.missing_objects(e, objects.limit(1)).collect()] in (["99999"], ["25544"])
    assert conj.score(e, objects.limit(1)).count() == 0
    assert conj.find_conjunctions(df.limit(0), t, 5.0).count() == 0


def test_window_that_opens_and_closes_twice(spark):
    t = np.arange(0, 300.0, 10.0)
    d = 20 + 15 * np.cos(t / 25)
    still, move = np.zeros((30, 3)) + [7000, 0, 0], np.stack([7000 + d, 0 * t, 0 * t], 1)
    v = [np.zeros((30, 3)), np.stack([-15 / 25 * np.sin(t / 25), 0 * t, 0 * t], 1)]
    rows = [(n, p.reshape(-1).tolist(), w.reshape(-1).tolist(), True) for n, p, w in zip("ab", (still, move), v, strict=True)]
    times = [int(x * 1e6) for x in t]
    got = conj.find_windows(spark.createDataFrame(rows, "id string, p array<double>, v array<double>, good boolean"), times, 10.0).orderBy("entry_us").collect()
    edge = 25 * math.acos(-10 / 15)
    assert len(got) == 2
    for r, centre in zip(got, (25 * math.pi, 75 * math.pi), strict=True):
        assert abs(r["entry_us"] / 1e6 - (centre - (25 * math.pi - edge))) < 0.05 and abs(r["exit_us"] / 1e6 - (centre + (25 * math.pi - edge))) < 0.05
        assert abs(r["tca_us"] / 1e6 - centre) < 0.05 and abs(r["miss_km"] - 5) < 1e-3


def test_spline_slopes_are_natural():
    r = np.random.default_rng(0)
    t, p = np.sort(r.uniform(0, 10, 9)), r.uniform(-1, 1, (4, 9, 3))
    s, h = approach.spline_slopes(t, p), np.diff(t)
    second = lambda k, end: (6 * (p[:, k + 1] - p[:, k]) / h[k] - (4 * s[:, k] + 2 * s[:, k + 1])) / h[k] if not end else -(6 * (p[:, k + 1] - p[:, k]) / h[k] - (2 * s[:, k] + 4 * s[:, k + 1])) / h[k]
    assert np.allclose(second(0, False), 0) and np.allclose(second(7, True), 0)
    assert all(np.allclose(second(k, True), second(k + 1, False)) for k in range(7))


def test_envelopes_equal_brute_force(spark):
    e = elements(spark, 40, low=400, high=30000)
    t = propagation.tracks(e, propagation.us_of_jd(START), 6, 60_000_000)
    rows = {r["id"]: np.array(r["p"]).reshape(6, 3) for r in t.collect()}
    want = set()
    for a, b in itertools.combinations(sorted(rows), 2):
        c = [rows[x].mean(0) for x in (a, b)]
        away = [np.linalg.norm(rows[x] - m, axis=1).max() for x, m in zip((a, b), c, strict=True)]
        if np.linalg.norm(c[0] - c[1]) <= 500 + sum(away):
            want.add((a, b))
    assert {(r["id_a"], r["id_b"]) for r in conj.candidate_pairs(t, 6, 500.0).collect()} == want


def test_passes_equal_dense_sampling(spark, monkeypatch):
    monkeypatch.setattr(visibility, "OBSERVERS", 2)
    e = elements(spark, 6)
    rows = e.collect()
    stations = [("x", 12.97, 77.59, 0.92, 10.0), ("y", -35.0, 149.0, 0.5, 5.0), ("pole", 89.0, 0.0, 0.0, 20.0)]
    got = visibility.predict_passes(e, spark.createDataFrame(stations, "name string, lat double, lon double, height_km double, mask_deg double"), START, START + 0.5, 1.0).collect()
    t = np.arange(0, 43200.0, 1.0)
    us = propagation.us_of_jd(START) + (t * 1e6).astype(np.int64)
    pos = kernel(rows).at((us - 1_705_276_800_000_000) / 60e6)[0]
    ecef = frames.teme_to_ecef(pos, frames.jd_of_us(us))
    n = 0
    for k, r in enumerate(rows):
        for name, lat, lon, h, mask in stations:
            el, _ = frames.look(ecef[k], frames.observer(lat, lon, h))
            edge = np.diff(np.pad((el >= mask).astype(int), 1))
            own = sorted((x for x in got if x["id"] == r["id"] and x["observer"] == name), key=lambda x: x["aos_us"])
            for a, z in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1, strict=True):
                if z - a < 130 or a == 0 or z == len(t) - 1:
                    continue  # shorter than two steps, or cut off by the ends
                x = next(x for x in own if abs(x["aos_us"] - us[a]) < 2e6)
                assert abs(x["los_us"] - us[z]) < 2e6 and el[a : z + 1].max() - x["max_elevation"] < 20 and abs(x["duration_s"] - (z - a)) < 3
                n += 1
    assert n > 5
    assert visibility.predict_passes(e, spark.createDataFrame([], "name string, lat double, lon double, height_km double, mask_deg double"), START, START + 0.1).count() == 0


def test_light(spark):
    sun = np.array([1.5e8, 0.0, 0.0])
    r = np.array([[7000.0, 0, 0], [-7000.0, 0, 0], [0, 7000.0, 0], [-7000.0, 6378.0, 0]])
    assert frames.sunlit(r, sun).round(2).tolist()[:3] == [1, 0, 1] and 0 < frames.sunlit(r, sun)[3] < 1


# ---------------------------------------------------------------- numerical orbits


def state(a=7000.0, i=0.9):
    v = math.sqrt(398600.4418 / a)
    return np.array([a, 0, 0, 0, v * math.cos(i), v * math.sin(i)])


def test_integrator_and_forces():
    circle = lambda t, y: np.concatenate([y[3:], -398600.4418 * y[:3] / np.linalg.norm(y[:3]) ** 3])
    period = 2 * math.pi * math.sqrt(7000**3 / 398600.4418)
    assert np.allclose(cowell.integrate(circle, 0, state(), period, 1e-11, 1e-11), state(), atol=1e-6)
    assert np.allclose(cowell.integrate(circle, 0, cowell.integrate(circle, 0, state(), 5000, 1e-11, 1e-11), -5000 + 5000, 1e-11, 1e-11), cowell.integrate(circle, 0, state(), 5000, 1e-11, 1e-11))
    f = cowell.Forces(START)
    there = cowell.integrate(cowell.derivative(f), 0, state(), 4000, 1e-11, 1e-11)
    assert np.allclose(cowell.integrate(cowell.derivative(f), 4000, there, 0, 1e-11, 1e-11), state(), atol=1e-5)
    assert np.allclose(cowell.density(np.array([150.0, 400.0, 99.9])), [2.180568e-07, 3.697213e-12, 0], rtol=1e-6)
    drag = cowell.Forces(START, cowell.Drag(area_m2=100, mass_kg=100))
    slow, _, _ = cowell.propagate(state(6678), np.array([0.0, 6000.0]), drag)
    free, _, _ = cowell.propagate(state(6678), np.array([0.0, 6000.0]), f)
    energy = lambda y: y[3:] @ y[3:] / 2 - 398600.4418 / np.linalg.norm(y[:3])
    assert energy(slow[1]) < energy(free[1]) and np.allclose(slow[0], state(6678))
    far = cowell.Forces(START, cowell.Drag(srp=True, cd=0), True, cowell.Ephemeris(START, 1))
    assert 1e-4 < np.linalg.norm(cowell.propagate(state(), np.array([6000.0]), far)[0][0] - cowell.propagate(state(), np.array([6000.0]), f)[0][0]) < 1


def test_transition_and_covariance(spark):
    f, y = cowell.Forces(START), state()
    end, phi = cowell.transition(y, 1200, f)
    for k in range(6):
        d = np.zeros(6)
        d[k] = 1e-3 if k < 3 else 1e-6
        up, down = (cowell.integrate(cowell.derivative(f), 0, y + s * d, 1200, 1e-12, 1e-12) for s in (1, -1))
        assert np.allclose((up - down) / (2 * d[k]), phi[:, k], rtol=2e-4, atol=2e-4 * np.abs(phi[:, k]).max())
    assert math.isclose(np.linalg.det(phi), 1, rel_tol=1e-5)
    c = np.diag([1e-2] * 3 + [1e-8] * 3)
    rows = [("a", START, *y.tolist(), c.reshape(-1).tolist()), ("b", START, *y.tolist(), [float("nan")] * 36)]
    schema = "id string, epoch_jd double, x double, y double, z double, vx double, vy double, vz double, cov array<double>"
    got = {r["id"]: r for r in numerical.propagate_covariance(spark.createDataFrame(rows, schema), 1200.0, 1e-12).collect()}
    assert np.allclose(np.array(got["a"]["cov"]).reshape(6, 6), phi @ c @ phi.T + cowell.process_noise(1e-12, 1200), rtol=1e-6) and got["b"]["error"]


def test_burns_and_strict_mode(spark):
    schema = "id string, epoch_jd double, x double, y double, z double, vx double, vy double, vz double, mass_kg double, burns array<struct<start_s:double,duration_s:double,thrust_n:double,isp_s:double,direction:array<double>,frame:string>>"
    burn = (100.0, 200.0, 500.0, 300.0, [1.0, 0.0, 0.0], "VNB")
    df = spark.createDataFrame([("up", START, *state().tolist(), 1000.0, [burn]), ("none", START, *state().tolist(), None, [burn]), ("coast", START, *state().tolist(), None, None)], schema)
    got = numerical.propagate(df, 400.0, 50.0).collect()
    up = [r for r in got if r["id"] == "up"]
    flow = 500 / (300 * 9.80665)
    assert len(up) == 9 and math.isclose(up[-1]["mass_kg"], 1000 - 200 * flow) and [r["powered"] for r in up] == [False] * 3 + [True] * 4 + [False] * 2
    speed = lambda r: math.sqrt(r["vx"] ** 2 + r["vy"] ** 2 + r["vz"] ** 2)
    coast = [r for r in got if r["id"] == "coast"]
    assert 0.05 < speed(up[-1]) - speed(coast[-1]) < 0.15 and coast[-1]["mass_kg"] is None
    assert [r["error"] for r in got if r["id"] == "none"] == ["MASS"]
    with pytest.raises(PropagationError):
        numerical.propagate(df, 400.0, 50.0, config=STRICT)
    assert cowell.timeline(10, [cowell.Burn(-5, 7, 1, 1, (1, 0, 0)), cowell.Burn(8, 9, 1, 1, (1, 0, 0))])[1][:2] == (2, 8)


def test_monte_carlo_agrees_with_the_plane(spark):
    """Against the density over the disk, for a fast meeting; and on relative orbits for a slow one."""
    cov = (np.eye(3) * 0.01).reshape(-1).tolist()
    rows = [("a", "b", [0.05, 0.0, 0.1], [0.0, 7.0, 0.0], cov, cov, 0.1, None), ("a", "c", [0.0, 0.1, 0.0], [0.0, 0.0, 1e-6], cov, cov, 0.1, 0.0011), ("x", "y", [0.0] * 3, [0.0] * 3, cov, [0.0] * 36, 0.1, None), ("x", "z", [0.0] * 3, [0.0] * 3, cov, cov, -1.0, None)]
    df = spark.createDataFrame(rows, "id_a string, id_b string, miss array<double>, speed array<double>, cov_a array<double>, cov_b array<double>, radius_km double, mean_motion double")
    got = {(r["id_a"], r["id_b"]): r["pc_mc"] for r in numerical.monte_carlo(df, 200_000).collect()}
    assert got == {(r["id_a"], r["id_b"]): r["pc_mc"] for r in numerical.monte_carlo(df.repartition(3), 200_000).collect()}
    t = np.linspace(-0.1, 0.1, 401)
    x, z = np.meshgrid(t, t)
    want = (np.exp(-((x - 0.05) ** 2 + (z - 0.1) ** 2) / 0.04) / (2 * np.pi * 0.02) * (x * x + z * z <= 0.01)).sum() * (t[1] - t[0]) ** 2
    assert abs(got["a", "b"] - want) < 0.005 and 0 < got["a", "c"] < 1 and got["x", "y"] is None and got["x", "z"] is None
    singular = np.diag([1.0, 0.0, 0.0])
    assert np.allclose(cowell.root(singular) @ cowell.root(singular).T, singular)


# ---------------------------------------------------------------- files and messages


def test_loading_strict_and_relaxed(spark):
    good = [x for pair in oq.VECTOR_LINES[:2] for x in ("0 NAME", *pair)]
    lines = lambda xs: spark.createDataFrame([("f", k, x) for k, x in enumerate(xs)], "file string, lineno long, line string")
    assert catalogs.load_tle(lines(good)).count() == 2
    bad = [*good, "1 00005U 58002B", oq.VECTOR_LINES[0][1], "orphan"]
    with pytest.raises(InvalidElementsError):
        catalogs.load_tle(lines(bad), STRICT)
    assert catalogs.load_tle(lines(bad), RELAXED).count() == 2
    with pytest.raises(InvalidElementsError):
        catalogs.load_tle(lines(bad[6:]), RELAXED)
    assert catalogs.load_tle(lines([]), STRICT).count() == 0
    payloads = spark.createDataFrame([("a", "{}"), ("b", None), ("c", "[]"), ("d", '[{"OBJECT_NAME": "X"}]')], "file string, text string")
    assert {(r["file"], r["reason"]) for r in catalogs.parse_omm_payloads(payloads).collect()} == {("a", "NOT_AN_ARRAY"), ("b", "NOT_AN_ARRAY"), ("d", "INVALID")}


def test_files_and_landed_groups(spark, tmp_path):
    tle_text = "\n".join(x for pair in oq.VECTOR_LINES for x in ("0 N", *pair))
    (tmp_path / "gp").mkdir()
    (tmp_path / "sup").mkdir()
    for name, text in (("stations", tle_text), ("visual", "status 503\nbusy"), ("active", "Invalid query"), ("limit", "status 403\n")):
        (tmp_path / "gp" / f"{name}.txt").write_text(text)
    (tmp_path / "sup" / "visual.txt").write_text(tle_text)
    (tmp_path / "sup" / "active.txt").write_text("")
    gp, sup = (catalogs.landed(spark, str(tmp_path / d)) for d in ("gp", "sup"))
    assert catalogs.group(gp, sup, "visual").first()["text"] == tle_text
    for name in ("active", "limit", "unknown"):
        with pytest.raises(LookupFailed):
            catalogs.group(gp, sup, name)
    assert catalogs.comprehensive(gp, sup, "tle", ("stations", "visual", "active"), RELAXED).count() == 4
    with pytest.raises(LookupFailed):
        catalogs.comprehensive(gp, sup, "tle", ("stations", "active"), STRICT)
    assert catalogs.read_tle(spark, str(tmp_path / "gp" / "stations.txt")).count() == 4
    assert catalogs.landed(spark, str(tmp_path / "gp"), 1.0, now_us=2**60).where("fresh").count() == 0
    names = spark.createDataFrame([("STARLINK-1",), ("COSMOS DEB",), ("ISS",)], "n string")
    assert [names.where(catalogs.name_filter(F.col("n"), g)).count() for g in ("starlink", "debris", "active")] == [1, 1, 3]


def test_messages_that_cannot_be_read(spark):
    sv = "<stateVector><EPOCH>{}</EPOCH><X>1</X><Y>{}</Y><Z>3</Z><X_DOT>4</X_DOT><Y_DOT>5</Y_DOT><Z_DOT>6</Z_DOT></stateVector>"
    xml = "<ocm><body><segment><metadata/><data>{}</data></segment></body></ocm>"
    cases = {
        "": "EMPTY", "<ocm/>": "NO_SEGMENT", xml.format(""): "NO_STATES", xml.format(sv.format("never", 2)): "BAD_EPOCH", xml.format(sv.format("2024-01-01", "")): "MISSING_Y", xml.format(sv.format("2024-01-01", "a")): "BAD_NUMBER",
        "EPOCH = 2024-001T00:00:00\nX = 1": "MISSING_Y", "REF_FRAME = TEME": "NO_STATES",
    }
    got = {r["k"]: r["reason"] for r in ephemerides.parse_ocm(spark.createDataFrame([(k, k) for k in cases], "k string, text string")).collect()}
    assert got == cases
    two = xml.format(sv.format("2024-060T12:00:00.5+01:00", 2) + sv.format("2024-01-01T00:00:00Z", 7))
    rows = ephemerides.parse_ocm(spark.createDataFrame([(two,)], "text string")).collect()
    assert [(r["y"], r["t_us"]) for r in rows] == [(7, 1704067200000000), (2, 1709204400500000)]
    stk = {"": "EMPTY", "hello": "NOT_STK", "stk.v.1\nBEGIN Ephemeris\nEphemerisTimePosVel\n1 2 3 4 5 6 7": "MISSING_EPOCH", "stk.v.1\nBEGIN Ephemeris\nScenarioEpoch 1 Jan 2024 00:00:00\nEND Ephemeris": "NO_STATES"}
    assert {r["k"]: r["reason"] for r in ephemerides.parse_stk(spark.createDataFrame([(k, k) for k in stk], "k string, text string")).collect()} == stk


def test_cdm_xml_cases(spark):
    body = "<CDM xmlns:a='u'>{}<a:OBJECT2><OBJECT2_X>9</OBJECT2_X><CR_R>4</CR_R></a:OBJECT2></CDM>"
    cases = {"nothing": "NOT_XML", body.format("<MISS_DISTANCE>-1</MISS_DISTANCE>"): "BOUNDS_VIOLATION", body.format("<MISS_DISTANCE>x</MISS_DISTANCE>"): "BAD_NUMBER", body.format("<TCA>never</TCA>"): "BAD_TIME", body.format("<COLLISION_PROBABILITY>2</COLLISION_PROBABILITY>"): "BOUNDS_VIOLATION", body.format(""): None}
    got = {r["xml"]: r for r in cdm_xml.parse_xml(spark.createDataFrame([(k,) for k in cases], "xml string")).collect()}
    assert {k: r["reason"] for k, r in got.items()} == cases
    r = got[body.format("")]
    assert r["message_id"] == "UNKNOWN" and r["tca_us"] == 0 and r["object_1"]["covariance"] is None and r["object_2"]["covariance"][0] == 4 and r["object_2"]["state"][0] == 9
    flat = "<CDM><OBJECT1_X>1</OBJECT1_X><CR_R>1</CR_R><OBJECT2_X>2</OBJECT2_X><CR_R>3</CR_R></CDM>"
    r = cdm_xml.parse_xml(spark.createDataFrame([(flat,)], "xml string")).first()
    assert r["object_1"]["covariance"][0] == 1 and r["object_2"]["covariance"][0] == 3 and r["object_1"]["state"][0] == 1


def test_environment_strict(spark):
    days = spark.createDataFrame([("2024-01-01",), ("2024-01-05",)], "day string").select(F.col("day").cast("date").alias("day"))
    table = spark.createDataFrame([("2024-01-01", 100.0, 101.0, 7.0)], "date string, f107_obs double, f107_adj double, ap double").withColumn("date", F.col("date").cast("date"))
    with pytest.raises(SpaceWeatherError):
        environment.weather_at(days, "day", [table], STRICT)
    assert {r["ap"] for r in environment.weather_at(days, "day", [table], RELAXED).collect()} == {7.0, 15.0}
    t = spark.createDataFrame([(2460000.0,)], "jd double")
    with pytest.raises(SpaceWeatherError):
        environment.orientation_at(t, "jd", None, STRICT)
    assert environment.orientation_at(t, "jd", None, RELAXED).first()["dut1_s"] == 0
    one = spark.createDataFrame([(60000, 0.1, 0.2, 0.3)], "mjd int, xp_arcsec double, yp_arcsec double, dut1_s double")
    assert environment.orientation_at(t, "jd", one).first()["dut1_s"] == 0.3
    assert str(OrbitError("m", a=1)) == "m (a=1)" and STRICT.relaxed() == RELAXED
