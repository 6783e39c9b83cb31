"""Geometry, probability, messages and sessions against known values and independent computations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitfold.functions import geometry as g
from orbitfold.operators import burns, passes
from orbitfold.sources import cdm
from orbitfold.streaming import sessions


def one(spark, values, stages, *names):
    df = spark.createDataFrame([tuple(map(float, values.values()))], list(values))
    return g.extend(df, stages).select(*names).first()


def meeting(miss, speed, sigmas):
    c = {k: 0.0 for k in ("cxx", "cxy", "cxz", "cyy", "cyz", "czz")}
    for axis, s in zip("xyz", zip(*sigmas, strict=True), strict=True):
        c[f"c{axis}{axis}"] = sum(v * v for v in s)
    return {**dict(zip(("mx", "my", "mz"), miss, strict=True)), **dict(zip(("ux", "uy", "uz"), speed, strict=True)), **c}


@pytest.mark.parametrize(
    "miss, speed, sigmas, radius, m2, pc",
    [((2, 0.1, 0.05), (0, 0.01, 7.5), ((0.5, 1.5, 0.8), (0.6, 2, 1)), 0.015, 6.558975, 2.169125e-06), ((0.05, 0, 0), (0, 0, 11.6), ((0.01, 0.03, 0.02),) * 2, 0.02, 12.5, 6.434847e-04)],
)
def test_probability_of_known_meetings(spark, miss, speed, sigmas, radius, m2, pc):
    r = one(spark, meeting(miss, speed, sigmas), g.collision_probability(f"{radius}e0"), "m2", "pc")
    assert math.isclose(r["m2"], m2, rel_tol=1e-4) and math.isclose(r["pc"], pc, rel_tol=1e-4)


def test_probability_over_the_disk(spark):
    r = one(spark, meeting((0.05, 0.02, 0), (0, 0, 9), ((0.06, 0.04, 0.1),)), g.collision_probability("0.03e0"), "pc")
    t = np.linspace(-0.03, 0.03, 2001)
    x, y = np.meshgrid(t, t)
    density = np.exp(-((x - 0.05) ** 2 / 0.0036 + (y - 0.02) ** 2 / 0.0016) / 2) / (2 * np.pi * 0.06 * 0.04)
    assert math.isclose(r["pc"], (density * (x * x + y * y <= 0.0009)).sum() * (t[1] - t[0]) ** 2, rel_tol=2e-3)


def test_probability_special_cases(spark):
    none = ((0, 0, 0),)
    pc = lambda miss, speed, s: one(spark, meeting(miss, speed, s), g.collision_probability("0.01e0"), "pc")["pc"]
    assert pc((0.005, 0, 0), (0, 0, 7), none) == 1.0 and pc((0.015, 0, 0), (0, 0, 7), none) == 0.0
    assert pc((1, 0, 0), (0, 0, 0), ((1, 1, 1),)) == 0.0
    assert pc((1, 0, 0), (0, 0, 7), ((1, 0, 1),)) is None


def test_gravity_is_the_gradient(spark):
    def potential(p):
        r = np.linalg.norm(p)
        s, u = p[2] / r, 1.0
        for n, j in g.ZONAL.items():
            u -= float(j) * (6378.137 / r) ** n * np.polynomial.legendre.Legendre.basis(n)(s)
        return 398600.4418 / r * u

    p = np.array([5000.0, 3000.0, 4000.0])
    r = one(spark, dict(zip("xyz", p, strict=True)), g.gravity(), "ax", "ay", "az")
    for k, got in enumerate(r):
        d = np.zeros(3)
        d[k] = 0.5
        assert math.isclose(got, float(potential(p + d) - potential(p - d)), rel_tol=1e-7)


def test_vincenty_known_distances(spark):
    for (a, b, c, d), want in {(0, 0, 0, 1): 111.319491, (0, 0, 90, 0): 10001.965729, (10, 20, 10, 20): 0.0}.items():
        r = one(spark, {"a": a, "b": b, "c": c, "d": d}, g.vincenty("a", "b", "c", "d"), "dist_km")
        assert abs(r["dist_km"] - want) < 1e-5


def textbook_vincenty(lat1, lon1, lat2, lon2):
    """Distance and rounds, or None."""
    a, fl = 6378.137, 1 / 298.257223563
    b, span = a * (1 - fl), math.radians(lon2 - lon1)
    u, v = (math.atan((1 - fl) * math.tan(math.radians(x))) for x in (lat1, lat2))
    lam = span
    for n in range(1, 201):
        ss = math.hypot(math.cos(v) * math.sin(lam), math.cos(u) * math.sin(v) - math.sin(u) * math.cos(v) * math.cos(lam))
        cs = math.sin(u) * math.sin(v) + math.cos(u) * math.cos(v) * math.cos(lam)
        sg, sa = math.atan2(ss, cs), math.cos(u) * math.cos(v) * math.sin(lam) / ss
        ca = 1 - sa * sa
        cm, c = cs - 2 * math.sin(u) * math.sin(v) / ca, fl / 16 * ca * (4 + fl * (4 - 3 * ca))
        lam, old = span + (1 - c) * fl * sa * (sg + c * ss * (cm + c * cs * (2 * cm * cm - 1))), lam
        if abs(lam - old) < 1e-12:
            q = ca * (a * a - b * b) / (b * b)
            p, w = 1 + q / 16384 * (4096 + q * (-768 + q * (320 - 175 * q))), q / 1024 * (256 + q * (-128 + q * (74 - 47 * q)))
            return b * p * (sg - w * ss * (cm + w / 4 * (cs * (2 * cm * cm - 1) - w / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))), n
    return None


def test_vincenty_of_slow_pairs(spark):
    pairs = [(10, 0, -9, 178.5), (45, 0, -44, 179), (0.5, 0, 0.2, 178.9), (51.5, 0.1, -33.9, 151.2)]
    df = spark.createDataFrame([tuple(map(float, p)) for p in pairs], "a double, b double, c double, d double")
    for r in g.extend(df, g.vincenty("a", "b", "c", "d")).select("a", "b", "c", "d", "dist_km").collect():
        want, _ = textbook_vincenty(*r[:4])
        assert abs(r["dist_km"] - want) < 1e-6
    assert textbook_vincenty(*pairs[0])[1] > 12 and textbook_vincenty(*pairs[2])[1] > 20
    assert textbook_vincenty(0, 0, 0.3, 179.7) is None
    far = one(spark, {"a": 0, "b": 0, "c": 0.3, "d": 179.7}, g.vincenty("a", "b", "c", "d"), "dist_km")["dist_km"]
    assert math.isclose(far, 6371 * math.acos(math.cos(math.radians(0.3)) * math.cos(math.radians(179.7))), rel_tol=1e-9)


def test_elements_of_special_orbits(spark):
    v = math.sqrt(398600.4418 / 7000)
    names = ("el_a", "el_e", "el_i", "el_raan", "el_argp", "el_nu")
    state = lambda r, w: dict(zip(("x", "y", "z", "vx", "vy", "vz"), (*r, *w), strict=True))
    assert one(spark, state((7000, 0, 0), (0, v, 0)), g.elements(1e-8), *names) == pytest.approx((7000, 0, 0, 0, 0, 0), abs=1e-6)
    assert one(spark, state((0, 7000, 0), (0, 0, v)), g.elements(1e-8), *names) == pytest.approx((7000, 0, 90, 90, 0, 0), abs=1e-6)
    a, e, i, raan, argp, nu = one(spark, state((7000, 0, 0), (0, 0.8 * v * 1.1, 0.6 * v * 1.1)), g.elements(), *names)
    assert (a, e, i, nu) == pytest.approx((7000 / 0.79, 0.21, math.degrees(math.acos(0.8)), 0), abs=1e-4) and argp % 360 == pytest.approx(0, abs=1e-6) and raan == 0
    assert one(spark, state((7000, 0, 0), (1, 0, 0)), g.RTN, "n_x")["n_x"] is None


def test_shadow(spark):
    lit = lambda x, y: one(spark, {"x": x, "y": y, "z": 0, "sx": 149597870.7, "sy": 0, "sz": 0}, g.illumination(), "nu")["nu"]
    assert lit(7000, 0) == 1.0 and lit(-7000, 0) == 0.0 and lit(0, 7000) == 1.0
    assert 0 < lit(-7000, 6378.137) < 1
    annular = 1 - (math.asin(6378.137 / 2e6) / math.asin(695700 / (149597870.7 + 2e6))) ** 2
    assert math.isclose(lit(-2e6, 0), annular, rel_tol=1e-9)


def test_cdm_round_trip_and_reasons(spark):
    thing = lambda n, c: (n, f"SAT {n}", [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], c)
    schema = "message_id string, creation string, tca string, miss_m double, speed_m_s double, pc double, " + ", ".join(f"object_{k} struct<designator: string, name: string, state: array<double>, covariance: array<double>>" for k in (1, 2))
    a, b = [1e-4 * (k + 1) for k in range(21)], [5e-3] * 21
    given = spark.createDataFrame([("m", "2024-01-01T00:00:00.000Z", "2024-01-02T00:00:00.000Z", 520.0, 14500.0, 1.23e-5, thing("A", a), thing("B", b))], schema)
    text = cdm.export_kvn(given, "X").first()["kvn"]
    r = cdm.parse_kvn(spark.createDataFrame([(text,)], "kvn string")).first()
    assert r["reason"] is None and (r["miss_m"], r["speed_m_s"], r["pc"]) == (520.0, 14500.0, 1.23e-5)
    assert r["object_1"]["covariance"] == pytest.approx(a) and r["object_2"]["covariance"] == pytest.approx(b) and r["object_2"]["designator"] == "B"
    bad = {"MISSING_TCA": text.replace("TCA ", "TCX ", 1), "BAD_NUMBER": text.replace("520.0000", "far"), "BOUNDS_VIOLATION": text.replace("520.0000", "-1"), "MISSING_CREATION_DATE": None}
    out = cdm.parse_kvn(spark.createDataFrame(list(bad.items()), "want string, kvn string")).collect()
    assert all(x["want"] == x["reason"] for x in out)


def test_burn_checks_and_passes(spark):
    rows = [("DURATION", 0, 1, 300, 1, 100), ("THRUST", 1, 0, 300, 1, 100), ("ISP", 1, 1, 0, 1, 100), ("DIRECTION", 1, 1, 300, 2, 100), ("MASS", 1e6, 10, 300, 1, 100), (None, 10, 10, 300, 1, 100)]
    df = spark.createDataFrame([(w, *map(float, r), 0.0, 0.0) for w, *r in rows], "want string, duration_s double, thrust double, isp double, dx double, mass double, dy double, dz double")
    assert all(x["want"] == x["reason"] for x in burns.validate(df).collect())
    looks = spark.createDataFrame([(1, k, v) for k, v in enumerate((-5.0, 12.0, 35.0, 20.0, -2.0, -8.0, -10.0))], "id int, step int, elevation double")
    assert [tuple(x) for x in passes.passes(looks, "id", "step", 10.0).select("first", "last", "n", "best", "max_elevation").collect()] == [(1, 3, 3, 2, 35.0)]


def test_sessions_and_first_updates_on_a_stream(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:05:00"), ("a", "2024-01-01 02:00:00"), ("z", "2024-01-03 00:00:00")]
    spark.createDataFrame(rows, "k string, s string").select("k", F.col("s").cast("timestamp").alias("t")).write.parquet(str(tmp_path / "in"))

    def result(name, make):
        stream = spark.readStream.schema("k string, t timestamp").parquet(str(tmp_path / "in"))
        q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    closed = result("closed_sessions", lambda s: sessions.sessions(s, "k", "t", "10 minutes", "0 seconds"))
    assert sorted(r["n"] for r in closed.where("k = 'a'").collect()) == [1, 3]
    assert result("first_updates", lambda s: sessions.first_updates(s, ["k", "t"], "t")).count() == 4
