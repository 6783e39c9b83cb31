"""Registered queries of propagation, conjunctions, passes, numerical orbits, messages and environment files.

Their SQL computes the same rows in another way: published vectors, closed forms for straight lines and rotations, or the
numbers that a message was made from. What only iteration gives (SGP4 of a catalog, passes, Cowell) has none; tests hold
these against brute force and invariants.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import EngineConfig
from ..functions import geometry as geo
from ..operators import conjunctions as conj
from ..operators import numerical, propagation, spatial, visibility
from ..sources import catalogs, cdm_xml, environment, ephemerides, tle
from . import synthetic as syn
from .queries import _CAT, _EPH, _PTS, ORACLE_SQL, QUERIES, numbered, query, rounded

RELAXED = EngineConfig(strict=False)

# ---------------------------------------------------------------- SGP4

#: Published verification elements and states (minutes since epoch, km, km/s).
VECTOR_LINES = (
    ("1 00005U 58002B   00179.78495062  .00000023  00000-0  28098-4 0  4753", "2 00005  34.2682 348.7242 1859667 331.7664  19.3264 10.82419157413667"),
    ("1 04632U 70093B   04031.91070959 -.00000084  00000-0  10000-3 0  9955", "2 04632  11.4628 273.1101 1450506 207.6000 143.9350  1.20231981 44145"),
    ("1 08195U 75081A   06176.33215444  .00000099  00000-0  11873-3 0   813", "2 08195  64.1586 279.0717 6877146 264.7651  20.2257  2.00491383225656"),
    ("1 09880U 77021A   06176.56157475  .00000421  00000-0  10000-3 0  9814", "2 09880  64.5968 349.3786 7069051 270.0229  16.3320  2.00813614112380"),
)
VECTORS = (
    ("00005", 0, 7022.46529266, -1400.08296755, 0.03995155, 1.893841015, 6.405893759, 4.534807250),
    ("00005", 360, -7154.03120202, -3783.17682504, -3536.19412294, 4.741887409, -4.151817765, -2.093935425),
    ("00005", 720, -7134.59340119, 6531.68641334, 3260.27186483, -4.113793027, -2.911922039, -2.557327851),
    ("00005", 4320, -9060.47373569, 4658.70952502, 813.68673153, -2.232832783, -4.110453490, -3.157345433),
    ("04632", 0, 2334.11450085, -41920.44035349, -0.03867437, 2.826321032, -0.065091664, 0.570936053),
    ("04632", -5184, -29020.02587128, 13819.84419063, -5713.33679183, -1.768068390, -3.235371192, -0.395206135),
    ("08195", 0, 2349.89483350, -14785.93811562, 0.02119378, 2.721488096, -3.256811655, 4.498416672),
    ("08195", 120, 15223.91713658, -17852.95881713, 25280.39558224, 1.079041732, 0.875187372, 2.485682813),
    ("09880", 0, 13020.06750784, -2449.07193500, 1.15896030, 4.247363935, 1.597178501, 4.956708611),
)
_VALUES = ", ".join(f"('{v[0]}', {', '.join(map(repr, v[1:]))})" for v in VECTORS)


def vector_elements(spark) -> DataFrame:
    return propagation.from_tle(tle.parse(spark.createDataFrame(VECTOR_LINES, "line1 string, line2 string")))


@query("g2_published_vectors", f"SELECT id, CAST(minutes AS BIGINT) AS minutes, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z, round(vx, 6) AS vx, round(vy, 6) AS vy, round(vz, 6) AS vz, 0 AS error_code FROM (VALUES {_VALUES}) v(id, minutes, x, y, z, vx, vy, vz)")
def _g2(spark, sf):
    times = spark.createDataFrame([(v[0], v[1]) for v in VECTORS], "id string, minutes long")
    rows = vector_elements(spark).join(F.broadcast(times), "id")  # nine rows
    states = propagation.propagate_at(rows.withColumn("t_us", F.col("epoch_us") + F.col("minutes") * 60_000_000))
    epochs = vector_elements(spark).select("id", "epoch_us")
    states = states.join(epochs, "id").withColumn("minutes", F.expr("CAST(round((t_us - epoch_us) / 60000000e0) AS BIGINT)"))
    return states.select("id", "minutes", *(F.round(c, 4 if len(c) == 1 else 6).alias(c) for c in propagation.STATE), "error_code")


def catalog_elements(spark, sf) -> DataFrame:
    """The synthetic catalog at its epochs, nearer to circles, so that most of its orbits stay above the ground."""
    c = syn.catalog(spark, sf).withColumns({"eccentricity": F.col("eccentricity") / 10, "epoch_us": F.expr("CAST(round((epoch_jd - 2440587.5e0) * 86400000000e0) AS BIGINT)"), "bstar": F.lit(1e-5)})
    return propagation.from_tle(c)


@query("g3_propagate_catalog")
def _g3(spark, sf):
    """Every object of the catalog at ten times of a day: a checksum of its states, and its error codes."""
    s = propagation.propagate(catalog_elements(spark, sf), propagation.us_of_jd(2460321.5), 10, 144 * 60_000_000)
    return s.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("error_code").alias("worst"), F.round(F.sum(F.expr("CASE WHEN error_code = 0 THEN sqrt(x * x + y * y + z * z) END")), 3).alias("radius_sum"))


@query("g4_propagate_in_chunks")
def _g4(spark, sf):
    s = propagation.propagate(catalog_elements(spark, sf).where("CAST(id AS INT) <= 20"), propagation.us_of_jd(2460321.5), 600, 60_000_000, chunk=100)
    return s.groupBy("id").agg(F.count_distinct("step").alias("n"), F.max("error_code").alias("worst"))


@query("g5_trajectory_grid", _CAT + "SELECT CAST(norad_id AS VARCHAR) AS id, CAST(s AS INTEGER) AS step, 1705276800000000 + s * 420000000 AS t_us FROM c, range(0, 18) r(s) WHERE ordinal <= 50")
def _g5(spark, sf):
    return propagation.trajectory(catalog_elements(spark, sf).where("CAST(id AS INT) <= 50"), 2460324.5, 2460324.5 + 119 / 1440, 7.0).select("id", "step", "t_us")


@query("f6_finite_tracks", _EPH + "SELECT id, count(*) AS n FROM e WHERE id % 7 <> 3 AND id % 11 <> 5 GROUP BY id")
def _f6(spark, sf):
    e = syn.ephemeris(spark, sf).withColumns({"x": F.expr("CASE WHEN id % 7 = 3 AND step = 4 THEN CAST('NaN' AS DOUBLE) ELSE x END"), "z": F.expr("CASE WHEN id % 11 = 5 AND step = 9 THEN NULL ELSE z END")})
    return propagation.finite_only(e).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- conjunctions on straight lines

STEPS, STEP_S, MISS = 24, 60, 175.0
_SPEED = {"vx": "((p_partkey * 31) % 21 - 10) / 10e0", "vy": "((p_partkey * 17) % 23 - 11) / 10e0", "vz": "((p_partkey * 13) % 19 - 9) / 10e0"}
_LINES = f"WITH p AS (SELECT {syn.POINTS}, {', '.join(f'{e} AS {c}' for c, e in _SPEED.items())} FROM part), q AS (SELECT a.id AS id_a, b.id AS id_b, b.x - a.x AS x, b.y - a.y AS y, b.z - a.z AS z, b.vx - a.vx AS vx, b.vy - a.vy AS vy, b.vz - a.vz AS vz FROM p a JOIN p b ON CAST(a.id AS VARCHAR) < CAST(b.id AS VARCHAR)), "
_LINES += f"k AS (SELECT *, vx * vx + vy * vy + vz * vz AS vv, x * vx + y * vy + z * vz AS rv, x * x + y * y + z * z AS rr FROM q), m AS (SELECT *, CASE WHEN vv = 0 THEN 0 ELSE least({(STEPS - 1) * STEP_S}, greatest(0, -rv / vv)) END AS t FROM k), n AS (SELECT *, sqrt(greatest(0, rr + 2 * rv * t + vv * t * t)) AS miss FROM m) "


def line_tracks(spark, sf, velocity: bool = True) -> DataFrame:
    rows = syn.table(spark, sf, "part").select(F.expr("struct(" + syn.POINTS + ", " + ", ".join(f"{e} AS {c}" for c, e in _SPEED.items()) + ")").alias("s")).select("s.*")
    steps = F.sequence(F.lit(0), F.lit(STEPS - 1))
    far = {"x": 20000.0, "y": 0.0, "z": 0.0}  # the centre's place does not change what is near to what
    p = F.flatten(F.transform(steps, lambda k: F.array(*(F.col(c) + far[c] + F.col(f"v{c}") * k * float(STEP_S) for c in "xyz"))))
    v = F.flatten(F.transform(steps, lambda k: F.array("vx", "vy", "vz"))) if velocity else F.lit(None).cast("array<double>")
    return rows.select(F.col("id").cast("string").alias("id"), p.alias("p"), v.alias("v"), F.lit(True).alias("good"))


def line_rows(spark, sf) -> DataFrame:
    """What ``line_tracks`` makes its tracks from."""
    rows = syn.table(spark, sf, "part").select(F.expr("struct(" + syn.POINTS + ", " + ", ".join(f"{e} AS {c}" for c, e in _SPEED.items()) + ")").alias("s"))
    return rows.select(F.col("s.id").cast("string").alias("id"), *(F.col(f"s.{c}").cast("double").alias(c) for c in propagation.STATE))


def made_lines(velocity: bool = True):
    """A function of batches of ``line_rows``: the tracks of ``line_tracks``."""

    def made(b):
        state = np.stack([b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in propagation.STATE], 1)
        start, speed = state[:, None, :3] + np.array([20000.0, 0.0, 0.0]), state[:, None, 3:]
        p = start + speed * np.arange(STEPS)[:, None] * float(STEP_S)
        return p, np.broadcast_to(speed, p.shape) if velocity else None, np.ones(len(p), bool)

    return made


_MISSES = {"id_a": None, "id_b": None, "miss_km": 4, "speed_km_s": 6}
LINE_TIMES = [1_700_000_000_000_000 + k * STEP_S * 1_000_000 for k in range(STEPS)]


@query("c1_conjunctions_of_lines", _LINES + f"SELECT CAST(id_a AS VARCHAR) AS id_a, CAST(id_b AS VARCHAR) AS id_b, round(miss, 4) AS miss_km, round(sqrt(vv), 6) AS speed_km_s FROM n WHERE miss <= {MISS}")
def _c1(spark, sf):
    return conj.find_conjunctions(line_rows(spark, sf), LINE_TIMES, MISS, orbits=False, made=made_lines(), columns=_MISSES)


@query("w3_closest_approach_by_splines", ORACLE_SQL["c1_conjunctions_of_lines"])
def _w3(spark, sf):
    return conj.find_conjunctions(line_rows(spark, sf), LINE_TIMES, MISS, orbits=False, made=made_lines(False), columns=_MISSES)


@query("o1_events_by_miss", _LINES + f"SELECT id_a, id_b, row_number() OVER (ORDER BY miss, CAST(id_a AS VARCHAR), CAST(id_b AS VARCHAR)) AS place FROM (SELECT CAST(id_a AS VARCHAR) AS id_a, CAST(id_b AS VARCHAR) AS id_b, round(miss, 3) AS miss FROM n WHERE miss <= {MISS}) ORDER BY place LIMIT 20")
def _o1(spark, sf):
    from pyspark.sql.window import Window

    best = conj.find_closest(line_rows(spark, sf), LINE_TIMES, 20, MISS, orbits=False, made=made_lines(), digits=3)  # the report's 20 closest events
    return best.withColumn("place", F.row_number().over(Window.orderBy("miss_km", "id_a", "id_b")).cast("long")).select("id_a", "id_b", "place")


_ROOT = f"sqrt(rv * rv - vv * (rr - {MISS * MISS}))"


@query("w1_conjunction_windows", _LINES + f""", s AS (SELECT id_a, id_b, vv, rv, rr, miss, min(k) AS k0, max(k) AS k1 FROM n, range(0, {STEPS}) r(k) WHERE rr + 2 * rv * k * {STEP_S} + vv * k * k * {STEP_S * STEP_S} < {MISS * MISS} GROUP BY ALL)
 SELECT CAST(id_a AS VARCHAR) AS id_a, CAST(id_b AS VARCHAR) AS id_b, round(CASE WHEN k0 = 0 THEN 0 ELSE (-rv - {_ROOT}) / vv END, 2) AS entry_s, round(CASE WHEN k1 = {STEPS - 1} THEN k1 * {STEP_S} ELSE (-rv + {_ROOT}) / vv END, 2) AS exit_s, round(miss, 4) AS miss_km FROM s""")
def _w1(spark, sf):
    return conj.find_windows(line_rows(spark, sf), LINE_TIMES, MISS, made=made_lines(), columns={"id_a": None, "id_b": None, "entry_s": 2, "exit_s": 2, "miss_km": 4})


_ENV = ", m AS (SELECT id, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM e GROUP BY id), v AS (SELECT id, mx, my, mz, max(sqrt((x - mx) * (x - mx) + (y - my) * (y - my) + (z - mz) * (z - mz))) AS away FROM e JOIN m USING (id) GROUP BY id, mx, my, mz) "


@query("j2_candidate_pairs", _EPH.replace("range(24)", "range(4)") + _ENV + "SELECT CAST(a.id AS VARCHAR) AS id_a, CAST(b.id AS VARCHAR) AS id_b FROM v a JOIN v b ON CAST(a.id AS VARCHAR) < CAST(b.id AS VARCHAR) AND sqrt((a.mx - b.mx) * (a.mx - b.mx) + (a.my - b.my) * (a.my - b.my) + (a.mz - b.mz) * (a.mz - b.mz)) <= 50.25 + a.away + b.away")
def _j2(spark, sf):
    return conj.candidate_pairs(propagation.tracks_of(syn.ephemeris(spark, sf).where("step < 4"), velocity=False), 4, 50.25)


@query("o5_pairs_lost_by_a_smaller_reach", _PTS + "SELECT a.id AS id_a, b.id AS id_b FROM p a JOIN p b ON CAST(a.id AS VARCHAR) < CAST(b.id AS VARCHAR) AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) BETWEEN 100.5 * 100.5 AND 150.5 * 150.5")
def _o5(spark, sf):
    return spatial.pairs_between(syn.points(spark, sf), 100.5, 150.5).select("id_a", "id_b")


@query("j4_upsert_and_rebuild", _PTS + "SELECT id, CASE WHEN id % 3 = 0 THEN x + 1 ELSE x END AS x FROM p WHERE id % 10 <> 4")
def _j4(spark, sf):
    p = syn.points(spark, sf)
    bad = p.withColumn("y", F.expr("CASE WHEN id % 10 = 4 THEN CAST('Infinity' AS DOUBLE) ELSE y END"))
    return spatial.rebuild(spatial.upsert(bad, bad.where("id % 3 = 0").withColumn("x", F.col("x") + 1))).select("id", "x")


@query("c1_scored_events", _LINES + f""", o AS (SELECT *, CASE id_a % 3 WHEN 0 THEN 'CDM' WHEN 1 THEN 'COMSPOC_SYNTHETIC' ELSE 'UNAVAILABLE' END AS sa, CASE id_b % 3 WHEN 0 THEN 'CDM' WHEN 1 THEN 'COMSPOC_SYNTHETIC' ELSE 'UNAVAILABLE' END AS sb FROM n WHERE miss <= {MISS} AND id_a % 13 <> 0 AND id_b % 13 <> 0)
 SELECT CAST(id_a AS VARCHAR) AS id_a, CAST(id_b AS VARCHAR) AS id_b, CASE WHEN sa = 'UNAVAILABLE' OR sb = 'UNAVAILABLE' THEN 'UNAVAILABLE' WHEN sa = sb THEN sa ELSE 'MIXED(' || sa || '+' || sb || ')' END AS source,
 round(sqrt((2 + id_a % 3) / pi()) / 1000 + sqrt((2 + id_b % 3) / pi()) / 1000, 9) AS hard_km, sa = 'UNAVAILABLE' OR sb = 'UNAVAILABLE' AS unknown FROM o""")
def _score(spark, sf):
    find = lambda rows: conj.find_conjunctions(rows, LINE_TIMES, MISS, orbits=False, made=made_lines())
    objects = syn.points(spark, sf).where("id % 13 <> 0").select(F.col("id").cast("string").alias("id"), F.lit(LINE_TIMES[0]).alias("epoch_us"), (2.0 + F.col("id") % 3).alias("rcs_m2"))
    cov = F.expr("array(1e0, 0e0, 0e0, 0e0, 1e0, 0e0, 0e0, 0e0, 1e0)").alias("cov")
    table = lambda k: objects.where(f"CAST(id AS INT) % 3 = {k}").select("id", cov)
    s = conj.find_scored(find, line_rows(spark, sf), objects, table(0), table(1))
    return s.select("id_a", "id_b", "source", F.round("hard_km", 9).alias("hard_km"), (F.col("risk") == "UNKNOWN").alias("unknown"))


@query("g6_sweep_catalog")
def _g6(spark, sf):
    """The whole catalog over two hours, relaxed scoring with heuristic covariances."""
    e = catalog_elements(spark, sf)
    find = lambda rows: conj.sweep(rows, 2460324.5, 2460324.5 + 2 / 24, 2.0, 50.0)
    return conj.find_scored(find, e, e.select("id", "epoch_us"), heuristic=True).select("id_a", "id_b", "tca_us", F.round("miss_km", 6).alias("miss_km"), "source", "risk")


@query("d5_radius_by_attitude", _CAT + """SELECT norad_id, round(CASE ordinal % 4 WHEN 0 THEN sqrt((3 * 4 * abs(sin(radians(argp))) + 2 * 3 * abs(cos(radians(argp)))) / pi()) / 1000
 WHEN 1 THEN sqrt((4 * 3 * abs(cos(radians(argp - raan))) + 2 * 3 * abs(sin(radians(argp - raan)))) / pi()) / 1000 WHEN 2 THEN sqrt(4 + 16 + 9) / 2000 ELSE sqrt((2 * 4 + 4 * 3 + 3 * 2) / 2e0 / pi()) / 1000 END, 9) AS radius_km FROM c""")
def _d5(spark, sf):
    c = syn.catalog(spark, sf).withColumns({
        "x": F.lit(7000.0), "y": F.lit(0.0), "z": F.lit(0.0), "vx": F.lit(0.0), "vy": F.lit(7.5), "vz": F.lit(0.0), "l": F.lit(2.0), "w": F.lit(4.0), "h": F.lit(3.0), "rcs_m2": F.lit(None).cast("double"), "radius_m": F.lit(None).cast("double"),
        "attitude": F.expr("CASE ordinal % 4 WHEN 0 THEN 'NADIR' WHEN 1 THEN 'INERTIAL' WHEN 2 THEN 'OTHER' ELSE 'TUMBLING' END"),
        "quaternion": F.expr("array(cos(radians(raan) / 2), 0e0, 0e0, sin(radians(raan) / 2))"),
    })
    # relative motion in the plane of the orbit: with NADIR faces t (y) is w x h, n (z) l x h, r (x) l x w
    c = c.withColumns({"s_x": F.expr("CASE WHEN ordinal % 4 = 0 THEN 0e0 ELSE cos(radians(argp)) END"), "s_y": F.expr("sin(radians(argp))"), "s_z": F.expr("CASE WHEN ordinal % 4 = 0 THEN cos(radians(argp)) ELSE 0e0 END")})
    return geo.extend(c, geo.RTN).selectExpr("norad_id", f"round({conj.radius_km('attitude', 'quaternion')}, 9) AS radius_km")


@query("t14_quaternion_rotation", _CAT + "SELECT norad_id, round(cos(radians(raan)), 9) AS x, round(sin(radians(raan)), 9) AS y, 0.5e0 AS z FROM c")
def _t14(spark, sf):
    q = "array(cos(radians(raan) / 2), 0e0, 0e0, sin(radians(raan) / 2))"
    x, y, z = geo.rotated(q, ("1e0", "0e0", "0.5e0"))
    return syn.catalog(spark, sf).selectExpr("norad_id", f"round({x}, 9) AS x", f"round({y}, 9) AS y", f"round({z}, 9) AS z")


# ---------------------------------------------------------------- passes


@query("v3_passes")
def _v3(spark, sf):
    """Two days of the catalog's low orbits over ten stations, with light at the best moment."""
    stations = syn.table(spark, sf, "nation").where("n_nationkey < 10").selectExpr("n_name AS name", "n_nationkey * 9e0 - 40 AS lat", "n_nationkey * 14e0 - 70 AS lon", "0.1e0 AS height_km", "10e0 AS mask_deg")
    low = catalog_elements(spark, sf).where("n > 0.05 AND CAST(id AS INT) % 5 = 0")
    p = visibility.predict_passes(low, stations, 2460324.5, 2460325.5, 2.0)
    return p.select("id", "observer", F.floor(F.col("aos_us") / 1e6).cast("long").alias("aos_s"), F.round("duration_s", 1).alias("duration_s"), F.round("max_elevation", 3).alias("max_elevation"), "sunlit", "dark")


@query("k4_track_for_drawing", "SELECT CAST(s_suppkey AS BIGINT) AS id, CAST(step AS INTEGER) AS step, step > 0 AND step % 8 = 4 AS breaks FROM supplier, range(0, 24, 4) r(step)")
def _k4(spark, sf):
    e = syn.ephemeris(spark, sf).withColumn("lon", F.expr("CASE WHEN step % 8 < 4 THEN -170e0 ELSE 175e0 END"))
    t = visibility.track_breaks(visibility.thinned(e, 24, 6))
    return t.select("id", "step", F.expr("breaks AND step % 8 = 4").alias("breaks"))


# ---------------------------------------------------------------- numerical orbits


def low_states(spark, sf, n: int) -> DataFrame:
    c = syn.catalog(spark, sf).where(f"ordinal <= {n}").withColumns({"a": F.expr("6978e0 + 37e0 * (ordinal % 17)"), "i": F.expr("radians(inclination)")})
    return c.selectExpr("norad_id AS id", "epoch_jd", "a AS x", "0e0 AS y", "0e0 AS z", "0e0 AS vx", "sqrt(398600.4418e0 / a) * cos(i) AS vy", "sqrt(398600.4418e0 / a) * sin(i) AS vz", "ordinal")


@query("n1_cowell_orbits", _CAT + "SELECT norad_id AS id, 7 AS n, true AS steady FROM c WHERE ordinal <= 40")
def _n1(spark, sf):
    """An hour under the Earth's field: its energy, with all zonal terms, is constant to 1e-9."""
    out = numerical.propagate(low_states(spark, sf, 40), 3600.0, 600.0)
    s = "z / sqrt(x * x + y * y + z * z)"
    r = "sqrt(x * x + y * y + z * z)"
    p = {2: "(3 * s * s - 1) / 2", 3: "(5 * s * s * s - 3 * s) / 2", 4: "(35 * power(s, 4) - 30 * s * s + 3) / 8", 5: "(63 * power(s, 5) - 70 * power(s, 3) + 15 * s) / 8", 6: "(231 * power(s, 6) - 315 * power(s, 4) + 105 * s * s - 5) / 16"}
    terms = " - ".join(f"({geo.ZONAL[k]}) * power(6378.137e0 / r, {k}) * {e}" for k, e in p.items())
    e = out.selectExpr("id", f"{s} AS s", f"{r} AS r", "(vx * vx + vy * vy + vz * vz) / 2 AS kinetic").selectExpr("id", f"kinetic - 398600.4418e0 / r * (1 - {terms}) AS energy")
    return e.groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("n"), F.expr("(max(energy) - min(energy)) / abs(avg(energy)) < 1e-9").alias("steady"))


@query("n2_cowell_at_times", _CAT + "SELECT norad_id AS id, CAST(k AS INTEGER) AS ordinal, k = 3 AS early, true AS close FROM c, range(0, 4) r(k) WHERE ordinal <= 10")
def _n2(spark, sf):
    """States between the steps are those of a run that ends there; a time before the epoch is an error."""
    s = low_states(spark, sf, 10)
    at = s.select("id", F.posexplode(F.expr("array(epoch_jd + 0.01, epoch_jd + 0.0123, epoch_jd, epoch_jd - 1)")).alias("ordinal", "t_jd"))
    got = numerical.propagate_at(s, at)
    want = numerical.propagate(s, 0.0123 * 86400, 864.0).where("abs(t_s - 864) < 1e-3 OR abs(t_s - 1062.72) < 1e-3 OR t_s = 0").select("id", F.round("t_s", 0).alias("k"), F.struct("x", "y", "z").alias("w"))
    both = got.withColumn("k", F.round("t_s", 0)).join(want, ["id", "k"], "left")
    close = F.expr("error = 'BEFORE_EPOCH' OR (abs(x - w.x) < 1e-2 AND abs(y - w.y) < 1e-2 AND abs(z - w.z) < 1e-2)")
    return both.select("id", "ordinal", (F.col("error").isNotNull()).alias("early"), F.coalesce(close, F.lit(False)).alias("close"))


@query("n5_burn_spends_propellant", _CAT + "SELECT norad_id AS id, round(500 - 20e0 / (300 * 9.80665) * (100 + ordinal), 6) AS mass_kg, CAST(NULL AS VARCHAR) AS error FROM c WHERE ordinal <= 10")
def _n5(spark, sf):
    s = low_states(spark, sf, 10).withColumns({"mass_kg": F.lit(500.0), "burns": F.expr("array(named_struct('start_s', 60e0, 'duration_s', 100e0 + ordinal, 'thrust_n', 20e0, 'isp_s', 300e0, 'direction', array(1e0, 0e0, 0e0), 'frame', 'VNB'))")})
    return numerical.propagate(s, 600.0, 600.0).where("t_s = 600 OR error IS NOT NULL").select("id", F.round("mass_kg", 6).alias("mass_kg"), "error")


@query("b6_burns_checked_before", _CAT + "SELECT norad_id AS id, CASE ordinal % 3 WHEN 0 THEN 'MASS' WHEN 1 THEN 'OVERLAP' ELSE 'BAD_BURN' END AS error FROM c WHERE ordinal <= 9")
def _b6(spark, sf):
    burn = lambda start, f: f"named_struct('start_s', {start}, 'duration_s', 100e0, 'thrust_n', {f}, 'isp_s', 300e0, 'direction', array(1e0, 0e0, 0e0), 'frame', 'RTN')"
    burns = f"CASE ordinal % 3 WHEN 0 THEN array({burn('0e0', '20e0')}, {burn('200e0', '2000e0')}) WHEN 1 THEN array({burn('0e0', '20e0')}, {burn('50e0', '20e0')}) ELSE array({burn('0e0', '-1e0')}) END"
    s = low_states(spark, sf, 9).withColumns({"mass_kg": F.lit(50.0), "burns": F.expr(burns)})
    return numerical.propagate(s, 600.0).select("id", "error")


@query("m7_covariance_by_transition", _CAT + "SELECT norad_id AS id, true AS symmetric, true AS positive, true AS grows FROM c WHERE ordinal <= 5")
def _m7(spark, sf):
    cov = F.expr("transform(sequence(0, 35), k -> CASE WHEN k % 7 <> 0 THEN 0e0 WHEN k < 21 THEN 1e-2 ELSE 1e-8 END)")
    out = numerical.propagate_covariance(low_states(spark, sf, 5).withColumn("cov", cov), 900.0, 1e-12)
    return out.selectExpr("id", "forall(sequence(0, 35), k -> cov[k] = cov[6 * (k % 6) + CAST(k / 6 AS INT)]) AS symmetric", "forall(sequence(0, 5), k -> cov[7 * k] > 0) AS positive", "cov[0] + cov[7] + cov[14] > 3e-2 AS grows")


@query("m3_monte_carlo", _CAT + "SELECT norad_id AS id_a, CASE ordinal % 3 WHEN 0 THEN 1e0 WHEN 1 THEN 0e0 END AS certain FROM c WHERE ordinal <= 12")
def _m3(spark, sf):
    """A sure hit, a sure miss, and covariances that do not fit; the values between are in the tests."""
    small, six = "transform(sequence(0, 8), k -> CASE WHEN k % 4 = 0 THEN 1e-10 ELSE 0e0 END)", "transform(sequence(0, 35), k -> 0e0)"
    e = syn.catalog(spark, sf).where("ordinal <= 12").selectExpr("norad_id AS id_a", "'x' AS id_b", "array(CASE WHEN ordinal % 3 = 1 THEN 1e0 ELSE 0e0 END, 0e0, 0e0) AS miss", "array(0e0, 7e0, 0e0) AS speed", f"{small} AS cov_a", f"CASE WHEN ordinal % 3 = 2 THEN {six} ELSE {small} END AS cov_b", "0.01e0 AS radius_km", "CAST(NULL AS DOUBLE) AS mean_motion")
    return numerical.monte_carlo(e, 2000).select("id_a", F.col("pc_mc").alias("certain"))


@query("w7_probability_over_time", "SELECT CAST(k AS INTEGER) AS step, round(least(1e0, exp(-((2e0 + 0.1e0 * k) * (2e0 + 0.1e0 * k)) / (2 * 0.02e0)) * 1e-4 / (2 * 0.02e0)) * 1e30, 0) AS scaled FROM range(0, 10) r(k)")
def _w7(spark, sf):
    """Probability of each step of a pair: the miss is across the motion, the summed covariance 0.02 on the diagonal."""
    s = spark.range(10).selectExpr("CAST(id AS INT) AS step", "2e0 + 0.1e0 * id AS mx", "0e0 AS my", "0e0 AS mz", "0e0 AS ux", "0e0 AS uy", "7e0 AS uz", "0.02e0 AS cxx", "0e0 AS cxy", "0e0 AS cxz", "0.02e0 AS cyy", "0e0 AS cyz", "0.02e0 AS czz")
    return geo.extend(s, geo.collision_probability("0.01e0")).selectExpr("step", "round(pc * 1e30, 0) AS scaled")


@query("w8_states_without_repeats", "SELECT CAST(s_suppkey AS VARCHAR) AS id, CAST(step AS INTEGER) AS step FROM supplier, range(0, 24) r(step) WHERE step % 6 <> 3")
def _w8(spark, sf):
    e = syn.ephemeris(spark, sf).select(F.col("id").cast("string").alias("id"), "step", F.expr("2460000.5e0 + (CASE WHEN step % 6 = 3 THEN step - 1 ELSE step END) / 1440e0").alias("t_jd"))
    return numerical.kept_states(e, order="step").select("id", "step")


@query("n8_sun_by_chebyshev", "SELECT CAST(k AS INTEGER) AS k, round(sx / 10) AS sx FROM (SELECT k, (1.00014 - 0.01671 * cos(m) - 0.00014 * cos(2 * m)) * 149597870.7 * cos(radians(280.46646 + 36000.76983 * t + 1.9146 * sin(m) + 0.02 * sin(2 * m))) AS sx FROM (SELECT k, (2460000.5 + k * 0.37 - 2451545) / 36525 AS t, radians(357.5291092 + 35999.0502909 * ((2460000.5 + k * 0.37 - 2451545) / 36525)) AS m FROM range(0, 50) r(k)))")
def _n8(spark, sf):
    from ..kernels.cowell import Ephemeris

    pieces = Ephemeris(2460000.5, 50 * 0.37)
    return spark.createDataFrame([(k, float(round(pieces.at(2460000.5 + k * 0.37)[0][0] / 10))) for k in range(50)], "k int, sx double")


@query("a8_accuracy_metrics", "SELECT event_type, round(avg(abs(value)), 6) AS mean, round(quantile_cont(abs(value), 0.5), 6) AS median, round(quantile_cont(abs(value), 0.95), 6) AS p95, round(max(abs(value)), 6) AS worst FROM events GROUP BY event_type")
def _a8(spark, sf):
    e = syn.table(spark, sf, "events").withColumn("v", F.abs("value"))
    q = F.percentile("v", F.array(F.lit(0.5), F.lit(0.95)))
    return rounded(e.groupBy("event_type").agg(F.avg("v").alias("mean"), q[0].alias("median"), q[1].alias("p95"), F.max("v").alias("worst")), digits=6)


# ---------------------------------------------------------------- messages and files


def catalog_lines(spark, sf) -> DataFrame:
    from .queries import _lines

    return _lines(spark, sf)


@query("s1_load_lines_relaxed", _CAT + "SELECT lpad(norad_id, 5, '0') AS norad_id, round(mean_motion, 6) AS mean_motion FROM c WHERE ordinal % 10 NOT IN (3, 7)")
def _s1(spark, sf):
    out = catalogs.load_tle(numbered(catalog_lines(spark, sf), F.concat(F.lit("0 SAT "), "norad_id")), RELAXED)
    return out.select("norad_id", F.round("mean_motion", 6).alias("mean_motion"))


@query("d2_elements_of_line2", _CAT + "SELECT norad_id, round(inclination, 4) AS inclination, round(eccentricity, 7) AS eccentricity, round(mean_motion, 6) AS mean_motion, round(raan, 4) AS raan FROM c WHERE ordinal % 10 <> 7")
def _d2(spark, sf):
    e = catalogs.line2_elements("line2")
    rows = catalog_lines(spark, sf).where("ordinal % 10 <> 7")
    return rows.select("norad_id", F.round(e["inclination"], 4).alias("inclination"), F.round(e["eccentricity"], 7).alias("eccentricity"), F.round(e["mean_motion"], 6).alias("mean_motion"), F.round(e["raan"], 4).alias("raan"))


@query("p8_lines_to_messages", _CAT + "SELECT lpad(norad_id, 5, '0') AS norad_id, round(radians(inclination), 8) AS inclination_rad, round(mean_motion * 2 * pi() / 1440, 8) AS mean_motion_rad_min FROM c WHERE ordinal % 10 NOT IN (3, 7)")
def _p8(spark, sf):
    out = catalogs.elements_of_lines(tle.parse(catalog_lines(spark, sf).select("line1", "line2")))
    return out.select("norad_id", F.round("inclination_rad", 8).alias("inclination_rad"), F.round("mean_motion_rad_min", 8).alias("mean_motion_rad_min"))


_RECORD = """'{"OBJECT_NAME":"O' || norad_id || '","NORAD_CAT_ID":"' || norad_id || '","EPOCH":"2024-01-01T00:00:00","INCLINATION":"51.5","RA_OF_ASC_NODE":"10","ARG_OF_PERICENTER":"20","MEAN_ANOMALY":"30","ECCENTRICITY":"' || CASE WHEN ordinal % 6 = 5 THEN '1.5' ELSE '0.001' END || '","MEAN_MOTION":"15.5","BSTAR":"0.0001"}'"""


@query("s3_message_arrays", _CAT + "SELECT CAST(ordinal // 10 AS BIGINT) AS file, norad_id, CASE WHEN ordinal % 6 = 5 THEN 'INVALID' END AS reason FROM c WHERE ordinal // 10 % 4 <> 1 UNION ALL SELECT DISTINCT CAST(ordinal // 10 AS BIGINT), NULL, 'NOT_AN_ARRAY' FROM c WHERE ordinal // 10 % 4 = 1")
def _s3(spark, sf):
    c = syn.catalog(spark, sf).selectExpr("CAST(ordinal DIV 10 AS BIGINT) AS file", f"{_RECORD} AS r")
    files = c.groupBy("file").agg(F.concat(F.lit("["), F.concat_ws(",", F.collect_list("r")), F.lit("]")).alias("text")).withColumn("text", F.expr("CASE WHEN file % 4 = 1 THEN substr(text, 2) ELSE text END"))
    return catalogs.parse_omm_payloads(files).select("file", "norad_id", "reason")


def _numbers(spark, sf) -> DataFrame:
    e = syn.ephemeris(spark, sf).withColumns({"vx": F.expr("x / 1000"), "vy": F.expr("y / 1000"), "vz": F.expr("z / 1000"), "t_us": F.expr("1704067200000000 + step * 90500000L")})
    return e.withColumn("name", F.concat(F.lit("S<"), F.col("id").cast("string")))


_STATES_SQL = _EPH + "SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY step) - 1 AS INTEGER) AS ordinal, 1704067200000000 + step * 90500000 AS t_us, round(x, 4) AS x, round(z / 1000, 6) AS vz FROM e"


def _shown(states: DataFrame, x: int = 4, vz: int = 6) -> DataFrame:
    return states.select("id", "ordinal", "t_us", F.round("x", x).alias("x"), F.round("vz", vz).alias("vz"))


@query("s8_ocm_xml_round_trip", _STATES_SQL.replace("round(x, 4)", "round(x, 6)").replace("1000, 6)", "1000, 9)"))  # the message has 6 and 9 decimals
def _s8(spark, sf):
    text = ephemerides.export_ocm_xml(_numbers(spark, sf), "name", "ORBITFOLD", "2024-01-01T00:00:00Z")
    text = text.withColumn("text", F.expr("replace(replace(text, '<segment>', '<!-- <stateVector/> --><n:segment xmlns:n=\"urn:x\">'), '</segment>', '</n:segment>')"))
    return _shown(ephemerides.parse_ocm(text).where("reason IS NULL").withColumn("id", F.expr("CAST(substr(name, 3) AS BIGINT)")), 6, 9)


@query("s9_ocm_kvn", _STATES_SQL)
def _s9(spark, sf):
    day = "date_format(timestamp_micros(t_us), 'yyyy') || '-' || date_format(timestamp_micros(t_us), 'DDD') || date_format(timestamp_micros(t_us), \"'T'HH:mm:ss.SSSSSS\")"
    block = F.expr(f"concat_ws('\\n', 'COMMENT X = 1', 'EPOCH = ' || {day}, ' X = ' || CAST(x AS STRING), 'Y=' || CAST(y AS STRING), 'Z = ' || CAST(z AS STRING), 'X_DOT = ' || CAST(vx AS STRING), 'Y_DOT = ' || CAST(vy AS STRING), 'Z_DOT = ' || CAST(vz AS STRING))")
    one = _numbers(spark, sf).groupBy("id").agg(F.concat_ws("\n", F.lit("CCSDS_OCM_VERS = 2.0\nREF_FRAME = TEME"), F.collect_list(block)).alias("text"))
    return _shown(ephemerides.parse_ocm(one).where("reason IS NULL"))


@query("s5_stk_ephemeris", _STATES_SQL)
def _s5(spark, sf):
    row = F.expr("concat_ws('  ', CAST(step * 90.5e0 AS STRING), CAST(x AS STRING), CAST(y AS STRING), CAST(z AS STRING), CAST(vx AS STRING), CAST(vy AS STRING), CAST(vz AS STRING))")
    head = "stk.v.11.0\n# made here\nBEGIN Ephemeris\nScenarioEpoch  1 Jan 2024 00:00:00.000\nDistanceUnit Kilometers\nEphemerisTimePosVel\n"
    cov = "\nnot a row\nCovarianceTimePosVel\n" + " ".join(["0.0"] * 22) + "\nEND Ephemeris"
    one = _numbers(spark, sf).groupBy("id").agg(F.concat(F.lit(head), F.concat_ws("\n", F.collect_list(row)), F.lit(cov)).alias("text"))
    return _shown(ephemerides.parse_stk(one).where("reason IS NULL"))


@query("s6_stk_covariance", "SELECT CAST(s_suppkey AS BIGINT) AS id, CASE WHEN s_suppkey % 3 <> 1 THEN 8e0 END AS c12, CASE WHEN s_suppkey % 3 <> 1 THEN 8e0 END AS c21, CASE WHEN s_suppkey % 3 <> 1 THEN 21e0 + s_suppkey END AS c55 FROM supplier")
def _s6(spark, sf):
    numbers = " ".join(str(float(k)) for k in range(0, 6)) + " 6.0 7.0 " + " ".join(str(float(k)) for k in range(8, 21))
    t = syn.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("stk.v.11.0\nCovarianceTimePosVel "), F.expr("CASE s_suppkey % 3 WHEN 0 THEN 'Units km' WHEN 1 THEN 'Units m' ELSE '' END"), F.lit(f"\n{numbers} "), (F.lit(21.0) + F.col("s_suppkey")).cast("string")).alias("text"))
    out = ephemerides.stk_covariance(t)
    return out.selectExpr("id", "cov[6 * 3 + 1] AS c12", "cov[6 + 3] AS c21", "cov[35] AS c55")


@query("s10_cdm_xml_round_trip", ORACLE_SQL["s11_cdm_round_trip"])
def _s10(spark, sf):
    thing = lambda label, sign, cov: F.expr(f"struct('{label}' AS designator, 'SAT & {label}' AS name, array({sign} * a_km, 0e0, 0e0, 0e0, 7.5e0, 0e0) AS state, {cov} AS covariance)")
    c = syn.catalog(spark, sf).select(
        F.concat(F.lit("M"), "norad_id").alias("message_id"), F.lit("2024-01-01T00:00:00.000Z").alias("creation"), F.lit("2024-01-02T00:00:00.000Z").alias("tca"), F.expr("CASE WHEN ordinal % 9 = 0 THEN -1e0 ELSE (ordinal % 5000) / 8e0 END").alias("miss_m"), F.lit(14500.0).alias("speed_m_s"), F.expr("CASE WHEN ordinal % 4 > 0 THEN (ordinal % 1000) / 1024e0 END").alias("pc"),
        thing("A", 1, "CASE WHEN ordinal % 2 = 0 THEN transform(sequence(0, 20), i -> 2e0 * (ordinal % 64)) END").alias("object_1"), thing("B", -1, "transform(sequence(0, 20), i -> 5e0)").alias("object_2"),
    )
    out = cdm_xml.parse_xml(cdm_xml.export_xml(c, "ORBITFOLD").select("xml"))
    return out.selectExpr("message_id", "reason", "round(miss_m, 4) AS miss_m", "round(pc * 1024e0) / 1024e0 AS pc", "object_1.state[0] AS x_1", "object_2.state[0] AS x_2", "object_1.covariance[2] AS cov_1", "object_2.covariance[20] AS cov_2")


@query("p9_ccsds_epochs", "SELECT event_id, epoch_us(ts) - CASE event_id % 4 WHEN 2 THEN 19800000000 ELSE 0 END AS us FROM events WHERE event_id % 4 <> 3 UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 4 = 3")
def _p9(spark, sf):
    e = syn.table(spark, sf, "events").withColumn("t", F.col("ts").cast("timestamp"))
    form = lambda p: F.date_format("t", p)
    text = F.when(F.col("event_id") % 4 == 0, F.concat(form("yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))).when(F.col("event_id") % 4 == 1, F.concat(form("yyyy"), F.lit("-"), form("DDD"), form("'T'HH:mm:ss.SSSSSS"))).when(F.col("event_id") % 4 == 2, F.concat(form("yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("+05:30"))).otherwise(F.lit("2024-13-45T99:00:00"))
    return e.select("event_id", ephemerides.ccsds_epoch_us(text).alias("us"))


@query("p10_stk_epochs", "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN epoch_us(date_trunc('second', ts)) + 250000 END AS us FROM events")
def _p10(spark, sf):
    e = syn.table(spark, sf, "events").withColumn("t", F.col("ts").cast("timestamp"))
    text = F.concat(F.date_format("t", "d"), F.lit(" "), F.expr("CASE WHEN event_id % 5 = 0 THEN 'Xyz' ELSE date_format(t, 'MMM') END"), F.lit(" "), F.date_format("t", "yyyy HH:mm:ss"), F.lit(".25"))
    return e.select("event_id", ephemerides.stk_epoch_us(text).alias("us"))


@query("t3_convert_time", "SELECT event_id, 2440587.5e0 + epoch_us(ts) / 86400000000e0 AS jd, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events")
def _t3(spark, sf):
    e = syn.table(spark, sf, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    iso = F.concat(F.substring(ephemerides.iso_of_us(F.col("us")), 1, 19), F.lit("Z"))
    return e.select("event_id", F.expr("2440587.5e0 + us / 86400000000e0").alias("jd"), iso.alias("iso"))


@query("p12_valid_matrices", _CAT + "SELECT norad_id, ordinal % 3 = 0 AS ok FROM c")
def _p12(spark, sf):
    c = syn.catalog(spark, sf).withColumn("cov", F.expr("CASE ordinal % 3 WHEN 0 THEN transform(sequence(1, 9), k -> 1e0) WHEN 1 THEN array(1e0, 2e0) ELSE transform(sequence(1, 9), k -> CASE WHEN k = 4 THEN CAST('NaN' AS DOUBLE) ELSE 1e0 END) END"))
    return c.select("norad_id", ephemerides.valid_matrix(F.col("cov")).alias("ok"))


def _csv_lines(spark, sf) -> DataFrame:
    d = syn.table(spark, sf, "part").where("p_partkey <= 120").withColumn("day", F.expr("date_add(DATE'2024-01-01', CAST(p_partkey AS INT))"))
    row = "concat_ws(',', CAST(day AS STRING), 'x', CASE WHEN p_partkey % 7 = 0 THEN '' ELSE CAST(p_partkey / 4e0 AS STRING) END, CASE WHEN p_partkey % 5 = 0 THEN '0' WHEN p_partkey % 6 = 0 THEN '' ELSE CAST(100e0 + p_partkey AS STRING) END, CASE WHEN p_partkey % 4 = 0 THEN '' WHEN p_partkey % 11 = 0 THEN 'bad' ELSE CAST(90e0 + p_partkey AS STRING) END)"
    head = spark.createDataFrame([("f", -1, "DATE,OTHER,AP_AVG,F10.7 OBS,F10.7_ADJ"), ("f", -2, "# comment")], "file string, lineno long, line string")
    return head.unionByName(d.selectExpr("'f' AS file", "p_partkey AS lineno", f"{row} AS line"))


_WEATHER = "SELECT strftime(DATE '2024-01-01' + CAST(p_partkey AS INTEGER), '%Y-%m-%d') AS date, CASE WHEN p_partkey % 6 = 0 THEN 150e0 ELSE 100e0 + p_partkey END AS f107_obs, CASE WHEN p_partkey % 4 = 0 THEN CASE WHEN p_partkey % 6 = 0 THEN 150e0 ELSE 100e0 + p_partkey END ELSE 90e0 + p_partkey END AS f107_adj, CASE WHEN p_partkey % 7 = 0 THEN 15e0 ELSE p_partkey / 4e0 END AS ap FROM part WHERE p_partkey <= 120 AND p_partkey % 5 <> 0 AND NOT (p_partkey % 11 = 0 AND p_partkey % 4 <> 0)"


@query("s18_space_weather_csv", _WEATHER)
def _s18(spark, sf):
    return environment.space_weather_csv(_csv_lines(spark, sf)).withColumn("date", F.col("date").cast("string"))


@query("n14_weather_of_events", f"WITH w AS ({_WEATHER}) SELECT event_id, coalesce(f107_obs, 150) AS f107_obs, coalesce(ap, 15) AS ap FROM events LEFT JOIN w ON strftime(ts, '%Y-%m-%d') = date")
def _n14(spark, sf):
    e = syn.table(spark, sf, "events").select("event_id", F.col("ts").cast("date").alias("day"))
    return environment.weather_at(e, "day", [environment.space_weather_csv(_csv_lines(spark, sf))], RELAXED).select("event_id", "f107_obs", "ap")


@query("s19_space_weather_blocks", "SELECT strftime(DATE '2024-01-01' + CAST(p_partkey AS INTEGER), '%Y-%m-%d') AS date, CASE WHEN p_partkey < 59 THEN 128e0 ELSE 1128e0 END + p_partkey AS f107_obs, 23e0 + p_partkey AS f107_adj, 20e0 + p_partkey AS ap FROM part WHERE p_partkey <= 120")
def _s19(spark, sf):
    days = syn.table(spark, sf, "part").where("p_partkey <= 120").withColumn("d", F.expr("date_add(DATE'2024-01-01', CAST(p_partkey AS INT))"))
    fields = ", ".join("'0'" if k not in (20, 23, 28) else f"CAST({k}e0 + {'v + ' if k == 28 else ''}p_partkey AS STRING)" for k in range(3, 29))
    line = f"concat_ws(' ', date_format(d, 'yyyy'), date_format(d, 'M'), date_format(d, 'd'), {fields})"
    block = lambda v, at: days.selectExpr("p_partkey", "d", f"{v} AS v").selectExpr("'f' AS file", f"p_partkey + {at} AS lineno", f"{line} AS line")
    marks = spark.createDataFrame([("f", 0, "NUM 120"), ("f", 1, "BEGIN OBSERVED"), ("f", 999, "END OBSERVED"), ("f", 1000, "2023 1 1 9 9"), ("f", 1001, "BEGIN PREDICTED"), ("f", 1999, "END PREDICTED")], "file string, lineno long, line string")
    lines = marks.unionByName(block("100e0", 2)).unionByName(block("1100e0", 1100))
    return environment.space_weather_fixed(lines, "2024-02-29").withColumn("date", F.col("date").cast("string"))


def _orientation(spark, scale: float, low: int, high: int, step: int) -> DataFrame:
    lines = [("f", 0, "BEGIN OBSERVED"), *(("f", 1 + k - low, f"2024 1 1 {k} {k * 1e-6 * scale!r} {k * 2e-6 * scale!r} {k * 3e-6 * scale!r} 0 0") for k in range(low, high, step)), ("f", 10**6, "END OBSERVED")]
    return environment.earth_orientation(spark.createDataFrame(lines, "file string, lineno long, line string"))


_EOP = "WITH t AS (SELECT mjd, mjd * 3e-6 * CASE WHEN mjd >= 60320 THEN 2 ELSE 1 END AS v FROM range(60310, 60331, 2) r(mjd)), n AS (SELECT mjd AS k0, v AS v0, lead(mjd) OVER (ORDER BY mjd) AS k1, lead(v) OVER (ORDER BY mjd) AS v1, row_number() OVER (ORDER BY mjd) AS i, count(*) OVER () AS m FROM t), "


@query("s20_orientation_merged", "SELECT CAST(mjd AS INTEGER) AS mjd, round(mjd * 3e-6 * CASE WHEN mjd >= 60320 THEN 2 ELSE 1 END, 9) AS dut1_s FROM range(60310, 60331, 2) r(mjd)")
def _s20(spark, sf):
    both = environment.merge_orientation(_orientation(spark, 1.0, 60310, 60331, 2), _orientation(spark, 2.0, 60320, 60331, 2))
    return both.select("mjd", F.round("dut1_s", 9).alias("dut1_s"))


@query("t8_orientation_of_times", _EOP + "e AS (SELECT c_custkey AS id, 2460308.75e0 + (c_custkey * 17 % 2600) / 100e0 AS jd FROM customer), f AS (SELECT id, floor(floor(jd) + 0.5 - 2400000.5) AS d FROM e) SELECT id, round(v0 + (v1 - v0) * (d - k0) / (k1 - k0), 9) AS dut1_s FROM f JOIN n ON k1 IS NOT NULL AND (i = 1 OR d >= k0) AND (i = m - 1 OR d < k1)")
def _t8(spark, sf):
    table = environment.merge_orientation(_orientation(spark, 1.0, 60310, 60331, 2), _orientation(spark, 2.0, 60320, 60331, 2))
    e = syn.table(spark, sf, "customer").selectExpr("c_custkey AS id", "2460308.75e0 + (c_custkey * 17 % 2600) / 100e0 AS jd")
    return environment.orientation_at(e, "jd", table).select("id", F.round("dut1_s", 9).alias("dut1_s"))


@query("t5_turned_by_ut1", _CAT + "SELECT norad_id, round(7000 * cos(g), 5) AS ex, round(-7000 * sin(g), 5) AS ey FROM (SELECT norad_id, radians((s - 86400 * floor(s / 86400)) / 240) AS g FROM (SELECT norad_id, 67310.54841 + (876600e0 * 3600 + 8640184.812866) * t + 0.093104 * t * t - 6.2e-6 * t * t * t AS s FROM (SELECT norad_id, (epoch_jd + 0.5e0 / 86400 - 2451545) / 36525 AS t FROM c)))")
def _t5(spark, sf):
    flat = spark.createDataFrame([(60300, 0.0, 0.0, 0.5), (60400, 0.0, 0.0, 0.5)], "mjd int, xp_arcsec double, yp_arcsec double, dut1_s double")
    rows = syn.catalog(spark, sf).select("norad_id", "epoch_jd", F.lit(7000.0).alias("x"), F.lit(0.0).alias("y"), F.lit(100.0).alias("z"))
    return environment.turned_with_orientation(rows, "epoch_jd", flat).select("norad_id", F.round("ex", 5).alias("ex"), F.round("ey", 5).alias("ey"))


@query("s15_requests_of_ids", "SELECT count(*) AS ids, max(n) <= 100 AS bounded FROM (SELECT c_custkey, 100 AS n FROM customer)")
def _s15(spark, sf):
    r = catalogs.requests(syn.catalog(spark, sf).select("norad_id").union(syn.catalog(spark, sf).select("norad_id")))
    return r.agg(F.sum(F.size("ids")).alias("ids"), (F.max(F.size("ids")) <= catalogs.BATCH).alias("bounded"))


@query("s17_details_of_objects", _CAT + "SELECT norad_id, CASE WHEN ordinal % 2 = 0 THEN 'g-' || norad_id END AS guid FROM c")
def _s17(spark, sf):
    c = syn.catalog(spark, sf)
    rec = F.concat(F.lit('{"noradId": '), "norad_id", F.lit(', "id": "g-'), "norad_id", F.lit('"}'))
    satcat = c.where("ordinal % 2 = 0").groupBy((F.col("ordinal") % 5).alias("file")).agg(F.concat(F.lit("["), F.concat_ws(",", F.collect_list(rec)), F.lit("]")).alias("text"))
    return catalogs.details(c.select("norad_id"), satcat).select("norad_id", "guid")
