"""The registered queries of the orbital operators, and DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formulas as f
from ..functions import geometry as geo
from ..operators import burns as burn_ops
from ..operators import catalog as cat
from ..operators import lookups, passes, spatial
from ..sources import cdm, omm, tle
from ..streaming import sessions
from . import oracles
from . import synthetic as syn

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_CAT = f"WITH c0 AS (SELECT {syn.CATALOG} FROM customer), c1 AS (SELECT *, power(398600.4418 / power(mean_motion * 2 * pi() / 86400, 2), 1e0 / 3) AS a_km, 1440 / mean_motion AS period_minutes FROM c0), c AS (SELECT *, a_km - 6378.137 AS altitude_km, a_km * (1 - eccentricity) - 6378.137 AS perigee_km, a_km * (1 + eccentricity) - 6378.137 AS apogee_km FROM c1) "
_PTS = f"WITH p AS (SELECT {syn.POINTS} FROM part) "
_EPH = "WITH e AS (SELECT s_suppkey AS id, CAST(step AS INTEGER) AS step, " + ", ".join(f"{e} AS {c}" for c, e in syn.TRACK.items()) + f" FROM supplier, range({syn.EPHEMERIS_STEPS}) r(step)) "
_BURN = "WITH b AS (SELECT o_custkey AS sat, o_orderkey AS id, (o_orderkey * 7919) % 86400 AS start, (o_orderkey * 7919) % 86400 + 60 + (o_orderkey * 31) % 3000 AS stop FROM orders) "


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return add


def rounded(df: DataFrame, *keys: str, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" and c not in keys else F.col(c) for c, t in df.dtypes))


def computed(name: str, keys: str, exprs: dict[str, str], digits: int = 6) -> None:
    """A projection of the catalog by formula text; text results are not rounded. Its SQL is in ``oracles``."""
    text = {c for c, e in exprs.items() if c.endswith("_class")}
    wrap = lambda c, e: f"{e} AS {c}" if c in text else f"round({e}, {digits}) AS {c}"
    items = [wrap(c, e) for c, e in exprs.items()]
    QUERIES[name] = lambda spark, sf: syn.catalog(spark, sf).selectExpr(*keys.split(", "), *items)


# ---------------------------------------------------------------- catalog


@query("d1_debris_object", _CAT + "SELECT norad_id, round(period_minutes, 6) AS period_minutes, round(a_km, 6) AS a_km, round(altitude_km, 6) AS altitude_km, round(perigee_km, 6) AS perigee_km, round(apogee_km, 6) AS apogee_km FROM c")
def _d1(spark, sf):
    return rounded(syn.catalog(spark, sf).select("norad_id", "period_minutes", "a_km", "altitude_km", "perigee_km", "apogee_km"))


@query("f1_filter_altitude", _CAT + "SELECT norad_id FROM c WHERE altitude_km >= 400 AND altitude_km <= 2000 AND perigee_km >= 360")
def _f1(spark, sf):
    return cat.filter_altitude(syn.catalog(spark, sf), 400.0, 2000.0).select("norad_id")


@query("f2_filter_region", _CAT + "SELECT norad_id FROM c WHERE least(inclination, 180 - inclination) >= 40.05 AND -least(inclination, 180 - inclination) <= 50.0")
def _f2(spark, sf):
    return cat.filter_region(syn.catalog(spark, sf), 40.05, 50.0).select("norad_id")


@query("f3_filter_time_window", _CAT + "SELECT norad_id FROM c WHERE 2460321.6 - epoch_jd <= CASE WHEN altitude_km < 2000 THEN 7 ELSE 14 END")
def _f3(spark, sf):
    return cat.filter_time_window(syn.catalog(spark, sf), 2460321.6).select("norad_id")


@query("f4_apply_filters", _CAT + "SELECT norad_id FROM c WHERE altitude_km BETWEEN 300 AND 30000 AND perigee_km >= 270 AND least(inclination, 180 - inclination) >= 10.05 AND 2460321.6 - epoch_jd <= CASE WHEN altitude_km < 2000 THEN 7 ELSE 14 END AND object_type IN ('PAYLOAD', 'DEBRIS') ORDER BY ordinal LIMIT 50")
def _f4(spark, sf):
    return cat.apply_filters(syn.catalog(spark, sf), (300.0, 30000.0), (10.05, 60.0), 2460321.6, ["PAYLOAD", "DEBRIS"], 50).select("norad_id")


@query("f5_staleness", _CAT + "SELECT norad_id, abs(2460346.6 - epoch_jd) > 30 AS stale FROM c")
def _f5(spark, sf):
    return cat.staleness(syn.catalog(spark, sf), 2460346.6).select("norad_id", "stale")


@query("a1_catalog_statistics", _CAT + """SELECT count(*) AS total_count, count_if(object_type = 'PAYLOAD')::BIGINT AS payload, count_if(object_type = 'ROCKET_BODY')::BIGINT AS rocket_body, count_if(object_type = 'DEBRIS')::BIGINT AS debris, count_if(object_type = 'UNKNOWN')::BIGINT AS unknown,
 count_if(eccentricity <= 0.25 AND altitude_km < 2000)::BIGINT AS leo, count_if(eccentricity <= 0.25 AND altitude_km >= 2000 AND (altitude_km < 35000 OR altitude_km > 36000))::BIGINT AS meo, count_if(eccentricity <= 0.25 AND altitude_km BETWEEN 35000 AND 36000)::BIGINT AS geo, count_if(eccentricity > 0.25)::BIGINT AS heo,
 count_if(inclination < 10)::BIGINT AS equatorial, count_if(inclination >= 10 AND inclination < 80)::BIGINT AS inclined, count_if(inclination BETWEEN 80 AND 90)::BIGINT AS polar, count_if(inclination > 90)::BIGINT AS retrograde,
 round(avg(altitude_km), 4) AS altitude_mean_km, round(stddev_pop(altitude_km), 4) AS altitude_std_km, round(min(altitude_km), 4) AS altitude_min_km, round(max(altitude_km), 4) AS altitude_max_km FROM c""")
def _a1(spark, sf):
    return rounded(cat.statistics(syn.catalog(spark, sf)), digits=4)


@query("a1_regime_statistics", _CAT + "SELECT CASE WHEN eccentricity > 0.25 THEN 'HEO' WHEN altitude_km < 2000 THEN 'LEO' WHEN altitude_km >= 35000 AND altitude_km <= 36000 THEN 'GEO' ELSE 'MEO' END AS regime, count(*) AS n, round(avg(altitude_km), 4) AS mean_km FROM c WHERE perigee_km > 100 GROUP BY 1")
def _flagship(spark, sf):
    c = syn.catalog(spark, sf).where("perigee_km > 100")
    return c.groupBy(F.expr(f.regime("altitude_km", "eccentricity")).alias("regime")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("altitude_km"), 4).alias("mean_km"))


@query("a3_inclination_bands", _CAT + "SELECT CASE WHEN inclination < 10 THEN 'equatorial' WHEN inclination < 80 THEN 'inclined' WHEN inclination <= 90 THEN 'polar' ELSE 'retrograde' END AS band, count(*) AS n FROM c GROUP BY 1")
def _a3(spark, sf):
    return syn.catalog(spark, sf).groupBy(F.expr(f.inclination_band("inclination")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


computed("d3_orbit_period", "norad_id", {"period": f.period_minutes("(mean_motion - 2e0)")})
computed("d4_risk_class", "norad_id", {"risk_class": f.risk("(eccentricity * inclination * 1e-6)")})
computed("d5_dynamic_radius", "norad_id", {"radius_km": f.radius_km("(CASE WHEN ordinal % 4 = 0 THEN 2e0 + ordinal % 7 END)", "(3e0 + ordinal % 3)", "1.5e0", "(CASE WHEN ordinal % 4 = 1 THEN 1e0 + ordinal % 9 END)", "(CASE WHEN ordinal % 4 = 2 THEN 3e0 END)")}, 9)
computed("d7_covariance_source", "norad_id", {"source_class": f.covariance_source("(CASE ordinal % 3 WHEN 0 THEN 'CDM' WHEN 1 THEN 'SYNTHETIC' ELSE 'UNAVAILABLE' END)", "(CASE ordinal % 4 WHEN 0 THEN 'CDM' WHEN 1 THEN 'SYNTHETIC' WHEN 2 THEN 'COMSPOC_SYNTHETIC' ELSE 'UNAVAILABLE' END)")})


@query("o3_first_in_catalog_order", "SELECT c_custkey AS ordinal FROM customer ORDER BY c_custkey LIMIT 100")
def _o3(spark, sf):
    return cat.apply_filters(syn.catalog(spark, sf), first=100).select("ordinal")


@query("s13_union_keep_first", _CAT + ", u AS (SELECT 0 AS g, * FROM c WHERE ordinal % 2 = 0 UNION ALL SELECT 1, * FROM c WHERE ordinal % 3 = 0 UNION ALL SELECT 2, * FROM c) SELECT norad_id, object_type FROM u QUALIFY row_number() OVER (PARTITION BY norad_id ORDER BY g, ordinal) = 1")
def _s13(spark, sf):
    c = syn.catalog(spark, sf)
    return cat.union_keep_first([c.where("ordinal % 2 = 0"), c.where("ordinal % 3 = 0"), c]).select("norad_id", "object_type")


# ---------------------------------------------------------------- messages


def _lines(spark, sf) -> DataFrame:
    c = syn.catalog(spark, sf).withColumns({"id": F.lpad("norad_id", 5, "0").cast("int"), "yy": (F.col("ordinal") % 30).cast("int"), "doy": F.expr("1e0 + ordinal % 365 + (ordinal % 8) / 8e0")})
    t = tle.format_lines(c)
    return t.withColumn("line2", F.when(F.col("ordinal") % 10 == 3, F.concat(F.substring("line2", 1, 68), ((F.substring("line2", 69, 1).cast("int") + 1) % 10).cast("string"))).when(F.col("ordinal") % 10 == 7, F.substring("line2", 1, 60)).otherwise(F.col("line2")))


def numbered(rows: DataFrame, name) -> DataFrame:
    """(file, lineno, line): the name and both lines of each row; rows of one id are in one file, one after the other."""
    lines = rows.withColumn("_row", F.monotonically_increasing_id()).select("ordinal", "_row", F.posexplode(F.array(name, "line1", "line2")).alias("_p", "line"))
    return lines.select(F.col("ordinal").alias("file"), (F.col("_row") * 3 + F.col("_p")).alias("lineno"), "line")


@query("p1_parse_tle", _CAT + """SELECT ordinal, CASE WHEN ordinal % 10 = 3 THEN 'L2_CHECKSUM' WHEN ordinal % 10 = 7 THEN 'L2_LENGTH' END AS reason,
 CASE WHEN ordinal % 10 NOT IN (3, 7) THEN round(inclination, 4) END AS inclination, CASE WHEN ordinal % 10 NOT IN (3, 7) THEN round(eccentricity, 7) END AS eccentricity, CASE WHEN ordinal % 10 NOT IN (3, 7) THEN round(mean_motion, 6) END AS mean_motion,
 CASE WHEN ordinal % 10 NOT IN (3, 7) THEN epoch_us(make_timestamp(2000 + ordinal % 30, 1, 1, 0, 0, 0)) + (ordinal % 365) * 86400000000 + (ordinal % 8) * 10800000000 END AS epoch_us FROM c""")
def _p1(spark, sf):
    out = tle.parse(_lines(spark, sf).select("ordinal", "line1", "line2"))
    return out.select("ordinal", "reason", F.round("inclination", 4).alias("inclination"), F.round("eccentricity", 7).alias("eccentricity"), F.round("mean_motion", 6).alias("mean_motion"), "epoch_us")


@query("s2_group_tle_lines", _CAT + "SELECT CASE WHEN ordinal % 10 = 5 THEN 'NORAD-' || lpad(norad_id, 5, '0') ELSE 'SAT ' || norad_id END AS name FROM c WHERE ordinal % 10 NOT IN (3, 7)")
def _s2(spark, sf):
    lines = numbered(_lines(spark, sf), F.when(F.col("ordinal") % 10 != 5, F.concat(F.lit("SAT "), "norad_id"))).where("line IS NOT NULL")
    return tle.parse(tle.group_lines(lines)).where("reason IS NULL").select("name")


@query("p5_parse_omm", _CAT + """SELECT norad_id, object_type_x AS object_type, round(radians(inclination), 9) AS inclination_rad, round(mean_motion * 2 * pi() / 1440, 9) AS mean_motion_rad_min, rcs AS rcs_m2, ordinal % 11 <> 0 AS valid
 FROM (SELECT *, CASE ordinal % 5 WHEN 0 THEN 'PAYLOAD' WHEN 1 THEN 'ROCKET_BODY' WHEN 2 THEN 'DEBRIS' ELSE 'UNKNOWN' END AS object_type_x, CASE ordinal % 4 WHEN 0 THEN 0.1e0 WHEN 1 THEN 1e0 WHEN 2 THEN 10e0 END AS rcs FROM c)""")
def _p5(spark, sf):
    c = syn.catalog(spark, sf)
    text = lambda c: F.col(c).cast("string")
    rec = F.struct(
        F.col("norad_id").alias("NORAD_CAT_ID"), F.concat(F.lit("OBJ "), "norad_id").alias("OBJECT_NAME"), F.expr("CASE ordinal % 5 WHEN 0 THEN 'payload' WHEN 1 THEN 'ROCKET BODY' WHEN 2 THEN 'DEBRIS' WHEN 3 THEN 'TBA' END").alias("OBJECT_TYPE"), F.lit("2024-01-01T00:00:00.000000Z").alias("EPOCH"),
        text("inclination").alias("INCLINATION"), text("raan").alias("RA_OF_ASC_NODE"), text("argp").alias("ARG_OF_PERICENTER"), text("mean_anomaly").alias("MEAN_ANOMALY"), text("eccentricity").alias("ECCENTRICITY"), text("mean_motion").alias("MEAN_MOTION"),
        F.expr("CASE WHEN ordinal % 11 = 0 THEN '1.5' ELSE '0.0001' END").alias("BSTAR"), F.expr("CASE ordinal % 4 WHEN 0 THEN 'SMALL' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'large' END").alias("RCS_SIZE"),
    )
    out = omm.parse(c.select(F.to_json(rec).alias("json")))
    return out.select("norad_id", "object_type", F.round("inclination_rad", 9).alias("inclination_rad"), F.round("mean_motion_rad_min", 9).alias("mean_motion_rad_min"), "rcs_m2", "valid")


# ---------------------------------------------------------------- time, frames, environment


@query("t2_datetime_to_jd", "SELECT event_id, 2440587.5e0 + epoch_us(ts) / 86400000000e0 AS jd FROM events")
def _t2(spark, sf):
    e = syn.table(spark, sf, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return e.select("event_id", F.expr(f.jd_of_micros("us")).alias("jd"))


@query("t1_jd_to_datetime", _CAT + "SELECT norad_id, CAST(round((epoch_jd - 2440587.5) * 86400000000) AS BIGINT) AS us FROM c")
def _t1(spark, sf):
    return syn.catalog(spark, sf).select("norad_id", F.expr(f.micros_of_jd("epoch_jd")).alias("us"))


_U = "radians(mean_anomaly)"
_X, _Y, _Z = f.circular_position("a_km", "inclination", "raan", _U)
_LAT, _LON, _ALT = "(inclination - 90e0)", "(raan - 180e0)", "altitude_km"
_GX, _GY, _GZ = f.geodetic_to_ecef(_LAT, _LON, _ALT)
computed("g0_circular_position", "norad_id", {"x": _X, "y": _Y, "z": _Z})
computed("t5_gmst", "norad_id", {"gmst_rad": f.gmst_rad("epoch_jd")})
computed("t5_teme_to_ecef", "norad_id", dict(zip(("x", "y"), f.teme_to_ecef(_X, _Y, "epoch_jd"), strict=True)), 3)
computed("t7_geodetic_to_ecef", "norad_id", {"x": _GX, "y": _GY, "z": _GZ})
computed("t6_ecef_to_latitude", "norad_id", {"lat": f.ecef_to_latitude(_X, _Y, _Z)})
computed("t6_ecef_to_altitude", "norad_id", {"alt": f.ecef_to_altitude(_GX, _GY, _GZ, _LAT)}, 4)
computed("n9_bates_density", "norad_id", {"log_density": f"log10(greatest({f.bates_density('altitude_km', '150e0', '148e0', '15e0')}, 1e-30))"})
computed("n10_exponential_density", "norad_id", {"log_density": f"log10(greatest({f.exponential_density('altitude_km')}, 1e-30))"})
computed("n12_sun_position", "norad_id", dict(zip("xyz", f.sun_position("epoch_jd"), strict=True)), 3)
computed("m5_estimate_covariance", "norad_id", dict(zip(("sigma_r", "sigma_t", "sigma_n"), f.heuristic_sigma("(2460321.6e0 - epoch_jd)", "160e0"), strict=True)), 9)


@query("t7_round_trip_latitude", _CAT + "SELECT norad_id, round(inclination - 90, 4) AS lat FROM c")
def _t7(spark, sf):
    xyz = syn.catalog(spark, sf).selectExpr("norad_id", f"{_GX} AS gx", f"{_GY} AS gy", f"{_GZ} AS gz")
    return xyz.selectExpr("norad_id", f"round({f.ecef_to_latitude('gx', 'gy', 'gz')}, 4) + 0e0 AS lat")


@query("j9_space_weather_by_day", "WITH w AS (SELECT CAST(ts AS DATE) AS d, round(max(value), 6) AS f107 FROM events GROUP BY 1) SELECT event_id, coalesce(f107, 150) AS f107 FROM events LEFT JOIN w ON CAST(ts AS DATE) = d")
def _j9(spark, sf):
    e = syn.table(spark, sf, "events").withColumn("d", F.col("ts").cast("date"))
    w = e.groupBy("d").agg(F.round(F.max("value"), 6).alias("f107"))
    return lookups.daily(e.select("event_id", "d"), w, "d", {"f107": 150.0}).select("event_id", "f107")


@query("j10_eop_interpolation", """WITH t AS (SELECT l AS k, sin(l * 0.1e0) AS v FROM range(60310, 60331, 2) r(l)), n AS (SELECT k AS k0, v AS v0, lead(k) OVER (ORDER BY k) AS k1, lead(v) OVER (ORDER BY k) AS v1, row_number() OVER (ORDER BY k) AS i, count(*) OVER () AS m FROM t), e AS (SELECT c_custkey AS id, 60308e0 + (c_custkey * 17 % 2600) / 100e0 AS mjd FROM customer)
 SELECT id, round(v0 + (v1 - v0) * (mjd - k0) / (k1 - k0), 9) AS dut1 FROM e JOIN n ON k1 IS NOT NULL AND (i = 1 OR mjd >= k0) AND (i = m - 1 OR mjd < k1)""")
def _j10(spark, sf):
    t = spark.range(60310, 60331, 2).select(F.col("id").alias("k"), F.expr("sin(id * 0.1e0)").alias("dut1"))
    e = syn.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.expr("60308e0 + (c_custkey * 17 % 2600) / 100e0").alias("mjd"))
    return lookups.interpolate(e, t, "k", "mjd", "dut1").select("id", F.round("dut1", 9).alias("dut1"))


# ---------------------------------------------------------------- joins over space and time

_D = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"


@query("j1_range_self_join", _PTS + f"SELECT a.id AS id_a, b.id AS id_b, round({_D}, 6) AS dist FROM p a JOIN p b ON CAST(a.id AS VARCHAR) < CAST(b.id AS VARCHAR) AND {_D} <= 150.5")
def _j1(spark, sf):
    return rounded(spatial.range_self_join(syn.points(spark, sf), 150.5))


@query("j3_point_in_ball", _PTS + "SELECT id, round(sqrt((x - 100) * (x - 100) + (y + 50) * (y + 50) + (z - 25) * (z - 25)), 6) AS dist FROM p WHERE sqrt((x - 100) * (x - 100) + (y + 50) * (y + 50) + (z - 25) * (z - 25)) <= 900.5")
def _j3(spark, sf):
    return rounded(spatial.within_radius(syn.points(spark, sf), 100.0, -50.0, 25.0, 900.5).select("id", "dist"))


@query("a5_trajectory_envelope", _EPH + ", m AS (SELECT id, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM e GROUP BY id) SELECT id, round(mx, 4) AS mx, round(my, 4) AS my, round(mz, 4) AS mz, round(max(sqrt((x - mx) * (x - mx) + (y - my) * (y - my) + (z - mz) * (z - mz))), 4) AS excursion FROM e JOIN m USING (id) GROUP BY id, mx, my, mz")
def _a5(spark, sf):
    return rounded(spatial.envelope(syn.ephemeris(spark, sf)), digits=4)


@query("a4_closest_samples", _EPH + f", p AS (SELECT a.id AS id_a, b.id AS id_b, a.step, {_D} AS dist FROM e a JOIN e b ON a.step = b.step AND CAST(a.id AS VARCHAR) < CAST(b.id AS VARCHAR)) SELECT id_a, id_b, step, round(dist, 6) AS dist FROM p QUALIFY row_number() OVER (PARTITION BY id_a, id_b ORDER BY dist, step) = 1 AND p.dist <= 500.5")
def _a4(spark, sf):
    return rounded(spatial.closest_samples(syn.ephemeris(spark, sf), 500.5))


@query("w1_proximity_islands", "WITH o AS (SELECT user_id, event_id, value > 50 AS on_, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events), g AS (SELECT user_id, event_id, i - row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM o WHERE on_) SELECT user_id, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM g GROUP BY user_id, run")
def _w1(spark, sf):
    return spatial.islands(syn.table(spark, sf, "events"), "user_id", "event_id", F.col("value") > 50)


# ---------------------------------------------------------------- burns

_PLAN = "SELECT c_custkey AS id, 6578e0 + (c_custkey * 13) % 2000 AS r1, 8600e0 + (c_custkey * 29) % 30000 AS r2, 1e0 + c_custkey % 60 AS di, 300e0 AS isp, 500e0 + c_custkey % 1000 AS mass, 10e0 AS thrust, 2460000.5e0 AS t0 FROM customer"


def _plans(spark, sf):
    return syn.table(spark, sf, "customer").selectExpr(*(x.strip() for x in _PLAN.removeprefix("SELECT ").removesuffix(" FROM customer").split(", ")))


_SPENT = "mass * exp(-spent * 1000 / (isp * 9.80665)) * (1 - exp(-abs(dv) * 1000 / (isp * 9.80665)))"
_BURNS = f"""SELECT id, seq, round(abs(dv), 8) AS dv_km_s, CAST(sign(dv) AS INTEGER) AS along, round({_SPENT}, 6) AS propellant_kg, round({_SPENT} * isp * 9.80665 / thrust, 4) AS duration_s,
 round(middle - {_SPENT} * isp * 9.80665 / thrust / 2, 3) AS ignition_s FROM u"""
_HOHMANN = f"""WITH p AS ({_PLAN}), v AS (SELECT *, sqrt(398600.4418 * (2 / r1 - 2 / (r1 + r2))) - sqrt(398600.4418 / r1) AS d1, sqrt(398600.4418 / r2) - sqrt(398600.4418 * (2 / r2 - 2 / (r1 + r2))) AS d2, pi() * sqrt(power((r1 + r2) / 2, 3) / 398600.4418) AS h FROM p),
 u AS (SELECT *, unnest([1, 2]) AS seq, unnest([d1, d2]) AS dv, unnest([0, abs(d1)]) AS spent, unnest([0, h]) AS middle FROM v) {_BURNS}"""


def _burns_shown(b: DataFrame) -> DataFrame:
    at = F.round("ignition_s", 3).alias("ignition_s")
    return b.select("id", "seq", F.round("dv_km_s", 8).alias("dv_km_s"), "along", F.round("propellant_kg", 6).alias("propellant_kg"), F.round("duration_s", 4).alias("duration_s"), at)


@query("b1_hohmann", _HOHMANN)
def _b1(spark, sf):
    return _burns_shown(burn_ops.hohmann(_plans(spark, sf)))


@query("b3_inclination_change", f"WITH p AS ({_PLAN}), v AS (SELECT *, 2 * sqrt(398600.4418 / r1) * abs(sin(radians(di) / 2)) AS dv FROM p) SELECT id, round(dv, 8) AS dv_km_s, round(mass - mass * exp(-dv * 1000 / (isp * 9.80665)), 6) AS propellant_kg, 1 AS normal_sign FROM v")
def _b3(spark, sf):
    return burn_ops.plane_change(_plans(spark, sf)).select("id", F.round("dv_km_s", 8).alias("dv_km_s"), F.round("propellant_kg", 6).alias("propellant_kg"), "normal_sign")


@query("a7_delta_v_budget", _BURN + ", r AS (SELECT *, 2e0 / (300 * 9.80665) * (stop - start) AS prop FROM b), s AS (SELECT *, 5000 - sum(prop) OVER (PARTITION BY sat ORDER BY id ROWS UNBOUNDED PRECEDING) AS after FROM r) SELECT id, round(prop, 6) AS propellant_kg, round(after, 6) AS mass_after_kg, round(300 * 9.80665 * ln((after + prop) / after), 6) AS dv_m_s FROM s")
def _a7(spark, sf):
    b = syn.burns(spark, sf).selectExpr("sat", "id", "2e0 AS thrust", "300e0 AS isp", "stop - start AS duration_s", "5000e0 AS initial_kg")
    return rounded(burn_ops.budget(b, "sat", "id").select("id", "propellant_kg", "mass_after_kg", "dv_m_s"))


@query("w5_burn_overlap", _BURN + ", n AS (SELECT *, lead(start) OVER (PARTITION BY sat ORDER BY start, id) AS next_start FROM b) SELECT id, next_start FROM n WHERE next_start < stop")
def _w5(spark, sf):
    return burn_ops.overlaps(syn.burns(spark, sf), "sat").select("id", "next_start")


@query("w6_timeline_segments", _BURN + """, k AS (SELECT sat, id, greatest(3600, least(72000, start)) AS start, greatest(3600, least(72000, stop)) AS stop FROM b), m AS (SELECT *, coalesce(max(stop) OVER (PARTITION BY sat ORDER BY start, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 3600) AS before, lead(id) OVER (PARTITION BY sat ORDER BY start, id) IS NULL AS last FROM k),
 s AS (SELECT sat, before AS start, greatest(start, before) AS stop, false AS burn FROM m UNION ALL SELECT sat, greatest(start, before), greatest(stop, before), true FROM m UNION ALL SELECT sat, greatest(stop, before), 72000, false FROM m WHERE last) SELECT * FROM s WHERE stop > start""")
def _w6(spark, sf):
    return burn_ops.segments(syn.burns(spark, sf), "sat", 3600, 72000)


def staged(name: str, stages: list[dict[str, str]], out: dict[str, str], digits: int = 6) -> None:
    """A projection of the catalog in stages of formula text. Its SQL is in ``oracles``."""
    items = ["norad_id", *(f"round({e}, {digits}) AS {c}" for c, e in out.items())]
    QUERIES[name] = lambda spark, sf: geo.extend(syn.catalog(spark, sf), stages).selectExpr(*items)


# ---------------------------------------------------------------- frames, elements, forces, probability

_PX, _PY, _PZ = f.circular_position("1.05e0 * sqrt(398600.4418e0 / a_km)", "inclination", "raan", "(radians(mean_anomaly) + 0.5e0 * pi() - 0.02e0)")
_STATE = [{"x": _X, "y": _Y, "z": _Z, "vx": _PX, "vy": _PY, "vz": _PZ}]
_same = lambda *names: {c: c for c in names}
staged("t11_rtn_axes", [*_STATE, *geo.RTN], _same(*(f"{p}_{a}" for p in "rtn" for a in "xyz")))
staged("t11_vnb_axes", [*_STATE, *geo.VNB], _same(*(f"{p}_{a}" for p in "vnb" for a in "xyz")))
staged("t12_thrust_to_inertial", [*_STATE, *geo.VNB, *geo.to_inertial(("v_", "n_", "b_"), ("0.6e0", "0e0", "0.8e0"))], _same("i_x", "i_y", "i_z"))
staged("d2_orbital_elements", [*_STATE, *geo.elements()], {"a": "el_a", "e": "el_e", "i": "el_i", "argp_sin": "sin(radians(el_argp))", "raan_cos": "cos(radians(el_raan))", "nu_cos": "cos(radians(el_nu))"}, 5)
_SR, _ST, _SN = f.heuristic_sigma("(2460321.6e0 - epoch_jd)", "160e0")
_SIGMA = [{"sig_r": _SR, "sig_t": _ST, "sig_n": _SN}]
_LOCAL = [["sig_r * sig_r", "", ""], ["", "sig_t * sig_t", ""], ["", "", "sig_n * sig_n"]]
staged("m6_rotate_covariance", [*_STATE, *geo.RTN, *_SIGMA, *geo.rotate_covariance(("r_", "t_", "n_"), _LOCAL)], _same("cxx", "cxy", "cxz", "cyy", "cyz", "czz"))
_MEET = [{"mx": "0.02e0 * (ordinal % 40)", "my": "0.3e0 * sin(ordinal)", "mz": "0.1e0 * cos(ordinal)", "ux": "vx", "uy": "vy - 7e0", "uz": "vz + 2e0", "cxx": "0.2e0 + 0.01e0 * (ordinal % 7)", "cxy": "0.03e0", "cxz": "-0.02e0", "cyy": "0.3e0 + 0.02e0 * (ordinal % 5)", "cyz": "0.01e0", "czz": "0.25e0"}]
QUERIES["m1_collision_probability"] = lambda spark, sf: geo.extend(syn.catalog(spark, sf), [*_STATE, *_MEET, *geo.collision_probability("0.01e0")]).selectExpr("norad_id", "round(m2, 6) AS m2", "round(log10(pc), 4) AS log_pc")
computed("n12_moon_position", "norad_id", dict(zip("xyz", geo.moon_position("epoch_jd"), strict=True)), 2)
_SUN = dict(zip(("sx", "sy", "sz"), f.sun_position("epoch_jd"), strict=True))
staged("n11_illumination", [*_STATE, _SUN, *geo.illumination()], _same("nu"))
staged("n4_zonal_acceleration", [*_STATE, *geo.gravity()], {c: f"a{c} * 1e6" for c in "xyz"})
computed("n13_scale_height", "norad_id", {"height_km": geo.scale_height_km("(70e0 + ordinal % 180)", "(80e0 + ordinal % 160)", "(ordinal % 50)")}, 4)
computed("n7_process_noise", "norad_id", geo.process_noise("1e-3", "(1e0 + ordinal % 600)"))
computed("d6_projected_area", "norad_id", {"area_m2": geo.projected_area_m2("3e0", "(1e0 + ordinal % 4)", "2e0", [("1e0", "0e0", "0e0"), ("0e0", "1e0", "0e0"), ("0e0", "0e0", "1e0")], ("cos(radians(raan))", "sin(radians(raan)) * 0.6e0", "sin(radians(raan)) * 0.8e0"))})
_PAIR = {"lat1": "(inclination - 90e0) * 0.9e0", "lon1": "raan - 180e0", "lat2": "(argp - 180e0) * 0.4e0", "lon2": "mean_anomaly * 0.3e0 - 50e0"}
QUERIES["t10_vincenty_distance"] = lambda spark, sf: geo.extend(syn.catalog(spark, sf), [_PAIR, *geo.vincenty(*_PAIR)]).selectExpr("norad_id", "round(dist_km, 3) AS dist_km")
_TX, _TY = f.teme_to_ecef("x", "y", "epoch_jd")
_TRACK = [*_STATE, {"ex": _TX, "ey": _TY}, {"lat": f.ecef_to_latitude("ex", "ey", "z"), "lon": "degrees(atan2(ey, ex))"}, {"alt": f.ecef_to_altitude("ex", "ey", "z", "lat")}]
staged("t9_ground_track", _TRACK, {"lat": "lat", "alt": "alt", "lon_cos": "cos(radians(lon))"}, 3)
_LOOK = [*_STATE, {"ex": _TX, "ey": _TY, "ez": "z"}, *geo.look_angles("12.97e0", "77.59e0", "0.92e0")]
staged("v1_elevation", _LOOK, _same("elevation"), 5)
staged("v2_azimuth", _LOOK, {"azimuth_cos": "cos(radians(azimuth))", "azimuth_sin": "sin(radians(azimuth))"}, 6)


@query("w2_passes")
def _w2(spark, sf):
    where = syn.table(spark, sf, "supplier").selectExpr("s_suppkey AS id", "(s_nationkey * 7 % 120) - 60e0 AS lat", "s_nationkey * 14e0 - 170e0 AS lon", "0.1e0 AS height_km")
    e = syn.ephemeris(spark, sf).withColumn("t_jd", F.expr("2460310.5e0 + step / 288e0")).join(where, "id")
    return passes.passes(passes.look(e), "id", "step", 5.0).select("id", "first", "last", "n", "best", F.round("max_elevation", 4).alias("max_elevation"))


@query("b2_bielliptic", f"""WITH p AS ({_PLAN}), q AS (SELECT *, 2 * r2 AS rb FROM p), v AS (SELECT *, sqrt(398600.4418 * (2 / r1 - 2 / (r1 + rb))) - sqrt(398600.4418 / r1) AS d1, sqrt(398600.4418 * (2 / rb - 2 / (r2 + rb))) - sqrt(398600.4418 * (2 / rb - 2 / (r1 + rb))) AS d2, sqrt(398600.4418 / r2) - sqrt(398600.4418 * (2 / r2 - 2 / (r2 + rb))) AS d3,
 pi() * sqrt(power((r1 + rb) / 2, 3) / 398600.4418) AS h1, pi() * sqrt(power((rb + r2) / 2, 3) / 398600.4418) AS h2 FROM q),
 u AS (SELECT *, unnest([1, 2, 3]) AS seq, unnest([d1, d2, d3]) AS dv, unnest([0, abs(d1), abs(d1) + abs(d2)]) AS spent, unnest([0, h1, h1 + h2]) AS middle FROM v) {_BURNS}""")
def _b2(spark, sf):
    return _burns_shown(burn_ops.bielliptic(_plans(spark, sf).withColumn("rb", F.expr("2e0 * r2"))))


@query("b5_thrust_acceleration")
def _b5(spark, sf):
    c = geo.extend(syn.catalog(spark, sf), _STATE).withColumns({"thrust": F.lit(12.0), "mass_kg": F.expr("400e0 + ordinal"), "dx": F.lit(0.6), "dy": F.lit(0.0), "dz": F.lit(0.8)})
    return rounded(burn_ops.thrust_acceleration(c).select("norad_id", "ax", "ay", "az"), digits=9)


@query("b4_validate_burn", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN 'DURATION' WHEN o_orderkey % 13 = 0 THEN 'THRUST' WHEN o_orderkey % 17 = 0 THEN 'ISP' WHEN o_orderkey % 19 = 0 THEN 'DIRECTION' WHEN 400 / (300 * 9.80665) * (60 + o_orderkey % 3000) > 200 THEN 'MASS' END AS reason FROM orders")
def _b4(spark, sf):
    o = syn.table(spark, sf, "orders").selectExpr("o_orderkey AS id", "CASE WHEN o_orderkey % 11 = 0 THEN 0e0 ELSE 60e0 + o_orderkey % 3000 END AS duration_s", "CASE WHEN o_orderkey % 13 = 0 THEN -1e0 ELSE 400e0 END AS thrust", "CASE WHEN o_orderkey % 17 = 0 THEN 0e0 ELSE 300e0 END AS isp", "CASE WHEN o_orderkey % 19 = 0 THEN 0.5e0 ELSE 0.6e0 END AS dx", "0e0 AS dy", "0.8e0 AS dz", "200e0 AS mass")
    return burn_ops.validate(o).select("id", "reason")


@query("s11_cdm_round_trip", _CAT + "SELECT 'M' || norad_id AS message_id, CASE WHEN ordinal % 9 = 0 THEN 'BOUNDS_VIOLATION' END AS reason, round(CASE WHEN ordinal % 9 = 0 THEN -1 ELSE ordinal % 5000 / 8 END, 4) AS miss_m, CASE WHEN ordinal % 4 > 0 THEN (ordinal % 1000) / 1024e0 END AS pc, round(a_km, 6) AS x_1, round(-a_km, 6) AS x_2, CASE WHEN ordinal % 2 = 0 THEN 2e0 * (ordinal % 64) END AS cov_1, 5e0 AS cov_2 FROM c")
def _s11(spark, sf):
    thing = lambda label, sign, cov: F.expr(f"struct('{label}' AS designator, 'SAT {label}' AS name, array({sign} * a_km, 0e0, 0e0, 0e0, 7.5e0, 0e0) AS state, {cov} AS covariance)")
    c = syn.catalog(spark, sf).select(
        F.concat(F.lit("M"), "norad_id").alias("message_id"), F.lit("2024-01-01T00:00:00.000Z").alias("creation"), F.lit("2024-01-02T00:00:00.000Z").alias("tca"), F.expr("CASE WHEN ordinal % 9 = 0 THEN -1e0 ELSE (ordinal % 5000) / 8e0 END").alias("miss_m"), F.lit(14500.0).alias("speed_m_s"), F.expr("CASE WHEN ordinal % 4 > 0 THEN (ordinal % 1000) / 1024e0 END").alias("pc"),
        thing("A", 1, "CASE WHEN ordinal % 2 = 0 THEN transform(sequence(0, 20), i -> 2e0 * (ordinal % 64)) END").alias("object_1"), thing("B", -1, "transform(sequence(0, 20), i -> 5e0)").alias("object_2"),
    )
    out = cdm.parse_kvn(cdm.export_kvn(c, "ORBITFOLD").select("kvn"))
    return out.selectExpr("message_id", "reason", "round(miss_m, 4) AS miss_m", "round(pc * 1024e0) / 1024e0 AS pc", "object_1.state[0] AS x_1", "object_2.state[0] AS x_2", "object_1.covariance[2] AS cov_1", "object_2.covariance[20] AS cov_2")


@query("x1_event_sessions", "WITH o AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 1 HOUR, true) AS fresh FROM events), g AS (SELECT user_id, ts, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM o) SELECT user_id, epoch_us(min(ts)) AS start, epoch_us(max(ts)) + 3600000000 AS stop, count(*) AS n FROM g GROUP BY user_id, run")
def _x1(spark, sf):
    e = syn.table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return sessions.sessions(e, "user_id", "ts", "1 hour").select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("stop").alias("stop"), "n")


ORACLE_SQL.update(oracles.SQL)
