"""DuckDB SQL of the formula queries, written apart from ``orbitfold.functions``.

Where there is one, another form is taken: rotations one after the other, Gram-Schmidt instead of cross products, the
reduced latitude, closed Legendre polynomials, the encounter plane without a basis, recursion for Vincenty's rounds.
"""

from __future__ import annotations

from . import synthetic as syn

CATALOG = f"""WITH RECURSIVE c0 AS (SELECT {syn.CATALOG} FROM customer),
 c1 AS (SELECT *, cbrt(398600.4418 / power(mean_motion * pi() / 43200, 2)) AS a_km, 1440 / mean_motion AS period_minutes FROM c0),
 c AS (SELECT *, a_km - 6378.137 AS altitude_km FROM c1)"""
#: A state: the position on the circle, turned by inclination and node, and a velocity a little off the tangent.
STATE = f"""{CATALOG},
 r0 AS (SELECT *, radians(mean_anomaly) AS u, radians(inclination) AS i, radians(raan) AS w FROM c),
 r1 AS (SELECT *, a_km * cos(u) AS p0, a_km * sin(u) * cos(i) AS q0, a_km * sin(u) * sin(i) AS z, 1.05e0 * sqrt(398600.4418 / a_km) AS sp, u + pi() / 2 - 0.02e0 AS u2 FROM r0),
 s AS (SELECT *, p0 * cos(w) - q0 * sin(w) AS x, p0 * sin(w) + q0 * cos(w) AS y, sp * (cos(u2) * cos(w) - sin(u2) * cos(i) * sin(w)) AS vx, sp * (cos(u2) * sin(w) + sin(u2) * cos(i) * cos(w)) AS vy, sp * sin(u2) * sin(i) AS vz FROM r1)"""
#: Radial, transverse (what of the velocity is across the radius) and normal.
RTN = f"""{STATE},
 t0 AS (SELECT *, sqrt(x * x + y * y + z * z) AS rn, x * vx + y * vy + z * vz AS rv FROM s),
 t1 AS (SELECT *, vx - rv * x / (rn * rn) AS gx, vy - rv * y / (rn * rn) AS gy, vz - rv * z / (rn * rn) AS gz FROM t0),
 t2 AS (SELECT *, x / rn AS r_x, y / rn AS r_y, z / rn AS r_z, sqrt(gx * gx + gy * gy + gz * gz) AS gn FROM t1),
 t3 AS (SELECT *, gx / gn AS t_x, gy / gn AS t_y, gz / gn AS t_z FROM t2),
 f AS (SELECT *, r_y * t_z - r_z * t_y AS n_x, r_z * t_x - r_x * t_z AS n_y, r_x * t_y - r_y * t_x AS n_z FROM t3)"""
#: Velocity, normal, and what of the radius is across the velocity.
VNB = f"""{STATE},
 t0 AS (SELECT *, sqrt(vx * vx + vy * vy + vz * vz) AS vn, x * vx + y * vy + z * vz AS rv FROM s),
 t1 AS (SELECT *, x - rv * vx / (vn * vn) AS gx, y - rv * vy / (vn * vn) AS gy, z - rv * vz / (vn * vn) AS gz FROM t0),
 t2 AS (SELECT *, vx / vn AS v_x, vy / vn AS v_y, vz / vn AS v_z, sqrt(gx * gx + gy * gy + gz * gz) AS gn FROM t1),
 t3 AS (SELECT *, gx / gn AS b_x, gy / gn AS b_y, gz / gn AS b_z FROM t2),
 f AS (SELECT *, b_y * v_z - b_z * v_y AS n_x, b_z * v_x - b_x * v_z AS n_y, b_x * v_y - b_y * v_x AS n_z FROM t3)"""


def turn(jd: str) -> str:
    """Sidereal angle as a share of a turn, less whole turns."""
    t = f"(({jd} - 2451545) / 36525)"
    days = f"((67310.54841e0 + 3164400184.812866e0 * {t} + 0.093104e0 * {t} * {t} - 6.2e-6 * {t} * {t} * {t}) / 86400)"
    return f"(2 * pi() * ({days} - floor({days})))"


def sun(jd: str) -> str:
    """Columns of the Sun: distance, longitude, obliquity."""
    t = f"(({jd} - 2451545) / 36525)"
    m = f"radians(357.5291092e0 + 35999.0502909e0 * {t})"
    return f"149597870.7e0 * (1.00014e0 - 0.01671e0 * cos({m}) - 0.00014e0 * cos(2 * {m})) AS sr, radians(280.46646e0 + 36000.76983e0 * {t} + 1.9146e0 * sin({m}) + 0.02e0 * sin(2 * {m})) AS sl, radians(23.439291e0 - 0.0130042e0 * {t}) AS so"


def moon(jd: str) -> str:
    t = f"(({jd} - 2451545) / 36525)"
    angle = lambda a, b: f"radians({a}e0 + {b}e0 * {t})"
    m, s, d, u = angle("134.9634", "477198.8676"), angle("357.5291", "35999.0503"), angle("297.8502", "445267.1115"), angle("93.2720", "483202.0175")
    return (
        f"385000.56e0 - 20905.36e0 * cos({m}) - 3699.11e0 * cos(2 * {d} - {m}) - 2955.97e0 * cos(2 * {d}) AS mr,"
        f" radians(218.3165e0 + 481267.8813e0 * {t} + 6.289e0 * sin({m}) - 1.274e0 * sin(2 * {d} - {m}) + 0.658e0 * sin(2 * {d}) - 0.214e0 * sin(2 * {m}) - 0.186e0 * sin({s})) AS ml,"
        f" radians(5.128e0 * sin({u}) + 0.281e0 * sin({m} + {u}) - 0.278e0 * sin({u} - {m})) AS mb, radians(23.439291e0 - 0.0130042e0 * {t}) AS mo"
    )


def temperature(z: str, top: str) -> str:
    return f"(CASE WHEN {z} > 120 THEN {top} + (380 - {top}) * exp(-0.02e0 * ({z} - 120) * 6498.137e0 / (6378.137e0 + {z})) ELSE 380e0 END)"


def scale(z: str, t: str) -> str:
    return f"(8.314462618e-3 * {t} / ((0.004e0 + 0.024e0 * exp((120 - {z}) / 160)) * 9.80665e0 * power(6378.137e0 / (6378.137e0 + {z}), 2)))"


def density(z: str, top: str) -> str:
    """Of the profile with the exospheric temperature ``top``."""
    base = f"3.7e-12 * exp(280 / {scale('400e0', temperature('400e0', '948e0'))} - 280 / {scale('400e0', temperature('400e0', top))})"
    return f"(CASE WHEN {z} BETWEEN 100 AND 1500 THEN greatest(1e-20, {base} * {temperature('400e0', top)} / {temperature(z, top)} * exp((400 - {z}) / {scale(z, temperature(z, top))})) ELSE 0e0 END)"


def top(f107: str, mean: str, ap: str) -> str:
    return f"least(2500e0, greatest(500e0, 379 + 3.24e0 * {mean} + 1.3e0 * ({f107} - {mean}) + 28 * power({ap}, 0.4e0)))"


E2, EP2, B = "0.0066943799901413165e0", "0.006739496742276434e0", "6356.752314245179e0"


def latitude(x: str, y: str, z: str) -> str:
    u = f"atan2({z} * 6378.137e0, sqrt({x} * {x} + {y} * {y}) * {B})"
    return f"degrees(atan2({z} + {EP2} * {B} * sin({u}) * sin({u}) * sin({u}), sqrt({x} * {x} + {y} * {y}) - {E2} * 6378.137e0 * cos({u}) * cos({u}) * cos({u})))"


def altitude(x: str, y: str, z: str, lat: str) -> str:
    n = f"(6378.137e0 / sqrt(1 - {E2} * sin(radians({lat})) * sin(radians({lat}))))"
    return f"(CASE WHEN abs({lat}) <= 80 THEN sqrt({x} * {x} + {y} * {y}) / cos(radians({lat})) - {n} ELSE abs({z} / sin(radians({lat}))) - {n} + {n} * {E2} END)"


def place(lat: str, lon: str, h: str) -> str:
    """Columns gx, gy, gz of a point by its reduced latitude."""
    b = f"atan({B} / 6378.137e0 * tan(radians({lat})))"
    flat = f"(6378.137e0 * cos({b}) + {h} * cos(radians({lat})))"
    return f"{flat} * cos(radians({lon})) AS gx, {flat} * sin(radians({lon})) AS gy, {B} * sin({b}) + {h} * sin(radians({lat})) AS gz"


def outputs(names, digits: int = 6) -> str:
    return ", ".join(f"round({e}, {digits}) + 0e0 AS {n}" for n, e in (names.items() if isinstance(names, dict) else ((n, n) for n in names)))


_SUN_XYZ = {"x": "sr * cos(sl)", "y": "sr * cos(so) * sin(sl)", "z": "sr * sin(so) * sin(sl)"}
_AGE, _F = "greatest(0.1e0, abs(2460321.6e0 - epoch_jd))", "(160e0 / 150e0)"
_SIGMA = f"least(50e0, 0.01e0 + 0.02e0 * {_AGE} * {_AGE}) AS sr_, CASE WHEN {_AGE} > 7 THEN least(100e0, 5 + 0.5e0 * {_F} * ({_AGE} - 7) * ({_AGE} - 7)) ELSE least(5e0, 0.1e0 + 0.3e0 * {_F} * {_AGE}) END AS st_, least(20e0, 0.01e0 + 0.05e0 * {_AGE}) AS sn_"
_COV = {f"c{a}{b}": f"sr_ * sr_ * r_{a} * r_{b} + st_ * st_ * t_{a} * t_{b} + sn_ * sn_ * n_{a} * n_{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")}

SQL: dict[str, str] = {
    "d3_orbit_period": f"{CATALOG} SELECT norad_id, CASE WHEN mean_motion > 2 THEN round(1440 / (mean_motion - 2), 6) ELSE CAST('Infinity' AS DOUBLE) END AS period FROM c",
    "d4_risk_class": f"{CATALOG} SELECT norad_id, CASE WHEN p <= 1e-6 THEN 'LOW' WHEN p <= 1e-5 THEN 'MEDIUM' WHEN p <= 1e-4 THEN 'HIGH' ELSE 'CRITICAL' END AS risk_class FROM (SELECT norad_id, eccentricity * inclination * 1e-6 AS p FROM c)",
    "d5_dynamic_radius": f"""{CATALOG} SELECT norad_id, round(CASE ordinal % 4 WHEN 0 THEN sqrt((l * k + k * 1.5e0 + 1.5e0 * l) / (2 * pi())) WHEN 1 THEN sqrt((1 + ordinal % 9) / pi()) WHEN 2 THEN 3 ELSE 5 END / 1000, 9) AS radius_km
 FROM (SELECT *, 2e0 + ordinal % 7 AS l, 3e0 + ordinal % 3 AS k FROM c)""",
    "d7_covariance_source": f"""{CATALOG} SELECT norad_id, CASE WHEN 'UNAVAILABLE' IN (a, b) THEN 'UNAVAILABLE' WHEN a <> b THEN 'MIXED(' || a || '+' || b || ')' ELSE a END AS source_class
 FROM (SELECT norad_id, ['CDM', 'SYNTHETIC', 'UNAVAILABLE'][ordinal % 3 + 1] AS a, ['CDM', 'SYNTHETIC', 'COMSPOC_SYNTHETIC', 'UNAVAILABLE'][ordinal % 4 + 1] AS b FROM c)""",
    "g0_circular_position": f"{STATE} SELECT norad_id, {outputs('xyz')} FROM s",
    "t5_gmst": f"{CATALOG} SELECT norad_id, round({turn('epoch_jd')}, 6) AS gmst_rad FROM c",
    "t5_teme_to_ecef": f"{STATE} SELECT norad_id, {outputs({'x': 'd * cos(l - g)', 'y': 'd * sin(l - g)'}, 3)} FROM (SELECT norad_id, sqrt(x * x + y * y) AS d, atan2(y, x) AS l, {turn('epoch_jd')} AS g FROM s)",
    "t7_geodetic_to_ecef": f"{CATALOG} SELECT norad_id, {outputs({'x': 'gx', 'y': 'gy', 'z': 'gz'})} FROM (SELECT norad_id, {place('(inclination - 90)', '(raan - 180)', 'altitude_km')} FROM c)",
    "t6_ecef_to_latitude": f"{STATE} SELECT norad_id, round({latitude('x', 'y', 'z')}, 6) + 0e0 AS lat FROM s",
    "t6_ecef_to_altitude": f"{CATALOG} SELECT norad_id, round({altitude('gx', 'gy', 'gz', '(inclination - 90)')}, 4) + 0e0 AS alt FROM (SELECT *, {place('(inclination - 90)', '(raan - 180)', 'altitude_km')} FROM c)",
    "n9_bates_density": f"{CATALOG} SELECT norad_id, round(log10(greatest(1e-30, {density('altitude_km', top('150e0', '148e0', '15e0'))})), 6) AS log_density FROM c",
    "n10_exponential_density": f"{CATALOG} SELECT norad_id, round(CASE WHEN altitude_km BETWEEN 100 AND 1500 THEN greatest(-30e0, log10(3.725e-12) + (400 - altitude_km) / 58.515e0 / ln(10)) ELSE -30 END, 6) AS log_density FROM c",
    "n12_sun_position": f"{CATALOG} SELECT norad_id, {outputs(_SUN_XYZ, 3)} FROM (SELECT norad_id, {sun('epoch_jd')} FROM c)",
    "n12_moon_position": f"{CATALOG} SELECT norad_id, {outputs({'x': 'mr * cos(mb) * cos(ml)', 'y': 'mr * (cos(mo) * cos(mb) * sin(ml) - sin(mo) * sin(mb))', 'z': 'mr * (sin(mo) * cos(mb) * sin(ml) + cos(mo) * sin(mb))'}, 2)} FROM (SELECT norad_id, {moon('epoch_jd')} FROM c)",
    "m5_estimate_covariance": f"{CATALOG} SELECT norad_id, round(sr_, 9) AS sigma_r, round(st_, 9) AS sigma_t, round(sn_, 9) AS sigma_n FROM (SELECT norad_id, {_SIGMA} FROM c)",
    "t11_rtn_axes": f"{RTN} SELECT norad_id, {outputs([f'{p}_{a}' for p in 'rtn' for a in 'xyz'])} FROM f",
    "t11_vnb_axes": f"{VNB} SELECT norad_id, {outputs([f'{p}_{a}' for p in 'vnb' for a in 'xyz'])} FROM f",
    "t12_thrust_to_inertial": f"{VNB} SELECT norad_id, {outputs({f'i_{a}': f'0.6e0 * v_{a} + 0.8e0 * b_{a}' for a in 'xyz'})} FROM f",
    "b5_thrust_acceleration": f"{VNB} SELECT norad_id, {outputs({f'a{a}': f'(0.6e0 * v_{a} + 0.8e0 * b_{a}) * 12 / (400 + ordinal) / 1000'  for a in 'xyz'}, 9)} FROM f",
    "d2_orbital_elements": f"""{RTN}, e0 AS (SELECT *, vx * vx + vy * vy + vz * vz AS v2, rn * gn AS h FROM f),
 e1 AS (SELECT *, (v2 / 398600.4418 - 1 / rn) * x - rv / 398600.4418 * vx AS ex, (v2 / 398600.4418 - 1 / rn) * y - rv / 398600.4418 * vy AS ey, (v2 / 398600.4418 - 1 / rn) * z - rv / 398600.4418 * vz AS ez FROM e0),
 e2 AS (SELECT *, sqrt(ex * ex + ey * ey + ez * ez) AS ecc, sqrt(n_x * n_x + n_y * n_y) AS si FROM e1)
 SELECT norad_id, {outputs({'a': '398600.4418 / (2 * 398600.4418 / rn - v2)', 'e': 'ecc', 'i': 'degrees(atan2(si, n_z))', 'argp_sin': 'CASE WHEN si < 1e-10 THEN ey / ecc ELSE ez / (ecc * si) END', 'raan_cos': 'CASE WHEN si < 1e-10 THEN 1 ELSE -n_y / si END', 'nu_cos': '(ex * x + ey * y + ez * z) / (ecc * rn)'}, 5)} FROM e2""",
    "m6_rotate_covariance": f"{RTN} SELECT norad_id, {outputs(_COV)} FROM (SELECT *, {_SIGMA} FROM f)",
    "m1_collision_probability": f"""{STATE}, a0 AS (SELECT norad_id, 0.02e0 * (ordinal % 40) AS mx, 0.3e0 * sin(ordinal) AS my, 0.1e0 * cos(ordinal) AS mz, vx AS ux, vy - 7 AS uy, vz + 2 AS uz, 0.2e0 + 0.01e0 * (ordinal % 7) AS a, 0.03e0 AS b, -0.02e0 AS d, 0.3e0 + 0.02e0 * (ordinal % 5) AS e, 0.01e0 AS g, 0.25e0 AS k FROM s),
 a1 AS (SELECT *, sqrt(ux * ux + uy * uy + uz * uz) AS un FROM a0), a2 AS (SELECT * REPLACE (ux / un AS ux, uy / un AS uy, uz / un AS uz) FROM a1),
 a3 AS (SELECT *, uy * mz - uz * my AS jx, uz * mx - ux * mz AS jy, ux * my - uy * mx AS jz, ux * ux * (e * k - g * g) + uy * uy * (a * k - d * d) + uz * uz * (a * e - b * b) + 2 * ux * uy * (d * g - b * k) + 2 * ux * uz * (b * g - d * e) + 2 * uy * uz * (b * d - a * g) AS det, a + e + k - (a * ux * ux + e * uy * uy + k * uz * uz + 2 * b * ux * uy + 2 * d * ux * uz + 2 * g * uy * uz) AS tr FROM a2),
 a4 AS (SELECT *, a * jx + b * jy + d * jz AS qx, b * jx + e * jy + g * jz AS qy, d * jx + g * jy + k * jz AS qz FROM a3),
 a5 AS (SELECT *, (jx * qx + jy * qy + jz * qz) / det AS m2, (qx * qx + qy * qy + qz * qz - power(qx * ux + qy * uy + qz * uz, 2)) / (det * det) AS grad FROM a4)
 SELECT norad_id, round(m2, 6) AS m2, round(log10(1e-4 / (2 * sqrt(det)) * exp(-m2 / 2) * CASE WHEN m2 < 4 THEN 1 + 1e-4 / 8 * (grad - tr / det) ELSE 1 END), 4) AS log_pc FROM a5""",
    "n11_illumination": f"""{STATE}, i0 AS (SELECT *, {sun('epoch_jd')} FROM s), i1 AS (SELECT norad_id, x, y, z, {_SUN_XYZ['x']} - x AS dx, {_SUN_XYZ['y']} - y AS dy, {_SUN_XYZ['z']} - z AS dz FROM i0),
 i2 AS (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS dn, sqrt(x * x + y * y + z * z) AS rn FROM i1), i3 AS (SELECT norad_id, asin(695700e0 / dn) AS a, asin(least(1e0, 6378.137e0 / rn)) AS b, acos(greatest(-1e0, least(1e0, -(x * dx + y * dy + z * dz) / (rn * dn)))) AS c FROM i2),
 i4 AS (SELECT *, CASE WHEN c < a + b AND c > abs(a - b) THEN a * a * acos((c * c + a * a - b * b) / (2 * c * a)) + b * b * acos((c * c + b * b - a * a) / (2 * c * b)) - sqrt((a + b - c) * (c + a - b) * (c - a + b) * (a + b + c)) / 2 END AS lens FROM i3)
 SELECT norad_id, round(CASE WHEN c >= a + b THEN 1 WHEN c <= b - a THEN 0 WHEN c <= a - b THEN 1 - b * b / (a * a) ELSE 1 - lens / (pi() * a * a) END, 6) AS nu FROM i4""",
    "n4_zonal_acceleration": f"""{STATE}, g0 AS (SELECT *, sqrt(x * x + y * y + z * z) AS r FROM s), g1 AS (SELECT *, z / r AS q, 6378.137e0 / r AS k, 398600.4418e0 / (r * r) AS m FROM g0),
 g2 AS (SELECT *, 1.08262668e-3 * k * k AS j2, -2.53265649e-6 * k * k * k AS j3, -1.61962159e-6 * power(k, 4) AS j4, -2.27626414e-7 * power(k, 5) AS j5, 5.40681239e-7 * power(k, 6) AS j6 FROM g1),
 g3 AS (SELECT *, m * (j2 * 3 * q + j3 * (15 * q * q - 3) / 2 + j4 * (35 * power(q, 3) - 15 * q) / 2 + j5 * (315 * power(q, 4) - 210 * q * q + 15) / 8 + j6 * (693 * power(q, 5) - 630 * power(q, 3) + 105 * q) / 8) AS down,
  m * (-1 + j2 * 3 * (3 * q * q - 1) / 2 + j3 * 4 * (5 * power(q, 3) - 3 * q) / 2 + j4 * 5 * (35 * power(q, 4) - 30 * q * q + 3) / 8 + j5 * 6 * (63 * power(q, 5) - 70 * power(q, 3) + 15 * q) / 8 + j6 * 7 * (231 * power(q, 6) - 315 * power(q, 4) + 105 * q * q - 5) / 16) AS out_ FROM g2)
 SELECT norad_id, {outputs({'x': '1e6 * (out_ + q * down) * x / r', 'y': '1e6 * (out_ + q * down) * y / r', 'z': '1e6 * ((out_ + q * down) * z / r - down)'})} FROM g3""",
    "n13_scale_height": f"{CATALOG} SELECT norad_id, round(greatest(20e0, least(150e0, 1 / greatest(1e-6, ln({density('400e0', 'top')}) - ln({density('401e0', 'top')})))), 4) AS height_km FROM (SELECT norad_id, {top('(70 + ordinal % 180)', '(80 + ordinal % 160)', '(ordinal % 50)')} AS top FROM c)",
    "n7_process_noise": f"{CATALOG} SELECT norad_id, round(1e-3 * t * t * t / 3, 6) AS q_pp, round(1e-3 * t * t / 2, 6) AS q_pv, round(1e-3 * t, 6) AS q_vv FROM (SELECT norad_id, 1e0 + ordinal % 600 AS t FROM c)",
    "d6_projected_area": f"{CATALOG} SELECT norad_id, round((1 + ordinal % 4) * 2 * abs(cos(radians(raan))) + abs(sin(radians(raan))) * (6 * 0.6e0 + 3 * (1 + ordinal % 4) * 0.8e0), 6) AS area_m2 FROM c",
    "t10_vincenty_distance": f"""{CATALOG}, p AS (SELECT norad_id, (inclination - 90) * 0.9e0 AS lat1, (argp - 180) * 0.4e0 AS lat2, radians(mean_anomaly * 0.3e0 - 50 - (raan - 180)) AS l, raan - 180 AS lon1, mean_anomaly * 0.3e0 - 50 AS lon2 FROM c),
 u AS (SELECT *, sin(atan({B} / 6378.137e0 * tan(radians(lat1)))) AS s1, cos(atan({B} / 6378.137e0 * tan(radians(lat1)))) AS k1, sin(atan({B} / 6378.137e0 * tan(radians(lat2)))) AS s2, cos(atan({B} / 6378.137e0 * tan(radians(lat2)))) AS k2, 1 / 298.257223563e0 AS fl FROM p),
 it AS (SELECT *, 0 AS k, l AS lam, CAST(NULL AS DOUBLE) AS before FROM u UNION ALL
  SELECT * EXCLUDE (ss, cs, sa, ca, cm, cc, lam, before, k), k + 1, l + (1 - cc) * fl * sa * (atan2(ss, cs) + cc * ss * (cm + cc * cs * (2 * cm * cm - 1))), lam FROM
  (SELECT *, fl / 16 * ca * (4 + fl * (4 - 3 * ca)) AS cc, CASE WHEN ca < 1e-14 THEN 0 ELSE cs - 2 * s1 * s2 / ca END AS cm FROM
   (SELECT *, 1 - sa * sa AS ca FROM (SELECT *, k1 * k2 * sin(lam) / ss AS sa FROM (SELECT *, sqrt(power(k2 * sin(lam), 2) + power(k1 * s2 - s1 * k2 * cos(lam), 2)) AS ss, s1 * s2 + k1 * k2 * cos(lam) AS cs FROM it WHERE k < 200 AND (before IS NULL OR abs(lam - before) > 1e-12))))) ),
 z AS (SELECT * FROM it QUALIFY row_number() OVER (PARTITION BY norad_id ORDER BY k DESC) = 1),
 y AS (SELECT *, 1 - sa * sa AS ca FROM (SELECT *, k1 * k2 * sin(before) / ss AS sa FROM (SELECT *, sqrt(power(k2 * sin(before), 2) + power(k1 * s2 - s1 * k2 * cos(before), 2)) AS ss, s1 * s2 + k1 * k2 * cos(before) AS cs FROM z))),
 x AS (SELECT *, ca * {EP2} AS q, CASE WHEN ca < 1e-14 THEN 0 ELSE cs - 2 * s1 * s2 / ca END AS cm FROM y), w AS (SELECT *, 1 + q / 16384 * (4096 + q * (-768 + q * (320 - 175 * q))) AS ba, q / 1024 * (256 + q * (-128 + q * (74 - 47 * q))) AS bb FROM x)
 SELECT norad_id, round(CASE WHEN abs(lam - before) <= 1e-12 THEN {B} * ba * (atan2(ss, cs) - bb * ss * (cm + bb / 4 * (cs * (2 * cm * cm - 1) - bb / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))) ELSE
  12742 * asin(sqrt(power(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * power(sin(l / 2), 2))) END, 3) AS dist_km FROM w""",
    "t9_ground_track": f"{STATE}, e AS (SELECT norad_id, z, sqrt(x * x + y * y) * cos(atan2(y, x) - {turn('epoch_jd')}) AS ex, sqrt(x * x + y * y) * sin(atan2(y, x) - {turn('epoch_jd')}) AS ey FROM s), l AS (SELECT *, {latitude('ex', 'ey', 'z')} AS lat FROM e) SELECT norad_id, {outputs({'lat': 'lat', 'alt': altitude('ex', 'ey', 'z', 'lat'), 'lon_cos': 'ex / sqrt(ex * ex + ey * ey)'}, 3)} FROM l",
}


def look(source: str, key: str, jd: str, lat: str, lon: str, h: str) -> str:
    """CTE texts that give el (degrees) and east, north of TEME x, y, z in ``source``."""
    return f"""k0 AS (SELECT *, sqrt(x * x + y * y) * cos(atan2(y, x) - {turn(jd)}) AS ex, sqrt(x * x + y * y) * sin(atan2(y, x) - {turn(jd)}) AS ey, {place(lat, lon, h)}, radians({lat}) AS la, radians({lon}) AS lo FROM {source}),
 k1 AS (SELECT *, (ex - gx) * cos(lo) + (ey - gy) * sin(lo) AS away, (ey - gy) * cos(lo) - (ex - gx) * sin(lo) AS east FROM k0), k2 AS (SELECT *, (z - gz) * cos(la) - away * sin(la) AS north, away * cos(la) + (z - gz) * sin(la) AS up FROM k1),
 k AS (SELECT *, degrees(asin(up / sqrt(up * up + east * east + north * north))) AS el FROM k2)"""


_LOOK = f"{STATE}, {look('s', 'norad_id', 'epoch_jd', '12.97e0', '77.59e0', '0.92e0')}"
SQL["v1_elevation"] = f"{_LOOK} SELECT norad_id, round(el, 5) AS elevation FROM k"
SQL["v2_azimuth"] = f"{_LOOK} SELECT norad_id, {outputs({'azimuth_cos': 'north / sqrt(east * east + north * north)', 'azimuth_sin': 'east / sqrt(east * east + north * north)'})} FROM k"
_TRACK = ", ".join(f"{e} AS {c}" for c, e in syn.TRACK.items())
SQL["w2_passes"] = f"""WITH s AS (SELECT s_suppkey AS id, CAST(step AS INTEGER) AS step, 2460310.5e0 + step / 288e0 AS jd, {_TRACK}, (s_nationkey * 7 % 120) - 60e0 AS lat, s_nationkey * 14e0 - 170e0 AS lon FROM supplier, range({syn.EPHEMERIS_STEPS}) r(step)),
 {look('s', 'id', 'jd', 'lat', 'lon', '0.1e0')}, n AS (SELECT *, step - row_number() OVER (PARTITION BY id ORDER BY step) AS run FROM k WHERE el >= 5)
 SELECT id, min(step) AS first, max(step) AS last, count(*) AS n, arg_max(step, el) AS best, round(max(el), 4) AS max_elevation FROM n GROUP BY id, run"""
