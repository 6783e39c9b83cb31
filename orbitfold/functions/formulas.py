"""Orbital formulas as SQL expression text over column names, for ``F.expr`` / ``selectExpr`` and for other SQL engines.

Angles are degrees, lengths km, speeds km/s, times Julian dates, unless a name says otherwise.
"""

from __future__ import annotations

#: Earth (WGS84), Sun, standard gravity.
RE, MU, OMEGA = "6378.137e0", "398600.4418e0", "7.292115146706979e-5"
FLATTENING, SUN_RADIUS, AU, G0 = "(1e0 / 298.257223563e0)", "695700e0", "149597870.7e0", "9.80665e0"
E2 = f"(2e0 * {FLATTENING} - {FLATTENING} * {FLATTENING})"
B = f"({RE} * (1e0 - {FLATTENING}))"


def period_minutes(n: str) -> str:
    """Without motion the period is infinite."""
    return f"CASE WHEN {n} <= 0e0 THEN CAST('Infinity' AS DOUBLE) ELSE 1440e0 / {n} END"


def semi_major_km(n: str) -> str:
    return f"power({MU} / power({n} * 2e0 * pi() / 86400e0, 2e0), 1e0 / 3e0)"


def regime(altitude: str, e: str) -> str:
    return f"CASE WHEN {e} > 0.25e0 THEN 'HEO' WHEN {altitude} < 2000e0 THEN 'LEO' WHEN {altitude} BETWEEN 35000e0 AND 36000e0 THEN 'GEO' ELSE 'MEO' END"


def inclination_band(i: str) -> str:
    return f"CASE WHEN {i} < 10e0 THEN 'equatorial' WHEN {i} < 80e0 THEN 'inclined' WHEN {i} <= 90e0 THEN 'polar' ELSE 'retrograde' END"


def risk(pc: str) -> str:
    """Unknown and NaN probabilities are UNKNOWN."""
    return f"CASE WHEN {pc} IS NULL OR isnan({pc}) THEN 'UNKNOWN' WHEN {pc} > 1e-4 THEN 'CRITICAL' WHEN {pc} > 1e-5 THEN 'HIGH' WHEN {pc} > 1e-6 THEN 'MEDIUM' ELSE 'LOW' END"


def covariance_source(a: str, b: str) -> str:
    return f"CASE WHEN {a} = {b} THEN {a} WHEN {a} = 'UNAVAILABLE' OR {b} = 'UNAVAILABLE' THEN 'UNAVAILABLE' ELSE concat('MIXED(', {a}, '+', {b}, ')') END"


def radius_km(l: str, w: str, h: str, rcs: str, radius_m: str) -> str:
    """Tumbling objects: mean projected area of the box, else the radar cross section, else the given radius, else 5 m."""
    return f"CASE WHEN {l} IS NOT NULL THEN sqrt(2e0 * ({l} * {w} + {w} * {h} + {h} * {l}) / 4e0 / pi()) / 1000e0 WHEN {rcs} IS NOT NULL THEN sqrt({rcs} / pi()) / 1000e0 WHEN {radius_m} IS NOT NULL THEN {radius_m} / 1000e0 ELSE 0.005e0 END"


def in_latitude_band(i: str, low: str, high: str) -> str:
    """Whether the ground track of inclination ``i`` reaches the band; longitude never excludes an orbit."""
    reach = f"CASE WHEN {i} <= 90e0 THEN {i} ELSE 180e0 - {i} END"
    return f"(({reach}) >= {low} AND -({reach}) <= {high})"


def is_fresh(epoch: str, start: str, altitude: str) -> str:
    """Elements older than 7 days below 2000 km, or 14 days above, are stale; future epochs are not."""
    return f"({start} - {epoch} <= CASE WHEN {altitude} < 2000e0 THEN 7e0 ELSE 14e0 END)"


def gmst_rad(jd: str) -> str:
    """Greenwich mean sidereal time (IAU 1982), UT1 taken as UTC."""
    t = f"(({jd} - 2451545e0) / 36525e0)"
    s = f"(67310.54841e0 + (876600e0 * 3600e0 + 8640184.812866e0) * {t} + 0.093104e0 * {t} * {t} - 6.2e-6 * {t} * {t} * {t})"
    return f"radians(({s} - 86400e0 * floor({s} / 86400e0)) / 240e0)"


def teme_to_ecef(x: str, y: str, jd: str) -> tuple[str, str]:
    """x and y after the rotation by sidereal time (no polar motion); z stays."""
    g = gmst_rad(jd)
    return f"(cos({g}) * {x} + sin({g}) * {y})", f"(cos({g}) * {y} - sin({g}) * {x})"


def geodetic_to_ecef(lat: str, lon: str, alt: str) -> tuple[str, str, str]:
    n = f"({RE} / sqrt(1e0 - {E2} * power(sin(radians({lat})), 2e0)))"
    return f"(({n} + {alt}) * cos(radians({lat})) * cos(radians({lon})))", f"(({n} + {alt}) * cos(radians({lat})) * sin(radians({lon})))", f"(({n} * (1e0 - {E2}) + {alt}) * sin(radians({lat})))"


def ecef_to_latitude(x: str, y: str, z: str) -> str:
    p, th = f"sqrt({x} * {x} + {y} * {y})", f"atan2({RE} * {z}, {B} * sqrt({x} * {x} + {y} * {y}))"
    return f"degrees(atan2({z} + ({RE} * {RE} - {B} * {B}) / {B} * power(sin({th}), 3e0), {p} - {E2} * {RE} * power(cos({th}), 3e0)))"


def ecef_to_altitude(x: str, y: str, z: str, lat: str) -> str:
    """``lat`` in degrees, as found; near the poles the height along z."""
    n = f"({RE} / sqrt(1e0 - {E2} * power(sin(radians({lat})), 2e0)))"
    return f"CASE WHEN abs({lat}) > 80e0 THEN abs({z}) / abs(sin(radians({lat}))) - {n} * (1e0 - {E2}) ELSE sqrt({x} * {x} + {y} * {y}) / cos(radians({lat})) - {n} END"


def sun_position(jd: str) -> tuple[str, str, str]:
    """Low-precision geocentric Sun, km, equatorial."""
    t = f"(({jd} - 2451545e0) / 36525e0)"
    m = f"radians(357.5291092e0 + 35999.0502909e0 * {t})"
    lon = f"radians(280.46646e0 + 36000.76983e0 * {t} + 1.9146e0 * sin({m}) + 0.02e0 * sin(2e0 * {m}))"
    r = f"((1.00014e0 - 0.01671e0 * cos({m}) - 0.00014e0 * cos(2e0 * {m})) * {AU})"
    ob = f"radians(23.439291e0 - 0.0130042e0 * {t})"
    return f"({r} * cos({lon}))", f"({r} * cos({ob}) * sin({lon}))", f"({r} * sin({ob}) * sin({lon}))"


def exponential_density(alt: str) -> str:
    return f"CASE WHEN {alt} > 1500e0 OR {alt} < 100e0 THEN 0e0 ELSE 3.725e-12 * exp(-({alt} - 400e0) / 58.515e0) END"


def bates_density(alt: str, f107: str, f107a: str, ap: str) -> str:
    """kg/m3: one-species Bates profile calibrated at 400 km, nothing outside 100..1500 km."""
    tinf = f"greatest(500e0, least(2500e0, 379e0 + 3.24e0 * {f107a} + 1.3e0 * ({f107} - {f107a}) + 28e0 * power({ap}, 0.4e0)))"
    temp = lambda z, top: f"(CASE WHEN {z} <= 120e0 THEN 380e0 ELSE {top} - ({top} - 380e0) * exp(-0.02e0 * ({z} - 120e0) * (6378.137e0 + 120e0) / (6378.137e0 + {z})) END)"
    height = lambda z, t: f"(8.314462618e0 * {t} / ((4.0e-3 + 24e0 * 1e-3 * exp(-({z} - 120e0) / 160e0)) * 9.80665e0 * power({RE} / ({RE} + {z}), 2e0)) / 1000e0)"
    t_z, t_400, t_ref = temp(alt, tinf), temp("400e0", tinf), temp("400e0", "948e0")
    rho_400 = f"(3.7e-12 * exp(280e0 * (1e0 / {height('400e0', t_ref)} - 1e0 / {height('400e0', t_400)})))"
    return f"CASE WHEN {alt} > 1500e0 OR {alt} < 100e0 THEN 0e0 ELSE greatest({rho_400} * ({t_400} / {t_z}) * exp(-({alt} - 400e0) / {height(alt, t_z)}), 1e-20) END"


def circular_position(a: str, i: str, raan: str, u: str) -> tuple[str, str, str]:
    """Position on a circular orbit; ``u`` is the argument of latitude in radians."""
    ci, si, co, so = f"cos(radians({i}))", f"sin(radians({i}))", f"cos(radians({raan}))", f"sin(radians({raan}))"
    return f"({a} * ({co} * cos({u}) - {so} * sin({u}) * {ci}))", f"({a} * ({so} * cos({u}) + {co} * sin({u}) * {ci}))", f"({a} * sin({u}) * {si})"


def heuristic_sigma(days: str, f107: str) -> tuple[str, str, str]:
    """Radial, transverse and normal standard deviations by age of the elements."""
    d, s = f"greatest(0.1e0, abs({days}))", f"greatest(0.1e0, {f107} / 150e0)"
    return (
        f"least(0.01e0 + 0.02e0 * {d} * {d}, 50e0)",
        f"CASE WHEN {d} <= 7e0 THEN least(0.1e0 + 0.3e0 * {s} * {d}, 5e0) ELSE least(5e0 + 0.5e0 * {s} * ({d} - 7e0) * ({d} - 7e0), 100e0) END",
        f"least(0.01e0 + 0.05e0 * {d}, 20e0)",
    )


def tsiolkovsky_kg(mass: str, dv_km_s: str, isp: str) -> str:
    return f"({mass} * (1e0 - exp(-({dv_km_s}) * 1000e0 / ({isp} * {G0}))))"


def hohmann_dv(r1: str, r2: str) -> tuple[str, str]:
    a = f"(({r1} + {r2}) / 2e0)"
    return f"abs(sqrt({MU} * (2e0 / {r1} - 1e0 / {a})) - sqrt({MU} / {r1}))", f"abs(sqrt({MU} / {r2}) - sqrt({MU} * (2e0 / {r2} - 1e0 / {a})))"


def jd_of_micros(us: str) -> str:
    return f"(2440587.5e0 + {us} / 86400000000e0)"


def micros_of_jd(jd: str) -> str:
    return f"CAST(round(({jd} - 2440587.5e0) * 86400000000e0) AS BIGINT)"
