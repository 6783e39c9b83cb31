"""Frames, elements, look angles, shadow, gravity and collision probability in stages of SQL expression text.

A stage names new columns; later stages use those of earlier ones, so no expression is expanded twice. ``extend`` puts
stages on a DataFrame. Inputs are x, y, z (km) and vx, vy, vz (km/s)
unless a docstring says otherwise. Degenerate frames give null.
"""

from __future__ import annotations

from math import pi

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import formulas as f

#: Zonal harmonics J2 to J6 of the Earth.
ZONAL = {2: "1.08262668e-3", 3: "-2.53265649e-6", 4: "-1.61962159e-6", 5: "-2.27626414e-7", 6: "5.40681239e-7"}
Stage = dict[str, str]


def extend(df: DataFrame, stages: list[Stage]) -> DataFrame:
    for s in stages:
        df = df.withColumns({c: F.expr(e) for c, e in s.items()})
    return df


def norm(*v: str) -> str:
    return f"sqrt({' + '.join(f'{a} * {a}' for a in v)})"


def dot(a: tuple, b: tuple) -> str:
    return f"({' + '.join(f'{p} * {q}' for p, q in zip(a, b, strict=True))})"


def cross(a: tuple, b: tuple) -> tuple[str, str, str]:
    return tuple(f"({a[i]} * {b[j]} - {a[j]} * {b[i]})" for i, j in ((1, 2), (2, 0), (0, 1)))


def named(prefix: str, v: tuple) -> Stage:
    return dict(zip((f"{prefix}x", f"{prefix}y", f"{prefix}z"), v, strict=True))


def vec(prefix: str) -> tuple[str, str, str]:
    return f"{prefix}x", f"{prefix}y", f"{prefix}z"


R, V, H = vec(""), vec("v"), vec("h")


def over(v: tuple, n: str) -> tuple:
    return tuple(f"{a} / nullif({n}, 0e0)" for a in v)


def positive(degrees: str) -> str:
    return f"({degrees} - 360e0 * floor({degrees} / 360e0))"


_H = [{"r_norm": norm(*R), "v_norm": norm(*V), **named("h", cross(R, V))}, {"h_norm": norm(*H)}]

#: r_, t_, n_: rows of the matrix from inertial axes to radial, transverse, normal.
RTN = [*_H, {**named("r_", over(R, "r_norm")), **named("n_", over(H, "h_norm"))}, named("t_", cross(vec("n_"), vec("r_")))]
#: v_, n_, b_: velocity, normal, binormal.
VNB = [*_H, {**named("v_", over(V, "v_norm")), **named("n_", over(H, "h_norm"))}, named("b_", cross(vec("v_"), vec("n_")))]


def to_inertial(frame: tuple[str, str, str], local: tuple[str, str, str], prefix: str = "i_") -> list[Stage]:
    """A vector given in the axes named ``frame`` (prefixes), in inertial axes."""
    return [named(prefix, tuple(" + ".join(f"{c} * {p}{axis}" for c, p in zip(local, frame, strict=True)) for axis in "xyz"))]


def rotate_covariance(frame: tuple[str, str, str], local: list[list[str]]) -> list[Stage]:
    """Upper triangle cxx .. czz of B C B' for a symmetric 3 x 3 covariance in the axes ``frame``."""
    cells = {}
    for i, a in enumerate("xyz"):
        for b in "xyz"[i:]:
            cells[f"c{a}{b}"] = " + ".join(f"{p}{a} * ({local[m][n]}) * {q}{b}" for m, p in enumerate(frame) for n, q in enumerate(frame) if local[m][n])
    return [cells]


def elements(circular: float = 1e-10) -> list[Stage]:
    """el_a, el_e, el_i, el_raan, el_argp, el_nu (degrees) of a state.

    Equatorial orbits have their node at x, circular ones their periapsis at the node.
    """
    n, ev = ("(-hy)", "hx", "0e0"), vec("ev_")
    side = cross(H, n)
    return [
        *_H,
        {"rv": dot(R, V), "n_norm": norm("hx", "hy")},
        named("ev_", tuple(f"(((v_norm * v_norm - {f.MU} / r_norm) * {p} - rv * {q}) / {f.MU})" for p, q in zip(R, V, strict=True))),
        {"el_e": norm(*ev), "el_a": f"1e0 / nullif(2e0 / r_norm - v_norm * v_norm / {f.MU}, 0e0)", "el_i": "degrees(acos(greatest(-1e0, least(1e0, hz / nullif(h_norm, 0e0)))))", "flat": f"n_norm <= {circular} * h_norm"},
        {
            "el_raan": f"CASE WHEN flat THEN 0e0 ELSE {positive('degrees(atan2(hx, -hy))')} END",
            "argp_raw": f"CASE WHEN el_e <= {circular} THEN 0e0 WHEN flat THEN degrees(atan2(ev_y, ev_x)) ELSE degrees(atan2({dot(ev, side)} / h_norm, {dot(ev, n)})) END",
            "nu_raw": f"CASE WHEN el_e > {circular} THEN degrees(atan2(h_norm * rv / ({f.MU} * r_norm), h_norm * h_norm / ({f.MU} * r_norm) - 1e0)) WHEN flat THEN degrees(atan2(y, x)) ELSE degrees(atan2({dot(R, side)} / h_norm, {dot(R, n)})) END",
        },
        {"el_argp": positive("argp_raw"), "el_nu": positive("nu_raw")},
    ]


def look_angles(lat: str, lon: str, height_km: str) -> list[Stage]:
    """elevation and azimuth (0..360) of ECEF ex, ey, ez from an observer."""
    o = f.geodetic_to_ecef(lat, lon, height_km)
    sl, cl, so, co = f"sin(radians({lat}))", f"cos(radians({lat}))", f"sin(radians({lon}))", f"cos(radians({lon}))"
    return [
        named("rho_", tuple(f"(e{a} - {p})" for a, p in zip("xyz", o, strict=True))),
        {"east": f"(-{so} * rho_x + {co} * rho_y)", "north": f"(-{sl} * {co} * rho_x - {sl} * {so} * rho_y + {cl} * rho_z)", "up": f"({cl} * {co} * rho_x + {cl} * {so} * rho_y + {sl} * rho_z)"},
        {"elevation": "degrees(atan2(up, sqrt(east * east + north * north)))", "azimuth": positive("degrees(atan2(east, north))")},
    ]


def moon_position(jd: str) -> tuple[str, str, str]:
    """Low-precision geocentric Moon, km, equatorial."""
    t = f"(({jd} - 2451545e0) / 36525e0)"
    m, s, d, u = (f"radians({a} + {b} * {t})" for a, b in (("134.9634e0", "477198.8676e0"), ("357.5291e0", "35999.0503e0"), ("297.8502e0", "445267.1115e0"), ("93.2720e0", "483202.0175e0")))
    lon = f"radians(218.3165e0 + 481267.8813e0 * {t} + 6.289e0 * sin({m}) - 1.274e0 * sin(2e0 * {d} - {m}) + 0.658e0 * sin(2e0 * {d}) - 0.214e0 * sin(2e0 * {m}) - 0.186e0 * sin({s}))"
    lat = f"radians(5.128e0 * sin({u}) + 0.281e0 * sin({m} + {u}) - 0.278e0 * sin({u} - {m}))"
    r = f"(385000.56e0 - 20905.36e0 * cos({m}) - 3699.11e0 * cos(2e0 * {d} - {m}) - 2955.97e0 * cos(2e0 * {d}))"
    ob = f"radians(23.439291e0 - 0.0130042e0 * {t})"
    ex, ey, ez = f"({r} * cos({lat}) * cos({lon}))", f"({r} * cos({lat}) * sin({lon}))", f"({r} * sin({lat}))"
    return ex, f"({ey} * cos({ob}) - {ez} * sin({ob}))", f"({ey} * sin({ob}) + {ez} * cos({ob}))"


def illumination() -> list[Stage]:
    """nu: the lit share of the Sun's disk seen from x, y, z with the Sun at sx, sy, sz; umbra, penumbra and annular."""
    d = tuple(f"(s{a} - {a})" for a in "xyz")
    unit = lambda v: f"greatest(-1e0, least(1e0, {v}))"
    return [
        {"sun_d": norm(*d), "r_norm": norm(*R)},
        {"sun_a": f"asin(least(1e0, {f.SUN_RADIUS} / sun_d))", "earth_a": f"asin(least(1e0, {f.RE} / r_norm))", "apart": f"acos({unit(f'-{dot(R, d)} / (r_norm * sun_d)')})"},
        {"part_x": "(apart * apart + sun_a * sun_a - earth_a * earth_a) / (2e0 * greatest(apart, 1e-12))"},
        {
            "nu": f"CASE WHEN apart >= sun_a + earth_a THEN 1e0 WHEN apart <= earth_a - sun_a THEN 0e0 WHEN apart <= sun_a - earth_a THEN 1e0 - earth_a * earth_a / (sun_a * sun_a)"
            f" ELSE 1e0 - (sun_a * sun_a * acos({unit('part_x / sun_a')}) + earth_a * earth_a * acos({unit('(apart - part_x) / earth_a')}) - apart * sqrt(greatest(0e0, sun_a * sun_a - part_x * part_x))) / (pi() * sun_a * sun_a) END"
        },
    ]


def gravity(degrees: tuple[int, ...] = (2, 3, 4, 5, 6)) -> list[Stage]:
    """ax, ay, az (km/s2): the gradient of the point mass and zonal potentials.

    Each zonal term is mu J Re^n / r^(n+2) times ((n+1) P_n + s P_n') along r minus P_n' along z, where s = z / r.
    """
    p = {0: "1e0", 1: "sz_"}
    stages, legendre, slope = [{"r_norm": norm(*R)}, {"sz_": "z / r_norm"}], {}, {}
    for n in range(2, max(degrees) + 1):
        legendre[f"p{n}"] = f"({2 * n - 1}e0 * sz_ * {p[n - 1]} - {n - 1}e0 * {p[n - 2]}) / {n}e0"
        p[n] = f"p{n}"
        stages.append({f"p{n}": legendre[f"p{n}"]})
    slope["dp1"] = "1e0"
    for n in range(2, max(degrees) + 1):
        before = "1e0" if n == 2 else f"dp{n - 1}"
        stages.append({f"dp{n}": f"{n}e0 * {p[n - 1]} + sz_ * {before}"})
    k = {n: f"({f.MU} * ({ZONAL[n]}) * power({f.RE} / r_norm, {n}e0) / (r_norm * r_norm))" for n in degrees}
    radial = " + ".join(f"{k[n]} * ({n + 1}e0 * p{n} + sz_ * dp{n})" for n in degrees)
    axial = " + ".join(f"{k[n]} * dp{n}" for n in degrees)
    return [*stages, {"along_r": f"-{f.MU} / (r_norm * r_norm) + {radial}", "along_z": axial}, {"ax": "along_r * x / r_norm", "ay": "along_r * y / r_norm", "az": "along_r * z / r_norm - along_z"}]


def scale_height_km(f107: str, f107a: str, ap: str) -> str:
    d = f"ln({f.bates_density('400e0', f107, f107a, ap)} / {f.bates_density('401e0', f107, f107a, ap)})"
    return f"greatest(20e0, least(150e0, 1e0 / greatest({d}, 1e-6)))"


def process_noise(q: str, dt: str) -> dict[str, str]:
    """Position, cross and velocity terms of white acceleration noise."""
    return {"q_pp": f"{q} * power({dt}, 3e0) / 3e0", "q_pv": f"{q} * power({dt}, 2e0) / 2e0", "q_vv": f"{q} * {dt}"}


def rotated(quaternion: str, v: tuple) -> tuple[str, str, str]:
    """A vector turned by a unit quaternion, the array (w, x, y, z) that the expression gives."""
    w, q = f"({quaternion})[0]", tuple(f"({quaternion})[{i}]" for i in (1, 2, 3))
    t = tuple(f"(2e0 * {c})" for c in cross(q, v))
    return tuple(f"({a} + {w} * {b} + {c})" for a, b, c in zip(v, t, cross(q, t), strict=True))


def projected_area_m2(l: str, w: str, h: str, axes: list[tuple], direction: tuple) -> str:
    """Of a box whose unit ``axes`` are given, seen along ``direction``."""
    return " + ".join(f"{face} * abs({dot(a, direction)})" for face, a in zip((f"{w} * {h}", f"{l} * {h}", f"{l} * {w}"), axes, strict=True))


def collision_probability(radius_km: str, fold=None) -> list[Stage]:
    """pc of a miss mx, my, mz with relative velocity ux, uy, uz and the summed covariance cxx .. czz (km2).

    Point formula in the encounter plane; where the squared Mahalanobis distance is below 4 the density is integrated
    over the disk: eight Gauss-Legendre radii, 32 angles. No covariance: 1 within the radius, else 0. No relative
    velocity: 0. A singular plane gives null. ``fold(term)`` sums a term over k = 0 .. 31 in the engine's SQL.
    """
    fold = fold or (lambda term: f"aggregate(sequence(0, 31), 0e0, (s, k) -> s + {term})")
    m, u = vec("m"), vec("u_")
    c = [["cxx", "cxy", "cxz"], ["cxy", "cyy", "cyz"], ["cxz", "cyz", "czz"]]
    quad = lambda a, b: " + ".join(f"{a}{i} * {c[p][q]} * {b}{j}" for p, i in enumerate("xyz") for q, j in enumerate("xyz"))
    nodes, weights = np.polynomial.legendre.leggauss(8)
    rho = [(x + 1) / 2 for x in nodes.tolist()]
    px = lambda r: f"(b1 - {r!r} * hard_r * cos(k * {2 * pi / 32!r}))"
    py = lambda r: f"(b2 - {r!r} * hard_r * sin(k * {2 * pi / 32!r}))"
    density = lambda r: fold(f"exp(-(p22 * {px(r)} * {px(r)} - 2e0 * p12 * {px(r)} * {py(r)} + p11 * {py(r)} * {py(r)}) / (2e0 * det))")
    disk = " + ".join(f"{w / 2 * r!r} * {density(r)}" for r, w in zip(rho, weights.tolist(), strict=True))
    return [
        {"hard_r": radius_km, "u_norm": norm("ux", "uy", "uz"), "miss": norm(*m)},
        named("u_", over(vec("u"), "u_norm")),
        named("k_", tuple(f"CASE WHEN {cond} THEN 1e0 ELSE 0e0 END" for cond in ("abs(u_x) <= abs(u_y) AND abs(u_x) <= abs(u_z)", "abs(u_y) < abs(u_x) AND abs(u_y) <= abs(u_z)", "abs(u_z) < abs(u_x) AND abs(u_z) < abs(u_y)"))),
        named("f_", cross(u, vec("k_"))),
        named("g_", over(vec("f_"), norm(*vec("f_")))),
        named("w_", cross(u, vec("g_"))),
        {"b1": dot(m, vec("g_")), "b2": dot(m, vec("w_")), "p11": quad("g_", "g_"), "p12": quad("g_", "w_"), "p22": quad("w_", "w_")},
        {"det": "p11 * p22 - p12 * p12"},
        {"m2": "CASE WHEN det > 0e0 THEN (p22 * b1 * b1 - 2e0 * p12 * b1 * b2 + p11 * b2 * b2) / det END"},
        {
            "pc": "CASE WHEN cxx = 0e0 AND cyy = 0e0 AND czz = 0e0 THEN CASE WHEN miss <= hard_r THEN 1e0 ELSE 0e0 END WHEN u_norm = 0e0 THEN 0e0 WHEN det IS NULL OR det <= 0e0 THEN NULL"
            f" WHEN m2 < 4e0 THEN least(1e0, hard_r * hard_r * ({2 * pi / 32!r}) * ({disk}) / (2e0 * pi() * sqrt(det)))"
            " ELSE least(1e0, exp(-m2 / 2e0) * hard_r * hard_r / (2e0 * sqrt(det))) END"
        },
    ]


def great_circle_km(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    h = f"(power(sin(radians({lat2} - {lat1}) / 2e0), 2e0) + cos(radians({lat1})) * cos(radians({lat2})) * power(sin(radians({lon2} - {lon1}) / 2e0), 2e0))"
    return f"(2e0 * 6371e0 * asin(least(1e0, sqrt({h}))))"


def _settled_longitude(rounds: int) -> str:
    """The longitude difference before the last round, of ``rounds`` at most, of Vincenty's formula, in Spark's SQL."""
    let = lambda name, values, body: f"transform(array(named_struct({', '.join(f'{c!r}, {e}' for c, e in values.items())})), {name} -> {body})[0]"
    body = f"span + (1e0 - w.cc) * {f.FLATTENING} * v.sa * (v.sg + w.cc * t.ss * (w.cm + w.cc * t.cs * (2e0 * w.cm * w.cm - 1e0)))"
    body = let("w", {"cm": "CASE WHEN 1e0 - v.sa * v.sa < 1e-14 THEN 0e0 ELSE t.cs - 2e0 * sin(u1) * sin(u2) / (1e0 - v.sa * v.sa) END", "cc": f"{f.FLATTENING} / 16e0 * (1e0 - v.sa * v.sa) * (4e0 + {f.FLATTENING} * (4e0 - 3e0 * (1e0 - v.sa * v.sa)))"}, body)
    body = let("v", {"sg": "atan2(t.ss, t.cs)", "sa": "CASE WHEN t.ss = 0e0 THEN 0e0 ELSE cos(u1) * cos(u2) * sin(s.nxt) / nullif(t.ss, 0e0) END"}, body)
    body = let("t", {"ss": "sqrt(power(cos(u2) * sin(s.nxt), 2e0) + power(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(s.nxt), 2e0))", "cs": "sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(s.nxt)"}, body)
    start = "named_struct('lam', CAST(NULL AS DOUBLE), 'nxt', span)"
    return f"aggregate(sequence(1, {rounds}), {start}, (s, k) -> CASE WHEN abs(s.nxt - s.lam) <= 1e-12 THEN s ELSE named_struct('lam', s.nxt, 'nxt', {body}) END, s -> s.lam)"


def vincenty(lat1: str, lon1: str, lat2: str, lon2: str, rounds: int = 200) -> list[Stage]:
    """dist_km on the ellipsoid by at most ``rounds`` rounds of the inverse formula, a fold; the great circle if these do not settle."""
    fl = f.FLATTENING
    return [
        {"u1": f"atan((1e0 - {fl}) * tan(radians({lat1})))", "u2": f"atan((1e0 - {fl}) * tan(radians({lat2})))", "span": f"radians({lon2} - {lon1})"},
        {"lam": _settled_longitude(rounds)},
        {"ss": "sqrt(power(cos(u2) * sin(lam), 2e0) + power(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam), 2e0))", "cs": "sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam)"},
        {"sg": "atan2(ss, cs)", "sa": "CASE WHEN ss = 0e0 THEN 0e0 ELSE cos(u1) * cos(u2) * sin(lam) / nullif(ss, 0e0) END"},
        {"ca": "1e0 - sa * sa"},
        {"cm": "CASE WHEN ca < 1e-14 THEN 0e0 ELSE cs - 2e0 * sin(u1) * sin(u2) / ca END", "cc": f"{fl} / 16e0 * ca * (4e0 + {fl} * (4e0 - 3e0 * ca))"},
        {"after": f"span + (1e0 - cc) * {fl} * sa * (sg + cc * ss * (cm + cc * cs * (2e0 * cm * cm - 1e0)))", "usq": f"ca * ({f.RE} * {f.RE} - {f.B} * {f.B}) / ({f.B} * {f.B})"},
        {"big_a": "1e0 + usq / 16384e0 * (4096e0 + usq * (-768e0 + usq * (320e0 - 175e0 * usq)))", "big_b": "usq / 1024e0 * (256e0 + usq * (-128e0 + usq * (74e0 - 47e0 * usq)))"},
        {"turn": "big_b * ss * (cm + big_b / 4e0 * (cs * (2e0 * cm * cm - 1e0) - big_b / 6e0 * cm * (4e0 * ss * ss - 3e0) * (4e0 * cm * cm - 3e0)))"},
        {"dist_km": f"CASE WHEN abs(after - lam) > 1e-12 THEN {great_circle_km(lat1, lon1, lat2, lon2)} ELSE {f.B} * big_a * (sg - turn) END"},
    ]
