"""Frames, observers, Sun and shadow in numpy, for operators that iterate; the expressions in ``functions`` are the same."""

from __future__ import annotations

import numpy as np

from .sgp4 import sidereal_angle

RE, FLATTENING, SUN_RADIUS, AU = 6378.137, 1 / 298.257223563, 695700.0, 149597870.7
E2 = 2 * FLATTENING - FLATTENING**2
ARCSEC = np.pi / 648000


def jd_of_us(us) -> np.ndarray:
    return 2440587.5 + np.asarray(us) / 86_400e6


def teme_to_ecef(r: np.ndarray, jd: np.ndarray, dut1_s=0.0, xp_arcsec=0.0, yp_arcsec=0.0) -> np.ndarray:
    """Positions (..., 3) turned by sidereal time of UT1, then by polar motion (small angles); corrections are clamped to 1 s and 0.01 rad."""
    g = sidereal_angle(np.asarray(jd) + np.clip(dut1_s, -1.0, 1.0) / 86400)
    c, s = np.cos(g), np.sin(g)
    x, y, z = c * r[..., 0] + s * r[..., 1], c * r[..., 1] - s * r[..., 0], r[..., 2]
    xp, yp = (np.clip(np.asarray(a) * ARCSEC, -0.01, 0.01) for a in (xp_arcsec, yp_arcsec))
    return np.stack([x + xp * z, y - yp * z, z - xp * x + yp * y], -1)


def observer(lat_deg, lon_deg, height_km) -> tuple[np.ndarray, np.ndarray]:
    """ECEF position, and rows east, north, up."""
    la, lo = np.radians(lat_deg), np.radians(lon_deg)
    n = RE / np.sqrt(1 - E2 * np.sin(la) ** 2)
    pos = np.array([(n + height_km) * np.cos(la) * np.cos(lo), (n + height_km) * np.cos(la) * np.sin(lo), (n * (1 - E2) + height_km) * np.sin(la)])
    enu = np.array([
        [-np.sin(lo), np.cos(lo), 0.0], [-np.sin(la) * np.cos(lo), -np.sin(la) * np.sin(lo), np.cos(la)], [np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)],
    ])
    return pos, enu


def look(ecef: np.ndarray, at: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Elevation and azimuth (0..360) in degrees."""
    e, n, u = np.moveaxis((ecef - at[0]) @ at[1].T, -1, 0)
    return np.degrees(np.arctan2(u, np.hypot(e, n))), np.degrees(np.arctan2(e, n)) % 360


def sun(jd) -> np.ndarray:
    """Low-precision geocentric Sun (km, equatorial)."""
    t = (np.asarray(jd) - 2451545.0) / 36525
    m = np.radians(357.5291092 + 35999.0502909 * t)
    lon = np.radians(280.46646 + 36000.76983 * t + 1.9146 * np.sin(m) + 0.02 * np.sin(2 * m))
    r = (1.00014 - 0.01671 * np.cos(m) - 0.00014 * np.cos(2 * m)) * AU
    ob = np.radians(23.439291 - 0.0130042 * t)
    return np.stack([r * np.cos(lon), r * np.cos(ob) * np.sin(lon), r * np.sin(ob) * np.sin(lon)], -1)


def moon(jd) -> np.ndarray:
    """Low-precision geocentric Moon (km, equatorial)."""
    t = (np.asarray(jd) - 2451545.0) / 36525
    m, s, d, u = (np.radians(a + b * t) for a, b in ((134.9634, 477198.8676), (357.5291, 35999.0503), (297.8502, 445267.1115), (93.2720, 483202.0175)))
    lon = np.radians(218.3165 + 481267.8813 * t + 6.289 * np.sin(m) - 1.274 * np.sin(2 * d - m) + 0.658 * np.sin(2 * d) - 0.214 * np.sin(2 * m) - 0.186 * np.sin(s))
    lat = np.radians(5.128 * np.sin(u) + 0.281 * np.sin(m + u) - 0.278 * np.sin(u - m))
    r = 385000.56 - 20905.36 * np.cos(m) - 3699.11 * np.cos(2 * d - m) - 2955.97 * np.cos(2 * d)
    ob = np.radians(23.439291 - 0.0130042 * t)
    x, y, z = r * np.cos(lat) * np.cos(lon), r * np.cos(lat) * np.sin(lon), r * np.sin(lat)
    return np.stack([x, y * np.cos(ob) - z * np.sin(ob), y * np.sin(ob) + z * np.cos(ob)], -1)


def sunlit(r: np.ndarray, s: np.ndarray) -> np.ndarray:
    """The lit share of the Sun's disk at positions ``r`` with the Sun at ``s``."""
    d = s - r
    far, near = np.linalg.norm(d, axis=-1), np.linalg.norm(r, axis=-1)
    a, b = np.arcsin(np.minimum(1, SUN_RADIUS / far)), np.arcsin(np.minimum(1, RE / near))
    c = np.arccos(np.clip(-(r * d).sum(-1) / (near * far), -1, 1))
    x = (c * c + a * a - b * b) / (2 * np.maximum(c, 1e-12))
    lens = a * a * np.arccos(np.clip(x / a, -1, 1)) + b * b * np.arccos(np.clip((c - x) / b, -1, 1)) - c * np.sqrt(np.maximum(0, a * a - x * x))
    part = 1 - lens / (np.pi * a * a)
    return np.where(c >= a + b, 1.0, np.where(c <= b - a, 0.0, np.where(c <= a - b, 1 - b * b / (a * a), part)))
