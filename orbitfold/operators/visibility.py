"""Passes of satellites over ground stations, with refined rise and set and the light at their best moment."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..kernels import frames
from . import propagation

#: Observers that go along with one job, and the rows of the grid that a block of satellites has.
OBSERVERS, BLOCK = 2000, 100_000
#: The Sun's elevation below which an observer is in the dark.
DARK_DEG = -6.0
PASSES = "id string, observer string, aos_us long, tca_us long, los_us long, max_elevation double, azimuth_aos double, azimuth_tca double, azimuth_los double, duration_s double, sunlit boolean, dark boolean"


def _passes(t_us: np.ndarray, step_us: int, stations: list, gravity: str, rounds: int):
    jd = frames.jd_of_us(t_us)
    places = [(name, mask, frames.observer(lat, lon, height)) for name, lat, lon, height, mask in stations]

    def elevation(b: pa.RecordBatch, rows: np.ndarray, which: np.ndarray, at_us: np.ndarray) -> np.ndarray:
        """Of (satellite, observer) pairs at a time each; not a number where the orbit fails."""
        part = b.take(pa.array(rows))
        pos, _, err = propagation.satellites(part, gravity).at(propagation.minutes(part, at_us[:, None]))
        ecef = frames.teme_to_ecef(pos[:, 0], frames.jd_of_us(at_us))
        out = np.empty(len(rows))
        for o in np.unique(which):
            mine = which == o
            out[mine] = frames.look(ecef[mine], places[o][2])[0]
        return np.where(err[:, 0] == 0, out, np.nan)

    def cross(b, rows, which, low, high, rising):
        """Microseconds at which the mask is passed, by bisection between the samples around."""
        mask = np.array([places[o][1] for o in which])
        low, high = low.astype(np.float64), high.astype(np.float64)
        for _ in range(rounds):
            mid = (low + high) / 2
            above = elevation(b, rows, which, mid.astype(np.int64)) >= mask
            up = above == rising
            low, high = np.where(up, low, mid), np.where(up, mid, high)
        return np.round((low + high) / 2).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(t_us)
        for whole in batches:
            for i in range(0, whole.num_rows, max(1, BLOCK // n)):
                b = whole.slice(i, max(1, BLOCK // n))
                pos, _, err = propagation.satellites(b, gravity).at(propagation.minutes(b, t_us[None, :]))
                ecef = frames.teme_to_ecef(pos, jd)
                found = []
                for o, (_, mask, place) in enumerate(places):
                    el, az = frames.look(ecef, place)
                    el = np.where(err == 0, el, np.nan)
                    edge = np.diff(np.pad((el >= mask).astype(np.int8), ((0, 0), (1, 1))), axis=1)
                    row, first = np.nonzero(edge == 1)
                    last = np.nonzero(edge == -1)[1] - 1
                    for r, a, z in zip(row.tolist(), first.tolist(), last.tolist(), strict=True):
                        best = a + int(el[r, a : z + 1].argmax())
                        found.append((r, o, a, z, best, el[r, best], az[r, a], az[r, best], az[r, z]))
                if not found:
                    continue
                r, o, a, z, best = (np.array([x[k] for x in found]) for k in range(5))
                aos = cross(b, r, o, t_us[a] - step_us, t_us[a], True)
                los = cross(b, r, o, t_us[z], t_us[z] + step_us, False)
                sun = frames.sun(jd[best])
                lit = frames.sunlit(pos[r, best], sun) > 0.5
                sun_ecef = frames.teme_to_ecef(sun, jd[best])
                dark = [bool(frames.look(s, places[k][2])[0] < DARK_DEG) for k, s in zip(o.tolist(), sun_ecef, strict=True)]
                columns = [b.column(0).take(pa.array(r)), pa.array([places[k][0] for k in o]), pa.array(aos), pa.array(t_us[best]), pa.array(los), *(pa.array([float(x[k]) for x in found]) for k in range(5, 9)), pa.array((los - aos) / 1e6), pa.array(lit), pa.array(dark)]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in PASSES.split(", ")])

    return run


def predict_passes(elements: DataFrame, observers: DataFrame, start_jd: float, end_jd: float, step_minutes: float = 1.0, gravity: str = "wgs72", rounds: int = 15) -> DataFrame:
    """Each pass of each satellite over each observer (name, lat, lon, height_km, mask_deg) at or above the mask.

    Rise and set are bisected between samples; the best moment is the sample of greatest elevation, with the azimuths of
    the samples. ``sunlit`` is whether more than half of the Sun's disk is seen from the satellite then, ``dark`` whether
    the Sun is more than 6 degrees below the observer's horizon. Satellites stay where they are; observers go along with
    the job, at most OBSERVERS at once, and more of them are further jobs over the satellites.
    """
    n = int(np.floor((end_jd - start_jd) * 1440 / step_minutes + 1e-6)) + 1 if end_jd >= start_jd else 0
    t_us = propagation.us_of_jd(start_jd) + np.arange(n, dtype=np.int64) * round(step_minutes * 60e6)
    rows = elements.select("id", "epoch_us", *propagation.FIELDS).repartition("id")
    out, stations = None, (tuple(r) for r in observers.select("name", "lat", "lon", "height_km", "mask_deg").toLocalIterator())
    while part := [*islice(stations, OBSERVERS)]:
        some = rows.mapInArrow(_passes(t_us, round(step_minutes * 60e6), part, gravity, rounds), PASSES) if n else rows.sparkSession.createDataFrame([], PASSES)
        out = some if out is None else out.unionByName(some)
    return rows.sparkSession.createDataFrame([], PASSES) if out is None else out


def thinned(ephemeris: DataFrame, n: int, most: int = 500, step: str = "step") -> DataFrame:
    """About ``most`` states of each track of ``n`` for drawing: every so many steps."""
    return ephemeris.where(F.col(step) % F.lit(max(1, n // most)) == 0)


def track_breaks(track: DataFrame, id_col: str = "id", step: str = "step", lon: str = "lon") -> DataFrame:
    """Ground track with ``breaks``: whether the longitude jumps by more than 180 degrees, so that no line is drawn across."""
    before = F.lag(lon).over(Window.partitionBy(id_col).orderBy(step))
    return track.withColumn("breaks", F.coalesce(F.abs(F.col(lon) - before) > 180, F.lit(False)))
