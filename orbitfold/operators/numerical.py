"""Numerical propagation, covariance and Monte Carlo of many objects: each object is a row of a task, in Arrow batches.

``states`` tables have id, epoch_jd, x .. vz and may have mass_kg, a drag struct (the fields of ``kernels.cowell.Drag``)
and burns, an array of structs (those of ``kernels.cowell.Burn``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import EngineConfig, PropagationError
from ..kernels import approach, cowell
from .propagation import STATE

_OUT = "id string, ordinal int, t_s double, t_jd double, " + ", ".join(f"{c} double" for c in STATE) + ", mass_kg double, powered boolean, error string"
_NAMES = [c.split()[0] for c in _OUT.split(", ")]


def _object(row: dict, third_body: bool, days: float) -> tuple[np.ndarray, cowell.Forces, list[cowell.Burn], float | None]:
    y = np.array([row[c] for c in STATE], np.float64)
    d = row.get("drag")
    drag = None if d is None else cowell.Drag(**{k: v for k, v in d.items() if v is not None})
    far = third_body or (drag is not None and drag.srp)
    pieces = cowell.Ephemeris(row["epoch_jd"], days) if far else None
    burns = [cowell.Burn(b["start_s"], b["duration_s"], b["thrust_n"], b["isp_s"], tuple(b["direction"]), b.get("frame") or "VNB") for b in row.get("burns") or []]
    return y, cowell.Forces(row["epoch_jd"], drag, third_body, pieces), burns, row.get("mass_kg")


def _rows(row: dict, times: np.ndarray, third_body: bool, rtol: float, atol: float) -> list[tuple]:
    """States at the times, or a single row with an error."""
    jd = row["epoch_jd"]
    try:
        y, f, burns, mass = _object(row, third_body, float(times[-1] if len(times) else 0.0) / 86400)
        if burns and (why := "MASS" if mass is None else cowell.check_burns(burns, mass)):
            raise ValueError(why)
        states, masses, powered = cowell.propagate(y, times, f, burns, mass, rtol, atol)
    except (ArithmeticError, ValueError, TypeError) as e:
        return [(row["id"], 0, None, None, *[None] * 6, None, None, str(e))]
    return [(row["id"], k, float(t), jd + float(t) / 86400, *states[k].tolist(), None if np.isnan(masses[k]) else float(masses[k]), bool(powered[k]), None) for k, t in enumerate(times)]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.float64(), pa.float64(), *[pa.float64()] * 6, pa.float64(), pa.bool_(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], _NAMES)


def _settled(out: DataFrame, config: EngineConfig) -> DataFrame:
    if config.strict:
        bad = out.where("error IS NOT NULL").select("id", "error").first()
        if bad is not None:
            raise PropagationError("an orbit cannot be propagated", id=bad[0], reason=bad[1])
    return out


def _spread(states: DataFrame) -> DataFrame:
    wanted = ["id", "epoch_jd", *STATE, *(c for c in ("mass_kg", "drag", "burns") if c in states.columns)]
    return states.withColumn("id", F.col("id").cast("string")).select(*wanted).repartition("id")  # few bytes a row, seconds of work


def propagate(states: DataFrame, duration_s: float, step_s: float = 60.0, third_body: bool = False, rtol: float = 1e-8, atol: float = 1e-8, config: EngineConfig = EngineConfig(strict=False)) -> DataFrame:
    """Each object's states from its epoch to ``duration_s``, every ``step_s`` and at the end.

    An object that cannot be propagated has one row with ``error``; strict raises. Powered states have the tolerance 1e-12.
    """
    times = np.append(np.arange(0.0, duration_s - 1e-9, step_s), duration_s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                yield _batch(_rows(row, times, third_body, rtol, atol))

    return _settled(_spread(states).mapInArrow(run, _OUT), config)


def propagate_at(states: DataFrame, times: DataFrame, third_body: bool = False, dense_s: float = 10.0, config: EngineConfig = EngineConfig(strict=False)) -> DataFrame:
    """Each object's state at its own times (id, ordinal, t_jd), in their order: a run of at most ``dense_s`` a step, then splines.

    A time before the epoch is an error of its row.
    """
    wanted = times.groupBy(F.col("id").cast("string").alias("id")).agg(F.sort_array(F.collect_list(F.struct("ordinal", "t_jd"))).alias("at"))
    both = _spread(states).join(wanted, "id")

    def one(row: dict) -> list[tuple]:
        jd = np.array([a["t_jd"] for a in row["at"]])
        t = (jd - row["epoch_jd"]) * 86400
        end = float(max(t.max(), 0.0))
        n = max(4, int(np.ceil(end / dense_s)) + 1)
        knots = np.linspace(0.0, max(end, 1e-3), n)
        dense = _rows(row, knots, third_body, 1e-8, 1e-8)
        if dense[0][-1] is not None:
            return dense
        p, v = (np.array([r[k : k + 3] for r in dense], np.float64) for k in (4, 7))
        slopes = approach.spline_slopes(knots, v)
        out = []
        for a, s in zip(row["at"], t.tolist(), strict=True):
            if s < -1e-6:
                out.append((row["id"], a["ordinal"], s, a["t_jd"], *[None] * 6, None, None, "BEFORE_EPOCH"))
                continue
            k = int(np.clip(np.searchsorted(knots, s, side="right") - 1, 0, n - 2))
            h, u = np.array([knots[k + 1] - knots[k]]), np.array([(max(s, 0.0) - knots[k]) / (knots[k + 1] - knots[k])])
            pos = approach.cubic(p[k : k + 1], v[k : k + 1], p[k + 1 : k + 2], v[k + 1 : k + 2], h, u)[0][0]
            vel = approach.cubic(v[k : k + 1], slopes[k : k + 1], v[k + 1 : k + 2], slopes[k + 1 : k + 2], h, u)[0][0]
            out.append((row["id"], a["ordinal"], s, a["t_jd"], *pos.tolist(), *vel.tolist(), None, dense[k][-2], None))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                yield _batch(one(row))

    return _settled(both.mapInArrow(run, _OUT), config)


def propagate_covariance(states: DataFrame, duration_s: float, q: float = 0.0, third_body: bool = False) -> DataFrame:
    """Each object's state and 6 x 6 covariance (``cov``, 36 numbers by rows) after ``duration_s``: by the state transition
    matrix, plus process noise of density ``q``. What cannot be propagated has an ``error``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row in b.to_pylist():
                try:
                    y, f, _, _ = _object(row, third_body, duration_s / 86400)
                    c = np.array(row["cov"], np.float64).reshape(6, 6)
                    if not np.isfinite(c).all():
                        raise ValueError("covariance")
                    end, phi = cowell.transition(y, duration_s, f)
                    new = phi @ c @ phi.T + cowell.process_noise(q, duration_s)
                    out.append((row["id"], *end.tolist(), ((new + new.T) / 2).reshape(-1).tolist(), None))
                except (ArithmeticError, ValueError, TypeError) as e:
                    out.append((row["id"], *[None] * 6, None, str(e) or "state"))
            kinds = [pa.string(), *[pa.float64()] * 6, pa.list_(pa.float64()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["id", *STATE, "cov", "error"])

    wanted = ["id", "epoch_jd", *STATE, "cov", *(c for c in ("drag",) if c in states.columns)]
    rows = states.withColumn("id", F.col("id").cast("string")).select(*wanted).repartition("id")
    return rows.mapInArrow(run, "id string, " + ", ".join(f"{c} double" for c in STATE) + ", cov array<double>, error string")


def monte_carlo(events: DataFrame, n: int = 100_000, seed: int = 0) -> DataFrame:
    """``pc_mc`` of rows (id_a, id_b, miss array, speed array, cov_a, cov_b, radius_km, mean_motion or null).

    Covariances are 9 or 36 numbers by rows. Each pair draws from a seed of its own ids, so results do not depend on the
    partitions. Covariances of unequal size, or a radius below 0, have a null.
    """
    rows = events.withColumn("_seed", F.pmod(F.xxhash64("id_a", "id_b", F.lit(seed)), F.lit(2**31)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                a, c = r["cov_a"], r["cov_b"]
                ok = a is not None and c is not None and len(a) == len(c) and len(a) in (9, 36) and r["radius_km"] >= 0
                k = int(round(len(a) ** 0.5)) if ok else 0
                out.append(cowell.collision_share(r["miss"], r["speed"], np.reshape(a, (k, k)), np.reshape(c, (k, k)), r["radius_km"], n, r["_seed"], r["mean_motion"]) if ok else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.float64())], ["id_a", "id_b", "pc_mc"])

    wanted = rows.select("id_a", "id_b", "miss", "speed", "cov_a", "cov_b", "radius_km", "mean_motion", "_seed")
    return wanted.mapInArrow(run, "id_a string, id_b string, pc_mc double")


def kept_states(states: DataFrame, id_col: str = "id", order: str = "ordinal", t_jd: str = "t_jd", gap_days: float = 1e-12) -> DataFrame:
    """States without those at the time of the last one kept: a fold over each object's states in order."""
    rest = [c for c in states.columns if c != id_col]
    sorted_ = F.sort_array(F.collect_list(F.struct(order, *(c for c in rest if c != order))))
    one = states.groupBy(id_col).agg(sorted_.alias("s"))
    first = F.slice("s", 1, 1)
    kept = F.aggregate(F.slice("s", 2, F.size("s")), first, lambda acc, x: F.when(F.abs(x[t_jd] - F.element_at(acc, -1)[t_jd]) <= gap_days, acc).otherwise(F.concat(acc, F.array(x))))
    return one.select(id_col, F.inline(kept)).select(*states.columns)
