"""SGP4 over catalogs: states at times of each row, on a common grid, in chunks of it, and as one row a satellite.

``elements`` tables have id, epoch_us (microseconds since 1970, UTC) and SGP4's mean elements in radians and radians a
minute: i, node, e, argp, m, n, bstar. ``from_tle`` and ``from_omm`` make them. Times are microseconds, so minutes since
epoch lose nothing; t_jd stands beside them. Satellites are rows, so tasks share nothing, and each batch is one call of
the kernel over satellites and times.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels.sgp4 import Satellites

FIELDS = ("i", "node", "e", "argp", "m", "n", "bstar")
STATE = ("x", "y", "z", "vx", "vy", "vz")
#: Satellite-times that one call of the kernel works on, and steps of a row of the grid.
BLOCK, CHUNK = 100_000, 1440
_STATES = "step int, t_us long, t_jd double, " + ", ".join(f"{c} double" for c in STATE) + ", error_code int"


def us_of_jd(jd: float) -> int:
    return round((jd - 2440587.5) * 86_400_000_000)


def from_tle(rows: DataFrame, id_col: str = "norad_id") -> DataFrame:
    """Elements of parsed two-line elements (degrees, revolutions a day); rows without mean motion or epoch are left out."""
    angle = lambda c, n: F.radians(c).alias(n)
    turn = (F.col("mean_motion") * (2 * np.pi / 1440)).alias("n")
    some = rows.where("mean_motion IS NOT NULL AND epoch_us IS NOT NULL")
    return some.select(
        F.col(id_col).cast("string").alias("id"), "epoch_us", angle("inclination", "i"), angle("raan", "node"), F.col("eccentricity").alias("e"), angle("argp", "argp"), angle("mean_anomaly", "m"), turn, "bstar"
    )


def from_omm(rows: DataFrame, id_col: str = "norad_id") -> DataFrame:
    """Elements of valid mean-elements messages."""
    names = {"inclination_rad": "i", "raan_rad": "node", "eccentricity": "e", "argp_rad": "argp", "mean_anomaly_rad": "m", "mean_motion_rad_min": "n", "bstar": "bstar"}
    return rows.where("valid").select(F.col(id_col).cast("string").alias("id"), "epoch_us", *(F.col(a).alias(b) for a, b in names.items()))


def last_by_id(elements: DataFrame, order: str) -> DataFrame:
    """Of each id the row that comes last in ``order``: of duplicate ids the last one wins."""
    rest = [c for c in elements.columns if c != "id"]
    return elements.groupBy("id").agg(F.max_by(F.struct(*rest), F.col(order)).alias("s")).select("id", "s.*")


def satellites(b: pa.RecordBatch, gravity: str) -> Satellites:
    get = lambda c: b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.float64)
    return Satellites(2440587.5 + get("epoch_us") / 86_400e6, *(get(c) for c in FIELDS), gravity=gravity)


def minutes(b: pa.RecordBatch, t_us: np.ndarray) -> np.ndarray:
    """Minutes since each row's epoch of times (row, time) or (time,)."""
    epoch = b.column(b.schema.get_field_index("epoch_us")).to_numpy(zero_copy_only=False).astype(np.int64)
    return (t_us - epoch[:, None]) / 60e6


def _flat(ids, step, t_us, pos, vel, err) -> pa.RecordBatch:
    n, m = err.shape
    columns = [ids.take(pa.array(np.repeat(np.arange(n), m))), pa.array(step.reshape(-1).astype(np.int32)), pa.array(t_us.reshape(-1)), pa.array(2440587.5 + t_us.reshape(-1) / 86_400e6)]
    states = [pa.array(np.ascontiguousarray(a[..., k]).reshape(-1)) for a in (pos, vel) for k in range(3)]
    return pa.RecordBatch.from_arrays([*columns, *states, pa.array(err.reshape(-1))], ["id", "step", "t_us", "t_jd", *STATE, "error_code"])


def propagate_at(rows: DataFrame, gravity: str = "wgs72") -> DataFrame:
    """The state of each row of elements at its own time ``t_us``; vectors stay as they are where there is an error code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                t = b.column(b.schema.get_field_index("t_us")).to_numpy(zero_copy_only=False).astype(np.int64)[:, None]
                yield _flat(b.column(0), np.zeros(t.shape), t, *satellites(b, gravity).at(minutes(b, t)))

    return rows.select("id", "epoch_us", *FIELDS, "t_us").mapInArrow(run, "id string, " + _STATES)


def propagate(elements: DataFrame, start_us: int, n: int, step_us: int, chunk: int = CHUNK, gravity: str = "wgs72") -> DataFrame:
    """The state of each satellite at ``n`` times: id, step, t_us, t_jd, x .. vz, error_code; vectors are NaN at errors.

    A row is cut into chunks of the grid, dealt over all partitions (elements are small, states are not), so a long grid
    of one satellite is many tasks, and no task holds more than a block of states.
    """
    chunks = elements.withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit((n - 1) // chunk)))) if n > 0 else elements.withColumn("_c", F.lit(0)).limit(0)
    dealt = chunks.repartition("id", "_c").select("id", "epoch_us", *FIELDS, "_c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = max(1, BLOCK // min(n, chunk))
        for whole in batches:
            for c in sorted(set(whole.column(9).to_pylist())):
                part = whole.filter(pa.array(whole.column(9).to_numpy() == c))
                steps = np.arange(c * chunk, min(n, (c + 1) * chunk), dtype=np.int64)
                for i in range(0, part.num_rows, most):
                    b = part.slice(i, most)
                    t = np.broadcast_to(start_us + steps * step_us, (b.num_rows, len(steps)))
                    pos, vel, err = satellites(b, gravity).at(minutes(b, t))
                    bad = err != 0
                    pos[bad], vel[bad] = np.nan, np.nan
                    yield _flat(b.column(0), np.broadcast_to(steps, t.shape), t, pos, vel, err)

    return dealt.mapInArrow(run, "id string, " + _STATES)


def trajectory(elements: DataFrame, start_jd: float, end_jd: float, step_minutes: float = 5.0, gravity: str = "wgs72") -> DataFrame:
    """States every ``step_minutes`` from start to end, the end included if it is on the grid."""
    n = int(np.floor((end_jd - start_jd) * 1440 / step_minutes + 1e-6)) + 1 if end_jd >= start_jd else 0
    return propagate(elements, us_of_jd(start_jd), n, round(step_minutes * 60e6), gravity=gravity)


def of_elements(start_us: int, n: int, step_us: int, gravity: str = "wgs72"):
    """A function of batches of elements: positions and velocities (row, time, 3) on the grid, and whether all steps are good."""
    t = start_us + np.arange(n, dtype=np.int64) * step_us

    def made(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p, v, good = np.empty((b.num_rows, n, 3)), np.empty((b.num_rows, n, 3)), np.empty(b.num_rows, bool)
        for i in range(0, b.num_rows, max(1, BLOCK // n)):
            part = b.slice(i, max(1, BLOCK // n))
            pos, vel, err = satellites(part, gravity).at(minutes(part, t[None, :]))
            to = slice(i, i + part.num_rows)
            p[to], v[to], good[to] = pos, vel, (err == 0).all(1) & np.isfinite(pos).all((1, 2)) & np.isfinite(vel).all((1, 2))
        return p, v, good

    return made


def tracks(elements: DataFrame, start_us: int, n: int, step_us: int, gravity: str = "wgs72") -> DataFrame:
    """One row a satellite: id, positions ``p`` and velocities ``v``, flat over the grid, and whether all steps are ``good``."""
    made = of_elements(start_us, n, step_us, gravity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, max(1, BLOCK // n)):
                b = whole.slice(i, max(1, BLOCK // n))
                pos, vel, good = made(b)
                off = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * (3 * n))
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.ListArray.from_arrays(off, pa.array(x.reshape(-1))) for x in (pos, vel)), pa.array(good)], ["id", "p", "v", "good"])

    return elements.select("id", "epoch_us", *FIELDS).repartition("id").mapInArrow(run, "id string, p array<double>, v array<double>, good boolean")


def tracks_of(ephemeris: DataFrame, id_col: str = "id", velocity: bool = True) -> DataFrame:
    """The same of a table of states (id, step, x .. vz) whose objects have the same steps; ``v`` is null without velocity."""
    names = STATE if velocity else STATE[:3]
    rows = ephemeris.groupBy(F.col(id_col).cast("string").alias("id")).agg(F.sort_array(F.collect_list(F.struct("step", *names))).alias("s"))
    flat = lambda cs: F.flatten(F.transform("s", lambda s: F.array(*(s[c] for c in cs))))
    good = F.forall("s", lambda s: sum((F.when(s[c].isNotNull() & ~F.isnan(s[c]) & (F.abs(s[c]) < 1e300), 0).otherwise(1) for c in names), F.lit(0)) == 0)
    v = flat(STATE[3:]) if velocity else F.lit(None).cast("array<double>")
    return rows.select("id", flat(STATE[:3]).alias("p"), v.alias("v"), good.alias("good"))


def finite_only(ephemeris: DataFrame, id_col: str = "id", strict: bool = False) -> DataFrame:
    """The states of objects all of whose steps are finite; ``strict`` raises where there is another."""
    bad = F.lit(False)
    for c in STATE[:3]:
        bad = bad | F.col(c).isNull() | F.isnan(c) | (F.abs(c) >= 1e300)
    gone = ephemeris.where(bad).select(id_col).distinct()
    if strict:
        from ..errors import PropagationError

        one = gone.first()
        if one is not None:
            raise PropagationError(f"object {one[0]} has a state that is not finite")
    return ephemeris.join(gone, id_col, "left_anti")
