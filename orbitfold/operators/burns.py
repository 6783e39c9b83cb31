"""Burn plans, budgets and timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import formulas as f
from ..functions import geometry as g


def _centred(n: int, dv: str, centre: str):
    """One burn around a moment (seconds after t0): along is +1 for a burn along the motion, -1 against it."""
    return F.struct(
        F.lit(n).alias("seq"), F.expr(f"abs({dv})").alias("dv_km_s"), F.expr(f"CASE WHEN {dv} < 0e0 THEN -1 ELSE 1 END").alias("along"), F.col(f"_p{n}").alias("propellant_kg"),
        F.expr(f"_p{n} * isp * {f.G0} / thrust").alias("duration_s"), F.expr(f"({centre}) - _p{n} * isp * {f.G0} / thrust / 2e0").alias("ignition_s"),
        F.expr(f"t0 + (({centre}) - _p{n} * isp * {f.G0} / thrust / 2e0) / 86400e0").alias("ignition_jd"),
    )


def _plan(plans: DataFrame, dvs: list[str], centres: list[str]) -> DataFrame:
    """Burns with these signed speeds; each starts from the mass that the one before has left."""
    left, p = "mass", plans.withColumns({f"_d{n}": F.expr(e) for n, e in enumerate(dvs, 1)})
    for n in range(1, len(dvs) + 1):
        p = p.withColumn(f"_p{n}", F.expr(f.tsiolkovsky_kg(f"({left})", f"abs(_d{n})", "isp")))
        left += f" - _p{n}"
    return p.select(*plans.columns, F.inline(F.array(*(_centred(n, f"_d{n}", c) for n, c in enumerate(centres, 1)))))


def _speed(r: str, other: str) -> str:
    return f"sqrt({f.MU} * (2e0 / {r} - 2e0 / ({r} + {other})))"


def _half(r: str, other: str) -> str:
    return f"pi() * sqrt(power(({r} + {other}) / 2e0, 3e0) / {f.MU})"


def hohmann(plans: DataFrame) -> DataFrame:
    """Two burns for each plan (r1, r2, isp, mass, thrust, t0), centred on the apsides: seq, dv_km_s, along, propellant_kg,
    duration_s, ignition_s (after t0), ignition_jd."""
    return _plan(plans, [f"{_speed('r1', 'r2')} - {_speed('r1', 'r1')}", f"{_speed('r2', 'r2')} - {_speed('r2', 'r1')}"], ["0e0", _half("r1", "r2")])


def plane_change(plans: DataFrame) -> DataFrame:
    """One burn for each plan (r1, di in degrees, isp, mass, thrust), along plus or minus the orbit's normal."""
    p = plans.withColumn("dv_km_s", F.expr(f"2e0 * sqrt({f.MU} / r1) * abs(sin(radians(di) / 2e0))"))
    p = p.withColumn("propellant_kg", F.expr(f.tsiolkovsky_kg("mass", "dv_km_s", "isp")))
    return p.withColumns({"duration_s": F.expr(f"propellant_kg * isp * {f.G0} / thrust"), "normal_sign": F.expr("CASE WHEN di > 0e0 THEN 1 ELSE -1 END")})


def budget(burns: DataFrame, key: str, order: str) -> DataFrame:
    """``burns`` (thrust, isp, duration_s, initial_kg) with propellant_kg, mass_before_kg, mass_after_kg and dv_m_s by running sums."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    b = burns.withColumn("propellant_kg", F.expr(f"thrust / (isp * {f.G0}) * duration_s"))
    b = b.withColumn("mass_after_kg", F.col("initial_kg") - F.sum("propellant_kg").over(w)).withColumn("mass_before_kg", F.col("mass_after_kg") + F.col("propellant_kg"))
    return b.withColumn("dv_m_s", F.when(F.col("mass_after_kg") > 0, F.expr(f"isp * {f.G0} * ln(mass_before_kg / mass_after_kg)")))


def overlaps(burns: DataFrame, key: str) -> DataFrame:
    """Burns that the next one of their key starts before the end of."""
    w = Window.partitionBy(key).orderBy("start", "id")
    return burns.withColumn("next_start", F.lead("start").over(w)).where(F.col("next_start") < F.col("stop"))


def segments(burns: DataFrame, key: str, low: int, high: int) -> DataFrame:
    """The timeline of each key from ``low`` to ``high`` as coast and burn intervals (start, stop, burn), clamped; empty ones are left out."""
    w = Window.partitionBy(key).orderBy("start", "id")
    clamp = lambda c: F.greatest(F.lit(low), F.least(F.lit(high), F.col(c)))
    b = burns.select(key, "id", clamp("start").alias("start"), clamp("stop").alias("stop"))
    before = F.coalesce(F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(low))
    last = F.lead("id").over(w).isNull()
    b = b.withColumn("_begin", F.greatest(F.col("start"), before)).withColumn("_before", before).withColumn("_last", last).withColumn("_end", F.greatest("stop", "_before"))
    parts = F.array(F.struct(F.col("_before").alias("start"), F.col("_begin").alias("stop"), F.lit(False).alias("burn")), F.struct(F.col("_begin").alias("start"), F.col("_end").alias("stop"), F.lit(True).alias("burn")), F.struct(F.col("_end").alias("start"), F.when(F.col("_last"), F.lit(high)).otherwise(F.col("_end")).alias("stop"), F.lit(False).alias("burn")))
    return b.select(key, F.inline(parts)).where("stop > start")


def bielliptic(plans: DataFrame) -> DataFrame:
    """Three burns for each plan (r1, rb, r2, isp, mass, thrust, t0) by way of apoapsis rb; columns as of ``hohmann``."""
    dvs = [f"{_speed('r1', 'rb')} - {_speed('r1', 'r1')}", f"{_speed('rb', 'r2')} - {_speed('rb', 'r1')}", f"{_speed('r2', 'r2')} - {_speed('r2', 'rb')}"]
    return _plan(plans, dvs, ["0e0", _half("r1", "rb"), f"{_half('r1', 'rb')} + {_half('rb', 'r2')}"])


def thrust_acceleration(burns: DataFrame, frame: str = "VNB") -> DataFrame:
    """``burns`` (state, thrust in N, mass_kg, direction dx, dy, dz in the frame) with ax, ay, az in inertial axes, km/s2."""
    axes = {"VNB": (g.VNB, ("v_", "n_", "b_")), "RTN": (g.RTN, ("r_", "t_", "n_"))}[frame]
    out = g.extend(burns, [*axes[0], *g.to_inertial(axes[1], ("dx", "dy", "dz"), "_i")])
    return out.select(*burns.columns, *(F.expr(f"thrust / mass_kg / 1000e0 * _i{c}").alias(f"a{c}") for c in "xyz"))


def validate(burns: DataFrame) -> DataFrame:
    """``burns`` (duration_s, thrust, isp, direction dx, dy, dz, mass) with ``reason``: the first check that fails, or null."""
    reason = f"CASE WHEN NOT duration_s > 0e0 THEN 'DURATION' WHEN NOT thrust > 0e0 THEN 'THRUST' WHEN NOT isp > 0e0 THEN 'ISP' WHEN abs(sqrt(dx * dx + dy * dy + dz * dz) - 1e0) > 1e-6 THEN 'DIRECTION' WHEN thrust / (isp * {f.G0}) * duration_s > mass THEN 'MASS' END"
    return burns.withColumn("reason", F.expr(reason))
