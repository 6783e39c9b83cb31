"""Orbit mean-elements messages (JSON records) as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = "OBJECT_NAME NORAD_CAT_ID OBJECT_TYPE EPOCH INCLINATION RA_OF_ASC_NODE ARG_OF_PERICENTER MEAN_ANOMALY ECCENTRICITY MEAN_MOTION BSTAR RCS_SIZE RCS MASS CD_AREA_OVER_MASS".split()


def parse(rows: DataFrame, json_col: str = "json") -> DataFrame:
    """``rows`` with the elements in radians and rad/min, ``valid``, and ``plausible``.

    Unreadable or incomplete records are neither. ``valid`` wants a catalog number and a drag term of 1 or less as well;
    ``plausible`` is the weaker check of a record before it is parsed.
    """
    r = rows.withColumn("_r", F.from_json(json_col, ", ".join(f"{n} string" for n in FIELDS)))
    num = lambda n: F.trim(F.col(f"_r.{n}")).try_cast("double")
    kind = F.upper(F.coalesce(F.col("_r.OBJECT_TYPE"), F.lit("UNKNOWN")))
    size = F.upper(F.trim(F.col("_r.RCS_SIZE")))
    # fixed values: object types and the cross sections of the size classes
    object_type = F.when(kind == "PAYLOAD", "PAYLOAD").when(kind.isin("ROCKET BODY", "ROCKET_BODY"), "ROCKET_BODY").when(kind.isin("DEBRIS", "DEBRIS/PAYLOAD"), "DEBRIS").otherwise("UNKNOWN")
    rcs = F.coalesce(num("RCS"), F.when(size == "SMALL", 0.1).when(size == "MEDIUM", 1.0).when(size == "LARGE", 10.0))
    epoch = F.unix_micros(F.try_to_timestamp(F.regexp_replace(F.trim(F.col("_r.EPOCH")), "Z$", "")))
    needed = [num(n) for n in ("INCLINATION", "RA_OF_ASC_NODE", "ARG_OF_PERICENTER", "MEAN_ANOMALY", "ECCENTRICITY", "MEAN_MOTION", "BSTAR")]
    sound = num("ECCENTRICITY").between(0, 1) & (num("ECCENTRICITY") < 1) & (num("MEAN_MOTION") > 0) & num("INCLINATION").between(0, 180) & epoch.isNotNull()
    plausible = F.coalesce(sound, F.lit(False))
    for n in needed:
        plausible = plausible & n.isNotNull()
    valid = plausible & F.coalesce(F.abs(num("BSTAR")) <= 1, F.lit(False)) & F.col("_r.NORAD_CAT_ID").isNotNull()
    return r.withColumns({
        "norad_id": F.col("_r.NORAD_CAT_ID"), "name": F.col("_r.OBJECT_NAME"), "object_type": object_type, "epoch_us": epoch, "inclination_rad": F.radians(num("INCLINATION")), "raan_rad": F.radians(num("RA_OF_ASC_NODE")),
        "argp_rad": F.radians(num("ARG_OF_PERICENTER")), "mean_anomaly_rad": F.radians(num("MEAN_ANOMALY")), "eccentricity": num("ECCENTRICITY"), "mean_motion_rad_min": num("MEAN_MOTION") * (2 * F.pi()) / 1440, "bstar": num("BSTAR"),
        "rcs_m2": rcs, "mass_kg": num("MASS"), "valid": valid, "plausible": plausible,
    }).drop("_r")
