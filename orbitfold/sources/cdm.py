"""Conjunction data messages in key = value notation: export and parse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The keys of the format, in its order.
REQUIRED = ("CREATION_DATE", "MESSAGE_ID", "TCA", "MISS_DISTANCE", "RELATIVE_SPEED")
STATE = ("X", "Y", "Z", "X_DOT", "Y_DOT", "Z_DOT")
COVARIANCE = (
    "CR_R", "CT_R", "CT_T", "CN_R", "CN_T", "CN_N", "CRDOT_R", "CRDOT_T", "CRDOT_N", "CRDOT_RDOT", "CTDOT_R",
    "CTDOT_T", "CTDOT_N", "CTDOT_RDOT", "CTDOT_TDOT", "CNDOT_R", "CNDOT_T", "CNDOT_N", "CNDOT_RDOT", "CNDOT_TDOT", "CNDOT_NDOT",
)


def export_kvn(messages: DataFrame, originator: str) -> DataFrame:
    """A column ``kvn`` of message_id, creation and tca (ISO text), miss_m, speed_m_s, pc, and structs object_1 and object_2.

    An object is (designator, name, state of six numbers, covariance of 21 numbers or null). A null pc has no line.
    """
    line = lambda k, v: F.concat(F.rpad(F.lit(k), 32, " "), F.lit(" = "), v)
    number = lambda c, form: F.format_string(form, c)

    def block(o: str, label: str) -> list[Column]:
        state = [line(k, number(F.col(o)["state"][i], "%.6f" if i < 3 else "%.9f")) for i, k in enumerate(STATE)]
        cov = [line(k, number(F.col(o)["covariance"][i], "%.6e")) for i, k in enumerate(COVARIANCE)]
        return [line("OBJECT", F.lit(label)), line("OBJECT_DESIGNATOR", F.col(o)["designator"]), line("OBJECT_NAME", F.col(o)["name"]), *state, *(F.when(F.col(o)["covariance"].isNotNull(), c) for c in cov)]

    head = [
        line("CCSDS_CDM_VERS", F.lit("1.0")), line("CREATION_DATE", F.col("creation")), line("ORIGINATOR", F.lit(originator)), line("MESSAGE_ID", F.col("message_id")), line("TCA", F.col("tca")),
        line("MISS_DISTANCE", number(F.col("miss_m"), "%.4f")), line("RELATIVE_SPEED", number(F.col("speed_m_s"), "%.4f")), F.when(F.col("pc").isNotNull(), line("COLLISION_PROBABILITY", number(F.col("pc"), "%.6e"))),
    ]
    return messages.withColumn("kvn", F.concat(F.concat_ws("\n", *head, *block("object_1", "OBJECT1"), *block("object_2", "OBJECT2")), F.lit("\n")))


def parse_kvn(messages: DataFrame, kvn: str = "kvn") -> DataFrame:
    """``messages`` with reason (null if valid), message_id, creation, tca, miss_m, speed_m_s, pc, object_1 and object_2.

    Each object has its own covariance; unknown keys and comments are passed over; of a repeated key the last counts.
    Reasons: MISSING_<key>, BAD_NUMBER, BOUNDS_VIOLATION (negative miss or speed, probability outside 0 to 1).
    """
    parts = messages.withColumn("_p", F.split(F.coalesce(F.col(kvn), F.lit("")), r"(?mi)^\s*OBJECT\s*=\s*(?=OBJECT[12]\s*$)"))
    lines = lambda text: F.transform(
        F.filter(F.split(text, r"\r?\n"), lambda x: x.contains("=") & ~F.ltrim(x).startswith("COMMENT")),
        lambda x: F.struct(F.upper(F.trim(F.substring_index(x, "=", 1))).alias("k"), F.trim(F.regexp_replace(x, r"^[^=]*=", "")).alias("v")),
    )
    section = lambda n: lines(F.concat_ws("\n", F.transform(F.filter(F.slice(F.col("_p"), 2, F.size("_p")), lambda s: F.upper(s).startswith(f"OBJECT{n}")), lambda s: s)))
    parts = parts.withColumns({"_h": lines(F.try_element_at("_p", F.lit(1))), "_o1": section(1), "_o2": section(2)})
    value = lambda c, k: F.try_element_at(F.filter(F.col(c), lambda e: e["k"] == k), F.lit(-1))["v"]
    number = lambda c, k: value(c, k).try_cast("double")

    def body(c: str) -> Column:
        cov = F.array(*(F.coalesce(number(c, k), F.lit(0.0)) for k in COVARIANCE))
        return F.struct(
            F.coalesce(value(c, "OBJECT_DESIGNATOR"), F.lit("UNKNOWN")).alias("designator"), F.coalesce(value(c, "OBJECT_NAME"), F.lit("Unknown")).alias("name"),
            F.array(*(F.coalesce(number(c, k), F.lit(0.0)) for k in STATE)).alias("state"), F.when(value(c, "CR_R").isNotNull(), cov).alias("covariance"),
        )

    miss, speed, pc = (number("_h", k) for k in ("MISS_DISTANCE", "RELATIVE_SPEED", "COLLISION_PROBABILITY"))
    reason = F.coalesce(
        *(F.when(value("_h", k).isNull(), F.lit(f"MISSING_{k}")) for k in REQUIRED),
        F.when(miss.isNull() | speed.isNull() | (value("_h", "COLLISION_PROBABILITY").isNotNull() & pc.isNull()), F.lit("BAD_NUMBER")),
        F.when((miss < 0) | (speed < 0) | F.coalesce((pc < 0) | (pc > 1), F.lit(False)), F.lit("BOUNDS_VIOLATION")),
    )
    return parts.select(
        *messages.columns, reason.alias("reason"), value("_h", "MESSAGE_ID").alias("message_id"), value("_h", "CREATION_DATE").alias("creation"), value("_h", "TCA").alias("tca"),
        miss.alias("miss_m"), speed.alias("speed_m_s"), pc.alias("pc"), body("_o1").alias("object_1"), body("_o2").alias("object_2"),
    )
