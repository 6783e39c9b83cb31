"""Two-line elements as DataFrames: grouping of lines, validation with reason codes, parsing. All in Catalyst."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Reasons in the order in which they are tested.
REASONS = ("L1_LENGTH", "L2_LENGTH", "L1_PREFIX", "L2_PREFIX", "L1_CHECKSUM", "L2_CHECKSUM", "ID_MISMATCH", "EPOCH_PARSE_ERROR", "BOUNDS_VIOLATION")


def checksum(line: Column) -> Column:
    """Sum of the digits, minus signs counting one, of the first 68 characters, modulo 10."""
    body = F.substring(line, 1, 68)
    digits = [F.lit(d) * (F.length(body) - F.length(F.replace(body, F.lit(str(d)), F.lit("")))) for d in range(1, 10)]
    return (sum(digits, F.length(body) - F.length(F.replace(body, F.lit("-"), F.lit("")))) % 10).cast("int")


def epoch_micros(text: Column) -> Column:
    """Microseconds since 1970 of YYDDD.ffffffff; null if it is no number. Years below 57 are 20YY."""
    yy, doy = F.expr("1").cast("int"), None
    yy = F.substring(text, 1, 2).try_cast("int")
    doy = F.substring(text, 3, 20).try_cast("double")
    year = F.when(yy < 57, yy + 2000).otherwise(yy + 1900)
    day = F.floor(doy)
    start = F.datediff(F.make_date(year, F.lit(1), F.lit(1)), F.lit("1970-01-01").cast("date")).cast("long")
    return ((start + day.cast("long") - 1) * F.lit(86_400_000_000) + F.round((doy - day) * 86400 * 1000000).cast("long")).cast("long")


def parse(rows: DataFrame, line1: str = "line1", line2: str = "line2") -> DataFrame:
    """``rows`` with the elements and ``reason``: null for a valid pair of lines, else why it is not (elements are then null).

    Null lines fail the length test.
    """
    a, b = F.trim(F.coalesce(F.col(line1), F.lit(""))), F.trim(F.coalesce(F.col(line2), F.lit("")))
    last = lambda c: F.substring(c, 69, 1).try_cast("int")
    part = lambda c, i, n: F.trim(F.substring(c, i, n))
    us = epoch_micros(part(a, 19, 14))
    ecc_text, inc_text = part(b, 27, 7), part(b, 9, 8)
    ecc, inc = F.concat(F.lit("."), ecc_text).try_cast("double"), inc_text.try_cast("double")
    bad_ecc = (ecc_text != "") & (ecc.isNull() | (ecc < 0) | (ecc >= 1))
    bad_inc = (inc_text != "") & (inc.isNull() | (inc < 0) | (inc > 180))
    tests = (F.length(a) != 69, F.length(b) != 69, ~a.startswith("1 "), ~b.startswith("2 "), ~last(a).eqNullSafe(checksum(a)), ~last(b).eqNullSafe(checksum(b)), part(a, 3, 5) != part(b, 3, 5), us.isNull(), bad_ecc | bad_inc)
    reason = F.coalesce(*(F.when(t, F.lit(r)) for t, r in zip(tests, REASONS, strict=True)))
    star = F.replace(part(a, 54, 8), F.lit(" "), F.lit(""))
    sign = F.when(star.startswith("-"), -1.0).otherwise(1.0)
    star = F.regexp_replace(star, "^-", "")
    mantissa = F.regexp_extract(star, r"^(\d*)([+-]?\d)$", 1)
    bstar = F.coalesce(sign * F.concat(F.lit("0."), mantissa, F.lit("e"), F.regexp_extract(star, r"^(\d*)([+-]?\d)$", 2)).try_cast("double"), F.lit(0.0))
    ok = lambda c: F.when(F.col("reason").isNull(), c)
    # through a generator: a filter on the reason then stays above, and does not repeat all the tests in itself
    return rows.withColumn("reason", F.explode(F.array(reason))).withColumns({
        "norad_id": ok(part(a, 3, 5)), "classification": ok(F.substring(a, 8, 1)), "epoch_us": ok(us), "inclination": ok(inc), "raan": ok(part(b, 18, 8).try_cast("double")), "eccentricity": ok(ecc),
        "argp": ok(part(b, 35, 8).try_cast("double")), "mean_anomaly": ok(part(b, 44, 8).try_cast("double")), "mean_motion": ok(part(b, 53, 11).try_cast("double")), "bstar": ok(bstar),
    })


def group_lines(lines: DataFrame, line: str = "line", order: str = "lineno", file: str = "file") -> DataFrame:
    """(file, lineno, name, line1, line2) of each pair of lines; the line before is the name, else NORAD-<id>; others are skipped."""
    w = Window.partitionBy(file).orderBy(order)
    c = F.rtrim(F.col(line))
    with_next = lines.select(file, order, c.alias("line1"), F.lead(c).over(w).alias("line2"), F.lag(c).over(w).alias("_before"))
    pair = with_next.where(F.col("line1").startswith("1 ") & F.col("line2").startswith("2 "))
    named = F.col("_before").isNotNull() & (F.trim("_before") != "") & ~F.col("_before").rlike("^[12] ")
    name = F.when(named, F.trim(F.regexp_replace("_before", "^0 ", ""))).otherwise(F.concat(F.lit("NORAD-"), F.trim(F.substring("line1", 3, 5))))
    return pair.select(file, order, name.alias("name"), "line1", "line2")


def format_lines(rows: DataFrame) -> DataFrame:
    """line1 and line2 from id (up to 99999), year (two digits), day of year and elements; the inverse of ``parse``."""
    one = F.format_string("1 %05dU 98067A   %02d%012.8f  .00000000  00000-0  00000-0 0  999", "id", "yy", "doy")
    two = F.format_string("2 %05d %8.4f %8.4f %07d %8.4f %8.4f %11.8f    0", "id", "inclination", "raan", F.round(F.col("eccentricity") * 1e7).cast("long"), "argp", "mean_anomaly", "mean_motion")
    out = rows.withColumns({"_one": F.rpad(one, 68, " "), "_two": F.rpad(two, 68, " ")})
    return out.withColumns({"line1": F.concat("_one", checksum(F.col("_one")).cast("string")), "line2": F.concat("_two", checksum(F.col("_two")).cast("string"))}).drop("_one", "_two")
