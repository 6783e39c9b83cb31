"""Space weather and Earth orientation: files as tables by day, and what a time needs of them.

Texts are lines (file, lineno, line), from ``numbered_lines``; tables have one row a day, a few ten thousand in all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import EngineConfig, SpaceWeatherError

#: Defaults of a day without weather, places of the fields, and names of the columns of the CSV file.
DEFAULTS = {"f107_obs": 150.0, "f107_adj": 150.0, "ap": 15.0}
AP, F107_ADJ, F107_OBS, WEATHER_FIELDS = 20, 23, 28, 29
CSV = {
    "date": (0, ("DATE", "DATE_UTC")), "f107_obs": (24, ("F10.7_OBS", "F107OBS", "F10.7OBS", "OBSERVED_F10.7")),
    "f107_adj": (25, ("F10.7_ADJ", "F107ADJ", "F10.7ADJ", "ADJUSTED_F10.7")), "ap": (20, ("AP_AVG", "AP-AVG", "APAVG", "AP_DAILY")),
}


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, lineno, line) of text files."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return rows.select("file", F.posexplode(F.split("value", r"\r\n|\n")).alias("lineno", "line"))


def _inside(lines: DataFrame) -> DataFrame:
    """Lines of BEGIN .. END blocks without comments, split into fields."""
    t = lines.withColumn("line", F.trim("line")).where("line <> '' AND NOT startswith(line, '#')")
    mark = F.when(F.col("line").startswith("BEGIN"), True).when(F.col("line").startswith("END") | F.col("line").startswith("NUM_"), False)
    # files have a line a day: a window over one file is small
    on = F.last(mark, ignorenulls=True).over(Window.partitionBy("file").orderBy("lineno"))
    return t.withColumn("_on", on).withColumn("_mark", mark).where("_on AND _mark IS NULL").select("file", "lineno", F.split("line", r"\s+").alias("f"))


def space_weather_csv(lines: DataFrame) -> DataFrame:
    """(date, f107_obs, f107_adj, ap) of CSV lines; columns by the header's names, else by place.

    Blanks become 150, the observed flux and 15; rows that are no numbers, or have a flux of 0 or less, are left out. Of a
    day that is there several times the last row counts.
    """
    t = lines.where("trim(line) <> '' AND NOT startswith(trim(line), '#')").withColumn("f", F.transform(F.split("line", ","), lambda x: F.trim(F.replace(x, F.lit('"'), F.lit("")))))
    first = F.row_number().over(Window.partitionBy("file").orderBy("lineno"))
    t = t.withColumn("_n", first)
    names = t.where("_n = 1").select("file", F.transform("f", lambda x: F.replace(F.upper(x), F.lit(" "), F.lit("_"))).alias("h"))

    def place(default: int, known: tuple[str, ...]) -> Column:
        at = [F.nullif(F.array_position("h", n), F.lit(0)) for n in known]
        return F.coalesce(*at, F.lit(default + 1)).cast("int")

    t = t.where("_n > 1").join(names, "file")  # one row a file
    raw = {k: F.nullif(F.try_element_at("f", place(*v)), F.lit("")) for k, v in CSV.items()}
    t = t.select("lineno", *(v.alias(f"r_{k}") for k, v in raw.items()))
    number = lambda k, default: F.when(F.col(f"r_{k}").isNull(), default).otherwise(F.col(f"r_{k}").try_cast("double"))
    t = t.withColumn("date", F.col("r_date").try_cast("date")).withColumn("f107_obs", number("f107_obs", F.lit(150.0)))
    t = t.withColumns({"f107_adj": number("f107_adj", F.col("f107_obs")), "ap": number("ap", F.lit(15.0))})
    t = t.where("date IS NOT NULL AND f107_obs > 0 AND f107_adj IS NOT NULL AND ap IS NOT NULL")
    return _by_day(t, F.max_by)


def _by_day(t: DataFrame, pick, order: str = "lineno") -> DataFrame:
    return t.groupBy("date").agg(pick(F.struct(*DEFAULTS), F.col(order)).alias("s")).select("date", "s.*")


def space_weather_fixed(lines: DataFrame, today: str) -> DataFrame:
    """(date, f107_obs, f107_adj, ap) of the blocks of a fixed-width file.

    Of a day before ``today`` the first record counts (observed, not predicted), of others the last.
    """
    t = _inside(lines).where(F.size("f") >= WEATHER_FIELDS)
    value = lambda i: F.col("f")[i].try_cast("double")
    whole = lambda i: F.col("f")[i].try_cast("int")
    date = F.format_string("%04d-%02d-%02d", whole(0), whole(1), whole(2)).try_cast("date")
    t = t.select("lineno", date.alias("date"), value(F107_OBS).alias("f107_obs"), value(F107_ADJ).alias("f107_adj"), value(AP).alias("ap"))
    t = t.dropna()
    order = F.when(F.col("date") < F.lit(today).cast("date"), -F.col("lineno")).otherwise(F.col("lineno"))
    return _by_day(t.withColumn("_o", order), F.max_by, "_o")


def earth_orientation(lines: DataFrame) -> DataFrame:
    """(mjd, xp_arcsec, yp_arcsec, dut1_s) of the blocks of an orientation file; of a day the last record counts."""
    t = _inside(lines).where(F.size("f") >= 7)
    value = lambda i: F.col("f")[i].try_cast("double")
    t = t.select("lineno", F.col("f")[3].try_cast("int").alias("mjd"), value(4).alias("xp_arcsec"), value(5).alias("yp_arcsec"), value(6).alias("dut1_s")).dropna()
    best = t.groupBy("mjd").agg(F.max_by(F.struct("xp_arcsec", "yp_arcsec", "dut1_s"), "lineno").alias("s"))
    return best.select("mjd", "s.*")


def merge_orientation(full: DataFrame, recent: DataFrame) -> DataFrame:
    """Both tables by day; the recent one counts where both have it."""
    names = ("xp_arcsec", "yp_arcsec", "dut1_s")
    a, b = full.alias("a"), recent.alias("b")
    pick = lambda c: F.when(F.col("b.mjd").isNotNull(), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c)
    return a.join(b, F.col("a.mjd") == F.col("b.mjd"), "full_outer").select(F.coalesce("a.mjd", "b.mjd").alias("mjd"), *(pick(c) for c in names))


def weather_at(rows: DataFrame, day: str, tables: list[DataFrame], config: EngineConfig = EngineConfig()) -> DataFrame:
    """``rows`` with f107_obs, f107_adj, ap of their day: of the first table that has it, else the defaults; strict raises instead.

    Rows are joined by day, which Spark broadcasts as far as it knows the tables to be small.
    """
    out = rows
    for k, t in enumerate(tables):
        out = out.join(t.select(F.col("date").alias(day), F.struct(*DEFAULTS).alias(f"_w{k}")), day, "left")
    found = F.coalesce(*(F.col(f"_w{k}") for k in range(len(tables))), F.lit(None).cast("struct<f107_obs:double,f107_adj:double,ap:double>"))
    if config.strict:
        miss = out.where(found.isNull()).select(day).first()
        if miss is not None:
            raise SpaceWeatherError("no space weather for a day", day=str(miss[0]))
    return out.withColumn("_w", found).select(*rows.columns, *(F.coalesce(F.col(f"_w.{c}"), F.lit(v)).alias(c) for c, v in DEFAULTS.items()))


def orientation_at(rows: DataFrame, t_jd: str, table: DataFrame | None, config: EngineConfig = EngineConfig()) -> DataFrame:
    """``rows`` with xp_arcsec, yp_arcsec, dut1_s of the midnight nearest to their time, between days interpolated.

    Each day is looked up once: the days are distinct, the table becomes intervals between neighbours, and rows find
    their day by an equi-join. Before the first and after the last day the line through the last two is carried on.
    Without a table all are 0, or strict raises.
    """
    names = ("xp_arcsec", "yp_arcsec", "dut1_s")
    if table is None:
        if config.strict:
            raise SpaceWeatherError("no Earth orientation")
        return rows.withColumns({c: F.lit(0.0) for c in names})
    mjd = F.floor(F.floor(F.col(t_jd)) + 0.5 - 2400000.5).cast("int")
    w = Window.orderBy("mjd")  # a row a day
    t = table.select("mjd", F.struct(*names).alias("a"), F.lead("mjd").over(w).alias("next"), F.lead(F.struct(*names)).over(w).alias("b"), F.lag("mjd").over(w).alias("prev"))
    t = t.withColumn("final", F.lead("next").over(w).isNull())
    one = table.count()
    if not one:
        return rows.withColumns({c: F.lit(0.0) for c in names})
    days = rows.select(mjd.alias("_day")).distinct()
    if one == 1:
        held = days.crossJoin(t.select(*(F.col(f"a.{c}").alias(c) for c in names)))  # a table of one row
    else:
        t = t.where("next IS NOT NULL").withColumns({"low": F.when(F.col("prev").isNull(), -(10**9)).otherwise(F.col("mjd")), "high": F.when(F.col("final"), 10**9).otherwise(F.col("next"))})
        met = days.join(F.broadcast(t), (F.col("_day") >= F.col("low")) & (F.col("_day") < F.col("high")))  # days against days
        share = (F.col("_day") - F.col("mjd")) / (F.col("next") - F.col("mjd"))
        held = met.select("_day", *((F.col(f"a.{c}") + share * (F.col(f"b.{c}") - F.col(f"a.{c}"))).alias(c) for c in names))
    return rows.withColumn("_day", mjd).join(held, "_day").drop("_day")


def turned_with_orientation(rows: DataFrame, t_jd: str, table: DataFrame | None, config: EngineConfig = EngineConfig()) -> DataFrame:
    """``rows`` (x, y, z in TEME) with ex, ey, ez on the Earth: sidereal time of UT1, then polar motion; corrections are clamped."""
    from ..functions import formulas as f
    from ..functions import geometry as geo

    out = orientation_at(rows, t_jd, table, config)
    ut1 = f"({t_jd} + greatest(-1e0, least(1e0, dut1_s)) / 86400e0)"
    x, y = f.teme_to_ecef("x", "y", ut1)
    small = lambda c: f"greatest(-0.01e0, least(0.01e0, radians({c} / 3600e0)))"
    return geo.extend(out, [{"_gx": x, "_gy": y, "_xp": small("xp_arcsec"), "_yp": small("yp_arcsec")}, {"ex": "_gx + _xp * z", "ey": "_gy - _yp * z", "ez": "z - _xp * _gx + _yp * _gy"}]).drop("_gx", "_gy", "_xp", "_yp")
