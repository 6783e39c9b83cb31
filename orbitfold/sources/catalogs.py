"""Catalogs from files and from landed responses: lines, JSON arrays, groups with fallbacks, object details, covariances.

Nothing here opens a connection: a job that lands responses writes them under a folder, one file for each request, and
these readers take the place of the requests. Strict reading raises at a bad record, relaxed reading leaves it out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EngineConfig, LookupFailed, settle
from ..operators.catalog import union_keep_first
from . import omm, tle
from .environment import numbered_lines

#: Bytes that a JSON payload may have; groups of the comprehensive catalog in their order; ids in one request.
MOST_BYTES = 50 << 20
GROUPS = ("stations", "visual", "active", "analyst", "fengyun-1c-debris", "iridium-33-debris", "cosmos-2251-debris")
BATCH = 100
#: Hours that a landed file counts as fresh, by what it holds.
FRESH_HOURS = {"tle": 6, "historical": None, "covariance": 1, "details": 24, "ids": 12, "weather": 6, "weather_full": 168, "orientation": 24, "orientation_full": 168}


def load_tle(lines: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Elements of lines (file, lineno, line) in groups of two or three; orphan lines are passed over.

    Strict: the first bad pair raises. Relaxed: bad pairs are left out, and it raises if all are bad. No lines, no rows.
    """
    return settle(tle.parse(tle.group_lines(lines)), "reason", config)


def read_tle(spark: SparkSession, path: str, config: EngineConfig = EngineConfig()) -> DataFrame:
    return load_tle(numbered_lines(spark, path), config)


def parse_omm_payloads(payloads: DataFrame, text: str = "text") -> DataFrame:
    """A row for each record of JSON arrays: ordinal, the columns of ``omm.parse`` and ``reason``.

    Reasons: TOO_LARGE and NOT_AN_ARRAY of a payload (one row, no record), INVALID of a record.
    """
    keep = [c for c in payloads.columns if c != text]
    t = F.coalesce(F.col(text), F.lit(""))
    rows = payloads.withColumn("_records", F.when((F.octet_length(t) <= MOST_BYTES) & F.ltrim(t).startswith("["), F.from_json(t, "array<string>")))
    why = F.when(F.octet_length(t) > MOST_BYTES, F.lit("TOO_LARGE")).when(F.col("_records").isNull(), F.lit("NOT_AN_ARRAY"))
    rows = rows.withColumn("_why", why).select(*keep, "_why", F.posexplode_outer("_records").alias("ordinal", "json")).where("json IS NOT NULL OR _why IS NOT NULL")
    out = omm.parse(rows)
    return out.withColumn("reason", F.coalesce("_why", F.when(~F.col("valid"), F.lit("INVALID")))).drop("_why", "json")


def read_omm(spark: SparkSession, path: str, config: EngineConfig = EngineConfig()) -> DataFrame:
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))
    return settle(parse_omm_payloads(files), "reason", config)


def elements_of_lines(rows: DataFrame) -> DataFrame:
    """Parsed lines with the columns of ``omm.parse`` as well: radians, radians a minute; rows with a reason are left out."""
    ok = rows.where("reason IS NULL")
    return ok.withColumns({
        "inclination_rad": F.radians("inclination"), "raan_rad": F.radians("raan"), "argp_rad": F.radians("argp"), "mean_anomaly_rad": F.radians("mean_anomaly"),
        "mean_motion_rad_min": F.col("mean_motion") * (2 * F.pi()) / 1440, "object_type": F.lit("UNKNOWN"), "valid": F.lit(True),
    })


def line2_elements(line2: str) -> dict[str, Column]:
    """Inclination, raan, eccentricity, argp, mean anomaly and mean motion as the second line has them (degrees, revolutions a day)."""
    cut = lambda i, n: F.trim(F.substring(F.col(line2), i, n))
    number = lambda i, n: cut(i, n).try_cast("double")
    return {"inclination": number(9, 8), "raan": number(18, 8), "eccentricity": F.concat(F.lit("0."), cut(27, 7)).try_cast("double"), "argp": number(35, 8), "mean_anomaly": number(44, 8), "mean_motion": number(53, 11)}


# ---------------------------------------------------------------- landed responses


def landed(spark: SparkSession, folder: str, fresh_hours: float | None = None, now_us: int | None = None) -> DataFrame:
    """(name, modified_us, fresh, text, reason) of the files of a folder: a name is the file's without its ending.

    Reasons as of a request: EMPTY, RATE_LIMIT and SERVER_ERROR by a first line ``status 403`` or ``status 5..``, and
    INVALID_QUERY where the text says so. Without ``fresh_hours`` a file never gets stale.
    """
    files = spark.read.format("binaryFile").load(folder)
    text = F.decode("content", "UTF-8")
    status = F.regexp_extract(text, r"^status (\d{3})", 1)
    body = F.regexp_replace(text, r"^status \d{3}\r?\n?", "")
    reason = F.when(status == "403", F.lit("RATE_LIMIT")).when(status.startswith("5"), F.lit("SERVER_ERROR")).when(F.trim(body) == "", F.lit("EMPTY")).when(F.lower(F.substring(body, 1, 200)).contains("invalid query"), F.lit("INVALID_QUERY"))
    at = F.unix_micros("modificationTime")
    fresh = F.lit(True) if fresh_hours is None else at >= (F.lit(now_us) if now_us is not None else F.unix_micros(F.current_timestamp())) - F.lit(int(fresh_hours * 3_600_000_000))
    return files.select(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("name"), at.alias("modified_us"), fresh.alias("fresh"), body.alias("text"), reason.alias("reason"))


def group(main: DataFrame, extra: DataFrame, name: str, config: EngineConfig = EngineConfig()) -> DataFrame:
    """The response for a group: of the main service, else, where that is empty, invalid or a server's fault, of the other one.

    A rate limit raises at once, and so does a group that neither has.
    """
    for table in (main, extra):
        row = table.where(F.col("name") == name).select("reason").first()
        if row is not None and row[0] == "RATE_LIMIT":
            raise LookupFailed("the service limits requests", group=name)
        if row is not None and row[0] is None:
            return table.where(F.col("name") == name)
    raise LookupFailed("no service has the group", group=name)


def comprehensive(main: DataFrame, extra: DataFrame, form: str = "json", groups: tuple[str, ...] = GROUPS, config: EngineConfig = EngineConfig()) -> DataFrame:
    """The union of the groups, of each object the row of the first group that has it; a group that fails is left out, or strict raises."""
    found = []
    for name in groups:
        try:
            one = group(main, extra, name, config).select("name", "text")
        except LookupFailed:
            if config.strict:
                raise
            continue
        if form == "json":
            rows = settle(parse_omm_payloads(one), "reason", config)
        else:
            lines = one.select(F.col("name").alias("file"), F.posexplode(F.split("text", r"\r\n|\n")).alias("lineno", "line"))
            rows = load_tle(lines, config).withColumnRenamed("lineno", "ordinal")
        found.append(rows)
    if not found:
        raise LookupFailed("no group could be read")
    return union_keep_first(found)


def name_filter(names: Column, group_name: str) -> Column:
    """Whether an object is of a group by its name: what starts with a constellation's name, or contains debris."""
    key = F.lit(group_name.upper())
    return F.when(key.isin("ACTIVE", "ALL"), F.lit(True)).when(key == "DEBRIS", F.upper(names).contains("DEB")).otherwise(F.startswith(F.upper(names), key))


def requests(ids: DataFrame, id_col: str = "norad_id") -> DataFrame:
    """(request, ids): distinct ids in ascending order, BATCH of them a request."""
    ranked = ids.select(F.col(id_col).cast("long").alias("id")).distinct().repartitionByRange("id").sortWithinPartitions("id")
    # numbered within partitions, so nothing passes through one task
    part, row = F.spark_partition_id(), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return ranked.withColumn("request", F.concat_ws("-", part.cast("string"), F.floor(row / BATCH).cast("string"))).groupBy("request").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def details(objects: DataFrame, satcat: DataFrame, id_col: str = "norad_id") -> DataFrame:
    """``objects`` with what a landed JSON array of details says of them: ``detail`` (JSON text), null if nothing, and ``guid``."""
    rows = satcat.select(F.explode(F.from_json("text", "array<string>")).alias("detail"))
    known = rows.select(F.get_json_object("detail", "$.noradId").alias("_id"), F.get_json_object("detail", "$.id").alias("guid"), "detail").where("_id IS NOT NULL")
    known = known.groupBy("_id").agg(F.min(F.struct("guid", "detail")).alias("d"))
    out = objects.join(known, F.col(id_col).cast("string") == F.col("_id"), "left")
    return out.select(*objects.columns, F.col("d.guid").alias("guid"), F.col("d.detail").alias("detail"))


def with_source(rows: DataFrame, tag: str, date: str | None = None) -> DataFrame:
    """Provenance: where the rows are from, and the catalog's day for landing tables."""
    return rows.withColumns({"source_tag": F.lit(tag), "catalog_date": F.lit(date).cast("date")})
