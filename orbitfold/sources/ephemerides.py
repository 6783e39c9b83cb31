"""Ephemeris messages and files as states: orbit comprehensive messages (XML and key = value), STK ephemerides and covariances.

Each text is one value of a column, so files come from ``spark.read.text(path, wholetext=True)`` and texts are parsed by
JVM functions, in parallel. A text that cannot be read has one row with a reason and no state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys of a state, months, and names of the unit kilometre and of the metre.
STATE_KEYS = ("X", "Y", "Z", "X_DOT", "Y_DOT", "Z_DOT")
NAMES = ("x", "y", "z", "vx", "vy", "vz")
MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
KILOMETRES, METRES = ("km", "kilometers", "kilometre", "kilometres"), ("m", "meters", "metre", "metres")


def _date_us(year: Column, month: Column, day: Column) -> Column:
    text = F.format_string("%04d-%02d-%02d", year, month, day)
    return F.unix_date(text.try_cast("date")).cast("long") * 86_400_000_000


def ccsds_epoch_us(text: Column) -> Column:
    """Microseconds since 1970 of an ISO date and time or YYYY-DDDThh:mm:ss.f, with Z, an offset or neither (UTC); else null."""
    t = F.trim(text)
    pattern = r"^(\d{4})-(?:(\d{2})-(\d{2})|(\d{3}))(?:[T ](\d{2}):(\d{2})(?::(\d{2})(?:\.(\d+))?)?)?\s*(Z|[+-]\d{2}:?\d{2})?$"
    part = lambda k: F.nullif(F.regexp_extract(t, pattern, k), F.lit(""))
    whole = lambda k: F.coalesce(part(k).cast("int"), F.lit(0))
    year, doy = part(1).cast("int"), part(4).cast("int")
    calendar = _date_us(year, part(2).cast("int"), part(3).cast("int"))
    counted = F.when(doy.between(1, 366), _date_us(year, F.lit(1), F.lit(1)) + (doy - 1).cast("long") * 86_400_000_000)
    micros = F.round(F.concat(F.lit("0."), F.coalesce(part(8), F.lit("0"))).cast("double") * 1e6).cast("long")
    seconds = whole(5) * 3600 + whole(6) * 60 + whole(7)
    zone = F.coalesce(part(9), F.lit("Z"))
    digits = F.regexp_replace(zone, "[^0-9]", "")
    offset = F.when(zone == "Z", 0).otherwise((F.substring(digits, 1, 2).try_cast("int") * 3600 + F.substring(digits, 3, 2).try_cast("int") * 60) * F.when(zone.startswith("-"), -1).otherwise(1))
    valid = (whole(5) < 24) & (whole(6) < 60) & (whole(7) < 60)
    return F.when(valid, F.coalesce(calendar, counted) + (seconds - offset).cast("long") * 1_000_000 + micros)


def stk_epoch_us(text: Column) -> Column:
    """Microseconds since 1970 of D Mon YYYY hh:mm:ss.f; null if it is none."""
    pattern = r"(\d+)\s+([A-Za-z]{3})\s+(\d{4})\s+(\d{2}):(\d{2}):(\d{1,2})(?:\.(\d+))?"
    part = lambda k: F.nullif(F.regexp_extract(text, pattern, k), F.lit(""))
    month = F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), F.initcap(part(2))), F.lit(0)).cast("int")
    hour, minute, second = (part(k).cast("int") for k in (4, 5, 6))
    micros = F.round(F.concat(F.lit("0."), F.coalesce(part(7), F.lit("0"))).cast("double") * 1e6).cast("long")
    day = _date_us(part(3).cast("int"), month, part(1).cast("int"))
    return F.when((hour < 24) & (minute < 60) & (second < 60), day + (hour * 3600 + minute * 60 + second).cast("long") * 1_000_000 + micros)


def _lines(text: Column) -> Column:
    return F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n"), lambda x: F.trim(F.regexp_replace(x, "\t", " ")))


def _once(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with columns computed once a row: through a generator, else each use, in a lambda each element, repeats them."""
    made = rows.withColumn("_once", F.explode(F.array(F.struct(*(v.alias(k) for k, v in columns.items())))))
    return made.withColumns({k: F.col(f"_once.{k}") for k in columns}).drop("_once")


def _states(rows: DataFrame, keep: list[str], states: Column, empty: Column) -> DataFrame:
    """One row a state, by time; a text with a reason, or none of whose states can be read, has one row with the reason.

    The reason goes through the generator too: so a filter on it stays above, and does not repeat the whole parsing.
    """
    out = _once(rows, _s=states, _empty=empty).withColumn("_bad", F.filter("_s", lambda s: s["reason"].isNotNull()))
    out = out.withColumn("_why", F.coalesce("_empty", F.try_element_at("_bad", F.lit(1))["reason"], F.when(F.size("_s") == 0, F.lit("NO_STATES"))))
    none = F.struct(F.lit(None).cast("long").alias("t_us"), *(F.lit(None).cast("double").alias(n) for n in NAMES), F.col("_why").alias("reason"))
    out = out.withColumn("_rows", F.when(F.col("_why").isNotNull(), F.array(none)).otherwise(F.sort_array("_s")))
    out = out.select(*keep, F.posexplode("_rows").alias("_k", "_s"))
    reason = F.col("_s.reason")
    return out.select(*keep, reason.alias("reason"), F.when(reason.isNull(), F.col("_k")).alias("ordinal"), F.col("_s.t_us").alias("t_us"), (2440587.5 + F.col("_s.t_us") / 86_400e6).alias("t_jd"), *(F.col(f"_s.{n}").alias(n) for n in NAMES))


def _state(epoch: Column, value) -> Column:
    """A state struct that sorts by time, with a reason if a value is missing or is no number."""
    us, numbers = ccsds_epoch_us(epoch), [value(k) for k in STATE_KEYS]
    missing = F.when(epoch.isNull(), F.lit("MISSING_EPOCH")).when(us.isNull(), F.lit("BAD_EPOCH"))
    for k, v in zip(STATE_KEYS, numbers, strict=True):
        missing = missing.when(v.isNull(), F.lit(f"MISSING_{k}")).when(v.try_cast("double").isNull(), F.lit("BAD_NUMBER"))
    return F.struct(us.alias("t_us"), *(v.try_cast("double").alias(n) for n, v in zip(NAMES, numbers, strict=True)), missing.alias("reason"))


def parse_ocm(messages: DataFrame, text: str = "text") -> DataFrame:
    """States of orbit comprehensive messages: XML if the text begins with <, else key = value; other columns go along.

    Reasons: EMPTY, NO_SEGMENT (XML), NO_STATES, MISSING_<key>, BAD_EPOCH, BAD_NUMBER.
    """
    keep = [c for c in messages.columns if c != text]
    rows = messages.withColumn("_t", F.ltrim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"^\s+", "")))
    xml = F.regexp_replace(F.regexp_replace("_t", r"(?s)<!--.*?-->", ""), r"(</?)[A-Za-z0-9_.-]+:", "$1")
    rows = rows.withColumn("_xml", F.when(F.col("_t").startswith("<"), xml))
    vectors = F.regexp_extract_all("_xml", F.lit(r"(?s)<(?i:stateVector)\b[^>/]*>(.*?)</(?i:stateVector)\s*>"), F.lit(1))

    def tagged(body: Column, key: str) -> Column:
        return F.nullif(F.trim(F.regexp_extract(body, rf"(?si)<{key}\b[^>]*>(.*?)</{key}\s*>", 1)), F.lit(""))

    of_xml = F.transform(vectors, lambda v: _state(tagged(v, "EPOCH"), lambda k: tagged(v, k)))
    # key = value: the text is cut before each EPOCH line; what stands before the first belongs to no state
    plain = F.regexp_replace("_t", r"(?m)^[ \t]*COMMENT.*$", "")
    parts = F.split(F.concat(F.lit("\n"), plain), r"(?im)\n[ \t]*(?=EPOCH[ \t]*=)")
    valued = lambda body, key: F.nullif(F.trim(F.regexp_extract(body, rf"(?im)^[ \t]*{key}[ \t]*=([^\r\n]*)", 1)), F.lit(""))
    some = F.filter(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda p: valued(p, "X").isNotNull())
    of_kvn = F.transform(some, lambda p: _state(valued(p, "EPOCH"), lambda k: valued(p, k)))
    empty = F.when(F.col("_t") == "", F.lit("EMPTY")).when(F.col("_xml").isNotNull() & ~F.col("_xml").rlike(r"(?i)<segment\b"), F.lit("NO_SEGMENT"))
    return _states(rows, keep, F.when(F.col("_xml").isNotNull(), of_xml).otherwise(of_kvn), empty)


def iso_of_us(us: Column) -> Column:
    """ISO date and time in UTC with microseconds, whatever the session's time zone is."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(us / F.lit(86_400_000_000)).cast("int"))
    rest = F.pmod(us, F.lit(86_400_000_000))
    second = F.floor(rest / F.lit(1_000_000)).cast("long")
    return F.concat(day.cast("string"), F.format_string("T%02d:%02d:%02d.%06dZ", F.floor(second / 3600).cast("int"), F.floor(second % 3600 / 60).cast("int"), (second % 60).cast("int"), (rest % 1_000_000).cast("int")))


def escaped(text: Column) -> Column:
    """Text for XML."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def export_ocm_xml(states: DataFrame, name: str, originator: str, created: str, t_us: str = "t_us") -> DataFrame:
    """(name, text): a message for each object with its states in order of time; km to 6 decimals, km/s to 9.

    ``created`` is the creation date as text. There is no empty first state, so that the parser reads what is written.
    """
    tag = lambda k, v: F.concat(F.lit(f"<{k}>"), v, F.lit(f"</{k}>"))
    numbers = [tag(k, F.format_string("%.6f" if i < 3 else "%.9f", n)) for i, (k, n) in enumerate(zip(STATE_KEYS, NAMES, strict=True))]
    body = F.concat(F.lit("<stateVector>"), tag("EPOCH", iso_of_us(F.col(t_us))), *numbers, F.lit("</stateVector>"))
    one = states.groupBy(name).agg(F.sort_array(F.collect_list(F.struct(F.col(t_us).alias("t"), body.alias("b")))).alias("s"))
    head = F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<ocm id="CCSDS_OCM_VERS" version="2.0"><header>'), tag("CREATION_DATE", F.lit(created)), tag("ORIGINATOR", F.lit(originator)), F.lit("</header><body><segment><metadata>"),
        tag("OBJECT_NAME", escaped(F.col(name).cast("string"))), F.lit("<CENTER_NAME>EARTH</CENTER_NAME><TIME_SYSTEM>UTC</TIME_SYSTEM><REF_FRAME>TEME</REF_FRAME></metadata><data>"),
    )
    return one.select(name, F.concat(head, F.array_join(F.transform("s", lambda s: s["b"]), "\n"), F.lit("</data></segment></body></ocm>")).alias("text"))


def parse_stk(files: DataFrame, text: str = "text") -> DataFrame:
    """States of STK ephemeris texts by time: rows of seven numbers and more between EphemerisTimePosVel and the covariances.

    Reasons: EMPTY, NOT_STK, MISSING_EPOCH, NO_STATES. Rows that are no numbers, and comments, are passed over.
    """
    keep = [c for c in files.columns if c != text]
    body = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"(?m)^[ \t]*#.*$", "")
    rows = _once(files, _t=F.concat(F.ltrim(F.regexp_replace(body, r"^\s+", "")), F.lit("\n")))
    # cut by the marks first, so that only the rows of states are split into lines and fields
    inside = F.regexp_extract("_t", r"(?is)\n\s*BEGIN Ephemeris[^\n]*\n(.*?)(?=\n\s*END Ephemeris|\z)", 1)
    rows = _once(rows, _in=F.concat(F.lit("\n"), inside))
    epoch = F.regexp_extract("_in", r"(?i)\n\s*ScenarioEpoch[ \t]+([^\n]*)", 1)
    data = F.regexp_extract("_in", r"(?is)\n\s*EphemerisTimePosVel[^\n]*\n(.*?)(?=\n\s*CovarianceTimePosVel|\z)", 1)
    rows = _once(rows, _head=epoch, _d=F.split(data, r"\r?\n"))
    rows = _once(rows, _e=stk_epoch_us(F.col("_head")), _n=F.transform("_d", lambda x: F.transform(F.slice(F.split(F.trim(F.regexp_replace(x, "\t", " ")), " +"), 1, 7), lambda v: v.try_cast("double"))))
    rows = rows.withColumn("_n", F.filter("_n", lambda n: (F.size(n) == 7) & F.forall(n, lambda v: v.isNotNull())))
    states = F.transform("_n", lambda n: F.struct((F.col("_e") + F.round(n[0] * 1e6).cast("long")).alias("t_us"), *(n[i + 1].alias(c) for i, c in enumerate(NAMES)), F.lit(None).cast("string").alias("reason")))
    empty = F.when(F.trim("_t") == "\n", F.lit("EMPTY")).when(~F.lower("_t").startswith("stk.v"), F.lit("NOT_STK")).when(F.col("_e").isNull(), F.lit("MISSING_EPOCH"))
    return _states(rows, keep, states, empty)


def stk_covariance(files: DataFrame, text: str = "text") -> DataFrame:
    """Other columns and ``cov``: the first row of 22 fields after CovarianceTimePosVel as 36 numbers, row by row, in km.

    Null if there is none, or if the units are metres. Units that are not named are kilometres.
    """
    keep = [c for c in files.columns if c != text]
    rows = files.withColumn("_l", F.filter(_lines(F.col(text)), lambda x: x != ""))
    at = F.array_position(F.transform("_l", lambda x: F.lower(x).startswith("covariancetimeposvel")), True)
    rows = rows.withColumn("_c", F.when(at > 0, F.slice("_l", at, F.size("_l"))).otherwise(F.array().cast("array<string>")))
    full = F.transform("_c", lambda x: F.size(F.split(x, r"\s+")) == 22)
    first = F.array_position(full, True)
    rows = rows.withColumn("_h", F.when(first > 0, F.slice("_c", 1, first - 1))).withColumn("_v", F.when(first > 0, F.transform(F.split(F.element_at("_c", F.greatest(first, F.lit(1)).cast("int")), r"\s+"), lambda v: v.try_cast("double"))))
    unit = F.lower(F.regexp_extract(F.array_join("_h", "\n"), r"(?i)\bunits\s+(\S+)", 1))
    ended = F.exists(F.slice("_h", 2, F.greatest(F.size("_h"), F.lit(1))), lambda x: ~F.lower(x).startswith("units") & ~F.regexp_replace(F.split(x, r"\s+")[0], "[.-]", "").rlike(r"^\d+$"))
    lower = [[i * (i + 1) // 2 + j + 1 if j <= i else j * (j + 1) // 2 + i + 1 for j in range(6)] for i in range(6)]
    matrix = F.array(*(F.col("_v")[k] for row in lower for k in row))
    good = F.col("_v").isNotNull() & ~unit.isin(*METRES) & ~ended & F.forall("_v", lambda v: v.isNotNull())
    return rows.select(*keep, F.when(good, matrix).alias("cov"))


def valid_matrix(cov: Column, size: int = 3) -> Column:
    """Whether an array is a matrix of that size with finite numbers only."""
    return F.coalesce((F.size(cov) == size * size) & F.forall(cov, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < 1e300)), F.lit(False))
