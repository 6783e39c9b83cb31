"""Conjunction data messages in XML: export and parse. Columns are those of ``sources.cdm``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cdm import COVARIANCE, STATE
from .ephemerides import ccsds_epoch_us, escaped

#: The keys of a message that belong to no object.
HEAD = ("MESSAGE_ID", "CREATION_DATE", "TCA", "MISS_DISTANCE", "RELATIVE_SPEED", "COLLISION_PROBABILITY")


def export_xml(messages: DataFrame, originator: str) -> DataFrame:
    """A column ``xml`` of message_id, creation and tca (ISO text), miss_m, speed_m_s, pc, and structs object_1 and object_2.

    Each object is an element of its own, so that its covariance is found there. A null pc or covariance has no element.
    """
    tag = lambda k, v: F.concat(F.lit(f"<{k}>"), v, F.lit(f"</{k}>"))
    number = lambda c, form: F.format_string(form, c)

    def block(o: str, label: str) -> Column:
        state = [tag(f"{label}_{k}", number(F.col(o)["state"][i], "%.6f" if i < 3 else "%.9f")) for i, k in enumerate(STATE)]
        cov = [F.when(F.col(o)["covariance"].isNotNull(), tag(k, number(F.col(o)["covariance"][i], "%.6e"))) for i, k in enumerate(COVARIANCE)]
        names = [tag(f"{label}_OBJECT_DESIGNATOR", escaped(F.col(o)["designator"])), tag(f"{label}_OBJECT_NAME", escaped(F.col(o)["name"]))]
        return F.concat(F.lit(f"<{label}>\n"), F.concat_ws("\n", *names, *state, *cov), F.lit(f"\n</{label}>"))

    head = [
        F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<CDM>'), tag("ORIGINATOR", F.lit(originator)), tag("MESSAGE_ID", escaped(F.col("message_id"))), tag("CREATION_DATE", F.col("creation")), tag("TCA", F.col("tca")),
        tag("MISS_DISTANCE", number(F.col("miss_m"), "%.4f")), tag("RELATIVE_SPEED", number(F.col("speed_m_s"), "%.4f")), F.when(F.col("pc").isNotNull(), tag("COLLISION_PROBABILITY", number(F.col("pc"), "%.6e"))),
    ]
    return messages.withColumn("xml", F.concat_ws("\n", *head, block("object_1", "OBJECT1"), block("object_2", "OBJECT2"), F.lit("</CDM>\n")))


def parse_xml(messages: DataFrame, xml: str = "xml") -> DataFrame:
    """``messages`` with reason (null if valid), message_id, creation_us, tca_us, miss_m, speed_m_s, pc, object_1 and object_2.

    Namespaces are dropped; tags count at any depth. Missing ones have the format's defaults (UNKNOWN, 1970, 0). The
    covariance is that inside the object's own element or segment. Reasons: NOT_XML, BAD_NUMBER, BAD_TIME,
    BOUNDS_VIOLATION (negative miss or speed, probability outside 0 to 1).
    """
    text = F.coalesce(F.col(xml), F.lit(""))
    clean = F.regexp_replace(F.regexp_replace(text, r"(?s)<!--.*?-->", ""), r"(</?)[A-Za-z0-9_.-]+:", "$1")
    rows = messages.withColumn("_x", clean)

    def scanned(body: str, keys: str) -> tuple[Column, Column]:
        """Names and contents of all closed elements whose names match ``keys``, nested ones too, in one pass each."""
        pattern = F.lit(rf"(?s)<({keys})(?:\s[^>]*)?>(?=(.*?)</\1\s*>)")
        return tuple(F.regexp_extract_all(body, pattern, F.lit(k)) for k in (1, 2))

    def found(c: str, keys: tuple[str, ...]) -> Column:
        """For each key the first element of that name, of those in columns ``c``_k and ``c``_v."""

        def first(key: Column) -> Column:
            raw = F.nullif(F.trim(F.try_element_at(f"{c}_v", F.nullif(F.array_position(f"{c}_k", key), F.lit(0)).cast("int"))), F.lit(""))
            for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
                raw = F.replace(raw, F.lit(a), F.lit(b))
            return raw

        return F.transform(F.array(*map(F.lit, keys)), first)

    segments = F.regexp_extract_all("_x", F.lit(r"(?s)<segment(?:\s[^>]*)?>(.*?)</segment\s*>"), F.lit(1))

    def own(label: str, k: int) -> Column:
        """The part of the text about an object: its element, its segment, else what stands after its first key."""
        element = F.nullif(F.regexp_extract("_x", rf"(?s)<{label}(?:\s[^>]*)?>(.*?)</{label}\s*>", 1), F.lit(""))
        segment = F.try_element_at(F.filter(segments, lambda s: s.rlike(rf"<OBJECT(?:\s[^>]*)?>\s*{label}\s*<") | s.contains(f"<{label}_")), F.lit(1))
        flat = F.regexp_extract("_x", rf"(?s)(<{label}_.*?)(?=<OBJECT{3 - k}_|</CDM|\Z)", 1)
        return F.coalesce(element, segment, flat)

    rows = rows.withColumns({"_o1": own("OBJECT1", 1), "_o2": own("OBJECT2", 2)})

    of_object = r"(?:OBJECT[12]_)?(?:OBJECT_DESIGNATOR|OBJECT_NAME|[XYZ](?:_DOT)?|C[RTN](?:DOT)?_[RTN](?:DOT)?)"
    lists = [x.alias(f"{c}_{p}") for c, keys in (("_x", "|".join(HEAD)), ("_o1", of_object), ("_o2", of_object)) for p, x in zip("kv", scanned(c, keys), strict=True)]
    # through a generator: else the optimizer may put a scan into the loop over the keys that reads it
    rows = rows.select("*", F.inline(F.array(F.struct(*lists))))

    # each step is a column that the next ones read several times, so that it is computed once; keys are looked up in
    # a loop, since code for each of them would be too long to be compiled
    own_keys, n = (*STATE, "OBJECT_DESIGNATOR", "OBJECT_NAME"), len(STATE)
    objects = (("_o1", "OBJECT1"), ("_o2", "OBJECT2"))
    rows = rows.withColumns({f"{c}_s": F.zip_with(found(c, tuple(f"{label}_{k}" for k in own_keys)), found(c, own_keys), lambda a, b: F.coalesce(a, b)) for c, label in objects} | {"_h": found("_x", HEAD)})
    rows = rows.withColumns({f"{c}_t": F.concat(F.slice(f"{c}_s", 1, n), found(c, COVARIANCE)) for c, _ in objects})
    rows = rows.withColumns({f"{c}_n": F.transform(f"{c}_t", lambda v: v.try_cast("double")) for c, _ in objects})

    def body(c: str) -> tuple[Column, Column]:
        filled = F.zip_with(f"{c}_t", f"{c}_n", lambda v, x: F.when(v.isNull(), F.lit(0.0)).otherwise(x))
        bad = F.exists(F.zip_with(f"{c}_t", f"{c}_n", lambda v, x: v.isNotNull() & x.isNull()), lambda x: x)
        out = F.struct(
            F.coalesce(F.col(f"{c}_s")[n], F.lit("UNKNOWN")).alias("designator"), F.coalesce(F.col(f"{c}_s")[n + 1], F.lit("Unknown")).alias("name"),
            F.slice(filled, 1, n).alias("state"), F.when(F.col(f"{c}_t")[n].isNotNull(), F.slice(filled, n + 1, len(COVARIANCE))).alias("covariance"),
        )
        return out, bad

    head = {k: F.col("_h")[i] for i, k in enumerate(HEAD)}
    default = lambda k, v: F.when(head[k].isNull(), F.lit(v)).otherwise(head[k].try_cast("double"))
    miss, speed, pc = default("MISS_DISTANCE", 0.0), default("RELATIVE_SPEED", 0.0), head["COLLISION_PROBABILITY"].try_cast("double")
    time = lambda k: ccsds_epoch_us(F.coalesce(head[k], F.lit("1970-01-01T00:00:00Z")))
    (o1, bad1), (o2, bad2) = body("_o1"), body("_o2")
    reason = F.coalesce(
        F.when(~F.col("_x").rlike(r"(?s)^\s*<.*>\s*$"), F.lit("NOT_XML")),
        F.when(miss.isNull() | speed.isNull() | (head["COLLISION_PROBABILITY"].isNotNull() & pc.isNull()) | bad1 | bad2, F.lit("BAD_NUMBER")),
        F.when(time("TCA").isNull() | time("CREATION_DATE").isNull(), F.lit("BAD_TIME")),
        F.when((miss < 0) | (speed < 0) | F.coalesce((pc < 0) | (pc > 1), F.lit(False)), F.lit("BOUNDS_VIOLATION")),
    )
    return rows.select(
        *messages.columns, reason.alias("reason"), F.coalesce(head["MESSAGE_ID"], F.lit("UNKNOWN")).alias("message_id"), time("CREATION_DATE").alias("creation_us"), time("TCA").alias("tca_us"),
        miss.alias("miss_m"), speed.alias("speed_m_s"), pc.alias("pc"), o1.alias("object_1"), o2.alias("object_2"),
    )
