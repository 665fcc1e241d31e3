"""Derived tables: lines of manuals and their companions, made from the star schema's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: (remainder of the quantity by 16, text around the part's name; {q} and {t} stand for the quantity and thrice it).
TEXTS = (
    (0, "The {p} turns off after a certain period of time."),
    (1, "Hold the {p} for {q} seconds until it beeps."),
    (2, "If the {p} is too far, errors of up to {q} m may not be shown."),
    (3, "Available modes: ● {p} mode ● demo mode"),
    (4, "The {p} stops when the upper limit is reached."),
    (5, "A nearby {p} is listed."),
    (6, "The {p} is updated periodically."),
    (7, "Wait a few seconds (about {q} sec) for the {p}."),
    (8, "The {p} has a certain level of inaccuracy, which the unit compensates for most of the time, but errors of up to {t} feet ({q} m) are normal."),
    (9, "Drive at low speed with the {p}."),
    (10, "Press the {p} repeatedly until it lights."),
    (11, "The {p} is hidden after a certain number of times."),
    (12, "The word {p} refers to the display."),
    (13, "● Customize the {p} with a long press."),
)
OTHERWISE = "The {p} is shown on the screen"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_sql() -> str:
    """The CASE over slot, q, page and p_name that makes a line's text, in SQL that both engines read."""

    def filled(t: str) -> str:
        parts, rest = [], t
        while rest:
            at, mark = min(((rest.find(m), m) for m in ("{p}", "{q}", "{t}") if m in rest), default=(-1, ""))
            if at < 0:
                parts.append(f"'{rest}'")
                break
            if at:
                parts.append(f"'{rest[:at]}'")
            parts.append({"{p}": "p_name", "{q}": "CAST(q AS STRING)", "{t}": "CAST(3 * q AS STRING)"}[mark])
            rest = rest[at + 3 :]
        return " || ".join(parts)

    cases = [
        "WHEN slot = 0 THEN 'Area ' || CAST(CAST(floor(page / 6.0) AS INT) AS STRING)",
        "WHEN slot % 10 = 1 THEN 'Using ' || p_name",
        "WHEN slot % 10 IN (2, 3, 4) THEN CAST(slot % 10 - 1 AS STRING) || '. Select ' || p_name || '.'",
        *(f"WHEN q % 16 = {k} THEN {filled(t)}" for k, t in TEXTS),
    ]
    return f"CASE {' '.join(cases)} ELSE {filled(OTHERWISE)} END"


def lines_sql() -> str:
    """manual_lines as SQL that Spark and DuckDB both run, over lineitem and part."""
    return f"""
        SELECT manual_id, line_no, page,
               CAST(60 + 12 * slot + 20 * floor((slot + 5) / 10.0) AS DOUBLE) AS top,
               CAST(CASE WHEN l_partkey % 7 = 0 THEN 320 ELSE 60 END AS DOUBLE) AS x0,
               CAST(CASE WHEN slot % 10 = 1 THEN 14 ELSE 9 END AS DOUBLE) AS size,
               {text_sql()} AS text, q, p_name
        FROM (
          SELECT l_suppkey AS manual_id, rn AS line_no, CAST(floor(rn / 30.0) AS INT) AS page, rn % 30 AS slot,
                 CAST(l_quantity AS INT) AS q, l_partkey, p_name
          FROM (
            SELECT l_suppkey, l_partkey, l_quantity,
                   CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate) - 1 AS INT) AS rn
            FROM lineitem) n
          JOIN part ON l_partkey = p_partkey) s
    """


def manual_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines (manual_id, line_no, page, top, x0, size, text) of one manual for each supplier; q and p_name too."""
    return spark.sql(lines_sql().replace("FROM lineitem)", "FROM {lineitem})").replace("JOIN part", "JOIN {part}"), lineitem=read(spark, sf_dir, "lineitem"), part=read(spark, sf_dir, "part"))


def manual_bookmarks(lines: DataFrame) -> DataFrame:
    """Bookmarks (manual_id, seq, title, level, page_index): level 0 where an area begins, level 1 for large lines."""
    area = lines.filter("text rlike '^Area [0-9]+$'").groupBy("manual_id", F.col("text").alias("title")).agg(F.min("page").alias("page_index"), F.min("line_no").alias("line_no")).withColumn("level", F.lit(0))
    heads = lines.filter("size > 10").select("manual_id", F.col("text").alias("title"), F.col("page").alias("page_index"), "line_no", F.lit(1).alias("level"))
    both = area.select("manual_id", "title", "page_index", "line_no", "level").unionByName(heads)
    seq = F.row_number().over(W.partitionBy("manual_id").orderBy("page_index", "line_no", "level"))
    return both.select("manual_id", (seq - 1).cast("int").alias("seq"), "title", "level", "page_index")


def manual_rects(lines: DataFrame) -> DataFrame:
    """Image rectangles (manual_id, page, rect_no, x0, top, x1, bottom, native_w, native_h) from every seventh line of a page."""
    own = lines.filter("line_no % 30 % 7 = 0")
    icon = F.col("line_no") % 2 == 0
    x0 = F.when(F.col("q") == 50, F.lit(-5.0)).otherwise(F.col("x0"))
    return own.select(
        "manual_id", "page", (F.col("line_no") % 30).alias("rect_no"), x0.alias("x0"), (F.col("top") + 2).alias("top"),
        (x0 + F.when(icon, 11.0).otherwise(200.0)).alias("x1"), (F.col("top") + 2 + F.when(icon, 11.0).otherwise(150.0)).alias("bottom"),
        F.when(F.col("q") == 49, 1).otherwise(400).alias("native_w"), F.when(F.col("q") == 49, 1).otherwise(300).alias("native_h"),
    )
