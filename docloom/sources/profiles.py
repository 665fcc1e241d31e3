"""Profiles: read with inheritance, chosen for manuals, judged and derived."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions.text import anomalies
from docloom.operators.figures import content_rects
from docloom.operators.layout import column_boundaries

#: Layout fields and what they are where no profile of a chain names them.
DEFAULTS = {
    "section_source": "bookmarks", "columns": 1, "column_detect_per_page": False, "header_boundary_pt": 0.0, "footer_boundary_pt": None,
    "page_number_offset": 1, "heading_prefixes": [], "running_head_separator_font": None, "figure_min_width_pt": 40.0, "figure_min_height_pt": 40.0,
    "figure_merge_distance_pt": 3.0, "running_head_regex": None, "repair_kerning": False, "shallow_outline_level": None, "section_depth_below_chapter": None,
}
MIN_TOP = 3
MARKER = "^[0-9A-Z_]+$"
ANOMALY_SHARE = 0.15
COVERAGE = 0.3
MIN_RECTS, SIZE_GAP = 4, 2.0


def resolve(raw: dict[str, dict], profile_id: str) -> dict:
    """A profile with what it inherits (SRC-10). A field that is given as null overrides its parent's: presence decides."""
    chain, at = [], profile_id
    while at is not None:
        if at in chain:
            raise ValueError(f"profile {at} extends itself")
        chain.append(at)
        at = raw[at].get("extends")
    layout = dict(DEFAULTS)
    excluded: list[str] = []
    rules: list = []
    for name in reversed(chain):
        layout |= {k: v for k, v in raw[name].get("layout", {}).items() if k in DEFAULTS}
        excluded = raw[name].get("excluded_section_titles", excluded)
        rules = raw[name].get("slot_rules", rules)
    return {"profile_id": profile_id, "extends": raw[profile_id].get("extends"), **layout, "excluded_section_titles": excluded, "slot_rules": rules}


def read_profiles(spark: SparkSession, path: str) -> dict[str, dict]:
    """Profiles of a folder of JSON files; drafts are left out (SRC-11). They are hand-written files, read as whole texts."""
    rows = spark.read.option("wholetext", True).text(f"{path}/*.json").select("value", F.input_file_name().alias("f")).filter("not f like '%.draft.json'").collect()
    raw = {p["profile_id"]: p for p in (json.loads(r["value"]) for r in rows) if "profile_id" in p}
    return {k: resolve(raw, k) for k in sorted(raw)}


def choose(manuals: DataFrame, mapping: DataFrame, default: str) -> DataFrame:
    """manuals (manual_id, maker) with profile_id: mapped by manual, else by maker, else the default."""
    m = mapping.select("key", "profile_id")
    by_id, by_maker = m.alias("i"), m.alias("k")
    return manuals.alias("m").join(by_id, F.col("m.manual_id") == F.col("i.key"), "left").join(by_maker, F.col("m.maker") == F.col("k.key"), "left").select(
        "m.*", F.coalesce("i.profile_id", "k.profile_id", F.lit(default)).alias("profile_id")
    )


def next_profile_id(profiles: DataFrame, makers: DataFrame) -> DataFrame:
    """The smallest free `<maker>_vN` of each maker (LAY-14)."""
    used = profiles.select(F.regexp_extract("profile_id", r"^(.*)_v([0-9]{1,6})$", 1).alias("maker"), F.nullif(F.regexp_extract("profile_id", r"^(.*)_v([0-9]{1,6})$", 2), F.lit("")).cast("int").alias("n")).filter("n is not null").distinct()
    taken = used.groupBy("maker").agg(F.collect_set("n").alias("ns"))
    free = F.array_min(F.array_except(F.sequence(F.lit(1), F.size("ns") + 1), "ns"))
    return makers.select("maker").distinct().join(taken, "maker", "left").select("maker", F.concat("maker", F.lit("_v"), F.coalesce(free, F.lit(1)).cast("string")).alias("profile_id"))


def size_threshold(values: DataFrame, by: list[str], col: str) -> DataFrame:
    """The lower edge of the widest gap and half of the gap, from four values and two points of gap on (LAY-5)."""
    w = W.partitionBy(*by).orderBy(col)
    v = values.select(*by, F.col(col).alias("v"), F.lead(col).over(w).alias("next"), F.row_number().over(w).alias("i"), F.count("*").over(W.partitionBy(*by)).alias("n"))
    m = v.filter(f"n >= {MIN_RECTS} and next is not null").groupBy(*by).agg(F.max(F.struct((F.col("next") - F.col("v")).alias("gap"), "i", "v")).alias("m"))
    return m.filter(F.col("m.gap") >= SIZE_GAP).select(*by, (F.col("m.v") + F.col("m.gap") / 2).alias(f"min_{col}"))


def figure_thresholds(rects: DataFrame, chapters: DataFrame | None = None) -> DataFrame:
    """Rows (manual_id, min_width, min_height): the least of a manual's chapters (LAY-6); the whole document without chapters."""
    sizes = content_rects(rects).select("manual_id", "page", (F.col("x1") - F.col("x0")).alias("width"), (F.col("bottom") - F.col("top")).alias("height"))
    by = ["manual_id"]
    if chapters is not None:
        last = rects.groupBy("manual_id").agg((F.max("page") + 1).alias("open_end"))
        spans = chapters.join(last, "manual_id").withColumn("stop", F.coalesce("page_end", "open_end")).filter("stop > page_start")
        pages = spans.select("manual_id", F.col("page_start").alias("chapter"), F.explode(F.sequence(F.col("page_start"), F.col("stop") - 1)).alias("page"))
        sizes, by = sizes.join(pages, ["manual_id", "page"]), ["manual_id", "chapter"]
    out = size_threshold(sizes, by, "width").join(size_threshold(sizes, by, "height"), by, "full")
    return out.groupBy("manual_id").agg(F.min("min_width").alias("min_width"), F.min("min_height").alias("min_height"))


def bookmark_depth(bookmarks: DataFrame) -> DataFrame:
    """Rows (manual_id, n_top, chapter_shaped): three top-level bookmarks, not over half of them markers (LAY-8)."""
    top = bookmarks.withColumn("least", F.min("level").over(W.partitionBy("manual_id"))).filter("level = least")
    marker = F.regexp_replace("title", r"(?U)\s", "").rlike(MARKER)
    t = top.groupBy("manual_id").agg(F.count("*").alias("n_top"), F.count_if(marker).alias("markers"))
    return t.select("manual_id", "n_top", ((F.col("n_top") >= MIN_TOP) & (F.col("markers") * 2 <= F.col("n_top"))).alias("chapter_shaped"))


def columns_match(lines: DataFrame, chapters: DataFrame, columns: int) -> DataFrame:
    """Chapters (of two lines at least) whose column count isn't the profile's (LAY-9)."""
    last = lines.groupBy("manual_id").agg((F.max("page") + 1).alias("open_end"))
    spans = chapters.join(last, "manual_id").withColumn("stop", F.coalesce("page_end", "open_end")).filter("stop > page_start")
    pages = spans.select("manual_id", "title", "seq", F.explode(F.sequence(F.col("page_start"), F.col("stop") - 1)).alias("page"))
    inside = lines.join(pages, ["manual_id", "page"])
    big = inside.withColumn("n", F.count("*").over(W.partitionBy("manual_id", "seq"))).filter("n >= 2")
    return column_boundaries(big, ("manual_id", "seq", "title")).filter(F.col("columns") != columns).select("manual_id", "seq", "title", "columns")


def anomaly_share(texts: DataFrame) -> DataFrame:
    """Rows (manual_id, chapter, share): flagged texts of each chapter's, and the worst chapter first (LAY-10). No text counts as 1."""
    per = texts.groupBy("manual_id", "chapter").agg(F.avg((F.size(anomalies(F.coalesce("text", F.lit("")))) > 0).cast("int")).alias("share"))
    return per.groupBy("manual_id").agg(F.max_by("chapter", F.struct("share", -F.col("chapter"))).alias("chapter"), F.max("share").alias("share"))


def fitness(depth: DataFrame, mismatched: DataFrame, shares: DataFrame) -> DataFrame:
    """Rows (manual_id, fits, reasons) (LAY-11)."""
    bad = mismatched.groupBy("manual_id").agg(F.sort_array(F.collect_list("title")).alias("bad"))
    df = depth.join(bad, "manual_id", "left").join(shares, "manual_id", "left")
    reasons = F.filter(
        F.array(
            F.when(~F.col("chapter_shaped"), "bookmarks are not chapter-shaped"),
            F.when(F.size("bad") > 0, F.concat(F.lit("columns differ in "), F.array_join("bad", ", "))),
            F.when(F.coalesce("share", F.lit(1.0)) > ANOMALY_SHARE, "too many anomalous texts"),
        ),
        lambda x: x.isNotNull(),
    )
    return df.select("manual_id", (F.size(reasons) == 0).alias("fits"), reasons.alias("reasons"))


def search(fits: DataFrame, manuals: DataFrame) -> DataFrame:
    """The first profile that fits each manual: the mapped one, the maker's own, then by id (LAY-12). fits has a row per manual and profile."""
    df = fits.join(manuals, "manual_id")
    rank = F.when(F.col("profile_id") == F.col("mapped"), 0).when(F.startswith("profile_id", "maker"), 1).otherwise(2)
    ok = df.filter(F.col("fits") | (F.col("profile_id") == F.col("mapped")))
    best = ok.groupBy("manual_id").agg(F.min(F.struct(rank.alias("r"), "profile_id")).alias("b"))
    return manuals.join(best, "manual_id", "left").select("manual_id", F.col("b.profile_id").alias("profile_id"), F.when(F.col("b").isNull(), "derive").otherwise("use").alias("resolution"))


def derive_source(depth: DataFrame, toc: DataFrame, heads: DataFrame, lines: DataFrame) -> DataFrame:
    """Rows (manual_id, section_source): bookmarks, a contents page, running heads over three tenths of the pages, or none (LAY-7)."""
    pages = lines.groupBy("manual_id").agg(F.countDistinct("page").alias("n_pages"))
    covered = heads.groupBy("manual_id").agg(F.sum(F.col("page_end") - F.col("page_start")).alias("covered"))
    t = toc.select("manual_id").distinct().withColumn("toc", F.lit(True))
    df = pages.join(depth, "manual_id", "left").join(t, "manual_id", "left").join(covered, "manual_id", "left")
    heads_ok = F.coalesce("covered", F.lit(0)) >= F.col("n_pages") * COVERAGE
    return df.select("manual_id", F.when(F.col("chapter_shaped"), "bookmarks").when(F.col("toc"), "chapter_toc").when(heads_ok, "running_head").otherwise("undetermined").alias("section_source"))


def review_status(candidates: DataFrame, allowlist: DataFrame, reviews: DataFrame | None = None) -> DataFrame:
    """ready where a reviewer has confirmed a list, even an empty one; needs_review else (LAY-13, SRC-14). reviews has a row for each manual reviewed; without it the list's rows tell."""
    listed = allowlist.groupBy("manual_id").agg(F.count("label").alias("n_confirmed"))
    reviewed = (allowlist if reviews is None else reviews).select("manual_id").distinct().join(listed, "manual_id", "left").withColumn("reviewed", F.lit(True))
    return candidates.select("manual_id").distinct().join(reviewed, "manual_id", "left").select(
        "manual_id", F.coalesce("reviewed", F.lit(False)).alias("reviewed"), F.coalesce("n_confirmed", F.lit(0).cast("long")).alias("n_confirmed"), F.when(F.col("reviewed"), "ready").otherwise("needs_review").alias("state")
    )


