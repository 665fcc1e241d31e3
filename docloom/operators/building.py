"""Steps, paragraphs and requirements of sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions.text import BULLETS, OVERVIEW_SLOT, SLOT_RULES, clean_title, content_id, join_lines, slot, strength, strip, strip_heading_marker

# A numbered step, and a step number alone on its line.
STEP = r"(?U)^\s*([0-9]{1,2})[.)]\s*([A-Z].*?)\s*$"
ORPHAN = r"(?U)^\s*([0-9]{1,2})[.)]\s*(\(.*\))?\s*$"
GAP = 15.0
MIN_LENGTH = 8
ID_PREFIX = 120
NOTE = r"(?U)(?<!\S)u(?=[A-Z])"
#: A bullet after white space or at the start, with no other bullet or note glyph within two characters.
SPLIT = rf"(?U)(?:(?<!\S)(?<![{BULLETS}])(?<![{BULLETS}].)[{BULLETS}](?![{BULLETS}])(?!.[{BULLETS}]))|(?:(?<!\S)(?<![{BULLETS}].)u(?=[A-Z])(?!.[{BULLETS}]))"
KEY = ["manual_id", "section_no"]


def attach_orphans(lines: DataFrame, top: str = "top") -> DataFrame:
    """Lines with a bare step number joined to the line below it (BLD-1).

    In a run of such numbers every other one takes the next line; parity within the run tells which.
    """
    w = W.partitionBy(*KEY).orderBy("page", top, "line_no")
    df = lines.withColumns({"_o": F.col("text").rlike(ORPHAN), "_i": F.row_number().over(w)})
    # Orphans at odd places of their run take the next line, orphan or not. The place counts from the last other line.
    df = df.withColumn("_k", F.col("_i") - F.coalesce(F.max(F.when(~F.col("_o"), F.col("_i"))).over(w), F.lit(0)))
    takes = F.col("_o") & (F.col("_k") % 2 == 1) & F.lead("text").over(w).isNotNull()
    df = df.withColumns({"_takes": takes, "_next": F.lead("text").over(w)})
    df = df.withColumn("_taken", F.coalesce(F.lag("_takes").over(w), F.lit(False)))
    ref = F.nullif(F.regexp_extract("text", ORPHAN, 2), F.lit(""))
    joined = F.concat_ws(" ", F.concat(F.regexp_extract("text", ORPHAN, 1), F.lit(".")), strip(F.col("_next")), ref)
    return df.filter("not _taken").withColumn("text", F.when(F.col("_takes"), joined).otherwise(F.col("text"))).select(*lines.columns)


def _heading(text: Column, prefixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | F.startswith(text, F.lit(p))
    return out


def split_lines(lines: DataFrame, prefixes: tuple[str, ...] = (), top: str = "top") -> DataFrame:
    """Lines with is_step_island, island, number: steps with their continuations, and prose (BLD-2).

    An island begins at a step and wherever a line can't continue what is above it: another page, over 15 points, a bullet, a note or a heading. An island whose head is a step is that step.
    """
    w = W.partitionBy(*KEY).orderBy("page", top, "line_no")
    t = strip(F.col("text"))
    df = attach_orphans(lines, top).withColumn("t", t).filter("t <> ''")
    head = _heading(F.col("t"), prefixes)
    df = df.withColumns({"is_step": F.col("t").rlike(STEP) & ~head, "is_heading": head})
    loose = F.col("t").rlike(rf"^[{BULLETS}]") | F.col("t").rlike(r"^u(?=[A-Z])") | F.col("is_heading")
    near = (F.lag("page").over(w) == F.col("page")) & (F.col(top) - F.lag(top).over(w) <= GAP)
    df = df.withColumn("_opens", F.col("is_step") | loose | ~F.coalesce(near, F.lit(False)))
    # A step opens its island, so the last line that opened one tells what the island is.
    head_is_step = F.last(F.when(F.col("_opens"), F.col("is_step")), ignorenulls=True).over(w)
    return df.withColumns({"island": F.sum(F.col("_opens").cast("int")).over(w), "in_step": head_is_step}).drop("_opens")


def steps(split: DataFrame, top: str = "top", offset: int = 1) -> DataFrame:
    """Steps (manual_id, section_no, step_no, number, sequence, text, page, top, source); a number not above the last begins a sequence (BLD-4)."""
    ordered = F.sort_array(F.collect_list(F.struct("page", F.col(top).alias("top"), "line_no", F.when(F.col("is_step"), F.regexp_extract("t", STEP, 2)).otherwise(F.col("t")).alias("t"))))
    made = (
        split.filter("in_step").groupBy(*KEY, "island")
        .agg(F.max(F.when(F.col("is_step"), F.regexp_extract("t", STEP, 1))).cast("int").alias("number"), ordered.alias("ls"))
        .select(*KEY, "island", "number", F.array_join(F.transform("ls", lambda x: x["t"]), " ").alias("text"), F.col("ls")[0]["page"].alias("page"), F.col("ls")[0]["top"].alias("top"))
    )
    w = W.partitionBy(*KEY).orderBy("island")
    made = made.withColumn("restart", F.coalesce((F.col("number") <= F.lag("number").over(w)).cast("int"), F.lit(0)))
    return made.select(*KEY, F.row_number().over(w).alias("step_no"), "number", (F.sum("restart").over(w) + 1).cast("int").alias("sequence"), "text", "page", "top", F.concat(F.lit("p."), (F.col("page") + offset).cast("string"), F.lit(" / step")).alias("source"))


def paragraphs(split: DataFrame, top: str = "top") -> DataFrame:
    """Paragraphs (manual_id, section_no, group_no, text, page, top) of the prose lines (BLD-3, TXT-9)."""
    w = W.partitionBy(*KEY).orderBy("page", top, "line_no")
    prose = split.filter("not in_step")
    new = (F.col("page") != F.lag("page").over(w)) | (F.col(top) - F.lag(top).over(w) > GAP) | F.col("is_heading") | F.lag("is_heading").over(w)
    grouped = prose.withColumn("_new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("group_no", F.sum("_new").over(w).cast("int"))
    ordered = F.sort_array(F.collect_list(F.struct("page", F.col(top).alias("top"), "line_no", "t")))
    return (
        grouped.groupBy(*KEY, "group_no").agg(ordered.alias("ls"))
        .select(*KEY, "group_no", strip(join_lines(F.transform("ls", lambda x: x["t"]))).alias("text"), F.col("ls")[0]["page"].alias("page"), F.col("ls")[0]["top"].alias("top"))
    )


def split_bullets(text: Column) -> Column:
    """array<struct<item, is_bullet>>: a paragraph cut at isolated bullets (TVF-1)."""
    raw = F.split(text, SPLIT, -1)
    parts = F.filter(F.transform(raw, strip), lambda x: x != "")
    starts = (strip(raw[0]) == "") & (F.size(raw) > 1)
    whole = F.array(F.struct(text.alias("item"), F.lit(False).alias("is_bullet")))
    return F.when(F.size(raw) == 1, whole).otherwise(F.transform(parts, lambda p, i: F.struct(p.alias("item"), (starts | (i > 0)).alias("is_bullet"))))


def next_steps(groups: DataFrame, step_rows: DataFrame) -> DataFrame:
    """groups with next_step_text: number and text of the first step strictly after (page, top) in the section (BLD-5).

    Both are put in one order and the step carried backwards, so no pairs are formed and each side is read once.
    """
    rest = [c for c in groups.columns if c not in (*KEY, "page", "top", "group_no")]
    a = groups.select(*KEY, "page", "top", "group_no", *rest, F.lit(None).cast("string").alias("step_text"), F.lit(None).cast("int").alias("step_no"))
    empty = [F.lit(None).cast(groups.schema[c].dataType).alias(c) for c in rest]
    b = step_rows.select(*KEY, "page", "top", F.lit(None).cast("int").alias("group_no"), *empty, F.concat_ws(". ", F.col("number").cast("string"), "text").alias("step_text"), "step_no")
    # A step at the same place is not after the group: it stands before it in this order.
    w = W.partitionBy(*KEY).orderBy("page", "top", F.col("group_no").isNotNull(), "step_text").rowsBetween(1, W.unboundedFollowing)
    both = a.unionByName(b).withColumn("next_step_text", F.first("step_text", ignorenulls=True).over(w))
    return both.filter("group_no is not null").select(*groups.columns, "next_step_text")


def requirements(groups: DataFrame, titles: DataFrame, offset: int = 1, citations: DataFrame | None = None, slot_rules: tuple | None = None) -> DataFrame:
    """Requirement rows of paragraphs (BLD-6, BLD-7): overview until a section's first bullet, then by the slot rules.

    titles has manual_id, section_no and the title as printed; citations manual_id, page and citation.
    """
    base = groups.withColumn("text", strip_heading_marker(F.col("text"))).filter(F.length("text") >= MIN_LENGTH)
    if "next_step_text" not in base.columns:
        base = base.withColumn("next_step_text", F.lit(None).cast("string"))
    items = base.select(*KEY, "group_no", "page", "next_step_text", F.posexplode(split_bullets(F.col("text"))).alias("item_no", "x")).select(
        *KEY, "group_no", "item_no", "page", "next_step_text", F.col("x.item").alias("source_text"), F.col("x.is_bullet").alias("is_bullet")
    ).filter(F.length("source_text") >= MIN_LENGTH)
    w = W.partitionBy(*KEY).orderBy("group_no", "item_no")
    seen = F.max(F.col("is_bullet").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)) == 1
    items = items.join(titles.select(*KEY, F.col("title").alias("raw_title")), KEY, "left")
    out = items.select(
        *KEY, F.row_number().over(w).alias("req_no"),
        content_id(F.lit("requirement"), F.col("manual_id"), F.col("raw_title"), F.substring("source_text", 1, ID_PREFIX)).alias("req_id"),
        F.when(seen, slot(F.concat(F.lit("\n"), F.col("source_text")), slot_rules or SLOT_RULES)).otherwise(OVERVIEW_SLOT).alias("slot"),
        F.when(F.col("source_text").rlike("[.!?]$"), F.col("source_text")).otherwise(F.concat("source_text", F.lit("."))).alias("text"),
        "source_text", strength(F.col("source_text")).alias("strength"),
        F.concat(F.lit("p."), (F.col("page") + offset).cast("string"), F.when(F.col("is_bullet"), " / bullet").otherwise(" / text")).alias("source"),
        "is_bullet", "page", "next_step_text",
    )
    if citations is None:
        return out.withColumn("page_citation", F.lit(None).cast("string"))
    return out.join(citations.withColumnRenamed("citation", "page_citation"), ["manual_id", "page"], "left")


def functions(section_lines: DataFrame, heads: DataFrame, offset: int = 1, excluded: tuple[str, ...] = ()) -> DataFrame:
    """Function rows (manual_id, section_no, chapter_no, function_no, function_id, raw_title, title, area, function_path, pages) of sections with text (BLD-8, BLD-9, FLT-9).

    heads has manual_id, section_no, chapter_no, title, area and page_start. Titles that hold a word of excluded go; the rest is numbered from one in each chapter.
    """
    pages = section_lines.groupBy(*KEY).agg(F.collect_set("page").alias("ps"))
    made = heads.join(pages, KEY).select(*KEY, "chapter_no", "page_start", "ps", F.col("title").alias("raw_title"), clean_title(F.col("title")).alias("title"), F.coalesce("area", F.lit("")).alias("area"))
    made = made.filter(~excluded_title(excluded))
    no = F.row_number().over(W.partitionBy("manual_id", "chapter_no").orderBy("section_no"))
    return made.select(
        *KEY, "chapter_no", no.alias("function_no"), content_id(F.lit("function"), F.col("manual_id"), F.col("area"), F.col("raw_title")).alias("function_id"), "raw_title", "title", "area",
        F.when(F.col("area") == "", F.col("title")).otherwise(F.concat_ws(" / ", "area", "title")).alias("function_path"),
        F.array_sort(F.array_distinct(F.transform(F.concat("ps", F.array("page_start")), lambda p: p + offset))).alias("pages"),
    )


def excluded_title(excluded: tuple[str, ...]) -> Column:
    """Whether a cleaned title holds one of these words, in any case (FLT-9)."""
    out = F.lit(False)
    for word in excluded:
        out = out | F.contains(F.lower("title"), F.lit(word.lower()))
    return out


def excluded_titles(section_lines: DataFrame, heads: DataFrame, excluded: tuple[str, ...]) -> DataFrame:
    """Rows (manual_id, section_no, title) of what functions leaves out (FLT-9)."""
    made = heads.join(section_lines.select(*KEY).distinct(), KEY).select(*KEY, clean_title(F.col("title")).alias("title"))
    return made.filter(excluded_title(excluded))
