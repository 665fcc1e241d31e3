"""Filters on page furniture, statistics of positions, and reading order of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions.text import normalise, production_filename, strip, strip_arrows

CONTINUATION = 15.0
GLYPH_PAGES = 3
COLUMN_GAP = 50.0
COLUMN_OFFSET = 100_000.0
SIDE_LINES, SIDE_OVERLAP = 2, 20.0
BAND = 5.0
STEP_SHAPE = r"(?U)^\s*[0-9]{1,2}[.)]\s*[A-Z]"
WORD_TOLERANCE, WORD_GAP = 3.0, 15.0


def furniture(lines: DataFrame, header: float = 0.0, footer: float | None = None) -> DataFrame:
    """Lines without headers and footers (FLT-1).

    A line stays within the body band, if it looks like a step, or up to 15 points below the
    line kept before it on its page. That depends on what was kept, so it is a fold over a page's lines, whose number a sheet of paper bounds.
    """
    cols = [c for c in lines.columns if c not in ("manual_id", "page")]
    body = F.col("top") >= header
    if footer is not None:
        body = body & (F.col("top") <= footer)
    row = F.struct("line_no", (body | F.col("text").rlike(STEP_SHAPE)).alias("base"), F.struct(*cols).alias("row"))
    pages = lines.groupBy("manual_id", "page").agg(F.sort_array(F.collect_list(row)).alias("ls"))
    kind = pages.schema["ls"].dataType.elementType["row"].dataType.simpleString()
    kept = F.aggregate(
        "ls",
        F.struct(F.lit(None).cast("double").alias("top"), F.array().cast(f"array<{kind}>").alias("out")),
        lambda acc, x: F.when(
            x["base"] | F.coalesce((x["row"]["top"] - acc["top"]).between(0, CONTINUATION), F.lit(False)),
            F.struct(x["row"]["top"].alias("top"), F.concat(acc["out"], F.array(x["row"])).alias("out")),
        ).otherwise(acc),
        lambda acc: acc["out"],
    )
    return pages.select("manual_id", "page", F.inline(kept)).select(*lines.columns)


def running_heads(lines: DataFrame, header: float, footer: float | None = None) -> DataFrame:
    """Rows (manual_id, page, citation): the text of the header band, file names left out (FLT-3)."""
    inside = (F.col("top") < header) & ~production_filename(F.col("text")) & (strip(F.col("text")) != "")
    ordered = F.array_sort(F.collect_list(F.struct("line_no", strip(F.regexp_replace(strip_arrows(F.col("text")), r"(?U)\s+", " ")).alias("t"))))
    return lines.filter(inside).groupBy("manual_id", "page").agg(F.array_join(F.transform(ordered, lambda x: x["t"]), " ").alias("citation"))


def margin_glyph_keys(lines: DataFrame, pages: int = GLYPH_PAGES) -> DataFrame:
    """Rows (manual_id, top10, x10, norm, n_pages): texts at one place on several pages (FLT-4)."""
    return (
        lines.select("manual_id", "page", *_place(), normalise(F.col("text")).alias("norm"))
        .filter("norm <> ''")
        .groupBy("manual_id", "top10", "x10", "norm")
        .agg(F.countDistinct("page").alias("n_pages"))
        .filter(F.col("n_pages") >= pages)
    )


def _place() -> list[Column]:
    return [F.bround("top", 1).alias("top10"), F.bround("x0", 1).alias("x10")]


def drop_margin_glyphs(lines: DataFrame, pages: int = GLYPH_PAGES, by: tuple[str, ...] = ("manual_id",)) -> DataFrame:
    """Lines whose text does not stand at one place on several pages (FLT-4).

    Pages are counted by rank over a window, so the lines are read once and stay where their manual is.
    """
    place = W.partitionBy(*by, "_top", "_x", "_norm")
    keyed = lines.withColumns({"_top": F.bround("top", 1), "_x": F.bround("x0", 1), "_norm": normalise(F.col("text"))})
    ranked = keyed.withColumn("_page", F.dense_rank().over(place.orderBy("page"))).withColumn("_pages", F.max("_page").over(place))
    return ranked.filter((F.col("_norm") == "") | (F.col("_pages") < pages) | F.col("_norm").isNull()).select(*lines.columns)


def column_boundaries(lines: DataFrame, by: tuple[str, ...] = ("manual_id", "page"), gap: float = COLUMN_GAP) -> DataFrame:
    """Rows (by, columns, boundary): two columns where the widest gap of the sorted x0 is wide enough (LAY-1)."""
    w = W.partitionBy(*by).orderBy("x0")
    steps = lines.select(*by, "x0", F.lead("x0").over(w).alias("next"), F.row_number().over(W.partitionBy(*by).orderBy("x0", "line_no")).alias("i"))
    widest = steps.groupBy(*by).agg(F.max(F.when(F.col("next").isNotNull(), F.struct((F.col("next") - F.col("x0")).alias("gap"), "i", "x0", "next"))).alias("m"))
    two = F.coalesce(F.col("m.gap") >= gap, F.lit(False))
    return widest.select(*by, F.when(two, 2).otherwise(1).alias("columns"), F.when(two, (F.col("m.x0") + F.col("m.next")) / 2).alias("boundary"))


def order_by_columns(lines: DataFrame, columns: int = 2, sidebars: bool = False) -> DataFrame:
    """Lines with read_top, which orders a page column by column (LAY-2); top stays the physical place.

    With one column and sidebars, both sides need lines enough that overlap in height.
    """
    if columns > 1:
        lines = drop_margin_glyphs(lines)
    elif not sidebars:
        return lines.withColumn("read_top", F.col("top"))
    w = W.partitionBy("manual_id", "page")
    by_x = w.orderBy("x0", "line_no")
    joined = lines.withColumns({"_next": F.lead("x0").over(by_x), "_i": F.row_number().over(by_x)})
    gap = F.struct((F.col("_next") - F.col("x0")).alias("gap"), "_i", "x0", "_next")
    joined = joined.withColumn("_m", F.max(F.when(F.col("_next").isNotNull(), gap)).over(w))
    joined = joined.withColumn("boundary", F.when(F.col("_m.gap") >= COLUMN_GAP, (F.col("_m.x0") + F.col("_m._next")) / 2))
    if columns <= 1:
        left = F.col("x0") < F.col("boundary")
        side = lambda cond, f: f(F.when(cond, F.col("top"))).over(w)
        overlap = F.least(side(left, F.max), side(~left, F.max)) - F.greatest(side(left, F.min), side(~left, F.min))
        enough = (side(left, F.count) >= SIDE_LINES) & (side(~left, F.count) >= SIDE_LINES) & (overlap >= SIDE_OVERLAP)
        joined = joined.withColumn("boundary", F.when(enough, F.col("boundary")))
    return joined.select(*lines.columns, read_top(F.col("x0"), F.col("top"), F.col("boundary")).alias("read_top"))


def read_top(x0: Column, top: Column, boundary: Column) -> Column:
    """Place of a raw position in reading order (LAY-3)."""
    return top + F.when(x0 >= boundary, COLUMN_OFFSET).otherwise(0.0)


def header_footer(lines: DataFrame) -> DataFrame:
    """Rows (manual_id, header, footer): bands whose short lines recur on half of the pages (the last page's number tells how many, rounded down), five at least (LAY-4)."""
    pages = lines.groupBy("manual_id").agg((F.max("page") + 1).alias("n_pages"), F.count("*").alias("n"))
    ranked = lines.select("manual_id", "top", F.row_number().over(W.partitionBy("manual_id").orderBy("top")).alias("i"))
    middle = ranked.join(pages, "manual_id").filter(F.expr("i = n div 2 + 1")).select("manual_id", F.col("top").alias("mid"))
    short = strip(F.col("text"))
    bands = (
        lines.filter((short != "") & (F.length(short) <= 60))
        .groupBy("manual_id", F.bround(F.col("top") / BAND).alias("band"))
        .agg(F.countDistinct("page").alias("hits"))
        .join(pages, "manual_id")
        .filter(F.col("hits") >= F.greatest(F.lit(5), F.floor(F.col("n_pages") * 0.5)))
        .withColumn("at", F.col("band") * BAND)
    )
    w = W.partitionBy("manual_id").orderBy("at")
    gaps = bands.withColumns({"next": F.lead("at").over(w), "i": F.row_number().over(w)})
    cut = gaps.groupBy("manual_id").agg(
        F.count("*").alias("k"), F.min("at").alias("only"), F.max(F.when(F.col("next").isNotNull(), F.struct((F.col("next") - F.col("at")).alias("gap"), "i", "at", "next"))).alias("m")
    )
    both = pages.select("manual_id").join(cut, "manual_id", "left").join(middle, "manual_id", "left")
    one_head = (F.col("k") == 1) & (F.col("only") < F.col("mid"))
    one_foot = (F.col("k") == 1) & (F.col("only") >= F.col("mid"))
    return both.select(
        "manual_id",
        F.when(one_head, F.col("only") + BAND).when(F.col("k") > 1, F.col("m.at") + BAND).otherwise(0.0).alias("header"),
        F.when(one_foot, F.col("only") - BAND).when(F.col("k") > 1, F.col("m.next") - BAND).alias("footer"),
    )


def group_words(words: DataFrame, columns: int = 1, split: bool = False) -> DataFrame:
    """Lines (manual_id, line_no, page, text, top, x0, size) from words (SRC-2 to SRC-5).

    A word joins a line if its top lies within 3 points of the line's first word. That anchor
    moves with each line, so it is a fold over a page's words in order of top.
    """
    upright = words.filter(F.coalesce("upright", F.lit(True)))
    row = F.struct("top", "word_no", F.struct("text", "top", "x0", "x1", "size", "height").alias("w"))
    pages = upright.groupBy("manual_id", "page").agg(F.sort_array(F.collect_list(row)).alias("ws"))
    word = "struct<text:string,top:double,x0:double,x1:double,size:double,height:double>"
    folded = F.aggregate(
        "ws",
        F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(-1).alias("g"), F.array().cast(f"array<struct<g:int,n:int,w:{word}>>").alias("out")),
        lambda acc, x: F.when(
            F.coalesce(x["top"] - acc["anchor"] <= WORD_TOLERANCE, F.lit(False)),
            F.struct(acc["anchor"].alias("anchor"), acc["g"].alias("g"), F.concat(acc["out"], F.array(F.struct(acc["g"].alias("g"), F.size(acc["out"]).alias("n"), x["w"].alias("w")))).alias("out")),
        ).otherwise(
            F.struct(x["top"].alias("anchor"), (acc["g"] + 1).alias("g"), F.concat(acc["out"], F.array(F.struct((acc["g"] + 1).alias("g"), F.size(acc["out"]).alias("n"), x["w"].alias("w")))).alias("out"))
        ),
        lambda acc: acc["out"],
    )
    placed = pages.select("manual_id", "page", F.inline(folded)).select("manual_id", "page", "g", "n", "w.*")
    by_x = W.partitionBy("manual_id", "page", "g").orderBy("x0", "n")
    placed = placed.withColumn("gap", F.col("x0") - F.lag("x1").over(by_x))
    cuts = F.sum(F.when((F.col("gap") > WORD_GAP) & F.lit(columns > 1 or split), 1).otherwise(0)).over(by_x)
    return build_lines(placed.withColumn("part", cuts))


def build_lines(placed: DataFrame) -> DataFrame:
    """A line of each (g, part): words by x0, least top and x0, median size without step markers (SRC-5)."""
    from docloom.functions.text import clean_glyphs

    text = strip(clean_glyphs(F.col("text")))
    size = F.coalesce("size", "height", F.lit(0.0))
    marker = text.rlike(r"^[0-9]{1,2}[.)]$")
    made = (
        placed.withColumns({"t": text, "s": size, "marker": marker})
        .groupBy("manual_id", "page", "g", "part")
        .agg(
            F.array_join(F.filter(F.transform(F.sort_array(F.collect_list(F.struct("x0", "n", "t"))), lambda x: x["t"]), lambda x: x != ""), " ").alias("text"),
            F.min("top").alias("top"), F.min("x0").alias("x0"),
            F.coalesce(F.median(F.when(~F.col("marker"), F.col("s"))), F.median("s")).alias("size"),
        )
        .filter("text <> ''")
    )
    no = F.row_number().over(W.partitionBy("manual_id").orderBy("page", "g", "part")) - 1
    return made.select("manual_id", no.cast("int").alias("line_no"), "page", "text", "top", "x0", "size")


def breadcrumbs(chars: DataFrame, header: float, separator_font: str) -> DataFrame:
    """Rows (manual_id, page, segments): the lowest line of the header band, cut at its arrow glyphs (SRC-8)."""
    band = chars.filter(F.col("top") < header).withColumn("row", F.bround("top"))
    lowest = band.withColumn("last", F.max("row").over(W.partitionBy("manual_id", "page"))).filter("row = last")
    glyph = F.when((F.col("text") == "u") & F.contains(F.coalesce("fontname", F.lit("")), F.lit(separator_font)), "\x01").otherwise(F.col("text"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", glyph.alias("t")))), lambda x: x["t"]), "")
    return lowest.groupBy("manual_id", "page").agg(F.filter(F.transform(F.split(joined, "\x01"), strip), lambda x: x != "").alias("segments"))
