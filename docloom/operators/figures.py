"""Figures: rectangles merged to a fixed point, filtered, and given the caption that stands closest."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions.text import content_id, looks_like_label, strip, strip_heading_marker, strip_note_glyph
from docloom.operators.layout import column_boundaries, drop_margin_glyphs, read_top

MERGE = 3.0
MIN_SIDE = 40.0
FILL_DPI = 10.0
ABOVE, NARROW, HANGING, FRAGMENT = 8.0, 30.0, 70.0, 100.0
LABEL_GAP, LABEL_SHIFT, LABELS = 15.0, 20.0, 6
WRAP_SHIFT = 40.0
KEY = ["manual_id", "page", "figure_no"]


def close(a: dict[str, Column], b: dict[str, Column], distance: float = MERGE) -> Column:
    """Both gaps between two rectangles are at most the distance (FIG-1)."""
    gx = F.greatest(b["x0"] - a["x1"], a["x0"] - b["x1"], F.lit(0.0))
    gy = F.greatest(b["top"] - a["bottom"], a["top"] - b["bottom"], F.lit(0.0))
    return (gx <= distance) & (gy <= distance)


def full_bleed() -> Column:
    return (F.col("x0") < 0) | (F.col("top") < 0)


def stretched_fill() -> Column:
    """An image of so few pixels that it must be a background (FLT-7)."""
    w, h = F.col("x1") - F.col("x0"), F.col("bottom") - F.col("top")
    has = (F.coalesce("native_w", F.lit(0)) > 0) & (F.coalesce("native_h", F.lit(0)) > 0) & (w > 0) & (h > 0)
    # Multiplied out, so that no division by zero arises.
    return has & (F.col("native_w") * 72 < w * FILL_DPI) & (F.col("native_h") * 72 < h * FILL_DPI)


def content_rects(rects: DataFrame) -> DataFrame:
    return rects.filter(~full_bleed() & ~stretched_fill())


def merge_rects(rects: DataFrame, distance: float = MERGE) -> DataFrame:
    """Rows (manual_id, page, figure_no, x0, top, x1, bottom, n_rects): close rectangles merged until none are (FIG-2).

    A merged box may touch others, so this is a fixed point; a page has tens of rectangles, and
    the final boxes don't depend on their order. One task works on many pages, one page at a time.
    """

    def fix(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in pages:
            out = []
            for m, p, rows in zip(df["manual_id"], df["page"], df["rs"], strict=True):
                boxes = [[r["x0"], r["top"], r["x1"], r["bottom"], 1] for r in rows]
                done: list[list] = []
                while boxes:
                    box = boxes.pop(0)
                    grown = True
                    while grown:
                        grown = False
                        for k, o in enumerate(boxes + done):
                            if max(o[0] - box[2], box[0] - o[2], 0) <= distance and max(o[1] - box[3], box[1] - o[3], 0) <= distance:
                                box = [min(box[0], o[0]), min(box[1], o[1]), max(box[2], o[2]), max(box[3], o[3]), box[4] + o[4]]
                                if k < len(boxes):
                                    boxes.pop(k)
                                else:
                                    done.pop(k - len(boxes))
                                grown = True
                                break
                    done.append(box)
                out += [(m, p, k, *b) for k, b in enumerate(sorted(done, key=lambda b: (b[1], b[0])))]
            yield pd.DataFrame(out, columns=["manual_id", "page", "figure_no", "x0", "top", "x1", "bottom", "n_rects"])

    kind = rects.schema["manual_id"].dataType.simpleString()
    pages = rects.groupBy("manual_id", "page").agg(F.sort_array(F.collect_list(F.struct("rect_no", "x0", "top", "x1", "bottom"))).alias("rs"))
    return pages.mapInPandas(fix, f"manual_id {kind}, page int, figure_no int, x0 double, top double, x1 double, bottom double, n_rects int")


def figure_sized(min_width: float = MIN_SIDE, min_height: float = MIN_SIDE) -> Column:
    return (F.col("x1") - F.col("x0") >= min_width) & (F.col("bottom") - F.col("top") >= min_height)


def caption_candidates(figures: DataFrame, lines: DataFrame, prefixes: tuple[str, ...] = ()) -> DataFrame:
    """Rows of each figure and line of its page that may caption it, with tier, gap and shift (FIG-3).

    Tiers: 0 heading, 1 narrow or above, 2 wide, 3 split fragment. Lines in the figure's column are preferred; where there are none, the whole page stays.
    """
    t = strip(F.col("text"))
    heading = F.lit(False)
    for p in prefixes:
        heading = heading | F.startswith(F.col("t"), F.lit(p))
    have = lines.select("manual_id", "page", "line_no", t.alias("t"), F.col("top").alias("lt"), F.col("x0").alias("lx")).filter("length(t) > 2")
    # A fragment starts lower-case beside another line of its height; equal heights are found within one point.
    band = F.explode(F.array(F.floor("lt"), F.floor("lt") - 1, F.floor("lt") + 1))
    other = have.select("manual_id", "page", F.col("lt").alias("ot"), F.col("lx").alias("ox"), F.col("line_no").alias("on"), band.alias("b"))
    parts = (
        have.filter(F.col("t").rlike(r"^\p{Ll}")).withColumn("b", F.floor("lt")).join(other, ["manual_id", "page", "b"])
        .filter((F.col("on") != F.col("line_no")) & (F.abs(F.col("ot") - F.col("lt")) < 1) & (F.col("ox") < F.col("lx")) & (F.col("lx") - F.col("ox") <= FRAGMENT))
        .select("manual_id", "page", "line_no").distinct().withColumn("part", F.lit(True))
    )
    have = have.join(parts, ["manual_id", "page", "line_no"], "left")
    df = figures.join(have, ["manual_id", "page"])
    above = (F.col("lt") < F.col("top")) & (F.col("top") - F.col("lt") >= ABOVE)
    narrow = F.abs(F.col("lx") - F.col("x0")) <= NARROW
    wide = F.col("lx").between(F.col("x0") - NARROW, F.col("x1") + NARROW)
    window = F.col("lx").between(F.col("x0") - HANGING, F.col("x1")) if prefixes else narrow
    df = df.withColumn("same", wide | (above & window))
    df = df.withColumn("any_same", F.max(F.col("same").cast("int")).over(W.partitionBy(*KEY)))
    df = df.filter((F.col("any_same") == 0) | F.col("same"))
    tier = F.when(heading, 0).when(F.coalesce("part", F.lit(False)), 3).when(narrow | (above & window), 1).otherwise(2)
    gap = F.when(F.col("lt") < F.col("top"), F.col("top") - F.col("lt")).when(F.col("lt") > F.col("bottom"), F.col("lt") - F.col("bottom")).otherwise(0.0)
    return df.withColumns({"tier": tier, "gap": gap, "shift": F.abs(F.col("lx") - F.col("x0"))})


def captions(figures: DataFrame, lines: DataFrame, prefixes: tuple[str, ...] = (), hold: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Rows (manual_id, page, figure_no, caption, line_no): the nearest candidate, its ties joined (FIG-3, FIG-4).

    Wrapped headings take the lines below that go on (FIG-6); figures merged of several rectangles take the labels
    around the caption (FIG-5). hold keeps the nearest candidates, which all of these read.
    """
    cand = caption_candidates(figures, lines, prefixes)
    ranked = cand.withColumn("tie", F.rank().over(W.partitionBy(*KEY).orderBy("tier", "gap"))).filter("tie = 1")
    # The nearest of all is the first of its ties, so one pass over the candidates gives both.
    best = F.min(F.struct("shift", "line_no", "tier", F.col("t").alias("first"), F.col("lt").alias("ct"), F.col("lx").alias("cx"), "n_rects")).alias("b")
    ties = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("lx", "line_no", "t"))), lambda x: x["t"]), " ").alias("joined")
    df = hold(ranked.groupBy(*KEY).agg(best, ties).select(*KEY, "b.line_no", "b.tier", "b.first", "b.ct", "b.cx", "b.n_rects", "joined"))
    below = lines.select("manual_id", "page", F.col("line_no").alias("ln"), strip(F.col("text")).alias("lt"), F.col("top").alias("ltop"), F.col("x0").alias("lx"))
    after = df.filter("tier = 0").select(*KEY, "first", "ct", "cx").join(below, ["manual_id", "page"]).filter("ltop > ct")
    order = W.partitionBy(*KEY).orderBy("ltop", "ln")
    prev_top, prev = F.coalesce(F.lag("ltop").over(order), F.col("ct")), F.coalesce(F.lag("lt").over(order), F.col("first"))
    goes = (F.col("ltop") - prev_top <= LABEL_GAP) & (F.abs(F.col("lx") - F.col("cx")) <= WRAP_SHIFT) & ~F.col("lt").rlike(r"^\s*[0-9]{1,2}[.)]") & F.col("lt").rlike(r"^\p{Ll}") & ~prev.rlike(r"[.!?:]\s*$")
    wraps = after.withColumn("goes", goes.cast("int")).withColumn("all", F.min("goes").over(order)).filter("all = 1").groupBy(*KEY).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ltop", "ln", "lt"))), lambda x: x["lt"]), " ").alias("more")
    )
    df = df.join(wraps, KEY, "left").join(_labels(df, below), KEY, "left")
    text = F.when(F.col("tier") == 0, F.concat_ws(" ", "first", "more")).otherwise(F.concat_ws(" ", "before", "joined", "behind"))
    return df.select(*KEY, strip_heading_marker(strip_note_glyph(text)).alias("caption"), "line_no")


def _labels(best: DataFrame, around: DataFrame) -> DataFrame:
    """Labels stacked above and below the caption of a composite figure: an unbroken chain of at most six each way."""
    df = best.filter("tier <> 0 and n_rects >= 2").filter(looks_like_label(F.col("first"))).select(*KEY, "ct", "cx").join(around, ["manual_id", "page"])
    out = []
    for name, cond, sign in (("before", F.col("ltop") < F.col("ct"), -1), ("behind", F.col("ltop") > F.col("ct"), 1)):
        order = W.partitionBy(*KEY).orderBy(F.col("ltop") * sign, "ln")
        ok = (F.abs(F.col("ltop") - F.coalesce(F.lag("ltop").over(order), F.col("ct"))) <= LABEL_GAP) & (F.abs(F.col("lx") - F.col("cx")) <= LABEL_SHIFT) & looks_like_label(F.col("lt"))
        chain = df.filter(cond).withColumn("ok", ok.cast("int")).withColumns({"all": F.min("ok").over(order), "k": F.row_number().over(order)}).filter((F.col("all") == 1) & (F.col("k") <= LABELS))
        out.append(chain.groupBy(*KEY).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ltop", "ln", "lt"))), lambda x: x["lt"]), " ").alias(name)))
    return out[0].join(out[1], KEY, "full")


def qr_caption(caption: Column) -> Column:
    """Whether a caption is nothing but a URL (FLT-8)."""
    return caption.rlike(r"(?i)^\s*https?://\S+\s*$")


def extract(rects: DataFrame, lines: DataFrame, sections: DataFrame, prefixes: tuple[str, ...] = (), min_width: float = MIN_SIDE, min_height: float = MIN_SIDE, distance: float = MERGE, columns: int = 1, offset: int = 1, hold: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Figures with section, caption and id (FIG-7): fills out, merge, size, section, caption, codes out.

    sections has manual_id, section_no, page_start, start_top, e_page, e_top in reading order; with two columns a figure's place is put into that order first
    (LAY-3). The start is inclusive here; the first section counts. lines are those of the pages, in their physical places. hold keeps
    what several parts read: without it the plan repeats the placed figures for each of them.
    """
    figs = merge_rects(content_rects(rects), distance).filter(figure_sized(min_width, min_height)).withColumn("read_top", F.col("top"))
    if columns > 1:
        bounds = column_boundaries(drop_margin_glyphs(lines)).select("manual_id", "page", "boundary")
        figs = figs.join(bounds, ["manual_id", "page"], "left").withColumn("read_top", read_top(F.col("x0"), F.col("top"), F.col("boundary"))).drop("boundary")
    pages = sections.withColumn("page", F.explode(F.sequence("page_start", F.greatest("page_start", "e_page"))))
    pos = F.struct(F.col("page").alias("p"), F.col("read_top").alias("t"))
    inside = (pos >= F.struct(F.col("page_start").alias("p"), F.col("start_top").alias("t"))) & (pos < F.struct(F.col("e_page").alias("p"), F.col("e_top").alias("t")))
    placed = figs.join(pages, ["manual_id", "page"]).filter(inside).groupBy(*KEY, "x0", "top", "x1", "bottom", "n_rects").agg(F.min("section_no").alias("section_no"))
    placed = hold(placed)
    out = placed.join(captions(placed, lines, prefixes, hold), KEY, "left").filter(~F.coalesce(qr_caption(F.col("caption")), F.lit(False)))
    rect = F.concat_ws(",", *[F.format_string("%.1f", F.bround(c, 1)) for c in ("x0", "top", "x1", "bottom")])
    # Figures without area have nothing to render.
    return out.filter("x1 > x0 and bottom > top").withColumns({"figure_id": content_id(F.lit("figure"), F.col("manual_id"), F.col("page"), rect), "printed_page": F.col("page") + offset})


def clip(page_width: Column, page_height: Column) -> list[Column]:
    """Rectangle within the page (SNK-6); filter on x1 > x0 and bottom > top drops what has no area."""
    return [F.greatest("x0", F.lit(0.0)).alias("x0"), F.greatest("top", F.lit(0.0)).alias("top"), F.least(F.col("x1"), page_width).alias("x1"), F.least(F.col("bottom"), page_height).alias("bottom")]
