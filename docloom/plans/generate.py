"""The whole derivation for many manuals at once: lines and bookmarks to functions, steps, requirements, thresholds and figures."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions.thresholds import detect
from docloom.operators import building, figures, layout, sections
from docloom.sources import tables

BY = ["manual_id", "chapter_no"]
#: section_no is a chapter's number times this plus the section's number in it.
CHAPTER_STEP = 1_000_000


@dataclass
class Spec:
    sections: DataFrame
    section_lines: DataFrame
    functions: DataFrame
    steps: DataFrame
    requirements: DataFrame
    thresholds: DataFrame
    figures: DataFrame | None = None
    excluded: DataFrame | None = None
    unmatched: DataFrame | None = None
    kept: tuple[str, ...] = ()

    def release(self) -> None:
        """Delete the tables of the parts that generate kept; nothing of this Spec can be read afterwards."""
        for path in self.kept:
            tables.remove(self.sections.sparkSession, path)


def chapters_of(bookmarks: DataFrame) -> DataFrame:
    """Rows (manual_id, chapter_no, chapter, page_start, page_end, nested): top-level bookmarks, and whether any lies below (SEC-1, SEC-4)."""
    top = sections.chapter_ranges(bookmarks).select("manual_id", F.col("seq").alias("chapter_no"), F.col("title").alias("chapter"), "page_start", "page_end")
    nested = _tied(bookmarks).select("manual_id", "chapter_no").distinct().withColumn("nested", F.lit(True))
    return top.join(nested, BY, "left").withColumn("nested", F.coalesce("nested", F.lit(False)))


def _tied(bookmarks: DataFrame) -> DataFrame:
    """Nested bookmarks with chapter_no, area (the chapter's title) and chapter_end of the top-level bookmark above: carried down, so no pairs are formed."""
    least = F.min("level").over(W.partitionBy("manual_id"))
    order = W.partitionBy("manual_id").orderBy("seq")
    own = bookmarks.withColumn("top", F.col("level") == least)
    # The next chapter's page is the nearest top-level bookmark's behind; carried up.
    end = F.first(F.when(F.col("top"), F.col("page_index")), True).over(order.rowsBetween(1, W.unboundedFollowing))
    above = F.last(F.when(F.col("top"), F.struct(F.col("seq").alias("chapter_no"), F.col("title").alias("area"))), True).over(order.rowsBetween(W.unboundedPreceding, 0))
    return own.withColumns({"chapter_end": end, "above": above}).filter("not top and above is not null").select("manual_id", "seq", "title", "level", "page_index", "above.chapter_no", "above.area", "chapter_end")


def headings(bookmarks: DataFrame, lines: DataFrame) -> DataFrame:
    """Candidates from nested bookmarks: each with its place, chapter and the chapter's end."""
    return sections.match_headings(_tied(bookmarks), lines)


def cut(lines: DataFrame, bookmarks: DataFrame, crumbs: DataFrame | None = None, offset: int = 1, hold: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(heads, section lines, chapters with strategy) of all chapters, each cut the way that it allows (SEC-4).

    heads has manual_id, chapter_no, section_no, title, area, page_start, start_top, page_end and matched; start_top is -1 where a section begins with its page.
    hold keeps what several parts read.
    """
    chapters = hold(chapters_of(bookmarks))
    cols = [*BY, "seq", "title", "area", "page_start", "start_top", "chapter_end", "matched"]
    nested = headings(bookmarks, lines).select(*cols)
    from_nested = sections.cut_sections(nested.withColumn("seq", _number("seq")), lines).withColumn("chapter_no", F.floor(F.col("section_no") / CHAPTER_STEP).cast("int"))
    heads, both = nested, [from_nested.select(*lines.columns, "chapter_no", "section_no")]
    bare, crumbed, plan = chapters.filter("not nested"), None, chapters.withColumn("strategy", F.lit("bookmarks"))
    # Few chapters need the other ways; those that none needs are not planned at all.
    if bare.limit(1).count():
        inside = hold(layout.drop_margin_glyphs(sections.in_chapters(lines, bare), by=tuple(BY)))
        ends = bare.select(*BY, F.col("chapter").alias("own_title"), F.col("page_end").alias("chapter_end"))
        no_area = lambda df: df.join(ends, BY).withColumn("area", F.col("own_title")).select(*cols)
        none = bare.select(*BY).limit(0)
        entries = hold(sections.index_entries(lines, bare))
        index = hold(sections.index_sections(entries, inside, offset)) if entries.limit(1).count() else None
        crumbed = None if crumbs is None else hold(sections.breadcrumb_sections(sections.in_chapters(crumbs, bare)))
        plan = sections.strategy(chapters, none if crumbed is None else crumbed, none if index is None else index)
        taken = bare.select(*BY).limit(0)
        if crumbed is not None:
            taken = crumbed.select(*BY).distinct()
        made = []
        if index is not None:
            made.append(no_area(index.join(taken, BY, "left_anti")))
            taken = taken.unionByName(index.select(*BY).distinct())
        rest = inside if index is None and crumbed is None else inside.join(taken, BY, "left_anti")
        made.append(no_area(sections.font_headings(rest, bare.select(*BY, F.col("chapter").alias("title")), by=tuple(BY), cleaned=True)))
        other = hold(made[0] if len(made) == 1 else made[0].unionByName(made[1]))
        heads = nested.unionByName(other)
        own = inside.withColumnRenamed("chapter_no", "in_chapter")
        found = sections.cut_sections(other.withColumn("seq", _number("seq")), own)
        both.append(found.filter(F.floor(F.col("section_no") / CHAPTER_STEP) == F.col("in_chapter")).select(*lines.columns, F.col("in_chapter").alias("chapter_no"), "section_no"))
    w = W.partitionBy(*BY).orderBy("seq")
    heads = heads.withColumn("page_end", F.coalesce(F.lead("page_start").over(w), "chapter_end"))
    heads = heads.select(*BY, "seq", "title", "area", "page_start", "start_top", "page_end", "matched")
    if crumbed is not None:
        mine = crumbed.join(ends, BY)
        area = F.when(F.col("area") == "", F.col("own_title")).otherwise(F.col("area"))
        heads = heads.unionByName(mine.select(*BY, "seq", "title", area.alias("area"), "page_start", F.lit(0.0).alias("start_top"), "page_end", F.lit(True).alias("matched")))
        pages = mine.select(*BY, _number("seq").alias("section_no"), F.explode(F.sequence("page_start", F.col("page_end") - 1)).alias("page"))
        both.append(inside.join(pages, [*BY, "page"]).select(*lines.columns, "chapter_no", "section_no"))
    out = both[0]
    for more in both[1:]:
        out = out.unionByName(more)
    return heads.withColumn("section_no", _number("seq")).drop("seq"), out, plan


def _number(seq: str) -> Column:
    return F.col("chapter_no").cast("long") * CHAPTER_STEP + F.col(seq)


def generate(
    lines: DataFrame, bookmarks: DataFrame | None = None, header: float = 0.0, footer: float | None = None, columns: int = 1, offset: int = 1, prefixes: tuple[str, ...] = (), excluded: tuple[str, ...] = (), keep: bool = False,
    crumbs: DataFrame | None = None, rects: DataFrame | None = None, min_width: float = figures.MIN_SIDE, min_height: float = figures.MIN_SIDE, slot_rules: tuple | None = None, outputs: tuple[str, ...] | None = None,
) -> Spec:
    """Functions of all manuals (BLD-10). Header citations are read before furniture goes, furniture before columns are put in order.

    Chapters without nested bookmarks are cut by breadcrumbs (if given), their own index or font sizes; without bookmarks a manual is one chapter, cut
    by font sizes. With rects figures are extracted. With keep, what several outputs share is computed at once and written to
    the shared folder, where it stays until release(): a lost executor costs nothing of it, and plans over it stay short. outputs names those
    that will be read, if known: what none of them needs isn't computed, and requirements and thresholds are kept too where they are read together.
    """
    held: list[str] = []

    def hold(df: DataFrame) -> DataFrame:
        if not keep:
            return df
        back, path = tables.store(df)
        held.append(path)
        return back

    def for_any(df: DataFrame, *names: str) -> DataFrame:
        return hold(df) if outputs is None or set(outputs) & set(names) else df

    ruled = outputs is not None and {"requirements", "thresholds"} <= set(outputs)
    lines = hold(lines)
    bookmarks = None if bookmarks is None else hold(bookmarks)
    citations = layout.running_heads(lines, header, footer) if header else None
    body = layout.furniture(lines, header, footer) if header or footer is not None else lines
    body = body if body is lines else hold(body)
    read = body if columns <= 1 else layout.order_by_columns(body, columns).withColumn("top", F.col("read_top")).drop("read_top")
    if bookmarks is None:
        bookmarks = lines.select("manual_id").distinct().select("manual_id", F.lit(0).alias("seq"), F.lit("").alias("title"), F.lit(0).alias("level"), F.lit(0).alias("page_index"))
    read = read if read is lines else hold(read)
    heads, section_lines, _ = cut(read, bookmarks, crumbs, offset, hold)
    heads, section_lines = hold(heads), hold(section_lines)
    funcs = for_any(building.functions(section_lines, heads, offset, excluded), "functions", "steps", "requirements", "thresholds")
    kept = section_lines.join(funcs.select("manual_id", "section_no"), ["manual_id", "section_no"], "left_semi") if excluded else section_lines
    split = for_any(building.split_lines(kept, prefixes), "steps", "requirements", "thresholds")
    step_rows = for_any(building.steps(split, offset=offset), "steps", "requirements", "thresholds")
    groups = building.next_steps(building.paragraphs(split), step_rows)
    reqs = hold(building.requirements(groups, funcs.select("manual_id", "section_no", F.col("raw_title").alias("title")), offset, citations, slot_rules))
    reqs = hold(reqs) if ruled else reqs
    found = detect(reqs.select("manual_id", "section_no", "req_no", "req_id", "source_text", "source"), "source_text", "source")
    found = hold(found) if ruled else found
    figs = None if rects is None else figures.extract(rects, body, figure_windows(heads, section_lines), prefixes, min_width, min_height, columns=columns, offset=offset, hold=hold)
    return Spec(heads, section_lines, funcs, step_rows, reqs, found, figs, building.excluded_titles(section_lines, heads, excluded), unmatched(heads, section_lines), tuple(held))


def unmatched(heads: DataFrame, section_lines: DataFrame) -> DataFrame:
    """Headings with text below them that were not found on their pages."""
    return heads.filter("not matched").join(section_lines.select("manual_id", "section_no").distinct(), ["manual_id", "section_no"], "left_semi").select("manual_id", "section_no", "title")


def figure_windows(heads: DataFrame, section_lines: DataFrame) -> DataFrame:
    """Rows (manual_id, section_no, page_start, start_top, e_page, e_top): from each section that has text to the next that has; the chapter's last ends with its last section's page."""
    real = heads.join(section_lines.select("manual_id", "section_no").distinct(), ["manual_id", "section_no"], "left_semi")
    last = section_lines.groupBy("manual_id").agg((F.max("page") + 1).alias("open_end"))
    w = W.partitionBy(*BY).orderBy("section_no")
    return real.join(last, "manual_id").select(
        "manual_id", "section_no", "page_start", "start_top", F.coalesce(F.lead("page_start").over(w), F.max(F.coalesce("page_end", "open_end")).over(W.partitionBy(*BY)) + 1).alias("e_page"), F.coalesce(F.lead("start_top").over(w), F.lit(0.0)).alias("e_top")
    )
