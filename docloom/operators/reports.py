"""Counts, rankings and rendered pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions.text import SLOT_ORDER, diagram_label, function_filename, html_escape, slugify

KEY = ["manual_id", "section_no"]


def function_counts(functions: DataFrame, steps: DataFrame, requirements: DataFrame, thresholds: DataFrame, figures: DataFrame | None = None) -> DataFrame:
    """Per function: steps, requirements, thresholds, filled, figures, test_ready (AGG-1, AGG-2); children are counted before any join."""
    s = steps.groupBy(*KEY).agg(F.count("*").alias("n_steps"))
    r = requirements.groupBy(*KEY).agg(F.count("*").alias("n_requirements"))
    t = thresholds.groupBy(*KEY).agg(F.count("*").alias("n_thresholds"), F.count_if(F.col("status") != "unfilled").alias("n_filled"))
    out = functions.select(*KEY).join(s, KEY, "left").join(r, KEY, "left").join(t, KEY, "left")
    if figures is not None:
        out = out.join(figures.groupBy(*KEY).agg(F.count("*").alias("n_figures")), KEY, "left")
    out = out.na.fill(0)
    return out.withColumn("test_ready", (F.col("n_steps") > 0) & (F.col("n_thresholds") == F.col("n_filled")))


def spec_counts(per_function: DataFrame) -> DataFrame:
    """Totals of each manual (AGG-1, AGG-6)."""
    return per_function.groupBy("manual_id").agg(
        F.count("*").alias("functions"), F.sum("n_requirements").alias("requirements"), F.sum("n_thresholds").alias("thresholds"), F.sum("n_filled").alias("filled"),
        (F.sum("n_thresholds") - F.sum("n_filled")).alias("unfilled"), F.count_if("test_ready").alias("test_ready"), *([F.sum("n_figures").alias("figures")] if "n_figures" in per_function.columns else []),
    )


def combined(functions: DataFrame, chapter_order: DataFrame) -> DataFrame:
    """Functions of all chapters of a manual in its order, numbered chapter.function (AGG-3, AGG-13); unknown chapters last by name."""
    df = functions.join(chapter_order, ["manual_id", "chapter_slug"], "left")
    i = F.dense_rank().over(W.partitionBy("manual_id").orderBy(F.coalesce("rank", F.lit(1 << 30)), "chapter_slug"))
    n = F.row_number().over(W.partitionBy("manual_id", "chapter_slug").orderBy("function_no"))
    return df.withColumns({"chapter_no": i, "number": n}).withColumn("label", F.concat_ws(".", "chapter_no", "number"))


#: Wordings that are sent to each task as one list, at most.
LISTED = 10_000


def _joined_hits(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """The counts by a join on what a wording begins with; a text is cut into distinct beginnings first."""
    t = texts.select("manual_id", F.lower(F.coalesce("maker", F.lit(""))).alias("maker"), F.lower("text").alias("t")).filter("t <> ''")
    begins = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length("t")), lambda i: F.array(*[F.substr(F.col("t"), i, F.lit(k)) for k in (1, 2, 3)]))))
    keyed = rows.withColumn("b", F.substring("w", 1, 3))
    met = t.withColumn("b", F.explode(begins)).join(keyed, "b").filter("(m = '' or maker = '' or m = maker) and contains(t, w)")
    n = ((F.length("t") - F.length(F.replace("t", F.col("w"), F.lit("")))) / F.length("w")).cast("long")
    return met.groupBy("manual_id", "term_id", "wording_no").agg(F.sum(n).alias("n"))


def glossary_hits(texts: DataFrame, words: DataFrame, listed_up_to: int = LISTED) -> DataFrame:
    """Rows (manual_id, term_id, wording_no, n): literal counts of wordings, whatever their case, in the scope of their maker (TVF-5).

    texts has manual_id, maker and text; a wording without maker counts in all, and a text without maker counts all. The glossary is a hand-made list: up to
    LISTED wordings become one array that each text counts in place, so texts are neither shuffled nor multiplied by it. Longer ones are joined to texts by their first three
    characters, so each text meets only wordings that can begin in it.
    """
    rows = words.select("term_id", "wording_no", F.lower("text").alias("w"), F.lower(F.coalesce("maker", F.lit(""))).alias("m")).filter("w <> ''")
    if rows.limit(listed_up_to + 1).count() > listed_up_to:
        return _joined_hits(texts, rows)
    listed = rows.agg(F.sort_array(F.collect_list(F.struct("term_id", "wording_no", "w", "m"))).alias("ws"))
    df = texts.select("manual_id", F.lower(F.coalesce("maker", F.lit(""))).alias("maker"), F.lower("text").alias("t")).join(F.broadcast(listed))
    hit = F.filter("ws", lambda x: ((x["m"] == "") | (F.col("maker") == "") | (x["m"] == F.col("maker"))) & F.contains(F.col("t"), x["w"]))
    n = F.transform(hit, lambda x: F.struct(x["term_id"].alias("term_id"), x["wording_no"].alias("wording_no"), ((F.length("t") - F.length(F.replace(F.col("t"), x["w"], F.lit("")))) / F.length(x["w"])).cast("long").alias("n")))
    return df.select("manual_id", F.inline(n)).groupBy("manual_id", "term_id", "wording_no").agg(F.sum("n").alias("n"))


def glossary_totals(hits: DataFrame, terms: DataFrame) -> DataFrame:
    """Hits of each term with its wordings found, most first (AGG-4)."""
    total = hits.groupBy("manual_id", "term_id").agg(F.sum("n").alias("hits"), F.sort_array(F.collect_set("wording_no")).alias("wordings"))
    return total.join(terms, "term_id", "left").orderBy("manual_id", F.desc("hits"), "term_id")


def by_slot(requirements: DataFrame) -> DataFrame:
    """Requirements numbered within their slot, slots in fixed order (AGG-5)."""
    order = F.array_position(F.array(*[F.lit(s) for s in SLOT_ORDER]), F.col("slot"))
    return requirements.withColumns({"slot_no": order.cast("int"), "number": F.row_number().over(W.partitionBy(*KEY, "slot").orderBy("req_no"))})


def threshold_value(value: Column) -> Column:
    """A missing or empty value prints as unfilled, also where none applies (AGG-7)."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit("unfilled"))


def procedure_edges(steps: DataFrame) -> DataFrame:
    """Edges between consecutive steps of a sequence (AGG-9)."""
    nxt = F.lead("step_no").over(W.partitionBy(*KEY, "sequence").orderBy("step_no"))
    return steps.select(*KEY, "sequence", F.col("step_no").alias("from_step"), nxt.alias("to_step")).filter("to_step is not null")


def procedure_chart(steps: DataFrame) -> DataFrame:
    """A flow chart's source for each function with steps: a box for each sequence, its steps chained (AGG-9)."""
    order = W.partitionBy(*KEY, "sequence").orderBy("step_no")
    node = F.concat(F.lit("S"), "sequence", F.lit("_"), "number")
    box = F.concat(F.lit("    "), node, F.lit('["'), diagram_label(F.concat_ws(". ", F.col("number").cast("string"), "text")), F.lit('"]'))
    drawn = steps.withColumns({"node": node, "box": box}).withColumn("arrow", F.concat(F.lit("    "), F.lag("node").over(order), F.lit(" --> "), "node"))
    rows = F.sort_array(F.collect_list(F.struct("step_no", "box", "arrow")))
    parts = drawn.groupBy(*KEY, "sequence").agg(rows.alias("rows")).select(
        *KEY, "sequence",
        F.concat_ws(
            "\n", F.concat(F.lit("    subgraph SEQ"), "sequence", F.lit('["Sequence '), "sequence", F.lit('"]')), F.lit("    direction TB"), F.array_join(F.transform("rows", lambda x: x["box"]), "\n"),
            F.nullif(F.array_join(F.transform("rows", lambda x: x["arrow"]), "\n"), F.lit("")), F.lit("    end"),
        ).alias("part"),
    )
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sequence", "part"))), lambda x: x["part"]), "\n")
    return parts.groupBy(*KEY).agg(joined.alias("parts")).select(*KEY, F.concat_ws("\n", F.lit("flowchart TD"), "parts").alias("chart"))


def threshold_pie(filled: Column, unfilled: Column) -> Column:
    """A pie chart's source (AGG-10)."""
    return F.concat(F.lit('pie showData\n    "Filled" : '), filled.cast("string"), F.lit('\n    "Unfilled" : '), unfilled.cast("string"))


def tree_chart(functions: DataFrame, counts: DataFrame, titles: DataFrame) -> DataFrame:
    """A tree chart's source for each manual: its title (manual_id, root), areas and functions (AGG-10)."""
    t = function_tree(functions, counts)
    n = F.row_number().over(W.partitionBy("manual_id", "area_no").orderBy("function_no"))
    leaf = F.concat(F.lit("    A"), "area_no", F.lit(" --> A"), "area_no", F.lit("F"), n, F.lit('["'), diagram_label(F.concat_ws(" ", F.col("function_no").cast("string"), "title", F.when(F.col("warn"), F.lit("⚠")))), F.lit('"]'))
    leaves = t.withColumn("leaf", leaf).groupBy("manual_id", "area_no", "area").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("function_no", "leaf"))), lambda x: x["leaf"]), "\n").alias("leaves"))
    area = F.concat(F.lit("    ROOT --> A"), "area_no", F.lit('["'), diagram_label(F.col("area")), F.lit('"]\n'), "leaves")
    areas = leaves.withColumn("part", area).groupBy("manual_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("area_no", "part"))), lambda x: x["part"]), "\n").alias("parts"))
    return areas.join(titles, "manual_id").select("manual_id", F.concat(F.lit('flowchart LR\n    ROOT["'), diagram_label(F.col("root")), F.lit('"]\n'), "parts").alias("chart"))


def function_tree(functions: DataFrame, counts: DataFrame) -> DataFrame:
    """Functions grouped by area in the order areas first appear; a blank area is General (AGG-10)."""
    df = functions.withColumn("area", F.coalesce(F.nullif(F.trim("area"), F.lit("")), F.lit("General"))).join(counts.select(*KEY, "test_ready"), KEY, "left")
    first = F.min("function_no").over(W.partitionBy("manual_id", "area"))
    df = df.withColumn("first", first)
    return df.select("manual_id", F.dense_rank().over(W.partitionBy("manual_id").orderBy("first")).alias("area_no"), "area", "function_no", "title", (~F.coalesce("test_ready", F.lit(False))).alias("warn"))


def thresholds_by_function(functions: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Functions with thresholds and how many are open (AGG-11, AGG-14)."""
    t = thresholds.groupBy(*KEY).agg(F.count("*").alias("n_thresholds"), F.count_if(F.col("status") == "unfilled").alias("n_unfilled"))
    return functions.join(t, KEY)


def by_maker(sources: DataFrame) -> DataFrame:
    """Manuals of each maker, and how many may be viewed (AGG-12)."""
    ok = F.col("license_state") == "internal_use_permitted"
    return sources.groupBy("maker").agg(F.count("*").alias("n_manuals"), F.count_if(ok).alias("n_viewable"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("n_blocked"), F.sort_array(F.collect_list("manual_id")).alias("manuals"))


def available_chapters(sources: DataFrame, bookmarks: DataFrame, allowlist: DataFrame, detected: DataFrame, reviews: DataFrame | None = None) -> DataFrame:
    """Chapters of each manual from the place that its section_source names (AGG-15, SRC-14).

    reviews has a row (manual_id) for each manual whose allowlist was confirmed: with an empty list it has no chapters, while one never reviewed shows what
    was detected. Without reviews the list's own rows tell. A contents-page manual shows nothing before its review.
    """
    b = bookmarks.select("manual_id", F.col("title").alias("label"), F.lit("bookmarks").alias("section_source"))
    a = allowlist.select("manual_id", "label", F.lit("allowlist").alias("section_source"))
    d = detected.select("manual_id", "label", F.lit("running_head").alias("section_source"))
    reviewed = (allowlist if reviews is None else reviews).select("manual_id").distinct().withColumn("reviewed", F.lit(True))
    want = sources.join(reviewed, "manual_id", "left").withColumn("section_source", F.when((F.col("section_source") != "bookmarks") & F.coalesce("reviewed", F.lit(False)), "allowlist").otherwise(F.col("section_source")))
    return want.select("manual_id", "section_source").join(b.unionByName(a).unionByName(d), ["manual_id", "section_source"])


def label_recurrence(candidates: DataFrame) -> DataFrame:
    """How often a label recurs (AGG-16)."""
    return candidates.withColumn("recurs", F.count("*").over(W.partitionBy("manual_id", "label")))


#: Numbers of the slots as printed.
SLOT_NUMBERS = {"overview": "2-1", "requirements": "2-2", "hmi": "3", "user_setting": "4", "exception": "5", "other": "6", "safety": "7"}


def _cell(c: str) -> Column:
    return F.replace(html_escape(F.coalesce(c, F.lit(""))), F.lit("|"), F.lit("\\|"))


def _listed(df: DataFrame, key: list[str], order: list[str], line: Column, name: str) -> DataFrame:
    """A text of all lines of a key, in order."""
    return df.groupBy(*key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, line.alias("l")))), lambda x: x["l"]), "\n").alias(name))


def _row(*cells: Column | str) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def threshold_table(thresholds: DataFrame) -> DataFrame:
    """Rows (KEY, line_no, pattern_no, at, row): the printed threshold table (AGG-7)."""
    dash = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("—"))
    for c in ("evidence", "filled_by"):
        if c not in thresholds.columns:
            thresholds = thresholds.withColumn(c, F.lit(None).cast("string"))
    row = _row("threshold_id", _cell("matching_text"), "kind", dash("unit"), threshold_value(F.col("value")), "status", html_escape(dash("evidence")), dash("filled_by"))
    return thresholds.select(*KEY, "line_no", "pattern_no", "at", "threshold_id", row.alias("row"))


def requirement_tables(functions: DataFrame, requirements: DataFrame) -> DataFrame:
    """Rows (KEY, slot_no, slot, part): a heading and table for each slot that a function fills (AGG-5).

    A change column appears if any requirement of the function has one; requirements may lack the column.
    """
    if "change" not in requirements.columns:
        requirements = requirements.withColumn("change", F.lit(None).cast("string"))
    numbers = F.create_map(*[F.lit(x) for kv in SLOT_NUMBERS.items() for x in kv])
    r = by_slot(requirements).join(functions.select(*KEY, "function_no", "title"), KEY)
    r = r.withColumn("changes", F.max(F.col("change").isNotNull()).over(W.partitionBy(*KEY)))
    label = F.when(F.col("is_bullet"), "Step -").otherwise(F.col("title"))
    text = F.concat(F.lit("**"), html_escape(label), F.lit("** "), _cell("text"))
    row = F.when(F.col("changes"), _row(F.col("number").cast("string"), text, F.coalesce("change", F.lit("")), "strength", "source")).otherwise(_row(F.col("number").cast("string"), text, "strength", "source"))
    parts = _listed(r.withColumn("row", row), [*KEY, "function_no", "slot_no", "slot", "changes"], ["number"], F.col("row"), "rows")
    head = F.when(F.col("changes"), "| # | Requirement | Change | Strength | Source |\n|---|---|---|---|---|").otherwise("| # | Requirement | Strength | Source |\n|---|---|---|---|")
    title = F.concat(F.lit("## "), "function_no", F.lit("-"), numbers[F.col("slot")], F.lit(". "), "slot")
    return parts.select(*KEY, "slot_no", "slot", F.concat_ws("\n", title, F.lit(""), head, "rows").alias("part"))


def function_pages(functions: DataFrame, requirements: DataFrame, steps: DataFrame, thresholds: DataFrame, figures: DataFrame | None = None) -> DataFrame:
    """A Markdown page (KEY, file, markdown) for each function: what it is, figures, procedure with its chart, thresholds, requirements (AGG-8); texts are joined in order within one row."""
    counts = function_counts(functions, steps, requirements, thresholds)
    r = _listed(requirement_tables(functions, requirements), KEY, ["slot_no"], F.col("part"), "r")
    s = _listed(steps, KEY, ["step_no"], _row(F.col("sequence").cast("string"), F.col("number").cast("string"), _cell("text"), "source"), "s")
    t = _listed(threshold_table(thresholds), KEY, ["line_no", "pattern_no", "at", "threshold_id"], F.col("row"), "t")
    df = functions.join(counts, KEY, "left").join(r, KEY, "left").join(s, KEY, "left").join(t, KEY, "left").join(procedure_chart(steps), KEY, "left")
    if figures is not None:
        line = F.concat(F.lit("![figure](../figures/FIG-"), "figure_id", F.lit(".png)\n- p."), F.col("printed_page").cast("string"), F.coalesce(F.concat(F.lit(" "), html_escape(F.col("caption"))), F.lit("")), F.lit("\n"))
        df = df.join(_listed(figures, KEY, ["page", "figure_no"], line, "f"), KEY, "left")
    else:
        df = df.withColumn("f", F.lit(None).cast("string"))
    part = lambda head, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"\n{head}\n"), F.col(c)))
    about = F.concat(
        F.lit("- Path: "), html_escape(F.col("function_path")), F.lit("\n- Printed pages: "), F.array_join("pages", ", "), F.lit("\n- Test-ready: "), F.when(F.col("test_ready"), "yes").otherwise("no"),
        F.lit("\n- Thresholds filled: "), F.col("n_filled").cast("string"), F.lit(" of "), F.col("n_thresholds").cast("string"),
    )
    return df.select(
        *KEY, function_file(F.col("function_no"), F.col("title")).alias("file"),
        F.concat_ws(
            "\n", F.concat(F.lit("# "), F.col("function_no").cast("string"), F.lit(". "), html_escape(F.col("title"))), about, part("## Figures", "f"),
            F.when(F.col("s").isNotNull(), F.concat(F.lit("\n## Procedure\n```mermaid\n"), "chart", F.lit("\n```\n\n| Seq | Step | Operation | Source |\n|---|---|---|---|\n"), "s")),
            part("## Thresholds\n| Threshold | Text | Kind | Unit | Value | Status | Evidence | Filled by |\n|---|---|---|---|---|---|---|---|", "t"), F.concat(F.lit("\n"), "r"),
        ).alias("markdown"),
    )


def function_file(number: Column, title: Column) -> Column:
    return function_filename(number, slugify(title))


def index_rows(functions: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows (manual_id, chapter_no, function_no, row): the index's line of each function (AGG-6)."""
    df = functions.join(counts, KEY, "left")
    figures = F.col("n_figures").cast("string") if "n_figures" in counts.columns else F.lit("0")
    row = _row(
        F.col("function_no").cast("string"), html_escape(F.col("title")), html_escape(F.coalesce("area", F.lit(""))), F.coalesce(F.col("n_requirements"), F.lit(0)).cast("string"), F.coalesce(figures, F.lit("0")),
        (F.coalesce("n_thresholds", F.lit(0)) - F.coalesce("n_filled", F.lit(0))).cast("string"), F.when(F.col("test_ready"), "o").otherwise("-"),
    )
    return df.select("manual_id", "chapter_no", "function_no", row.alias("row"))


def index_pages(functions: DataFrame, counts: DataFrame) -> DataFrame:
    """A Markdown index (manual_id, chapter_no, markdown) of each chapter: totals, pie and the table of functions (AGG-8, AGG-6)."""
    by = ["manual_id", "chapter_no"]
    rows = _listed(index_rows(functions, counts), by, ["function_no"], F.col("row"), "rows")
    totals = functions.join(counts, KEY, "left").groupBy(*by).agg(
        F.first("area").alias("area"), F.count("*").alias("functions"), F.sum("n_thresholds").alias("thresholds"), F.sum("n_filled").alias("filled"), F.count_if("test_ready").alias("ready")
    )
    text = F.concat(
        F.lit("# "), html_escape(F.col("area")), F.lit("\n\n- Thresholds: "), F.col("thresholds").cast("string"), F.lit(", filled "), F.col("filled").cast("string"), F.lit("\n- Test-ready functions: "), F.col("ready").cast("string"), F.lit(" of "),
        F.col("functions").cast("string"), F.lit("\n\n```mermaid\n"), threshold_pie(F.col("filled"), F.col("thresholds") - F.col("filled")),
        F.lit("\n```\n\n| No. | Function | Area | Requirements | Figures | Unfilled | Ready |\n|---|---|---|---|---|---|---|\n"), "rows",
    )
    return totals.join(rows, by).select(*by, text.alias("markdown"))
