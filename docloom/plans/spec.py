"""Queries over whole specifications, figures and their companions, each with its SQL written from the rules and not from the operators' constants."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import building, figures, layout, overlay, reports, sections
from docloom.plans.generate import cut, generate
from docloom.sources import fixtures, profiles, tables
from docloom.sources.fixtures import manual_lines, read

KEY = ["manual_id", "section_no"]
EXCLUDED = ("blue", "Green")


def _marks(lines: DataFrame) -> DataFrame:
    """Bookmarks of which every other chapter of every other manual has no nested ones."""
    return fixtures.manual_bookmarks(lines).filter("level = 0 or not (manual_id % 2 = 0 and floor(page_index / 6) % 2 = 1)")


def _spec(spark: SparkSession, d: str, **more):
    """The derivation of all manuals; every chapter has nested bookmarks, so no other way of cutting is planned."""
    lines = manual_lines(spark, d).drop("q", "p_name")
    return generate(lines, fixtures.manual_bookmarks(lines), keep=True, **more)


def cascade_sections(spark: SparkSession, d: str) -> DataFrame:
    lines = manual_lines(spark, d).drop("q", "p_name")
    hold = lambda df: tables.store(df)[0]
    lines = hold(lines)
    heads, cut_lines, plan = cut(lines, hold(_marks(lines)), hold=hold)
    n = cut_lines.groupBy(*KEY).agg(F.count("*").alias("n_lines"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"))
    return heads.join(n, KEY).join(plan.select("manual_id", "chapter_no", "strategy"), ["manual_id", "chapter_no"]).select(*KEY, "title", "area", "strategy", "n_lines", "first_line", "last_line")


def function_rows(spark: SparkSession, d: str) -> DataFrame:
    lines = manual_lines(spark, d).drop("q", "p_name")
    f = generate(lines, _marks(lines), keep=True, excluded=EXCLUDED).functions
    return f.select(*KEY, "function_no", "function_id", "title", "area", "function_path", F.array_join("pages", ",").alias("pages"))


def excluded_functions(spark: SparkSession, d: str) -> DataFrame:
    lines = manual_lines(spark, d).drop("q", "p_name")
    return generate(lines, _marks(lines), keep=True, excluded=EXCLUDED).excluded


def function_steps(spark: SparkSession, d: str) -> DataFrame:
    return _spec(spark, d).steps.select(*KEY, "step_no", "number", "sequence", "text", "source")


def function_counts(spark: SparkSession, d: str) -> DataFrame:
    s = _spec(spark, d)
    return reports.function_counts(s.functions, s.steps, s.requirements, s.thresholds)


def spec_totals(spark: SparkSession, d: str) -> DataFrame:
    s = _spec(spark, d)
    return reports.spec_counts(reports.function_counts(s.functions, s.steps, s.requirements, s.thresholds))


def spec_requirements(spark: SparkSession, d: str) -> DataFrame:
    return _spec(spark, d).requirements.select(*KEY, "req_no", "req_id", "slot", "text", "source_text", "strength", "source", "next_step_text")


def spec_thresholds(spark: SparkSession, d: str) -> DataFrame:
    return _spec(spark, d).thresholds.select(*KEY, "req_no", "pattern_id", "at", "matching_text", "context", "unit", "value", "status")


def function_pages(spark: SparkSession, d: str) -> DataFrame:
    lines = manual_lines(spark, d)
    s = generate(lines.drop("q", "p_name"), fixtures.manual_bookmarks(lines), keep=True, rects=fixtures.manual_rects(lines), outputs=("functions", "steps", "requirements", "thresholds", "figures"))
    return reports.function_pages(s.functions, s.requirements, s.steps, s.thresholds.withColumn("line_no", F.col("req_no")), s.figures)


def index_pages(spark: SparkSession, d: str) -> DataFrame:
    s = _spec(spark, d)
    return reports.index_pages(s.functions, reports.function_counts(s.functions, s.steps, s.requirements, s.thresholds))


def index_table(spark: SparkSession, d: str) -> DataFrame:
    s = _spec(spark, d)
    return reports.index_rows(s.functions, reports.function_counts(s.functions, s.steps, s.requirements, s.thresholds)).select("manual_id", "chapter_no", "function_no", F.col("row").alias("line"))


def spec_figures(spark: SparkSession, d: str) -> DataFrame:
    lines = manual_lines(spark, d)
    f = generate(lines.drop("q", "p_name"), fixtures.manual_bookmarks(lines), columns=2, keep=True, rects=fixtures.manual_rects(lines), prefixes=("Using",), outputs=("figures",)).figures
    return f.select("manual_id", "section_no", "page", "figure_no", "figure_id", "n_rects", "caption", "printed_page")


def running_heads(spark: SparkSession, d: str) -> DataFrame:
    return layout.running_heads(manual_lines(spark, d), 75.0)


def rect_filters(spark: SparkSession, d: str) -> DataFrame:
    r = fixtures.manual_rects(manual_lines(spark, d))
    return r.select("manual_id", "page", "rect_no", figures.full_bleed().alias("bleed"), figures.stretched_fill().alias("fill"), figures.figure_sized(40.0, 40.0).alias("sized"))


def figure_sizes(spark: SparkSession, d: str) -> DataFrame:
    return profiles.figure_thresholds(fixtures.manual_rects(manual_lines(spark, d)))


def figure_sizes_by_chapter(spark: SparkSession, d: str) -> DataFrame:
    lines = manual_lines(spark, d)
    return profiles.figure_thresholds(fixtures.manual_rects(lines), sections.chapter_ranges(fixtures.manual_bookmarks(lines)))


def caption_pick(spark: SparkSession, d: str) -> DataFrame:
    lines = manual_lines(spark, d)
    figs = figures.content_rects(fixtures.manual_rects(lines)).select("manual_id", "page", F.col("rect_no").alias("figure_no"), "x0", "top", "x1", "bottom", F.lit(1).alias("n_rects"))
    return figures.captions(figs, lines, ("Using",)).select("manual_id", "page", "figure_no", "caption")


def word_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = manual_lines(spark, d)
    w = lines.select("manual_id", "page", "line_no", "top", "x0", "size", F.posexplode(F.split("text", " ")).alias("k", "text"))
    words = w.select(
        "manual_id", "page", (F.col("line_no") * 100 + F.col("k")).alias("word_no"), "text", (F.col("top") + F.col("k") % 3 * 0.9).alias("top"), (F.col("x0") + F.col("k") * 10.0).alias("x0"),
        (F.col("x0") + F.col("k") * 10.0 + 8.0).alias("x1"), "size", F.lit(9.0).alias("height"), F.when(F.col("k") % 7 != 6, F.lit(None)).otherwise(F.lit(False)).cast("boolean").alias("upright"),
    )
    return layout.group_words(words).select("manual_id", "page", "text", "top", "x0", "size")


def text_cleaning(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").select("p_partkey", F.col("p_name").alias("n"))
    up = F.initcap("n")
    return p.select(
        "p_partkey", T.clean_bookmark(F.concat(F.lit("\u0081 "), "n", F.lit("\u009f "))).alias("bookmark"), T.clean_glyphs(F.concat(F.lit("Press  "), "n", F.lit(' "" now'))).alias("glyphs"),
        T.strip_arrows(F.concat(F.lit("uu"), up, F.lit("u"), up)).alias("arrows"), T.strip_note_glyph(F.concat(F.lit("u"), up)).alias("note"), T.strip_heading_marker(F.concat(F.lit("■  "), "n")).alias("marker"),
        T.join_lines(F.array(F.concat(F.lit(" "), "n", F.lit("-")), F.lit("goes on "), F.lit(""), F.lit("Next-"), F.lit("Line"))).alias("joined"),
    )


def anomaly_flags(spark: SparkSession, d: str) -> DataFrame:
    """Texts of every kind of anomaly, made from names."""
    n = F.col("p_name")
    kinds = F.array(
        F.lit(""), F.lit("ab."), F.lit("- a :"), F.lit("..."), F.concat(F.lit("] "), n), F.concat(n, F.lit(" (")), F.concat(n, F.lit(" ● x")), F.concat(n, F.lit("�")), F.concat(F.lit(""), n), F.substring(n, 1, 3), n
    )
    rows = read(spark, d, "part").select("p_partkey", F.posexplode(kinds).alias("k", "t"))
    return rows.select("p_partkey", "k", F.array_join(T.anomalies(F.col("t")), ",").alias("flags"))


def _thresholds(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select(
        F.col("o_orderkey").alias("threshold_id"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")).alias("evidence"), F.when(F.col("o_orderkey") % 5 > 0, F.lit("qa")).otherwise("").alias("filled_by"),
        F.when(F.col("o_orderkey") % 7 > 0, F.lit("12")).alias("value"), F.when(F.col("o_orderkey") % 11 == 0, "guessed").when(F.col("o_orderkey") % 2 == 0, "unfilled").otherwise("measured").alias("status"),
    )


def touched_thresholds(spark: SparkSession, d: str) -> DataFrame:
    return overlay.touched(_thresholds(spark, d)).select("threshold_id")


def overlay_checks(spark: SparkSession, d: str) -> DataFrame:
    return _thresholds(spark, d).select("threshold_id", overlay.invalid_overlay().alias("invalid"))


def element_changes(spark: SparkSession, d: str) -> DataFrame:
    base = read(spark, d, "customer").filter("c_custkey <= 100").select(F.col("c_custkey").alias("figure_id"), F.lit("purchase").alias("symbol"), F.col("c_name").alias("label"))
    log = read(spark, d, "events").select(F.col("user_id").alias("figure_id"), F.col("event_type").alias("symbol"), F.concat(F.lit("L"), F.col("event_id").cast("string")).alias("label"), "ts", "event_id", (F.col("event_id") % 4 == 0).alias("deleted"))
    return overlay.apply_changes(base, log, ["figure_id", "symbol"], ["ts", "event_id"])


def figure_elements(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "part").select((F.col("p_size") % 4).alias("manual_id"), F.col("p_brand").alias("figure_id"), F.col("p_type").alias("symbol"), F.col("p_name").alias("label"), F.col("p_partkey").cast("string").alias("note"))
    out = overlay.elements_by_figure(e)
    return out.select("manual_id", "figure_id", F.size("elements").alias("n"), F.array_join(F.transform("elements", lambda x: x["note"]), ",").alias("notes"))


def duplicate_labels(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "part").select((F.col("p_partkey") % 5).alias("manual_id"), F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.replace("p_name", F.lit(" "), F.lit("-"))).alias("label"))
    return overlay.duplicate_labels(c)


def shared_wordings(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").select(F.col("p_partkey").alias("term_id"), F.initcap("p_name").alias("text"), F.col("p_brand").alias("maker"))
    out = overlay.shared_wordings(p)
    return out.select("norm", F.array_join(F.transform("terms", lambda x: x.cast("string")), ",").alias("terms"), F.array_join("makers", ",").alias("makers"))


def license_gate(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("manual_id"), F.when(F.col("s_suppkey") % 3 == 0, "internal_use_permitted").when(F.col("s_suppkey") % 3 == 1, "unreviewed").alias("license_state"))
    return overlay.publishable(s).select("manual_id")


def classifier_answers(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "lineitem").filter("l_linenumber <= 4").select(F.col("l_orderkey").alias("manual_id"), F.col("l_linenumber").alias("idx"), F.col("l_returnflag").alias("label"), F.array(F.lit("X"), F.col("l_linestatus")).alias("evidence"))
    a = read(spark, d, "lineitem").filter("l_linenumber <= 4 and l_orderkey % 5 > 0 or l_linenumber < 3").select(
        F.col("l_orderkey").alias("manual_id"), F.col("l_linenumber").alias("idx"), F.when(F.col("l_partkey") % 3 == 0, F.col("l_linestatus")).when(F.col("l_partkey") % 3 == 1, F.col("l_returnflag")).otherwise("invented").alias("label"), (F.col("l_partkey") % 2 == 0).alias("is_real_chapter"),
    )
    return overlay.valid_labels(a, c)


def label_lookup(spark: SparkSession, d: str) -> DataFrame:
    return sections.find_label(sections.running_head_chapters(manual_lines(spark, d)), "AREA - 2!")


def glossary_table(spark: SparkSession, d: str) -> DataFrame:
    """All part names as wordings, in the scope of half the makers; more than fit one list at larger scales."""
    p = read(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("k"))
    words = p.select(F.col("p_name").alias("term_id"), F.lit(0).alias("wording_no"), F.upper("p_name").alias("text"), F.when(F.col("k") % 2 == 0, F.lit("")).otherwise("brazil").alias("maker"))
    makers = read(spark, d, "supplier").join(read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("manual_id"), F.when(F.col("s_suppkey") % 10 == 0, "").otherwise(F.col("n_name")).alias("maker"))
    hits = reports.glossary_hits(manual_lines(spark, d).select("manual_id", "text").join(makers, "manual_id"), words, listed_up_to=50)
    return reports.glossary_totals(hits, words.select("term_id", "maker")).select("manual_id", "term_id", "hits", F.size("wordings").alias("n_wordings"))


def outline_rows(spark: SparkSession, d: str) -> DataFrame:
    b = fixtures.manual_bookmarks(manual_lines(spark, d)).withColumns({"title": F.concat(F.lit("\u0085 "), "title", F.lit("\u0099")), "page_index": F.when(F.col("seq") % 4 > 0, F.col("page_index"))})
    return tables.outline(b)


def rect_pages(spark: SparkSession, d: str) -> DataFrame:
    return tables.image_rects(fixtures.manual_rects(manual_lines(spark, d)), 3, 9).select("manual_id", "page", "rect_no")


def _contents_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines behind a printed table of contents: a name, its number half a point lower in another column, and a dotted sub-entry below."""
    lines = manual_lines(spark, d)
    top = fixtures.manual_bookmarks(lines).filter("level = 0").withColumn("y", F.col("page_index") / 6 * 20.0 + 100)
    cols = "manual_id long, line_no int, page int, top double, x0 double, size double, text string"
    pick = lambda no, top, x0, text: F.struct(no.cast("int").alias("line_no"), top.cast("double").alias("top"), F.lit(x0).alias("x0"), text.alias("text"))
    rows = top.select("manual_id", F.explode(F.array(
        pick(F.col("page_index") * 3 - 900, F.col("y"), 60.0, F.col("title")), pick(F.col("page_index") * 3 - 899, F.col("y") + 0.4, 300.0, (F.col("page_index") + 2).cast("string")),
        pick(F.col("page_index") * 3 - 898, F.col("y") + 8, 60.0, F.concat(F.lit("· Parts of "), "title", F.lit("..... 5 · More ... 7"))),
    )).alias("r")).select("manual_id", "r.line_no", F.lit(0).alias("page"), "r.top", "r.x0", F.lit(9.0).alias("size"), "r.text")
    head = lines.select("manual_id").distinct().select("manual_id", F.lit(-1000).alias("line_no"), F.lit(0).alias("page"), F.lit(40.0).alias("top"), F.lit(60.0).alias("x0"), F.lit(14.0).alias("size"), F.lit("Table of Contents").alias("text"))
    names = [c.split()[0] for c in cols.split(", ")]
    return rows.select(*names).unionByName(head.select(*names)).unionByName(lines.withColumn("page", F.col("page") + 1).select(*names))


def toc_chapters(spark: SparkSession, d: str) -> DataFrame:
    return sections.toc_chapters(_contents_lines(spark, d)).select("manual_id", "label", "page_start", "page_end", "printed_page", F.array_join("evidence", "|").alias("evidence"))


def _indexed_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines behind three pages that list every large line with its page; every fifth name is misprinted."""
    lines = manual_lines(spark, d)
    marks = fixtures.manual_bookmarks(lines).filter("level = 1 and seq < 60")
    name = F.when(F.col("seq") % 5 == 4, F.concat("title", F.lit(" of another kind than any line"))).otherwise(F.col("title"))
    listed = marks.select("manual_id", (F.col("seq") - 1000).alias("line_no"), F.floor(F.col("seq") / 20).cast("int").alias("page"), (F.col("seq") % 20 * 12.0).alias("top"), F.lit(60.0).alias("x0"), F.lit(9.0).alias("size"), F.concat(name, F.lit(" ..... "), (F.col("page_index") + 4).cast("string")).alias("text"))
    return listed.unionByName(lines.withColumn("page", F.col("page") + 3).select("manual_id", "line_no", "page", "top", "x0", "size", "text"))


def index_sections(spark: SparkSession, d: str) -> DataFrame:
    lines = _indexed_lines(spark, d)
    return sections.index_sections(sections.index_entries(lines), lines).select("manual_id", "seq", "title", "page_start", "start_top", "matched")


def fitness_reports(spark: SparkSession, d: str) -> DataFrame:
    lines = manual_lines(spark, d)
    marks = fixtures.manual_bookmarks(lines)
    shares = profiles.anomaly_share(lines.withColumn("chapter", F.floor(F.col("page") / 6).cast("int")))
    out = profiles.fitness(profiles.bookmark_depth(marks), profiles.columns_match(lines, sections.chapter_ranges(marks), 2), shares)
    return out.select("manual_id", "fits", F.size("reasons").alias("n_reasons"))


def profile_search(spark: SparkSession, d: str) -> DataFrame:
    m = read(spark, d, "supplier").select(F.col("s_suppkey").alias("manual_id"), F.when(F.col("s_suppkey") % 7 == 0, "p3").alias("mapped"), F.concat(F.lit("p"), (F.col("s_nationkey") % 4).cast("string")).alias("maker"))
    fits = m.select("manual_id", F.explode(F.array(*[F.lit(f"p{k}") for k in range(4)])).alias("profile_id")).withColumn("fits", (F.col("manual_id") * 7 + F.ascii(F.substring("profile_id", 2, 1))) % 5 == 0)
    return profiles.search(fits, m)


QUERIES = (
    cascade_sections, function_rows, excluded_functions, function_steps, function_counts, spec_totals, spec_requirements, spec_thresholds, function_pages, index_pages, index_table, spec_figures, running_heads, rect_filters, figure_sizes, figure_sizes_by_chapter,
    caption_pick, word_lines, text_cleaning, anomaly_flags, touched_thresholds, overlay_checks, element_changes, figure_elements, duplicate_labels, shared_wordings, license_gate, classifier_answers, label_lookup, glossary_table,
    outline_rows, rect_pages, toc_chapters, index_sections, fitness_reports, profile_search,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql(norm: Callable[[str], str], found: Callable[..., str]) -> dict[str, str]:
    """SQL for these queries; found makes the CTEs of thresholds over a relation."""
    lines = f"lines AS ({fixtures.lines_sql()})"
    marks = f"""
        {lines},
        raw_marks AS (
          SELECT manual_id, text AS title, min(page) AS page_index, min(line_no) AS line_no, 0 AS level FROM lines WHERE regexp_matches(text, '^Area [0-9]+$') GROUP BY ALL
          UNION ALL SELECT manual_id, text, page, line_no, 1 FROM lines WHERE size > 10),
        marks AS (SELECT manual_id, title, page_index, level, CAST(row_number() OVER (PARTITION BY manual_id ORDER BY page_index, line_no, level) - 1 AS INT) AS seq FROM raw_marks)
    """
    step = r"'^\s*(\d{1,2})[.)]\s*([A-Z].*?)\s*$'"
    rects = f"""
        {lines},
        rects AS (
          SELECT manual_id, page, line_no % 30 AS rect_no, CASE WHEN q = 50 THEN -5.0 ELSE x0 END AS x0, top + 2 AS top, CASE WHEN q = 50 THEN -5.0 ELSE x0 END + CASE WHEN line_no % 2 = 0 THEN 11 ELSE 200 END AS x1,
                 top + 2 + CASE WHEN line_no % 2 = 0 THEN 11 ELSE 150 END AS bottom, CASE WHEN q = 49 THEN 1 ELSE 400 END AS nw, CASE WHEN q = 49 THEN 1 ELSE 300 END AS nh
          FROM lines WHERE line_no % 30 % 7 = 0)
    """
    real = "real_rects AS (SELECT * FROM rects WHERE x0 >= 0 AND top >= 0 AND NOT (nw / (x1 - x0) * 72 < 10 AND nh / (bottom - top) * 72 < 10))"
    inside = "(l.page, l.top) > (w.page_start, w.start_top) AND (l.page, l.top) < (w.e_page, w.e_top)"
    mixed = "WHERE level = 0 OR NOT (manual_id % 2 = 0 AND page_index // 6 % 2 = 1)"
    cut_ctes = f"""
        {marks},
        mm AS (SELECT * FROM marks {mixed}),
        pages AS (SELECT manual_id, max(page) + 1 AS n_pages FROM lines GROUP BY ALL),
        ch AS (SELECT manual_id, seq AS chapter_no, title AS chapter, page_index AS c_start, lead(page_index) OVER (PARTITION BY manual_id ORDER BY seq) AS c_end FROM mm WHERE level = 0),
        sub AS (SELECT m.*, c.chapter_no, c.chapter, c.c_end FROM mm m JOIN ch c ON m.manual_id = c.manual_id AND c.chapter_no = (SELECT max(x.chapter_no) FROM ch x WHERE x.manual_id = m.manual_id AND x.chapter_no < m.seq) WHERE m.level = 1),
        win1 AS (SELECT *, {norm('title')} AS norm, greatest(page_index, least(coalesce(lead(page_index) OVER (PARTITION BY manual_id, chapter_no ORDER BY seq), c_end, page_index + 2), page_index + 2)) AS last FROM sub),
        have AS (SELECT manual_id, page, line_no, top, {norm('text')} AS ln FROM lines),
        hit AS (SELECT s.manual_id, s.seq, min(row(CASE WHEN ln = norm THEN 0 ELSE 1 END, line_no, page, top)) AS b FROM win1 s JOIN have h ON s.manual_id = h.manual_id AND h.page BETWEEN page_index AND last AND norm <> '' AND (ln = norm OR length(norm) > 3 AND (contains(ln, norm) OR contains(norm, ln))) GROUP BY ALL),
        heads1 AS (SELECT manual_id, chapter_no, seq, title, chapter AS area, 'bookmarks' AS strategy, coalesce(b[3], page_index) AS page_start, coalesce(b[4], -1.0) AS start_top, c_end FROM win1 LEFT JOIN hit USING (manual_id, seq)),
        bare AS (SELECT * FROM ch c WHERE NOT EXISTS (SELECT 1 FROM sub s WHERE s.manual_id = c.manual_id AND s.chapter_no = c.chapter_no)),
        own AS (SELECT l.*, b.chapter_no, b.chapter, b.c_end, {norm('text')} AS norm FROM lines l JOIN pages USING (manual_id) JOIN bare b ON l.manual_id = b.manual_id AND l.page >= c_start AND l.page < coalesce(c_end, n_pages)),
        noise AS (SELECT manual_id, chapter_no, top, x0, norm FROM own WHERE norm <> '' GROUP BY ALL HAVING count(DISTINCT page) >= 3),
        body AS (SELECT * FROM own o ANTI JOIN noise n ON n.manual_id = o.manual_id AND n.chapter_no = o.chapter_no AND n.top = o.top AND n.x0 = o.x0 AND n.norm = o.norm),
        med AS (SELECT manual_id, chapter_no, median(size) AS b FROM body WHERE size > 0 GROUP BY ALL),
        mk AS (SELECT y.*, size >= b * 1.15 AND regexp_matches(text, '[a-zA-Z]') AND norm <> {norm('chapter')} AS big, row_number() OVER (PARTITION BY manual_id, chapter_no ORDER BY page, top, line_no) AS i FROM body y JOIN med USING (manual_id, chapter_no)),
        isl AS (SELECT *, i - row_number() OVER (PARTITION BY manual_id, chapter_no ORDER BY i) AS island FROM mk WHERE big),
        hd AS (SELECT manual_id, chapter_no, chapter, c_end, island, min(i) AS i, arg_min(page, i) AS page_start, arg_min(top, i) AS start_top, string_agg(trim(text), ' ' ORDER BY i) AS title FROM isl GROUP BY ALL),
        heads AS (
          SELECT * FROM heads1
          UNION ALL SELECT manual_id, chapter_no, row_number() OVER (PARTITION BY manual_id, chapter_no ORDER BY i) - 1, title, chapter, 'font', page_start, start_top, c_end FROM hd),
        win AS (
          SELECT h.*, CAST(chapter_no AS BIGINT) * 1000000 + seq AS section_no, coalesce(lead(page_start) OVER w, c_end, n_pages) AS e_page, coalesce(lead(start_top) OVER w, -1.0) AS e_top
          FROM heads h JOIN pages USING (manual_id) WINDOW w AS (PARTITION BY manual_id, chapter_no ORDER BY seq)),
        sl AS (
          SELECT w.manual_id, section_no, l.line_no, l.page, l.top, l.text FROM win w JOIN lines l ON l.manual_id = w.manual_id AND {inside} WHERE strategy = 'bookmarks'
          UNION ALL SELECT w.manual_id, section_no, l.line_no, l.page, l.top, l.text FROM win w JOIN body l ON l.manual_id = w.manual_id AND l.chapter_no = w.chapter_no AND {inside} WHERE strategy = 'font'),
        secs AS (SELECT manual_id, section_no, count(*) AS n_lines, min(line_no) AS first_line, max(line_no) AS last_line FROM sl GROUP BY ALL),
        real_secs AS (SELECT * FROM win JOIN secs USING (manual_id, section_no))
    """
    by = "(PARTITION BY manual_id, section_no ORDER BY page, top, line_no)"
    step_ctes = f"""
        {cut_ctes.replace(mixed, "")},
        t0 AS (SELECT *, trim(text) AS t, regexp_matches(trim(text), {step}) AS is_step FROM sl),
        t1 AS (SELECT *, CASE WHEN is_step OR regexp_matches(t, '^[●•▪○◦■]') OR NOT coalesce(page = lag(page) OVER w AND top - lag(top) OVER w <= 15, false) THEN 1 ELSE 0 END AS opens FROM t0 WINDOW w AS {by}),
        t2 AS (SELECT *, sum(opens) OVER {by} AS island FROM t1),
        t3 AS (SELECT *, max(is_step) OVER (PARTITION BY manual_id, section_no, island) AS in_step FROM t2),
        raw_steps AS (
          SELECT manual_id, section_no, island, max(CASE WHEN is_step THEN CAST(regexp_extract(t, {step}, 1) AS INT) END) AS number, min(row(page, top)) AS pos,
                 string_agg(CASE WHEN is_step THEN regexp_extract(t, {step}, 2) ELSE t END, ' ' ORDER BY page, top, line_no) AS text
          FROM t3 WHERE in_step GROUP BY ALL),
        s1 AS (SELECT *, CASE WHEN number <= lag(number) OVER w THEN 1 ELSE 0 END AS restart, CAST(row_number() OVER w AS INT) AS step_no FROM raw_steps WINDOW w AS (PARTITION BY manual_id, section_no ORDER BY island)),
        steps AS (SELECT *, CAST(sum(restart) OVER (PARTITION BY manual_id, section_no ORDER BY island) + 1 AS INT) AS sequence FROM s1),
        p1 AS (SELECT *, CASE WHEN NOT coalesce(page = lag(page) OVER w AND top - lag(top) OVER w <= 15, false) THEN 1 ELSE 0 END AS opens2 FROM t3 WHERE NOT in_step WINDOW w AS {by}),
        p2 AS (SELECT *, sum(opens2) OVER {by} AS group_no FROM p1),
        groups AS (SELECT manual_id, section_no, group_no, string_agg(t, ' ' ORDER BY page, top, line_no) AS text, min(row(page, top)) AS pos FROM p2 GROUP BY ALL),
        paras AS (SELECT g.*, (SELECT arg_min(s.number || '. ' || s.text, row(s.pos, s.number || '. ' || s.text)) FROM steps s WHERE s.manual_id = g.manual_id AND s.section_no = g.section_no AND s.pos > g.pos) AS next_step_text, string_split(text, '●') AS raw FROM groups g WHERE length(text) >= 8),
        parts AS (SELECT *, list_filter(list_transform(raw, lambda x: trim(x)), lambda x: x <> '') AS ps, len(raw) > 1 AND trim(raw[1]) = '' AS starts FROM paras),
        items AS (SELECT manual_id, section_no, group_no, pos, next_step_text, unnest(ps) AS item, generate_subscripts(ps, 1) AS k, starts FROM parts),
        long AS (SELECT *, starts OR k > 1 AS is_bullet FROM items WHERE length(item) >= 8),
        r0 AS (SELECT l.*, title AS raw_title, row_number() OVER w AS req_no, max(is_bullet) OVER (PARTITION BY manual_id, section_no ORDER BY group_no, k ROWS UNBOUNDED PRECEDING) AS seen FROM long l JOIN real_secs USING (manual_id, section_no) WINDOW w AS (PARTITION BY manual_id, section_no ORDER BY group_no, k)),
        reqs AS (
          SELECT manual_id, section_no, CAST(req_no AS INT) AS req_no, substr(sha256(concat_ws(chr(31), 'requirement', CAST(manual_id AS VARCHAR), raw_title, substr(item, 1, 120))), 1, 12) AS req_id,
                 CASE WHEN NOT seen THEN 'overview' WHEN regexp_matches(lower(item), 'may not|error|cannot|unavailable|problem|trouble|warning|caution|hazard|malfunction') THEN 'exception'
                      WHEN regexp_matches(lower(item), 'customize|preference') THEN 'user_setting' WHEN regexp_matches(lower(item), 'steering wheel switch|voice command|long press|double-tap') THEN 'hmi' ELSE 'requirements' END AS slot,
                 CASE WHEN regexp_matches(item, '[.!?]$') THEN item ELSE item || '.' END AS text, item AS source_text,
                 CASE WHEN regexp_matches(lower(item), ' means | refers to |is defined as| is a term for') THEN 'define' WHEN regexp_matches(lower(item), ' if | when | unless |cannot| only if ') THEN 'constraint' ELSE 'capability' END AS strength,
                 'p.' || (pos[1] + 1) || CASE WHEN is_bullet THEN ' / bullet' ELSE ' / text' END AS source, next_step_text
          FROM r0)
    """
    count_ctes = f"""
        {step_ctes}, {found('reqs', 'manual_id, section_no, req_no, source, source_text', 'source_text', 'source')},
        counts AS (
          SELECT manual_id, section_no, (SELECT count(*) FROM steps s WHERE s.manual_id = r.manual_id AND s.section_no = r.section_no) AS n_steps, (SELECT count(*) FROM reqs q WHERE q.manual_id = r.manual_id AND q.section_no = r.section_no) AS n_requirements,
                 (SELECT count(*) FROM found f WHERE f.manual_id = r.manual_id AND f.section_no = r.section_no) AS n_thresholds, (SELECT count(*) FROM found f WHERE f.manual_id = r.manual_id AND f.section_no = r.section_no AND status <> 'unfilled') AS n_filled
          FROM real_secs r)
    """
    ready = "n_steps > 0 AND n_thresholds = n_filled"
    clean = r"coalesce(nullif(trim(regexp_replace(title, '^\s*[\d.\-]+\s+', '')), ''), trim(title))"
    kept = f"kept AS (SELECT *, {clean} AS ct FROM real_secs WHERE NOT (contains(lower({clean}), 'blue') OR contains(lower({clean}), 'green')))"
    sizes = """
        w AS (SELECT {by}, x1 - x0 AS v, lead(x1 - x0) OVER w AS nx, row_number() OVER w AS i, count(*) OVER (PARTITION BY {by}) AS n FROM {src} WINDOW w AS (PARTITION BY {by} ORDER BY x1 - x0)),
        h AS (SELECT {by}, bottom - top AS v, lead(bottom - top) OVER w AS nx, row_number() OVER w AS i, count(*) OVER (PARTITION BY {by}) AS n FROM {src} WINDOW w AS (PARTITION BY {by} ORDER BY bottom - top)),
        wt AS (SELECT {by}, max(row(nx - v, i, v)) AS m FROM w WHERE n >= 4 AND nx IS NOT NULL GROUP BY {by}), ht AS (SELECT {by}, max(row(nx - v, i, v)) AS m FROM h WHERE n >= 4 AND nx IS NOT NULL GROUP BY {by}),
        both_ AS (SELECT manual_id, m[3] + m[1] / 2 AS mw, NULL::DOUBLE AS mh FROM wt WHERE m[1] >= 2 UNION ALL SELECT manual_id, NULL, m[3] + m[1] / 2 FROM ht WHERE m[1] >= 2)
    """
    from_both = "SELECT manual_id, min(mw) AS min_width, min(mh) AS min_height FROM both_ GROUP BY ALL"
    title_case = "array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"
    tops = "tops AS (SELECT manual_id, title, page_index, seq FROM marks WHERE level = 0)"
    return {
        "cascade_sections": f"WITH {cut_ctes} SELECT manual_id, section_no, title, area, strategy, n_lines, first_line, last_line FROM real_secs",
        "function_rows": f"""
            WITH {cut_ctes}, {kept},
            pg AS (SELECT manual_id, section_no, page + 1 AS p FROM sl UNION SELECT manual_id, section_no, page_start + 1 FROM kept),
            ps AS (SELECT manual_id, section_no, string_agg(CAST(p AS VARCHAR), ',' ORDER BY p) AS pages FROM pg GROUP BY ALL)
            SELECT manual_id, section_no, CAST(row_number() OVER (PARTITION BY manual_id, chapter_no ORDER BY section_no) AS INT) AS function_no,
                   substr(sha256(concat_ws(chr(31), 'function', CAST(manual_id AS VARCHAR), area, title)), 1, 12) AS function_id, ct AS title, area, area || ' / ' || ct AS function_path, pages
            FROM kept JOIN ps USING (manual_id, section_no)
        """,
        "excluded_functions": f"WITH {cut_ctes}, {kept} SELECT manual_id, section_no, {clean} AS title FROM real_secs r WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.manual_id = r.manual_id AND k.section_no = r.section_no)",
        "function_steps": f"WITH {step_ctes} SELECT manual_id, section_no, step_no, number, sequence, text, 'p.' || (pos[1] + 1) || ' / step' AS source FROM steps",
        "function_counts": f"WITH {count_ctes} SELECT *, {ready} AS test_ready FROM counts",
        "spec_totals": f"""
            WITH {count_ctes} SELECT manual_id, count(*) AS functions, CAST(sum(n_requirements) AS BIGINT) AS requirements, CAST(sum(n_thresholds) AS BIGINT) AS thresholds, CAST(sum(n_filled) AS BIGINT) AS filled,
            CAST(sum(n_thresholds - n_filled) AS BIGINT) AS unfilled, count(*) FILTER ({ready}) AS test_ready FROM counts GROUP BY ALL
        """,
        "spec_requirements": f"WITH {step_ctes} SELECT * FROM reqs",
        "spec_thresholds": f'WITH {count_ctes} SELECT manual_id, section_no, req_no, pattern_id, "at", matching_text, trim(source_text) AS context, unit, value, status FROM found',
        "index_table": f"""
            WITH {count_ctes}, f AS (SELECT r.manual_id, chapter_no, section_no, {clean} AS title, area, row_number() OVER (PARTITION BY r.manual_id, chapter_no ORDER BY section_no) AS no FROM real_secs r)
            SELECT manual_id, chapter_no, CAST(no AS INT) AS function_no, '| ' || no || ' | ' || title || ' | ' || area || ' | ' || n_requirements || ' | 0 | ' || (n_thresholds - n_filled) || ' | ' || CASE WHEN {ready} THEN 'o' ELSE '-' END || ' |' AS line
            FROM f JOIN counts USING (manual_id, section_no)
        """,
        "running_heads": f"WITH {lines} SELECT manual_id, page, string_agg(regexp_replace(trim(text), '\\s+', ' ', 'g'), ' ' ORDER BY line_no) AS citation FROM lines WHERE top < 75 AND trim(text) <> '' GROUP BY ALL",
        "rect_filters": f"WITH {rects} SELECT manual_id, page, rect_no, x0 < 0 OR top < 0 AS bleed, nw / (x1 - x0) * 72 < 10 AND nh / (bottom - top) * 72 < 10 AS fill, x1 - x0 >= 40 AND bottom - top >= 40 AS sized FROM rects",
        "figure_sizes": f"WITH {rects}, {real}, {sizes.format(by='manual_id', src='real_rects')} {from_both}",
        "figure_sizes_by_chapter": f"WITH {rects}, {real}, scoped AS (SELECT *, page // 6 AS c FROM real_rects), {sizes.format(by='manual_id, c', src='scoped')} {from_both}",
        "caption_pick": f"""
            WITH {rects}, {real},
            have AS (SELECT manual_id, page, line_no, trim(text) AS t, top AS lt, x0 AS lx FROM lines WHERE length(trim(text)) > 2),
            c AS (
              SELECT f.manual_id, f.page, rect_no, h.*EXCLUDE (manual_id, page), starts_with(t, 'Using') AS heading, lt < f.top AND f.top - lt >= 8 AS above, abs(lx - f.x0) <= 30 AS narrow, lx BETWEEN f.x0 - 30 AND f.x1 + 30 AS wide, lx BETWEEN f.x0 - 70 AND f.x1 AS near,
                     CASE WHEN lt < f.top THEN f.top - lt WHEN lt > f.bottom THEN lt - f.bottom ELSE 0 END AS gap, abs(lx - f.x0) AS shift
              FROM real_rects f JOIN have h USING (manual_id, page)),
            s AS (SELECT *, wide OR (above AND near) AS same, CASE WHEN heading THEN 0 WHEN narrow OR (above AND near) THEN 1 ELSE 2 END AS tier FROM c),
            o AS (SELECT * FROM s WHERE same OR NOT EXISTS (SELECT 1 FROM s x WHERE x.manual_id = s.manual_id AND x.page = s.page AND x.rect_no = s.rect_no AND x.same)),
            b AS (SELECT manual_id, page, rect_no, min(row(tier, gap)) AS best, arg_min(t, row(tier, gap, shift, line_no)) AS t FROM o GROUP BY ALL),
            j AS (SELECT o.manual_id, o.page, o.rect_no, string_agg(o.t, ' ' ORDER BY lx, line_no) AS joined FROM o JOIN b USING (manual_id, page, rect_no) WHERE row(o.tier, o.gap) = b.best GROUP BY ALL)
            SELECT manual_id, page, rect_no AS figure_no, CASE WHEN best[1] = 0 THEN t ELSE joined END AS caption FROM b JOIN j USING (manual_id, page, rect_no)
        """,
        "word_lines": f"""
            WITH {lines}, w AS (SELECT manual_id, page, line_no, top, x0, size, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) - 1 AS k FROM lines)
            SELECT manual_id, page, string_agg(word, ' ' ORDER BY k) AS text, min(top + k % 3 * 0.9) AS top, min(x0 + k * 10) AS x0, median(size) AS size FROM w WHERE k % 7 <> 6 GROUP BY manual_id, page, line_no
        """,
        "text_cleaning": f"SELECT p_partkey, p_name AS bookmark, 'Press  ' || p_name || ' [icon] now' AS glyphs, ' ' || {title_case} || ' ' || {title_case} AS arrows, {title_case} AS note, p_name AS marker, p_name || 'goes on Next- Line' AS joined FROM part",
        "anomaly_flags": """
            WITH k AS (SELECT unnest(range(0, 11)) AS k), n AS (SELECT p_partkey, CAST(k AS INT) AS k, p_name FROM part, k)
            SELECT p_partkey, k, CASE k WHEN 1 THEN 'too_short' WHEN 2 THEN 'too_short' WHEN 4 THEN 'orphan_lead' WHEN 5 THEN 'orphan_trail' WHEN 6 THEN 'bullet_leftover' WHEN 7 THEN 'replacement_char' WHEN 8 THEN 'pua_glyph'
              WHEN 9 THEN CASE WHEN length(trim(substr(p_name, 1, 3), ' .:,;-')) IN (1, 2) THEN 'too_short' ELSE '' END ELSE '' END AS flags FROM n
        """,
        "touched_thresholds": "SELECT o_orderkey AS threshold_id FROM orders WHERE o_orderkey % 3 > 0 AND o_orderkey % 5 > 0",
        "overlay_checks": """
            SELECT o_orderkey AS threshold_id, o_orderkey % 3 = 0 OR o_orderkey % 5 = 0 OR o_orderkey % 11 = 0 OR (o_orderkey % 7 = 0 AND o_orderkey % 2 <> 0) AS invalid FROM orders
        """,
        "element_changes": """
            WITH l AS (SELECT user_id, event_type, arg_max(event_id, row(ts, event_id)) AS e FROM events GROUP BY ALL)
            SELECT user_id AS figure_id, event_type AS symbol, 'L' || e AS label FROM l WHERE e % 4 <> 0
            UNION ALL SELECT c_custkey, 'purchase', c_name FROM customer WHERE c_custkey <= 100 AND NOT EXISTS (SELECT 1 FROM l WHERE user_id = c_custkey AND event_type = 'purchase')
        """,
        "figure_elements": "SELECT p_size % 4 AS manual_id, p_brand AS figure_id, CAST(count(*) AS INT) AS n, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_type, p_name, CAST(p_partkey AS VARCHAR)) AS notes FROM part GROUP BY ALL",
        "duplicate_labels": f"SELECT p_partkey % 5 AS manual_id, {norm('p_name')} AS norm, count(*) AS count FROM part GROUP BY ALL HAVING count(*) > 1",
        "shared_wordings": """
            WITH d AS (SELECT lower(p_name) AS norm, p_partkey, p_brand FROM part), m AS (SELECT norm, string_agg(p_brand, ',' ORDER BY p_brand) AS makers FROM (SELECT DISTINCT norm, p_brand FROM d) GROUP BY ALL)
            SELECT norm, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) AS terms, any_value(makers) AS makers FROM d JOIN m USING (norm) GROUP BY norm HAVING count(*) > 1
        """,
        "license_gate": "SELECT s_suppkey AS manual_id FROM supplier WHERE s_suppkey % 3 = 0",
        "classifier_answers": """
            WITH c AS (SELECT * FROM lineitem WHERE l_linenumber <= 4), a AS (SELECT l_orderkey, l_linenumber, CASE l_partkey % 3 WHEN 0 THEN l_linestatus WHEN 1 THEN l_returnflag ELSE 'invented' END AS answer, l_partkey % 2 = 0 AS real_ FROM lineitem WHERE l_linenumber <= 4 AND l_orderkey % 5 > 0 OR l_linenumber < 3),
            want AS (SELECT l_orderkey, list_sort(list(DISTINCT l_linenumber)) AS w FROM c GROUP BY ALL), got AS (SELECT l_orderkey, list_sort(list(l_linenumber)) AS g FROM a GROUP BY ALL), ok AS (SELECT l_orderkey FROM want JOIN got USING (l_orderkey) WHERE w = g),
            j AS (SELECT c.l_orderkey, c.l_linenumber, l_returnflag, answer, real_, answer IN (l_returnflag, 'X', l_linestatus) AS fine FROM c JOIN a USING (l_orderkey, l_linenumber) WHERE c.l_orderkey IN (SELECT l_orderkey FROM ok))
            SELECT l_orderkey AS manual_id, l_linenumber AS idx, CASE WHEN fine THEN answer ELSE l_returnflag END AS label, real_ AS is_real_chapter, CASE WHEN NOT fine THEN 'label not in the evidence' END AS reverted FROM j
        """,
        "label_lookup": f"""
            WITH {lines}, pg AS (SELECT DISTINCT manual_id, page FROM lines WHERE text = 'Area 2')
            SELECT manual_id, 'area 2' AS label, min(page) AS page_start, max(page) + 1 AS page_end FROM pg GROUP BY ALL HAVING count(*) >= 3
        """,
        "glossary_table": f"""
            WITH {lines}, low AS MATERIALIZED (SELECT manual_id, lower(text) AS text FROM lines),
            words AS MATERIALIZED (SELECT p_name AS term_id, lower(p_name) AS w, min(p_partkey) % 2 = 0 AS any_maker FROM part GROUP BY ALL),
            makers AS MATERIALIZED (SELECT s_suppkey AS manual_id, CASE WHEN s_suppkey % 10 = 0 THEN '' ELSE n_name END AS maker FROM supplier JOIN nation ON s_nationkey = n_nationkey)
            SELECT manual_id, term_id, CAST(sum((length(text) - length(replace(text, w, ''))) // length(w)) AS BIGINT) AS hits, CAST(1 AS INT) AS n_wordings FROM low JOIN makers USING (manual_id) JOIN words ON contains(text, w) AND (any_maker OR maker = '' OR lower(maker) = 'brazil') GROUP BY ALL
        """,
        "outline_rows": f"WITH {marks} SELECT manual_id, seq, title, level, page_index FROM marks WHERE seq % 4 > 0",
        "rect_pages": f"WITH {rects} SELECT manual_id, page, rect_no FROM rects WHERE page >= 3 AND page < 9",
        "toc_chapters": f"""
            WITH {marks}, {tops}, pages AS (SELECT manual_id, max(page) + 2 AS n_pages FROM lines GROUP BY ALL), n AS (SELECT *, count(*) OVER (PARTITION BY manual_id) AS n, lead(page_index) OVER (PARTITION BY manual_id ORDER BY seq) AS nx FROM tops)
            SELECT manual_id, title AS label, page_index + 1 AS page_start, coalesce(nx + 1, n_pages) AS page_end, page_index + 2 AS printed_page, 'Parts of ' || title || '|More' AS evidence FROM n JOIN pages USING (manual_id) WHERE n >= 3
        """,
        "index_sections": f"""
            WITH {marks},
            listed AS (SELECT manual_id, seq, CASE WHEN seq % 5 = 4 THEN title || ' of another kind than any line' ELSE title END AS name, page_index + 3 AS guess FROM marks WHERE level = 1 AND seq < 60),
            once AS (SELECT manual_id, min(seq) AS seq, arg_min(name, seq) AS name, {norm('name')} AS norm, guess FROM listed GROUP BY manual_id, {norm('name')}, guess),
            enough AS (SELECT *, row_number() OVER (PARTITION BY manual_id ORDER BY seq) AS no FROM once QUALIFY count(*) OVER (PARTITION BY manual_id) >= 5),
            have AS (SELECT manual_id, page + 3 AS page, top, line_no, size, {norm('text')} AS ln FROM lines),
            b AS (SELECT e.manual_id, e.no, min(row(CASE WHEN ln = norm THEN 0 ELSE 1 END, page, top, line_no)) AS b FROM enough e JOIN have h ON e.manual_id = h.manual_id AND page BETWEEN guess AND guess + 2
                  AND (ln = norm OR size >= 9 * 1.15 AND (contains(ln, norm) OR contains(norm, ln)) AND least(length(ln), length(norm)) * 2 >= greatest(length(ln), length(norm))) GROUP BY ALL),
            f AS (SELECT e.*, b FROM enough e LEFT JOIN b USING (manual_id, no) QUALIFY count(b) OVER (PARTITION BY e.manual_id) * 2 >= count(*) OVER (PARTITION BY e.manual_id))
            SELECT manual_id, CAST(row_number() OVER (PARTITION BY manual_id ORDER BY coalesce(b[2], guess), coalesce(b[3], -1.0), no) - 1 AS INT) AS seq, name AS title, coalesce(b[2], guess) AS page_start, coalesce(b[3], -1.0) AS start_top, b IS NOT NULL AS matched FROM f
        """,
        "fitness_reports": f"""
            WITH {marks}, {tops}, pages AS (SELECT manual_id, max(page) + 1 AS n_pages FROM lines GROUP BY ALL), r AS (SELECT *, lead(page_index) OVER (PARTITION BY manual_id ORDER BY seq) AS nx FROM tops),
            depth AS (SELECT manual_id, count(*) >= 3 AS deep FROM tops GROUP BY ALL),
            inside AS (SELECT r.manual_id, r.seq, x0, line_no FROM r JOIN pages USING (manual_id) JOIN lines l ON l.manual_id = r.manual_id AND l.page >= page_index AND l.page < coalesce(nx, n_pages)),
            gaps AS (SELECT manual_id, seq, lead(x0) OVER (PARTITION BY manual_id, seq ORDER BY x0, line_no) - x0 AS g FROM inside),
            bad AS (SELECT DISTINCT manual_id FROM (SELECT manual_id, seq, coalesce(max(g), 0) AS g, count(*) AS n FROM gaps GROUP BY ALL) WHERE n >= 2 AND g < 50),
            flagged AS (SELECT manual_id, page // 6 AS c, avg(CASE WHEN contains(text, '●') THEN 1 ELSE 0 END) AS share FROM lines GROUP BY ALL), worst AS (SELECT manual_id, max(share) AS share FROM flagged GROUP BY ALL),
            n AS (SELECT manual_id, (CASE WHEN deep THEN 0 ELSE 1 END) + (CASE WHEN manual_id IN (SELECT manual_id FROM bad) THEN 1 ELSE 0 END) + (CASE WHEN share > 0.15 THEN 1 ELSE 0 END) AS n FROM depth JOIN worst USING (manual_id))
            SELECT manual_id, n = 0 AS fits, n AS n_reasons FROM n
        """,
        "profile_search": """
            WITH m AS (SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN 'p3' END AS mapped, 'p' || (s_nationkey % 4) AS maker FROM supplier),
            f AS (SELECT m.*, 'p' || k AS p, (s_suppkey * 7 + 48 + k) % 5 = 0 AS fits FROM m, (SELECT unnest(range(0, 4)) AS k)),
            b AS (SELECT s_suppkey, coalesce(any_value(mapped), coalesce(min(p) FILTER (fits AND p = maker), min(p) FILTER (fits))) AS profile_id FROM f GROUP BY ALL)
            SELECT s_suppkey AS manual_id, profile_id, CASE WHEN profile_id IS NULL THEN 'derive' ELSE 'use' END AS resolution FROM b
        """,
    }
