"""Further queries over the derived manuals: bookmarks, contents pages, profiles, labels, reports, change logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.functions.thresholds import detect
from docloom.operators import building, overlay, reports, sections
from docloom.plans.generate import headings
from docloom.sources import fixtures, profiles, tables
from docloom.sources.fixtures import manual_lines, read

KEY = ["manual_id", "section_no"]


def _marks(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.manual_bookmarks(manual_lines(spark, d))


def _steps(spark: SparkSession, d: str) -> DataFrame:
    return building.steps(building.split_lines(manual_lines(spark, d).withColumn("section_no", F.col("page"))))


def _functions(spark: SparkSession, d: str) -> DataFrame:
    """Nested bookmarks as functions, each in the area above it."""
    last = W.partitionBy("manual_id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    area = F.last(F.when(F.col("level") == 0, F.col("title")), True).over(last)
    return _marks(spark, d).withColumn("area", area).filter("level = 1").select("manual_id", F.col("seq").alias("section_no"), F.col("seq").alias("function_no"), "title", "area", F.col("page_index").alias("page"))


def _contents(spark: SparkSession, d: str) -> DataFrame:
    """Nested bookmarks printed as the leader lines of an index."""
    text = F.concat("title", F.lit(" ...... "), (F.col("page_index") + 1).cast("string"))
    return _marks(spark, d).filter("level = 1").select("manual_id", F.col("seq").alias("line_no"), (F.col("seq") / 40).cast("int").alias("page"), (F.col("seq") % 40 * 12.0).alias("top"), F.lit(60.0).alias("x0"), F.lit(9.0).alias("size"), text.alias("text"))


def _chapters(spark: SparkSession, d: str) -> DataFrame:
    return sections.chapter_ranges(_marks(spark, d))


def bookmark_chapters(spark: SparkSession, d: str) -> DataFrame:
    return _chapters(spark, d)


def bookmark_depth(spark: SparkSession, d: str) -> DataFrame:
    return profiles.bookmark_depth(_marks(spark, d))


def chapter_lookup(spark: SparkSession, d: str) -> DataFrame:
    return sections.find_chapter(_marks(spark, d), "AREA - 2")


def heading_match(spark: SparkSession, d: str) -> DataFrame:
    return headings(_marks(spark, d), manual_lines(spark, d)).select("manual_id", "seq", "area", "page_start", "start_top", "matched")


def index_entries(spark: SparkSession, d: str) -> DataFrame:
    return sections.index_entries(_contents(spark, d)).drop("chapter_no")


def toc_subentries(spark: SparkSession, d: str) -> DataFrame:
    return sections.toc_subentries(_contents(spark, d))


def toc_rows(spark: SparkSession, d: str) -> DataFrame:
    marks = _marks(spark, d).filter("level = 1").withColumns({"page": (F.col("seq") / 20).cast("int"), "top": F.col("seq") % 20 * 12.0})
    base = marks.select("manual_id", "page", "top", F.explode(F.array(F.struct(F.lit(60.0).alias("x0"), F.col("title").alias("text"), (F.col("seq") * 2).alias("line_no")), F.struct(F.lit(300.0).alias("x0"), (F.col("page_index") + 1).cast("string").alias("text"), (F.col("seq") * 2 + 1).alias("line_no")))).alias("x"))
    return sections.toc_rows(base.select("manual_id", "page", "top", "x.*"))


def breadcrumb_runs(spark: SparkSession, d: str) -> DataFrame:
    lines = manual_lines(spark, d).filter("line_no % 30 = 1")
    crumbs = lines.select("manual_id", "page", F.array(F.concat(F.lit("Area "), F.floor(F.col("page") / 6).cast("string")), F.concat(F.lit("Group "), F.floor(F.col("page") / 2).cast("string"))).alias("segments"))
    return sections.breadcrumb_sections(crumbs).drop("chapter_no")


def heading_evidence(spark: SparkSession, d: str) -> DataFrame:
    chapters = _chapters(spark, d).filter("page_end is not null").select("manual_id", F.col("title").alias("label"), "page_start", "page_end")
    return sections.heading_evidence(manual_lines(spark, d), chapters)


def column_mismatch(spark: SparkSession, d: str) -> DataFrame:
    return profiles.columns_match(manual_lines(spark, d), _chapters(spark, d), 1)


def anomaly_shares(spark: SparkSession, d: str) -> DataFrame:
    return profiles.anomaly_share(manual_lines(spark, d).withColumn("chapter", F.floor(F.col("page") / 6).cast("int")))


def derived_source(spark: SparkSession, d: str) -> DataFrame:
    lines = manual_lines(spark, d)
    none = lines.select("manual_id").limit(0)
    return profiles.derive_source(profiles.bookmark_depth(_marks(spark, d)), none, sections.running_head_chapters(lines), lines)


def free_profile_ids(spark: SparkSession, d: str) -> DataFrame:
    used = read(spark, d, "supplier").join(read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).filter("s_suppkey % 4 <> 1")
    ids = used.select(F.concat(F.lower("n_name"), F.lit("_v"), (F.col("s_suppkey") % 4 + 1).cast("string")).alias("profile_id"))
    return profiles.next_profile_id(ids, read(spark, d, "nation").select(F.lower("n_name").alias("maker")))


def line_shapes(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return manual_lines(spark, d).select(
        "manual_id", "line_no", T.clean_title(t).alias("title"), T.html_escape(t).alias("escaped"), T.diagram_label(t, 20).alias("label"), T.content_id(F.lit("line"), t).alias("id"),
        T.looks_like_label(t).alias("control"), T.is_running_label(t).alias("running"), T.production_filename(t).alias("production"),
    )


def document_anomalies(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.array_join(T.anomalies(F.coalesce("text", F.lit(""))), ",").alias("flags"))


def function_files(spark: SparkSession, d: str) -> DataFrame:
    df = read(spark, d, "part").select("p_partkey", T.slugify(F.concat_ws(" / ", "p_name", "p_brand", "p_type")).alias("slug"))
    return df.select("p_partkey", "slug", T.function_filename(F.col("p_partkey"), F.col("slug")).alias("file"), T.chapter_name(F.col("slug")).alias("chapter"))


def cover_identity(spark: SparkSession, d: str) -> DataFrame:
    makers = ["France", "Germany", "United States", "Japan", "China"]
    cover = F.concat_ws(" ", F.lit("Manual for"), F.initcap("n_name"), "s_name", F.lit("Owners Manual"), (1990 + F.col("s_suppkey") % 40).cast("string"))
    df = read(spark, d, "supplier").join(read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return df.select("s_suppkey", T.identity(cover, makers).alias("i")).select("s_suppkey", "i.maker", "i.model", "i.year", "i.evidence")


def natural_order(spark: SparkSession, d: str) -> DataFrame:
    names = read(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("notes-"), F.col("c_custkey").cast("string"))).otherwise(F.concat((F.col("c_custkey") % 97).cast("string"), F.lit("-file.md"))).alias("file"))
    k = T.natural_key(F.col("file"))
    return names.select("c_custkey", "file", k["n"].alias("n"))


def procedure_edges(spark: SparkSession, d: str) -> DataFrame:
    return reports.procedure_edges(_steps(spark, d))


def procedure_charts(spark: SparkSession, d: str) -> DataFrame:
    return reports.procedure_chart(_steps(spark, d))


def open_thresholds(spark: SparkSession, d: str) -> DataFrame:
    lines = manual_lines(spark, d).withColumns({"section_no": F.col("page"), "source": F.concat(F.lit("p."), (F.col("page") + 1).cast("string"), F.lit(" / text"))})
    return reports.thresholds_by_function(lines.select(*KEY).distinct(), detect(lines))


def slot_numbers(spark: SparkSession, d: str) -> DataFrame:
    reqs = manual_lines(spark, d).select("manual_id", F.col("page").alias("section_no"), F.col("line_no").alias("req_no"), T.slot(F.col("text")).alias("slot"))
    return reports.by_slot(reqs)


def combined_functions(spark: SparkSession, d: str) -> DataFrame:
    functions = _functions(spark, d).withColumn("chapter_slug", F.coalesce("area", F.lit("")))
    order = _chapters(spark, d).filter("seq % 2 = 0").select("manual_id", F.col("title").alias("chapter_slug"), F.col("seq").alias("rank"))
    return reports.combined(functions, order).select("manual_id", "function_no", "chapter_slug", "label")


def function_tree(spark: SparkSession, d: str) -> DataFrame:
    functions = _functions(spark, d)
    return reports.function_tree(functions, functions.select(*KEY, (F.col("section_no") % 2 == 0).alias("test_ready")))


def chapters_available(spark: SparkSession, d: str) -> DataFrame:
    sources = read(spark, d, "supplier").select(F.col("s_suppkey").alias("manual_id"), F.when(F.col("s_suppkey") % 2 == 0, "bookmarks").otherwise("running_head").alias("section_source"))
    confirmed = _chapters(spark, d).filter("manual_id % 9 = 0").select("manual_id", F.col("title").alias("label"))
    reviews = sources.filter("manual_id % 3 = 0").select("manual_id")
    return reports.available_chapters(sources, _chapters(spark, d), confirmed, sections.running_head_chapters(manual_lines(spark, d)), reviews)


def review_states(spark: SparkSession, d: str) -> DataFrame:
    chapters = _chapters(spark, d)
    return profiles.review_status(chapters, chapters.filter("manual_id % 3 = 0").select("manual_id", F.col("title").alias("label")))


def recurring_labels(spark: SparkSession, d: str) -> DataFrame:
    df = _marks(spark, d).select("manual_id", "seq", F.col("title").alias("label"))
    return reports.label_recurrence(df)


def manual_previews(spark: SparkSession, d: str) -> DataFrame:
    return tables.preview(manual_lines(spark, d))


def log_upsert(spark: SparkSession, d: str) -> DataFrame:
    base = read(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("event_type"), F.col("c_acctbal").cast("double").alias("value"))
    log = read(spark, d, "events").select("user_id", "ts", "event_id", F.when(F.col("event_id") % 3 > 0, F.col("event_type")).alias("event_type"), F.col("value").cast("double").alias("value"))
    return overlay.upsert(base, log, ["user_id"], ["ts", "event_id"])


QUERIES = (
    bookmark_chapters, bookmark_depth, chapter_lookup, heading_match, index_entries, toc_subentries, toc_rows, breadcrumb_runs, heading_evidence, column_mismatch, anomaly_shares, derived_source,
    free_profile_ids, line_shapes, document_anomalies, function_files, cover_identity, natural_order, procedure_edges, procedure_charts, open_thresholds, slot_numbers, combined_functions, function_tree,
    chapters_available, review_states, recurring_labels, manual_previews, log_upsert,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql(norm: Callable[[str], str], steps: str, found: str) -> dict[str, str]:
    """SQL for these queries; steps and found are the CTEs of the catalogue's steps and thresholds."""
    lines = f"lines AS ({fixtures.lines_sql()})"
    marks = f"""
        {lines},
        raw_marks AS (
          SELECT manual_id, text AS title, min(page) AS page_index, min(line_no) AS line_no, 0 AS level FROM lines WHERE regexp_matches(text, '^Area [0-9]+$') GROUP BY ALL
          UNION ALL SELECT manual_id, text, page, line_no, 1 FROM lines WHERE size > 10),
        marks AS (SELECT manual_id, title, page_index, level, CAST(row_number() OVER (PARTITION BY manual_id ORDER BY page_index, line_no, level) - 1 AS INT) AS seq FROM raw_marks)
    """
    top = f"{marks}, tops AS (SELECT *, min(level) OVER (PARTITION BY manual_id) AS least FROM marks), chapters AS (SELECT manual_id, seq, title, page_index AS page_start, lead(page_index) OVER (PARTITION BY manual_id ORDER BY seq) AS page_end FROM tops WHERE level = least)"
    funcs = f"{top}, funcs AS (SELECT * FROM (SELECT *, last_value(CASE WHEN level = 0 THEN title END IGNORE NULLS) OVER (PARTITION BY manual_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS area FROM marks) WHERE level = 1)"
    space = r"[\s\x0b\x{85}\p{Z}]"
    stripped = rf"regexp_replace(regexp_replace(coalesce(text, ''), '^{space}+', ''), '{space}+$', '')"
    running = f"trim(text) <> '' AND NOT regexp_matches(trim(text), '[.!?:;]$') AND length({norm('text')}) <= 30 AND regexp_matches({norm('text')}, '[a-zA-Z]')"
    heads = f"""
        seen AS (SELECT DISTINCT manual_id, {norm('text')} AS label, page FROM lines WHERE {running}),
        runs AS (SELECT *, page - row_number() OVER (PARTITION BY manual_id, label ORDER BY page) AS isl FROM seen),
        heads AS (SELECT manual_id, label, min(page) AS page_start, max(page) + 1 AS page_end FROM runs GROUP BY manual_id, label, isl HAVING count(*) >= 3)
    """
    flags = " || ".join(f"CASE WHEN regexp_matches(t, '{p}') THEN '{name},' ELSE '' END" for name, p in (
        ("replacement_char", r"\x{FFFD}"), ("pua_glyph", r"[\x{e000}-\x{f8ff}]"), ("orphan_lead", r"^[>\]\)\}»”’]"), ("orphan_trail", r"[<\[\(\{«“‘]$"), ("bullet_leftover", "[●•▪○◦]")))
    flagged = f"rtrim({flags} || CASE WHEN length(trim(t, ' .:,;-')) IN (1, 2) THEN 'too_short,' ELSE '' END, ',')"
    slots = " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + f" THEN '{name}'" for name, words in T.SLOT_RULES)
    order = ", ".join(f"'{s}'" for s in T.SLOT_ORDER)
    makers = "CASE " + " ".join(f"WHEN contains(lower(cover), '{m.lower()}') THEN '{m}'" for m in ("France", "Germany", "United States", "Japan", "China")) + " END"
    title_case = "array_to_string(list_transform(string_split(lower({c}), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"
    slug = "trim(regexp_replace(lower(p_name || ' / ' || p_brand || ' / ' || p_type), '[^a-z0-9]+', '-', 'g'), '-')"
    spaced = "replace(slug, '-', ' ')"
    cut_title = r"regexp_replace(text, '^\s*[\d.\-]+\s+', '')"
    label = "replace(replace(text, '\"', ''''), chr(10), ' ')"
    return {
        "bookmark_chapters": f"WITH {top} SELECT * FROM chapters",
        "bookmark_depth": f"""
            WITH {top}, k AS (SELECT manual_id, count(*) AS n_top, count(*) FILTER (regexp_matches(replace(title, ' ', ''), '^[0-9A-Z_]+$')) AS m FROM tops WHERE level = least GROUP BY ALL)
            SELECT manual_id, n_top, n_top >= 3 AND m * 2 <= n_top AS chapter_shaped FROM k
        """,
        "chapter_lookup": f"WITH {top} SELECT * FROM chapters WHERE starts_with({norm('title')}, 'area 2') QUALIFY row_number() OVER (PARTITION BY manual_id ORDER BY seq) = 1",
        "heading_match": f"""
            WITH {funcs},
            sub AS (SELECT manual_id, seq, title, area, page_index, {norm('title')} AS norm, greatest(page_index, least(coalesce(lead(page_index) OVER (PARTITION BY manual_id, area ORDER BY seq), (SELECT min(c.page_start) FROM chapters c WHERE c.manual_id = funcs.manual_id AND c.seq > funcs.seq), page_index + 2), page_index + 2)) AS last FROM funcs),
            have AS (SELECT manual_id, page, line_no, top, {norm('text')} AS ln FROM lines),
            hit AS (
              SELECT s.manual_id, s.seq, min(row(CASE WHEN ln = norm THEN 0 ELSE 1 END, line_no, page, top)) AS b
              FROM sub s JOIN have h ON s.manual_id = h.manual_id AND h.page BETWEEN page_index AND last AND norm <> '' AND (ln = norm OR length(norm) > 3 AND (contains(ln, norm) OR contains(norm, ln))) GROUP BY ALL)
            SELECT manual_id, seq, area, coalesce(b[3], page_index) AS page_start, coalesce(b[4], -1.0) AS start_top, b IS NOT NULL AS matched FROM sub LEFT JOIN hit USING (manual_id, seq)
        """,
        "index_entries": f"""
            WITH {marks},
            printed AS (SELECT manual_id, seq, title, page_index + 1 AS p, seq // 40 AS page FROM marks WHERE level = 1),
            near AS (SELECT * FROM printed QUALIFY page < min(page) OVER (PARTITION BY manual_id) + 3),
            once AS (SELECT manual_id, arg_min(title, seq) AS name, min(seq) AS seq, p FROM near WHERE length(title) <= 80 AND regexp_matches(title, '[a-zA-Z]') GROUP BY manual_id, {norm('title')}, p),
            enough AS (SELECT * FROM once QUALIFY count(*) OVER (PARTITION BY manual_id) >= 5)
            SELECT manual_id, CAST(row_number() OVER (PARTITION BY manual_id ORDER BY seq) - 1 AS INT) AS entry_no, name, p AS printed_page FROM enough
        """,
        "toc_subentries": f"WITH {marks} SELECT manual_id, seq AS line_no, 0 AS entry_no, title AS name, page_index + 1 AS number FROM marks WHERE level = 1",
        "toc_rows": f"WITH {marks} SELECT manual_id, seq // 20 AS page, dense_rank() OVER (PARTITION BY manual_id, seq // 20 ORDER BY seq) AS row_no, title AS name, page_index + 1 AS number FROM marks WHERE level = 1",
        "breadcrumb_runs": f"""
            WITH {lines}, pages AS (SELECT DISTINCT manual_id, page, page // 6 AS a, page // 2 AS g FROM lines WHERE line_no % 30 = 1),
            islands AS (SELECT *, page - row_number() OVER (PARTITION BY manual_id, a, g ORDER BY page) AS isl FROM pages),
            runs AS (SELECT manual_id, 'Group ' || g AS title, 'Area ' || a AS area, min(page) AS page_start, max(page) + 1 AS page_end FROM islands GROUP BY manual_id, a, g, isl),
            enough AS (SELECT * FROM runs QUALIFY count(*) OVER (PARTITION BY manual_id) >= 3)
            SELECT manual_id, CAST(row_number() OVER (PARTITION BY manual_id ORDER BY page_start, page_end) - 1 AS INT) AS seq, title, area, page_start, page_end FROM enough
        """,
        "heading_evidence": f"""
            WITH {top}, med AS (SELECT manual_id, median(size) AS body FROM lines WHERE size > 0 GROUP BY ALL),
            big AS (SELECT manual_id, page, line_no, trim(text) AS text, {norm('text')} AS norm FROM lines JOIN med USING (manual_id) WHERE size >= body * 1.15 AND {running}),
            got AS (SELECT c.manual_id, c.title AS label, c.page_start, norm, min(line_no) AS line_no, arg_min(text, line_no) AS text FROM chapters c JOIN big b ON c.manual_id = b.manual_id AND page BETWEEN page_start AND greatest(page_start, page_end - 1) WHERE page_end IS NOT NULL AND norm <> {norm('c.title')} GROUP BY ALL)
            SELECT manual_id, label, page_start, CAST(row_number() OVER (PARTITION BY manual_id, label, page_start ORDER BY line_no) AS INT) AS rank, text FROM got QUALIFY rank <= 8
        """,
        "column_mismatch": f"""
            WITH {top}, last AS (SELECT manual_id, max(page) + 1 AS open_end FROM lines GROUP BY ALL),
            inside AS (SELECT l.manual_id, c.seq, c.title, l.x0, l.line_no FROM chapters c JOIN last USING (manual_id) JOIN lines l ON l.manual_id = c.manual_id AND l.page >= c.page_start AND l.page < coalesce(c.page_end, open_end)),
            gaps AS (SELECT manual_id, seq, title, lead(x0) OVER (PARTITION BY manual_id, seq ORDER BY x0, line_no) - x0 AS gap FROM inside),
            wide AS (SELECT manual_id, seq, title, max(gap) AS gap, count(*) AS n FROM gaps GROUP BY ALL)
            SELECT manual_id, seq, title, 2 AS columns FROM wide WHERE n >= 2 AND gap >= 50
        """,
        "anomaly_shares": f"""
            WITH {lines}, t AS (SELECT manual_id, CAST(page // 6 AS INT) AS chapter, {stripped} AS t FROM lines),
            per AS (SELECT manual_id, chapter, avg(CASE WHEN {flagged} <> '' THEN 1 ELSE 0 END) AS share FROM t GROUP BY ALL)
            SELECT manual_id, arg_max(chapter, row(share, -chapter)) AS chapter, max(share) AS share FROM per GROUP BY ALL
        """,
        "derived_source": f"""
            WITH {top}, {heads},
            d AS (SELECT manual_id, count(*) >= 3 AND count(*) FILTER (regexp_matches(replace(title, ' ', ''), '^[0-9A-Z_]+$')) * 2 <= count(*) AS shaped FROM tops WHERE level = least GROUP BY ALL),
            c AS (SELECT manual_id, sum(page_end - page_start) AS covered FROM heads GROUP BY ALL),
            p AS (SELECT manual_id, count(DISTINCT page) AS n FROM lines GROUP BY ALL)
            SELECT manual_id, CASE WHEN shaped THEN 'bookmarks' WHEN coalesce(covered, 0) >= n * 0.3 THEN 'running_head' ELSE 'undetermined' END AS section_source FROM p LEFT JOIN d USING (manual_id) LEFT JOIN c USING (manual_id)
        """,
        "free_profile_ids": """
            WITH used AS (SELECT DISTINCT lower(n_name) AS maker, s_suppkey % 4 + 1 AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 4 <> 1),
            free AS (SELECT lower(n_name) AS maker, k FROM nation, (SELECT unnest(range(1, 6)) AS k) ANTI JOIN used ON lower(n_name) = used.maker AND k = used.n)
            SELECT maker, maker || '_v' || CAST(min(k) AS VARCHAR) AS profile_id FROM free GROUP BY maker
        """,
        "line_shapes": f"""
            WITH {lines}
            SELECT manual_id, line_no, coalesce(nullif(trim({cut_title}), ''), trim(text)) AS title, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped,
                   CASE WHEN length(text) > 20 THEN substr({label}, 1, 19) || '…' ELSE {label} END AS label, substr(sha256('line' || chr(31) || text), 1, 12) AS id,
                   NOT regexp_matches(text, '^P\\.?\\s*[0-9]') AND regexp_matches(text, '[A-Za-z]') AND len(list_filter(regexp_extract_all(text, '[A-Za-z]+'), lambda w: NOT regexp_matches(w, '^[A-Z]'))) = 0 AS control,
                   {running} AS running, regexp_matches(text, '(?i)\\.(?:book|fm|mif|indd|docx?|framemaker)\\b') AS production
            FROM lines
        """,
        "document_anomalies": f"SELECT doc_id, {flagged} AS flags FROM (SELECT doc_id, {stripped} AS t FROM documents)",
        "function_files": f"SELECT p_partkey, slug, p_partkey || '-' || rtrim(substr(slug, 1, 80), '-') || '.md' AS file, {title_case.format(c=spaced)} AS chapter FROM (SELECT p_partkey, {slug} AS slug FROM part)",
        "cover_identity": f"""
            WITH c AS (SELECT s_suppkey, 'Manual for ' || {title_case.format(c='n_name')} || ' ' || s_name || ' Owners Manual ' || (1990 + s_suppkey % 40) AS cover, regexp_extract(s_name, '^[A-Za-z0-9][A-Za-z0-9_-]*') AS model FROM supplier JOIN nation ON s_nationkey = n_nationkey)
            SELECT s_suppkey, {makers} AS maker, CASE WHEN {makers} IS NOT NULL THEN model END AS model, CAST(1990 + s_suppkey % 40 AS VARCHAR) AS year, substr(cover, 1, 200) AS evidence FROM c
        """,
        "natural_order": "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'notes-' || c_custkey ELSE (c_custkey % 97) || '-file.md' END AS file, CASE WHEN c_custkey % 5 = 0 THEN 1000000000 ELSE c_custkey % 97 END AS n FROM customer",
        "procedure_edges": f"WITH {lines}, {steps} SELECT * FROM (SELECT manual_id, section_no, sequence, step_no AS from_step, lead(step_no) OVER (PARTITION BY manual_id, section_no, sequence ORDER BY step_no) AS to_step FROM steps) WHERE to_step IS NOT NULL",
        "procedure_charts": f"""
            WITH {lines}, {steps},
            d AS (SELECT *, 'S' || sequence || '_' || number AS node, '    S' || sequence || '_' || number || '["' || (CASE WHEN length(number || '. ' || {label}) > 60 THEN substr(number || '. ' || {label}, 1, 59) || '…' ELSE number || '. ' || {label} END) || '"]' AS box FROM steps),
            a AS (SELECT *, '    ' || lag(node) OVER (PARTITION BY manual_id, section_no, sequence ORDER BY step_no) || ' --> ' || node AS arrow FROM d),
            p AS (SELECT manual_id, section_no, sequence, concat_ws(chr(10), '    subgraph SEQ' || sequence || '["Sequence ' || sequence || '"]', '    direction TB', string_agg(box, chr(10) ORDER BY step_no), string_agg(arrow, chr(10) ORDER BY step_no), '    end') AS part FROM a GROUP BY manual_id, section_no, sequence)
            SELECT manual_id, section_no, 'flowchart TD' || chr(10) || string_agg(part, chr(10) ORDER BY sequence) AS chart FROM p GROUP BY manual_id, section_no
        """,
        "open_thresholds": f"WITH {found} SELECT manual_id, CAST(line_no // 30 AS INT) AS section_no, count(*) AS n_thresholds, count(*) FILTER (status = 'unfilled') AS n_unfilled FROM found GROUP BY ALL",
        "slot_numbers": f"""
            WITH {lines}, r AS (SELECT manual_id, page AS section_no, line_no AS req_no, CASE {slots} ELSE 'requirements' END AS slot FROM lines)
            SELECT *, CAST(list_position([{order}], slot) AS INT) AS slot_no, CAST(row_number() OVER (PARTITION BY manual_id, section_no, slot ORDER BY req_no) AS INT) AS number FROM r
        """,
        "combined_functions": f"""
            WITH {funcs}, o AS (SELECT f.manual_id, f.seq AS function_no, coalesce(area, '') AS chapter_slug, coalesce(c.seq, 1 << 30) AS r FROM funcs f LEFT JOIN chapters c ON f.manual_id = c.manual_id AND f.area = c.title AND c.seq % 2 = 0)
            SELECT manual_id, function_no, chapter_slug, dense_rank() OVER (PARTITION BY manual_id ORDER BY r, chapter_slug) || '.' || row_number() OVER (PARTITION BY manual_id, chapter_slug ORDER BY function_no) AS label FROM o
        """,
        "function_tree": f"""
            WITH {funcs}, f AS (SELECT manual_id, coalesce(nullif(trim(area), ''), 'General') AS area, seq, title FROM funcs), g AS (SELECT *, min(seq) OVER (PARTITION BY manual_id, area) AS first FROM f)
            SELECT manual_id, CAST(dense_rank() OVER (PARTITION BY manual_id ORDER BY first) AS INT) AS area_no, area, seq AS function_no, title, seq % 2 <> 0 AS warn FROM g
        """,
        "chapters_available": f"""
            WITH {top}, {heads}
            SELECT c.manual_id, 'bookmarks' AS section_source, title AS label FROM chapters c JOIN supplier ON s_suppkey = manual_id WHERE manual_id % 2 = 0
            UNION ALL SELECT c.manual_id, 'allowlist', title FROM chapters c JOIN supplier ON s_suppkey = manual_id WHERE manual_id % 2 <> 0 AND manual_id % 9 = 0
            UNION ALL SELECT h.manual_id, 'running_head', label FROM heads h JOIN supplier ON s_suppkey = manual_id WHERE manual_id % 2 <> 0 AND manual_id % 3 <> 0
        """,
        "review_states": f"WITH {top}, n AS (SELECT manual_id, count(*) AS n FROM chapters GROUP BY ALL) SELECT manual_id, manual_id % 3 = 0 AS reviewed, CASE WHEN manual_id % 3 = 0 THEN n ELSE 0 END AS n_confirmed, CASE WHEN manual_id % 3 = 0 THEN 'ready' ELSE 'needs_review' END AS state FROM n",
        "recurring_labels": f"WITH {marks} SELECT manual_id, seq, title AS label, count(*) OVER (PARTITION BY manual_id, title) AS recurs FROM marks",
        "manual_previews": f"WITH {lines} SELECT manual_id, max(page) + 1 AS n_pages, string_agg(text, chr(10) ORDER BY line_no) FILTER (page = 0) AS cover FROM lines GROUP BY ALL",
        "log_upsert": """
            WITH l AS (SELECT user_id, arg_max(row(CASE WHEN event_id % 3 > 0 THEN event_type END, CAST(value AS DOUBLE)), row(ts, event_id)) AS r FROM events GROUP BY ALL)
            SELECT coalesce(c_custkey, user_id) AS user_id, coalesce(r[1], c_mktsegment) AS event_type, coalesce(r[2], CAST(c_acctbal AS DOUBLE)) AS value FROM customer FULL JOIN l ON c_custkey = user_id
        """,
    }
