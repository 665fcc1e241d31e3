"""The catalogue of queries over the derived manuals, each with an independent SQL oracle where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.functions.thresholds import PATTERNS, detect
from docloom.operators import building, figures, layout, overlay, reports, sections
from docloom.plans import inventory, spec
from docloom.sources import fixtures
from docloom.sources.fixtures import manual_lines, read

HEADER, FOOTER = 75.0, 400.0


def _thresholds(spark: SparkSession, d: str) -> DataFrame:
    return detect(manual_lines(spark, d).withColumn("source", F.concat(F.lit("p."), (F.col("page") + 1).cast("string"), F.lit(" / text"))))


def threshold_scan(spark: SparkSession, d: str) -> DataFrame:
    return _thresholds(spark, d).groupBy("pattern_id", "kind", "status", "unit").agg(F.count("*").alias("n"))


def threshold_rows(spark: SparkSession, d: str) -> DataFrame:
    return _thresholds(spark, d).select("manual_id", "line_no", "threshold_id", "pattern_id", "at", "matching_text", "unit", "value", "status")


def furniture_filter(spark: SparkSession, d: str) -> DataFrame:
    return layout.furniture(manual_lines(spark, d), HEADER, FOOTER).select("manual_id", "line_no")


def running_head_chapters(spark: SparkSession, d: str) -> DataFrame:
    return sections.running_head_chapters(manual_lines(spark, d))


def margin_glyphs(spark: SparkSession, d: str) -> DataFrame:
    return layout.margin_glyph_keys(manual_lines(spark, d))


def column_boundary(spark: SparkSession, d: str) -> DataFrame:
    return layout.column_boundaries(manual_lines(spark, d))


def column_order(spark: SparkSession, d: str) -> DataFrame:
    return layout.order_by_columns(manual_lines(spark, d), 2).select("manual_id", "line_no", "read_top")


def header_footer_bands(spark: SparkSession, d: str) -> DataFrame:
    return layout.header_footer(manual_lines(spark, d))


def font_headings(spark: SparkSession, d: str) -> DataFrame:
    return sections.font_headings(manual_lines(spark, d)).select("manual_id", "seq", "title", "page_start", "start_top")


def _page_sections(spark: SparkSession, d: str) -> DataFrame:
    return manual_lines(spark, d).withColumn("section_no", F.col("page"))


def step_sequences(spark: SparkSession, d: str) -> DataFrame:
    return building.steps(building.split_lines(_page_sections(spark, d))).select("manual_id", "section_no", "step_no", "number", "sequence", "text", "top")


def paragraph_groups(spark: SparkSession, d: str) -> DataFrame:
    return building.paragraphs(building.split_lines(_page_sections(spark, d)))


def next_step(spark: SparkSession, d: str) -> DataFrame:
    split = building.split_lines(_page_sections(spark, d))
    return building.next_steps(building.paragraphs(split), building.steps(split)).select("manual_id", "section_no", "group_no", "next_step_text")


def bullet_items(spark: SparkSession, d: str) -> DataFrame:
    lines = manual_lines(spark, d).filter(F.col("text").rlike(f"[{T.BULLETS}]"))
    return lines.select("manual_id", "line_no", F.posexplode(building.split_bullets(F.col("text"))).alias("item_no", "x")).select("manual_id", "line_no", "item_no", "x.item", "x.is_bullet")


def section_cut(spark: SparkSession, d: str) -> DataFrame:
    lines = layout.drop_margin_glyphs(manual_lines(spark, d))
    heads = sections.font_headings(lines)
    return sections.cut_sections(heads, lines).groupBy("manual_id", "section_no").agg(F.count("*").alias("n_lines"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"))


def strength_mix(spark: SparkSession, d: str) -> DataFrame:
    return manual_lines(spark, d).groupBy(T.strength(F.col("text")).alias("strength"), T.slot(F.col("text")).alias("slot")).agg(F.count("*").alias("n"))


def overlay_latest(spark: SparkSession, d: str) -> DataFrame:
    return overlay.latest(read(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


def _overlay(found: DataFrame) -> DataFrame:
    third = found.filter("line_no % 3 = 0").groupBy("manual_id", "threshold_id").agg(F.max("q").cast("string").alias("value"))
    ghosts = found.filter("line_no % 50 = 0").select("manual_id", F.concat(F.lit("ghost"), F.col("line_no").cast("string")).alias("threshold_id"), F.lit("1").alias("value")).distinct()
    return third.unionByName(ghosts).withColumns({"status": F.lit("measured"), "evidence": F.lit("bench"), "filled_by": F.lit("qa")})


def overlay_merge(spark: SparkSession, d: str) -> DataFrame:
    found = _thresholds(spark, d).withColumn("filled_by", F.lit(None).cast("string"))
    return overlay.merge(found, _overlay(found)).groupBy("status", "applied").agg(F.count("*").alias("n"), F.count("filled_by").alias("n_filled"))


def overlay_orphans(spark: SparkSession, d: str) -> DataFrame:
    found = _thresholds(spark, d)
    return overlay.orphans(_overlay(found), found).select("manual_id", "threshold_id")


def _terms(spark: SparkSession, d: str) -> DataFrame:
    names = read(spark, d, "part").groupBy("p_name").count().orderBy(F.desc("count"), "p_name").limit(10)
    return names.select(F.col("p_name").alias("term_id"), F.lit(0).alias("wording_no"), F.upper("p_name").alias("text"), F.when(F.length("p_name") % 2 == 0, F.lit("")).otherwise("BRAZIL").alias("maker"))


def _sources(spark: SparkSession, d: str) -> DataFrame:
    s, n = read(spark, d, "supplier"), read(spark, d, "nation")
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("manual_id"), F.col("n_name").alias("maker"), F.when(F.col("s_suppkey") % 3 == 0, "internal_use_permitted").when(F.col("s_suppkey") % 3 == 1, "unknown").alias("license_state")
    )


def glossary_hits(spark: SparkSession, d: str) -> DataFrame:
    texts = manual_lines(spark, d).join(_sources(spark, d).select("manual_id", "maker"), "manual_id")
    return reports.glossary_hits(texts, _terms(spark, d)).groupBy("term_id").agg(F.sum("n").alias("hits"), F.count("*").alias("manuals"))


def wording_collisions(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    words = p.select(F.col("p_partkey").cast("string").alias("term_id"), F.col("p_name").alias("text"), F.when(F.col("p_size") % 3 == 0, F.lit("")).otherwise(F.col("p_brand")).alias("maker"))
    return overlay.wording_collisions(words)


def stale_keys(spark: SparkSession, d: str) -> DataFrame:
    keys = read(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("key"))
    return overlay.stale(read(spark, d, "customer").select(F.col("c_custkey").alias("key")), keys, ["key"])


def rollup_by_maker(spark: SparkSession, d: str) -> DataFrame:
    return reports.by_maker(_sources(spark, d)).select("maker", "n_manuals", "n_viewable", "n_blocked")


def normalise_documents(spark: SparkSession, d: str) -> DataFrame:
    n = T.normalise(F.col("text"))
    return read(spark, d, "documents").select("doc_id", F.length(n).alias("n_normal"), T.content_id(n).alias("norm_id"))


def repeated_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).filter("line <> ''")
    return lines.groupBy("line").agg(F.countDistinct("doc_id").alias("n_docs")).filter("n_docs >= 3")


def rect_merge(spark: SparkSession, d: str) -> DataFrame:
    return figures.merge_rects(figures.content_rects(fixtures.manual_rects(manual_lines(spark, d))))


def figure_captions(spark: SparkSession, d: str) -> DataFrame:
    lines = manual_lines(spark, d)
    return figures.captions(figures.merge_rects(figures.content_rects(fixtures.manual_rects(lines))), lines, ("Using",))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            threshold_scan, threshold_rows, furniture_filter, running_head_chapters, margin_glyphs, column_boundary, column_order, header_footer_bands, font_headings, step_sequences,
            paragraph_groups, next_step, bullet_items, section_cut, strength_mix, overlay_latest, overlay_merge, overlay_orphans, glossary_hits, wording_collisions, stale_keys, rollup_by_maker,
            normalise_documents, repeated_lines, rect_merge, figure_captions,
        )
    } | inventory.queries() | spec.queries()


def _norm(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace(lower({c}), '[-‐‑‒–—―]+', ' ', 'g'), '[^\\pL\\pM\\pN_\\s]', '', 'g'), '\\s+', ' ', 'g'))"


def _threshold_ctes() -> str:
    return f"lines AS ({fixtures.lines_sql()}), {_found_ctes('lines', 'manual_id, line_no, page, q, text', 'text', "'p.' || CAST(page + 1 AS VARCHAR) || ' / text'")}"


def _found_ctes(relation: str, keep: str, text: str, source: str) -> str:
    """found: the thresholds of a relation's texts, with the columns to keep."""
    unit = r"(?:seconds?|sec\.?|minutes?|min\.?|hours?|hrs?|miles?|mi\.?|km|kilometers?|feet|ft\.?|meters?|m\b|%|percent)"
    number, paren = rf"(\d+(?:\.\d+)?)\s*({unit})", rf"\(\s*(\d+(?:\.\d+)?)\s*({unit})\s*\)"
    parts = " UNION ALL ".join(
        f"SELECT {keep}, '{name}' AS pattern_id, '{kind}' AS kind, {f"'{hint}'" if hint else 'NULL::VARCHAR'} AS hint, unnest(regexp_extract_all({text}, '(?i){pattern}', 0)) AS matching_text FROM {relation}"
        for name, kind, hint, pattern in PATTERNS
    )
    return f"""
        hits AS ({parts}),
        placed AS (SELECT h.*, CAST(strpos(CASE WHEN k = 1 THEN {text} ELSE {text} END, matching_text) - 1 AS INT) AS first_at, k FROM (SELECT *, row_number() OVER (PARTITION BY {keep}, pattern_id, matching_text) AS k FROM hits) h),
        spots AS (SELECT *, CASE WHEN k = 1 THEN first_at ELSE CAST(length(list_reduce(list_slice(string_split({text}, matching_text), 1, k), lambda a, b: a || matching_text || b)) AS INT) END AS "at" FROM placed),
        near_text AS (SELECT *, trim(substr({text}, greatest("at" - 60, 0) + 1, least("at" + length(matching_text) + 60, length({text})) - greatest("at" - 60, 0))) AS w FROM spots),
        num AS (SELECT *, regexp_matches(w, '(?i){number}') AS near, kind = 'quantity' AND regexp_matches({text}, '(?i){paren}') AS far FROM near_text),
        vals AS (
          SELECT *, CASE WHEN near THEN regexp_extract(w, '(?i){number}', 1) WHEN far THEN regexp_extract({text}, '(?i){paren}', 1) END AS v,
                 CASE WHEN near THEN regexp_extract(w, '(?i){number}', 2) WHEN far THEN regexp_extract({text}, '(?i){paren}', 2) END AS u FROM num),
        found AS (
          SELECT {keep}, pattern_id, kind, "at", matching_text,
                 substr(sha256(concat_ws(chr(31), 'threshold', {source}, matching_text, CAST("at" AS VARCHAR))), 1, 12) AS threshold_id,
                 CASE WHEN v IS NOT NULL AND kind <> 'quantity' THEN u WHEN v IS NOT NULL THEN hint
                      WHEN pattern_id = 'vague_few_duration' THEN regexp_extract(matching_text, '(?i)(seconds?|sec\\.?|minutes?|min\\.?|hours?|hrs?)$', 1) ELSE hint END AS unit,
                 CASE WHEN v IS NOT NULL AND kind = 'quantity' THEN v || ' ' || u ELSE v END AS value,
                 CASE WHEN v IS NOT NULL THEN 'from_manual' ELSE 'unfilled' END AS status
          FROM vals)
    """


def _step_ctes() -> str:
    step = r"'^\s*(\d{1,2})[.)]\s*([A-Z].*?)\s*$'"
    return f"""
        t0 AS (SELECT *, page AS section_no, trim(text) AS t, regexp_matches(trim(text), {step}) AS is_step FROM lines),
        t1 AS (SELECT *, CASE WHEN is_step OR regexp_matches(t, '^[●•▪○◦■]') OR NOT coalesce(top - lag(top) OVER w <= 15, false) THEN 1 ELSE 0 END AS opens FROM t0 WINDOW w AS (PARTITION BY manual_id, page ORDER BY top, line_no)),
        t2 AS (SELECT *, sum(opens) OVER (PARTITION BY manual_id, page ORDER BY top, line_no) AS island FROM t1),
        t3 AS (SELECT *, max(is_step) OVER (PARTITION BY manual_id, page, island) AS in_step FROM t2),
        raw_steps AS (
          SELECT manual_id, section_no, island, max(CASE WHEN is_step THEN CAST(regexp_extract(t, {step}, 1) AS INT) END) AS number, min(top) AS top,
                 string_agg(CASE WHEN is_step THEN regexp_extract(t, {step}, 2) ELSE t END, ' ' ORDER BY top, line_no) AS text
          FROM t3 WHERE in_step GROUP BY ALL),
        s1 AS (SELECT *, CASE WHEN number <= lag(number) OVER w THEN 1 ELSE 0 END AS restart, CAST(row_number() OVER w AS INT) AS step_no FROM raw_steps WINDOW w AS (PARTITION BY manual_id, section_no ORDER BY island)),
        steps AS (SELECT manual_id, section_no, step_no, number, CAST(sum(restart) OVER (PARTITION BY manual_id, section_no ORDER BY island) + 1 AS INT) AS sequence, text, top FROM s1),
        p1 AS (SELECT *, CASE WHEN NOT coalesce(top - lag(top) OVER (PARTITION BY manual_id, page ORDER BY top, line_no) <= 15, false) THEN 1 ELSE 0 END AS opens2 FROM t3 WHERE NOT in_step),
        p2 AS (SELECT *, CAST(sum(opens2) OVER (PARTITION BY manual_id, page ORDER BY top, line_no) AS INT) AS group_no FROM p1),
        groups AS (SELECT manual_id, section_no, group_no, string_agg(t, ' ' ORDER BY top, line_no) AS text, min(page) AS page, min(top) AS top FROM p2 GROUP BY ALL)
    """


def oracle_sql() -> dict[str, str]:
    lines = f"lines AS ({fixtures.lines_sql()})"
    found = _threshold_ctes()
    overlay_cte = """
        over AS (
          SELECT manual_id, threshold_id, CAST(max(q) AS VARCHAR) AS value FROM found WHERE line_no % 3 = 0 GROUP BY ALL
          UNION ALL SELECT DISTINCT manual_id, 'ghost' || CAST(line_no AS VARCHAR), '1' FROM found WHERE line_no % 50 = 0)
    """
    split = _step_ctes()
    glyphs = f"""
        keyed AS (SELECT *, {_norm('text')} AS norm FROM lines),
        keys AS (SELECT manual_id, top AS top10, x0 AS x10, norm, count(DISTINCT page) AS n_pages FROM keyed WHERE norm <> '' GROUP BY ALL HAVING count(DISTINCT page) >= 3),
        body AS (SELECT k.* FROM keyed k ANTI JOIN keys g ON k.manual_id = g.manual_id AND k.top = g.top10 AND k.x0 = g.x10 AND k.norm = g.norm)
    """
    bound = """
        gaps AS (SELECT manual_id, page, x0, lead(x0) OVER w AS nx, row_number() OVER w AS i FROM {src} WINDOW w AS (PARTITION BY manual_id, page ORDER BY x0, line_no)),
        wide AS (SELECT manual_id, page, max(CASE WHEN nx IS NOT NULL THEN row(nx - x0, i, x0, nx) END) AS m FROM gaps GROUP BY ALL),
        bounds AS (SELECT manual_id, page, CASE WHEN coalesce(m[1] >= 50, false) THEN 2 ELSE 1 END AS columns, CASE WHEN m[1] >= 50 THEN (m[3] + m[4]) / 2 END AS boundary FROM wide)
    """
    fonts = f"""
        {glyphs},
        med AS (SELECT manual_id, median(size) AS b FROM body WHERE size > 0 GROUP BY ALL),
        mk AS (SELECT y.*, y.size >= m.b * 1.15 AND regexp_matches(y.text, '[a-zA-Z]') AND NOT starts_with(trim(y.text), '■') AS big, row_number() OVER (PARTITION BY y.manual_id ORDER BY page, top, line_no) AS i FROM body y JOIN med m USING (manual_id)),
        isl AS (SELECT *, i - row_number() OVER (PARTITION BY manual_id ORDER BY i) AS island FROM mk WHERE big),
        hd AS (SELECT manual_id, island, min(i) AS i, arg_min(page, i) AS page_start, arg_min(top, i) AS start_top, string_agg(trim(text), ' ' ORDER BY i) AS title FROM isl GROUP BY ALL),
        heads AS (SELECT manual_id, CAST(row_number() OVER (PARTITION BY manual_id ORDER BY i) - 1 AS INT) AS seq, title, page_start, start_top FROM hd)
    """
    sources = "src AS (SELECT s_suppkey AS manual_id, n_name AS maker, CASE s_suppkey % 3 WHEN 0 THEN 'internal_use_permitted' WHEN 1 THEN 'unknown' END AS license_state FROM supplier JOIN nation ON s_nationkey = n_nationkey)"
    define = " OR ".join(f"contains(lower(text), '{m}')" for m in T.DEFINE_MARKERS)
    constraint = " OR ".join(f"contains(lower(text), '{m}')" for m in T.CONSTRAINT_MARKERS)
    slots = " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + f" THEN '{name}'" for name, words in T.SLOT_RULES)
    return {
        "threshold_scan": f"WITH {found} SELECT pattern_id, kind, status, unit, count(*) AS n FROM found GROUP BY ALL",
        "threshold_rows": f'WITH {found} SELECT manual_id, line_no, threshold_id, pattern_id, "at", matching_text, unit, value, status FROM found',
        "furniture_filter": f"""
            WITH {lines},
            a AS (SELECT *, (top >= 75 AND top <= 400) OR regexp_matches(text, '^\\s*\\d{{1,2}}[.)]\\s*[A-Z]') AS base, CASE WHEN top - lag(top) OVER w <= 15 THEN 0 ELSE 1 END AS brk FROM lines WINDOW w AS (PARTITION BY manual_id, page ORDER BY line_no)),
            b AS (SELECT *, sum(brk) OVER (PARTITION BY manual_id, page ORDER BY line_no) AS isl FROM a)
            SELECT manual_id, line_no FROM (SELECT *, max(base) OVER (PARTITION BY manual_id, page, isl ORDER BY line_no) AS keep FROM b) WHERE keep
        """,
        "running_head_chapters": f"""
            WITH {lines},
            seen AS (SELECT DISTINCT manual_id, {_norm('text')} AS label, page FROM lines WHERE trim(text) <> '' AND NOT regexp_matches(trim(text), '[.!?:;]$') AND length({_norm('text')}) <= 30 AND regexp_matches({_norm('text')}, '[a-zA-Z]')),
            r AS (SELECT *, page - row_number() OVER (PARTITION BY manual_id, label ORDER BY page) AS isl FROM seen)
            SELECT manual_id, label, min(page) AS page_start, max(page) + 1 AS page_end FROM r GROUP BY manual_id, label, isl HAVING count(*) >= 3
        """,
        "margin_glyphs": f"WITH {lines}, {glyphs} SELECT * FROM keys",
        "column_boundary": f"WITH {lines}, {bound.format(src='lines')} SELECT * FROM bounds",
        "column_order": f"""
            WITH {lines}, {glyphs}, {bound.format(src='body')}
            SELECT l.manual_id, l.line_no, l.top + CASE WHEN l.x0 >= b.boundary THEN 100000 ELSE 0 END AS read_top FROM body l JOIN bounds b USING (manual_id, page)
        """,
        "header_footer_bands": f"""
            WITH {lines},
            pg AS (SELECT manual_id, max(page) + 1 AS n_pages, count(*) AS n FROM lines GROUP BY ALL),
            mid AS (SELECT manual_id, list_sort(list(top))[CAST(floor(count(*) / 2) AS INT) + 1] AS mid FROM lines GROUP BY ALL),
            bands AS (SELECT manual_id, round_even(top / 5, 0) * 5 AS band FROM lines JOIN pg USING (manual_id) WHERE trim(text) <> '' AND length(trim(text)) <= 60 GROUP BY ALL HAVING count(DISTINCT page) >= greatest(5, any_value(n_pages) // 2)),
            g AS (SELECT *, lead(band) OVER w AS nx, row_number() OVER w AS i FROM bands WINDOW w AS (PARTITION BY manual_id ORDER BY band)),
            c AS (SELECT manual_id, count(*) AS k, min(band) AS one, max(CASE WHEN nx IS NOT NULL THEN row(nx - band, i, band, nx) END) AS m FROM g GROUP BY ALL)
            SELECT manual_id, CASE WHEN k = 1 AND one < mid THEN one + 5 WHEN k > 1 THEN m[3] + 5 ELSE 0 END AS header, CASE WHEN k = 1 AND one >= mid THEN one - 5 WHEN k > 1 THEN m[4] - 5 END AS footer
            FROM pg LEFT JOIN c USING (manual_id) LEFT JOIN mid USING (manual_id)
        """,
        "font_headings": f"WITH {lines}, {fonts} SELECT * FROM heads",
        "section_cut": f"""
            WITH {lines}, {fonts},
            win AS (SELECT *, lead(page_start) OVER w AS p2, lead(start_top) OVER w AS t2 FROM heads WINDOW w AS (PARTITION BY manual_id ORDER BY seq))
            SELECT l.manual_id, seq AS section_no, count(*) AS n_lines, min(line_no) AS first_line, max(line_no) AS last_line
            FROM body l JOIN win h ON l.manual_id = h.manual_id AND (page, top) > (page_start, start_top) AND (p2 IS NULL OR (page, top) < (p2, t2)) GROUP BY ALL
        """,
        "step_sequences": f"WITH {lines}, {split} SELECT manual_id, section_no, step_no, number, sequence, text, top FROM steps",
        "paragraph_groups": f"WITH {lines}, {split} SELECT * FROM groups",
        "next_step": f"""
            WITH {lines}, {split}
            SELECT g.manual_id, g.section_no, g.group_no, (SELECT arg_min(s.number || '. ' || s.text, s.top) FROM steps s WHERE s.manual_id = g.manual_id AND s.section_no = g.section_no AND s.top > g.top) AS next_step_text FROM groups g
        """,
        "bullet_items": f"""
            WITH {lines},
            b AS (SELECT manual_id, line_no, trim(text) AS text, string_split(trim(text), '●') AS raw FROM lines WHERE contains(text, '●')),
            p AS (SELECT manual_id, line_no, list_filter(list_transform(raw, lambda x: trim(x)), lambda x: x <> '') AS parts, trim(raw[1]) = '' AS starts FROM b),
            n AS (SELECT manual_id, line_no, unnest(parts) AS item, generate_subscripts(parts, 1) - 1 AS k, starts FROM p)
            SELECT manual_id, line_no, CAST(k AS INT) AS item_no, item, starts OR k > 0 AS is_bullet FROM n
        """,
        "strength_mix": f"WITH {lines} SELECT CASE WHEN {define} THEN 'define' WHEN {constraint} THEN 'constraint' ELSE 'capability' END AS strength, CASE {slots} ELSE 'requirements' END AS slot, count(*) AS n FROM lines GROUP BY ALL",
        "overlay_latest": "SELECT user_id, arg_max(event_id, row(ts, event_id)) AS event_id, arg_max(event_type, row(ts, event_id)) AS event_type, arg_max(value, row(ts, event_id)) AS value FROM events GROUP BY ALL",
        "overlay_merge": f"""
            WITH {found}, {overlay_cte},
            r AS (SELECT f.*, row_number() OVER (PARTITION BY manual_id, threshold_id ORDER BY line_no DESC, "at" DESC) = 1 AS last FROM found f),
            m AS (SELECT CASE WHEN last AND o.threshold_id IS NOT NULL THEN 'measured' ELSE status END AS status, last AND o.threshold_id IS NOT NULL AS applied FROM r LEFT JOIN over o USING (manual_id, threshold_id))
            SELECT status, applied, count(*) AS n, count(*) FILTER (applied) AS n_filled FROM m GROUP BY ALL
        """,
        "overlay_orphans": f"WITH {found}, {overlay_cte} SELECT manual_id, threshold_id FROM over o ANTI JOIN found f USING (manual_id, threshold_id)",
        "glossary_hits": f"""
            WITH {lines}, {sources},
            top AS (SELECT p_name FROM part GROUP BY p_name ORDER BY count(*) DESC, p_name LIMIT 10),
            terms AS (SELECT p_name AS term_id, lower(p_name) AS w, CASE WHEN length(p_name) % 2 = 0 THEN '' ELSE 'BRAZIL' END AS m FROM top),
            h AS (SELECT manual_id, term_id, sum((length(text) - length(replace(lower(text), w, ''))) // length(w)) AS n FROM lines JOIN src USING (manual_id) JOIN terms ON (m = '' OR m = maker) AND contains(lower(text), w) GROUP BY ALL)
            SELECT term_id, CAST(sum(n) AS BIGINT) AS hits, count(*) AS manuals FROM h GROUP BY ALL
        """,
        "wording_collisions": """
            WITH w AS (SELECT CAST(p_partkey AS VARCHAR) AS term_id, lower(p_name) AS norm, CASE WHEN p_size % 3 <> 0 THEN p_brand END AS maker FROM part)
            SELECT DISTINCT a.term_id AS term_a, b.term_id AS term_b, a.norm FROM w a JOIN w b ON a.norm = b.norm AND a.term_id < b.term_id AND (a.maker IS NULL OR b.maker IS NULL OR a.maker = b.maker)
        """,
        "stale_keys": "SELECT c_custkey AS key FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'",
        "rollup_by_maker": f"WITH {sources} SELECT maker, count(*) AS n_manuals, count(*) FILTER (license_state = 'internal_use_permitted') AS n_viewable, count(*) FILTER (coalesce(license_state, '') <> 'internal_use_permitted') AS n_blocked FROM src GROUP BY ALL",
        "normalise_documents": f"SELECT doc_id, CAST(length({_norm('text')}) AS INT) AS n_normal, substr(sha256({_norm('text')}), 1, 12) AS norm_id FROM documents",
        "repeated_lines": "SELECT line, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE line <> '' GROUP BY ALL HAVING count(DISTINCT doc_id) >= 3",
    } | inventory.oracle_sql(_norm, split, found) | spec.oracle_sql(_norm, _found_ctes)
