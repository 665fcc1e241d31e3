"""Operators on literal rows, and the catalogue against DuckDB at the smallest scale."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.functions.thresholds import detect
from docloom.operators import building, figures, layout, overlay, sections
from docloom.plans import queries as catalogue
from docloom.plans.generate import generate

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
LINE = "manual_id long, line_no int, page int, top double, x0 double, size double, text string"


def lines(spark, rows):
    """rows: (page, top, text[, x0[, size]])."""
    full = [(1, k, r[0], float(r[1]), float(r[3]) if len(r) > 3 else 60.0, float(r[4]) if len(r) > 4 else 9.0, r[2]) for k, r in enumerate(rows)]
    return spark.createDataFrame(full, LINE)


def plain(rows):
    out = []
    for r in rows:
        out.append(tuple("" if v is None or (isinstance(v, float) and math.isnan(v)) else (round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)) for v in r))
    return sorted(out, key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_catalogue_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = catalogue.queries()[name](spark, SF)
    cols = sorted(got.columns)
    want = con.execute("SELECT " + ", ".join(f'"{c}"' for c in cols) + f" FROM ({catalogue.oracle_sql()[name]})").fetchall()
    rows = [tuple(r) for r in got.select(*cols).collect()]
    assert rows
    assert plain(rows) == plain(want)


def test_furniture_keeps_steps_and_what_follows(spark):
    df = lines(spark, [(0, 20, "Header"), (0, 67.8, "1. Press"), (0, 70, "follows"), (0, 71.3, "and on"), (0, 720, "Footer"), (1, 70, "new page")])
    assert [r.line_no for r in layout.furniture(df, 75, 700).orderBy("line_no").collect()] == [1, 2, 3]


def test_columns_are_read_one_after_another(spark):
    df = lines(spark, [(0, t, f"{c}{t}", x) for t in (10, 20, 30) for c, x in (("L", 50), ("R", 300))])
    got = layout.order_by_columns(df, 2).orderBy("page", "read_top").collect()
    assert [r.text for r in got] == ["L10", "L20", "L30", "R10", "R20", "R30"]
    one = lines(spark, [(0, 10 * k, "x", 50 + k) for k in range(10)])
    assert {r.columns for r in layout.column_boundaries(one).collect()} == {1}


def test_step_takes_its_wrapped_lines(spark):
    df = lines(spark, [(0, 100, "7. Close the door, then"), (0, 110, "move at least"), (0, 120, "ten feet away.")]).withColumn("section_no", F.lit(0))
    split = building.split_lines(df)
    assert [r.text for r in building.steps(split).collect()] == ["Close the door, then move at least ten feet away."]
    assert building.paragraphs(split).count() == 0


def test_step_numbers_alone_take_the_next_line(spark):
    df = lines(spark, [(0, 100, "1."), (0, 110, "Touch it"), (0, 120, "2. (P.3)"), (0, 130, "Hold it")]).withColumn("section_no", F.lit(0))
    got = [r.text for r in building.attach_orphans(df).orderBy("line_no").collect()]
    assert got == ["1. Touch it", "2. Hold it (P.3)"]


def test_sequences_restart(spark):
    df = lines(spark, [(0, 50 * k, f"{n}. Step it") for k, n in enumerate([1, 2, 3, 1, 2])]).withColumn("section_no", F.lit(0))
    assert [r.sequence for r in building.steps(building.split_lines(df)).orderBy("step_no").collect()] == [1, 1, 1, 2, 2]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Lead in: ● first one ● second one", [("Lead in:", False), ("first one", True), ("second one", True)]),
        ("●only item", [("only item", True)]),
        ("Packed ○○○ circles", [("Packed ○○○ circles", False)]),
        ("nothing here", [("nothing here", False)]),
    ],
)
def test_bullets(spark, text, want):
    df = spark.createDataFrame([(text,)], ["t"]).select(F.inline(building.split_bullets(F.col("t"))))
    assert [tuple(r) for r in df.collect()] == want


@pytest.mark.parametrize(
    ("text", "value", "unit", "status"),
    [
        ("Wait a few seconds (about 5 sec) first.", "5", "sec", "from_manual"),
        ("There is a certain level of inaccuracy, which the unit compensates for in most of the cases it meets, up to (100 m) or so.", "100 m", "as stated", "from_manual"),
        ("It turns off after a certain period of time.", None, "time", "unfilled"),
    ],
)
def test_thresholds_are_seeded(spark, text, value, unit, status):
    r = detect(spark.createDataFrame([(text, "p.1 / text")], ["text", "source"])).collect()
    assert [(x.value, x.unit, x.status) for x in r] == [(value, unit, status)]


def test_breadcrumb_runs(spark):
    crumbs = [["A"], ["A", "B"], ["A", "B"], ["A", "C"], ["A", "C"], ["A", "C"], ["A", "D"]]
    df = spark.createDataFrame([(1, p, c) for p, c in enumerate(crumbs)], "manual_id long, page int, segments array<string>")
    got = [(r.title, r.area, r.page_start, r.page_end) for r in sections.breadcrumb_sections(df).orderBy("seq").collect()]
    assert got == [("B", "A", 0, 3), ("C", "A", 3, 6), ("D", "A", 6, 7)]


def test_index_needs_five_entries(spark):
    rows = [(0, 10 * k, f"Item {k} ....... {k + 2}") for k in range(5)]
    assert sections.index_entries(lines(spark, rows)).count() == 5
    assert sections.index_entries(lines(spark, rows[:4])).count() == 0


def test_words_join_by_their_first(spark):
    words = [(1, 0, k, t, top, x, x + 20, 9.0, 9.0, True) for k, (t, top, x) in enumerate([("a", 10.0, 0.0), ("b", 12.5, 25.0), ("c", 14.0, 0.0), ("d", 14.5, 100.0)])]
    df = spark.createDataFrame(words, "manual_id long, page int, word_no int, text string, top double, x0 double, x1 double, size double, height double, upright boolean")
    assert [r.text for r in layout.group_words(df).orderBy("line_no").collect()] == ["a b", "c d"]
    assert [r.text for r in layout.group_words(df, columns=2).orderBy("line_no").collect()] == ["a b", "c", "d"]


def test_merged_boxes_reach_a_fixed_point(spark):
    rows = [(1, 0, 0, 0.0, 0.0, 10.0, 10.0), (1, 0, 1, 12.0, 0.0, 20.0, 10.0), (1, 0, 2, 22.0, 0.0, 30.0, 10.0), (1, 0, 3, 100.0, 0.0, 110.0, 10.0)]
    df = spark.createDataFrame(rows, "manual_id long, page int, rect_no int, x0 double, top double, x1 double, bottom double")
    assert [(r.x0, r.x1, r.n_rects) for r in figures.merge_rects(df).orderBy("x0").collect()] == [(0.0, 30.0, 3), (100.0, 110.0, 1)]


def test_end_to_end(spark):
    df = lines(spark, [(0, 10, "Navigation"), (0, 30, "Searching"), (0, 50, "1. Select the map."), (0, 60, "2. Touch a place."), (0, 70, "3. Start it."),
                       (0, 120, "It stops after a certain period of time when idle."), (1, 10, "Route"), (1, 40, "The route is shown."), (2, 10, "Audio"), (2, 30, "Radio"), (2, 60, "The radio plays.")])
    marks = [("Navigation", 0, 0), ("Searching", 1, 0), ("Route", 1, 1), ("Audio", 0, 2), ("Radio", 1, 2)]
    bm = spark.createDataFrame([(1, k, t, lv, p) for k, (t, lv, p) in enumerate(marks)], "manual_id long, seq int, title string, level int, page_index int")
    spec = generate(df, bm)
    assert [r.title for r in spec.functions.orderBy("section_no").collect()] == ["Searching", "Route", "Radio"]
    assert spec.steps.count() == 3
    assert [(r.kind, r.status) for r in spec.thresholds.collect()] == [("duration", "unfilled")]


def test_overlay_last_duplicate_wins(spark):
    t = spark.createDataFrame([(1, "x", 0, 0, None, "unfilled", None, None), (1, "x", 5, 0, None, "unfilled", None, None)], "manual_id long, threshold_id string, line_no int, at int, value string, status string, evidence string, filled_by string")
    o = spark.createDataFrame([(1, "x", "3", "measured", "e", "me"), (1, "y", "4", "measured", "e", "me")], "manual_id long, threshold_id string, value string, status string, evidence string, filled_by string")
    assert [(r.line_no, r.value) for r in overlay.merge(t, o).orderBy("line_no").collect()] == [(0, None), (5, "3")]
    assert [r.threshold_id for r in overlay.orphans(o, t).collect()] == ["y"]


def test_text_scalars(spark):
    df = spark.createDataFrame([("Élan—vital: “x”!",)], ["s"])
    assert df.select(T.normalise(F.col("s"))).first()[0] == "élan vital x"
    joined = spark.createDataFrame([(["multi-", "line", "text"],)], "l array<string>").select(T.join_lines(F.col("l"))).first()[0]
    assert joined == "multiline text"


@pytest.mark.parametrize(("name", "most"), [("spec_figures", 120), ("function_pages", 160)])
def test_pages_and_figures_are_read_from_written_parts(spark, name, most):
    """A plan that repeats its shared parts takes the driver's memory: its operators are counted."""
    plan = catalogue.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("- " in row for row in plan.split("\n")) <= most


def test_collisions_of_several_scopes_are_met_once(spark):
    """Each pair comes from the join alone: nothing is made distinct or exchanged behind it."""
    rows = [("a", "Map", "x"), ("a", "MAP", "y"), ("b", "map", "y"), ("b", "map", "x"), ("c", "map", "z"), ("d", "map", None), ("d", "map", "x"), ("e", "other", ""), ("f", None, "x"), (None, "map", "x")]
    df = overlay.wording_collisions(spark.createDataFrame(rows, "term_id string, text string, maker string"))
    assert sorted((r.term_a, r.term_b, r.norm) for r in df.collect()) == [("a", "b", "map"), ("a", "d", "map"), ("b", "d", "map"), ("c", "d", "map")]
    plan = df._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert not any("Aggregate" in row for row in plan[: next(k for k, row in enumerate(plan) if "Join" in row)])


def test_collisions_are_not_sent_to_the_driver(spark, tmp_path):
    """Many terms in a small file: neither side is broadcast, and pairs within and across parts are met once."""
    path = str(tmp_path / "words")
    spark.range(300).selectExpr("cast(id as string) term_id", "'map' text", "if(id % 3 = 0, '', concat('m', id % 2)) maker").coalesce(1).write.parquet(path)
    df = overlay.wording_collisions(spark.read.parquet(path))
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    maker = {str(k): "" if k % 3 == 0 else k % 2 for k in range(300)}
    want = sorted((a, b, "map") for a in maker for b in maker if a < b and (maker[a] == "" or maker[b] == "" or maker[a] == maker[b]))
    assert sorted(tuple(r) for r in df.collect()) == want
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_written_tables_of_many_rows_are_not_broadcast(spark):
    """A file of few bytes may hold more rows than the driver can take; a small table is still broadcast."""
    from docloom.sources import tables

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1m")
    try:
        many = tables.store(spark.range(50_000).selectExpr("id div 10 as k", "'the same text in all lines' as t").coalesce(1))[0]
        few = tables.store(spark.range(50).selectExpr("id as k", "'x' as u").coalesce(1))[0]
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan(many.join(many.selectExpr("k", "upper(t) as v"), "k"))
        assert "Broadcast" in plan(few.join(few.selectExpr("k", "u as v"), "k"))
        assert many.join(few, "k").count() == 500
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_thresholds_and_requirements_are_written_where_both_are_read(spark):
    df = lines(spark, [(0, 10, "Navigation"), (0, 30, "Searching"), (0, 50, "1. Select the map."), (0, 120, "It stops after a certain period of time when idle.")])
    bm = spark.createDataFrame([(1, 0, "Navigation", 0, 0), (1, 1, "Searching", 1, 0)], "manual_id long, seq int, title string, level int, page_index int")
    spec = generate(df, bm, keep=True, outputs=("requirements", "thresholds"))
    for part in (spec.requirements, spec.thresholds):
        assert len(part._jdf.queryExecution().optimizedPlan().toString().strip().split("\n")) == 1
    assert [(r.kind, r.status) for r in spec.thresholds.collect()] == [("duration", "unfilled")]
