"""Cutting documents into chapters and sections: range joins by heading order, and islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions.text import is_running_label, normalise, production_filename, strip
from docloom.operators.layout import drop_margin_glyphs

HEADING_RATIO = 1.15
LABEL_PAGES = 3
SEARCH_PAGES = 2
STRICT_SHARE = 0.5
EVIDENCE = 8
INDEX_ENTRIES, INDEX_PAGES, NAME_LENGTH = 5, 3, 80
TOC_PAGES, TOC_WINDOW, TOC_ROW, TOC_ROWS = 15, 6, 2.0, 3
CRUMB_RUNS = 3


def chapter_ranges(bookmarks: DataFrame) -> DataFrame:
    """Rows (manual_id, seq, title, page_start, page_end): each top-level bookmark to the next; the last is open (SEC-1)."""
    top = bookmarks.withColumn("least", F.min("level").over(W.partitionBy("manual_id"))).filter("level = least")
    return top.select(
        "manual_id", "seq", "title", F.col("page_index").alias("page_start"), F.lead("page_index").over(W.partitionBy("manual_id").orderBy("seq")).alias("page_end")
    )


def find_chapter(bookmarks: DataFrame, prefix: str) -> DataFrame:
    """The first top-level bookmark of each manual whose normalised title starts with the prefix (SEC-1)."""
    target = normalise(F.lit(prefix))
    first = F.row_number().over(W.partitionBy("manual_id").orderBy("seq"))
    return chapter_ranges(bookmarks).filter(F.startswith(normalise(F.col("title")), target)).withColumn("k", first).filter("k = 1").drop("k")


def _chaptered(df: DataFrame, **defaults: str) -> DataFrame:
    """df with chapter_no, chapter_end and the like where it has none: one chapter without an end."""
    for name, kind in {"chapter_no": "int", "chapter_end": "int"}.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(0 if name == "chapter_no" else None).cast(kind))
    return df


def match_headings(headings: DataFrame, lines: DataFrame) -> DataFrame:
    """headings (manual_id, seq, title, level, page_index) with page_start, start_top and matched (SEC-2).

    A heading is searched on its page up to the next heading's in its chapter (the last up to chapter_end, if given), two pages on at most: an
    equal normalised line first, else one that holds it or is held by it. The few pages of each are listed, so
    the join is on (manual, page).
    """
    nxt = F.coalesce(F.lead("page_index").over(W.partitionBy("manual_id", "chapter_no").orderBy("seq")), "chapter_end", F.col("page_index") + SEARCH_PAGES)
    last = F.greatest(F.col("page_index"), F.least(nxt, F.col("page_index") + SEARCH_PAGES))
    want = _chaptered(headings).withColumns({"norm": normalise(F.col("title")), "last": last})
    pages = want.filter("norm <> ''").select("manual_id", "seq", "norm", F.explode(F.sequence("page_index", "last")).alias("page"))
    have = lines.select("manual_id", "page", "line_no", "top", normalise(F.col("text")).alias("ln"))
    equal = F.col("ln") == F.col("norm")
    holds = (F.length("norm") > 3) & (F.contains("ln", "norm") | F.contains("norm", "ln"))
    best = (
        pages.join(have, ["manual_id", "page"]).filter(equal | holds)
        .groupBy("manual_id", "seq")
        .agg(F.min(F.struct(F.when(equal, 0).otherwise(1).alias("rank"), "line_no", "page", "top")).alias("b"))
    )
    return want.join(best, ["manual_id", "seq"], "left").select(
        *headings.columns, F.coalesce("b.page", "page_index").alias("page_start"), F.coalesce("b.top", F.lit(-1.0)).alias("start_top"), F.col("b").isNotNull().alias("matched")
    )


def cut_sections(candidates: DataFrame, lines: DataFrame, top: str = "top") -> DataFrame:
    """Section lines: lines with section_no (a candidate's seq), for windows between one candidate and the next of its chapter by list order (SEC-3).

    candidates has manual_id, seq, page_start and start_top, and may have chapter_no and chapter_end (null: open). A line
    belongs strictly between its section's start and the next one's; headings out of order may give windows that overlap
    or hold nothing. Windows are listed by page for an equality join; an open one ends at its manual's last page.
    """
    w = W.partitionBy("manual_id", "chapter_no").orderBy("seq")
    last_page = lines.groupBy("manual_id").agg(F.max("page").alias("last_page"))
    win = _chaptered(candidates).select(
        "manual_id", "seq", "page_start", "start_top",
        F.lead("page_start").over(w).alias("p2"), F.lead("start_top").over(w).alias("t2"), "chapter_end",
    ).join(last_page, "manual_id")
    win = win.withColumns({"e_page": F.coalesce("p2", "chapter_end", F.col("last_page") + 1), "e_top": F.coalesce("t2", F.lit(-1.0))})
    pages = win.filter(F.col("e_page") >= F.col("page_start")).withColumn("page", F.explode(F.sequence("page_start", F.least("e_page", F.col("last_page") + 1))))
    pos = F.struct(F.col("page").alias("p"), F.col(top).alias("t"))
    inside = (pos > F.struct(F.col("page_start").alias("p"), F.col("start_top").alias("t"))) & (pos < F.struct(F.col("e_page").alias("p"), F.col("e_top").alias("t")))
    return lines.join(pages.select("manual_id", "page", F.col("seq").alias("section_no"), "page_start", "start_top", "e_page", "e_top"), ["manual_id", "page"]).filter(inside).select(*lines.columns, "section_no")


def font_headings(lines: DataFrame, titles: DataFrame | None = None, ratio: float = HEADING_RATIO, by: tuple[str, ...] = ("manual_id",), cleaned: bool = False) -> DataFrame:
    """Headings (by, seq, title, page_start, start_top, matched) by font size, wrapped lines merged (SEC-5, SEC-6).

    With by of manual and chapter the body's size, the margin's glyphs and what follows a heading are each chapter's own. cleaned lines have lost the margin's glyphs before.
    titles (by, title) gives chapter titles that are no headings of their own.
    """
    body = F.median(F.when(F.col("size") > 0, F.col("size"))).over(W.partitionBy(*by))
    marked = (lines if cleaned else drop_margin_glyphs(lines, by=by)).withColumn("body", body)
    big = (F.col("size") >= F.col("body") * ratio) & F.col("text").rlike("[a-zA-Z]") & ~strip(F.col("text")).rlike("^■")
    if titles is not None:
        own = titles.select(*by, normalise(F.col("title")).alias("chapter"))
        marked = marked.join(own, [*by], "left")
        big = big & F.coalesce(normalise(strip(F.col("text"))) != F.col("chapter"), F.lit(True))
    w = W.partitionBy(*by).orderBy("page", "top", "line_no")
    marked = marked.withColumns({"big": big, "i": F.row_number().over(w)}).filter("big")
    marked = marked.withColumn("island", F.col("i") - F.row_number().over(w))
    ordered = F.sort_array(F.collect_list(F.struct("i", strip(F.col("text")).alias("t"))))
    heads = marked.groupBy(*by, "island").agg(
        F.min(F.struct("i", "page", "top")).alias("f"), F.array_join(F.transform(ordered, lambda x: x["t"]), " ").alias("title")
    )
    seq = F.row_number().over(W.partitionBy(*by).orderBy("f.i")) - 1
    return heads.select(*by, seq.cast("int").alias("seq"), "title", F.col("f.page").alias("page_start"), F.col("f.top").alias("start_top"), F.lit(True).alias("matched"))


def running_head_chapters(lines: DataFrame, pages: int = LABEL_PAGES) -> DataFrame:
    """Rows (manual_id, label, page_start, page_end): one short text on consecutive pages, whatever its case and signs (SEC-10).

    label is the text's normal form; the end is exclusive.
    """
    seen = lines.filter(is_running_label(F.col("text"))).select("manual_id", normalise(F.col("text")).alias("label"), "page").distinct()
    run = seen.withColumn("island", F.col("page") - F.row_number().over(W.partitionBy("manual_id", "label").orderBy("page")))
    return (
        run.groupBy("manual_id", "label", "island")
        .agg(F.min("page").alias("page_start"), (F.max("page") + 1).alias("page_end"), F.count("*").alias("n"))
        .filter(F.col("n") >= pages)
        .select("manual_id", "label", "page_start", "page_end")
    )


def find_label(chapters: DataFrame, label: str) -> DataFrame:
    """The first chapter of each manual with this normalised label (SEC-11, SEC-12)."""
    first = F.row_number().over(W.partitionBy("manual_id").orderBy("page_start", "label"))
    return chapters.filter(normalise(F.col("label")) == normalise(F.lit(label))).withColumn("k", first).filter("k = 1").drop("k")


def in_chapters(lines: DataFrame, chapters: DataFrame) -> DataFrame:
    """lines with chapter_no of each chapter (manual_id, chapter_no, page_start, page_end) whose pages hold them; a null end is open."""
    last = lines.groupBy("manual_id").agg((F.max("page") + 1).alias("open_end"))
    span = chapters.join(last, "manual_id").select("manual_id", "chapter_no", "page_start", F.coalesce("page_end", "open_end").alias("stop")).filter("stop > page_start")
    pages = span.select("manual_id", "chapter_no", F.explode(F.sequence("page_start", F.col("stop") - 1)).alias("page"))
    return lines.join(pages, ["manual_id", "page"])


def index_entries(lines: DataFrame, chapters: DataFrame | None = None) -> DataFrame:
    """Entries (manual_id, chapter_no, entry_no, name, printed_page) of a dot-leader index on a chapter's first three pages (TVF-4).

    Equal names and pages count once. A chapter with fewer than five entries has no index: no rows. Without chapters a manual is one, from its first page on.
    """
    leader = r"(?U)^(.+?)[^\w\s]{3,}\s*([0-9]{1,4})\s*$"
    if chapters is None:
        chapters = lines.groupBy("manual_id").agg(F.min("page").alias("page_start")).withColumns({"chapter_no": F.lit(0), "page_end": F.lit(None).cast("int")})
    first = chapters.withColumn("page_end", F.least(F.coalesce("page_end", F.col("page_start") + INDEX_PAGES), F.col("page_start") + INDEX_PAGES))
    t = strip(F.col("text"))
    raw = (
        in_chapters(lines, first).filter(t.rlike(leader))
        .select("manual_id", "chapter_no", "line_no", F.btrim(F.regexp_extract(t, leader, 1), F.lit(" ·")).alias("name"), F.regexp_extract(t, leader, 2).cast("int").alias("printed_page"))
        .withColumn("norm", normalise(F.col("name")))
        .filter((F.length("name") <= NAME_LENGTH) & F.col("name").rlike("[a-zA-Z]") & (F.col("norm") != ""))
    )
    own = W.partitionBy("manual_id", "chapter_no")
    once = raw.withColumn("k", F.row_number().over(W.partitionBy("manual_id", "chapter_no", "norm", "printed_page").orderBy("line_no"))).filter("k = 1")
    gated = once.withColumn("n", F.count("*").over(own)).filter(F.col("n") >= INDEX_ENTRIES)
    no = F.row_number().over(own.orderBy("line_no")) - 1
    return gated.select("manual_id", "chapter_no", no.cast("int").alias("entry_no"), "name", "printed_page")


def index_sections(entries: DataFrame, lines: DataFrame, offset: int = 1, ratio: float = HEADING_RATIO) -> DataFrame:
    """Headings (manual_id, chapter_no, seq, title, page_start, start_top, matched) of index entries found near their pages (SEC-7, SEC-8).

    lines are those of the chapters, with chapter_no and without the margin's glyphs. A chapter where under half are found has no rows.
    """
    by = ["manual_id", "chapter_no"]
    lines = _chaptered(lines)
    median = lines.filter("size > 0").groupBy(*by).agg(F.median("size").alias("body"))
    want = _chaptered(entries).withColumns({"norm": normalise(F.col("name")), "guess": F.col("printed_page") - offset})
    pages = want.filter("norm <> ''").withColumn("page", F.explode(F.sequence("guess", F.col("guess") + SEARCH_PAGES)))
    have = lines.join(median, by, "left").select(*by, "page", "line_no", "top", "size", "body", normalise(F.col("text")).alias("ln")).filter("ln <> ''")
    equal = F.col("ln") == F.col("norm")
    share = F.least(F.length("ln"), F.length("norm")) / F.greatest(F.length("ln"), F.length("norm"))
    holds = (F.col("size") >= F.col("body") * ratio) & (share >= STRICT_SHARE) & (F.contains("ln", "norm") | F.contains("norm", "ln"))
    best = (
        pages.join(have, [*by, "page"]).filter(equal | holds).groupBy(*by, "entry_no")
        .agg(F.min(F.struct(F.when(equal, 0).otherwise(1).alias("rank"), F.col("page").alias("p"), F.col("top").alias("t"), "line_no")).alias("b"))
    )
    found = want.join(best, [*by, "entry_no"], "left")
    w = W.partitionBy(*by)
    gated = found.withColumns({"hits": F.count("b").over(w), "n": F.count("*").over(w)}).filter("hits * 2 >= n")
    placed = gated.select(*by, "entry_no", F.col("name").alias("title"), F.coalesce("b.p", "guess").alias("page_start"), F.coalesce("b.t", F.lit(-1.0)).alias("start_top"), F.col("b").isNotNull().alias("matched"))
    seq = F.row_number().over(W.partitionBy(*by).orderBy("page_start", "start_top", "entry_no")) - 1
    return placed.withColumn("seq", seq.cast("int")).drop("entry_no")


def breadcrumb_sections(crumbs: DataFrame) -> DataFrame:
    """Rows (manual_id, chapter_no, seq, title, area, page_start, page_end): runs of equal breadcrumbs on consecutive pages of a chapter (SEC-9).

    Breadcrumbs with a segment over 80 characters or a typesetter's file name are left out. A run of a bare area that is the parent of others is dropped; where
    it spans one page and the next run lies in that area, that run begins with it. Of several such bare runs in a row each takes the one before, so every other one
    still spans one page. A chapter needs three runs of two levels or more.
    """
    by = ["manual_id", "chapter_no"]
    fine = F.forall("segments", lambda s: (F.length(s) <= NAME_LENGTH) & ~production_filename(s))
    run = (
        _chaptered(crumbs).filter((F.size("segments") > 0) & fine).withColumn("path", F.array_join("segments", "\x1f"))
        .withColumn("island", F.col("page") - F.row_number().over(W.partitionBy(*by, "path").orderBy("page")))
        .groupBy(*by, "path", "island")
        .agg(F.first("segments").alias("segments"), F.min("page").alias("page_start"), (F.max("page") + 1).alias("page_end"))
    )
    order, w = W.partitionBy(*by).orderBy("page_start"), W.partitionBy(*by)
    deep = F.size("segments") >= 2
    run = run.withColumns({"deep": F.sum(deep.cast("int")).over(w), "areas": F.collect_set(F.when(deep, F.col("segments")[0])).over(w)}).filter(F.col("deep") >= CRUMB_RUNS)
    run = run.withColumns({"bare": (F.size("segments") == 1) & F.array_contains("areas", F.col("segments")[0]), "first": F.col("segments")[0]})
    lone = F.col("bare") & (F.col("page_end") - F.col("page_start") == 1)
    run = run.withColumns({"lone": lone, "i": F.row_number().over(order), "same": F.coalesce(F.lag("first").over(order) == F.col("first"), F.lit(False))})
    # A row of lone runs of one area begins where the run before is another area's or no lone one.
    begins = F.col("lone") & ~(F.coalesce(F.lag("lone").over(order), F.lit(False)) & F.col("same"))
    run = run.withColumn("begin", F.last(F.when(begins, F.col("i")), ignorenulls=True).over(order))
    run = run.withColumn("spans_one", F.col("lone") & ((F.col("i") - F.col("begin")) % 2 == 0))
    takes = F.coalesce(F.lag("spans_one").over(order), F.lit(False)) & F.col("same") & ~F.col("bare")
    run = run.withColumn("page_start", F.when(takes, F.lag("page_start").over(order)).otherwise(F.col("page_start"))).filter("not bare")
    seq = F.row_number().over(W.partitionBy(*by).orderBy("page_start", "page_end")) - 1
    return run.select(
        *by, seq.cast("int").alias("seq"), F.element_at("segments", -1).alias("title"),
        F.array_join(F.slice("segments", F.lit(1), F.size("segments") - 1), " / ").alias("area"), "page_start", "page_end",
    )


def toc_rows(lines: DataFrame) -> DataFrame:
    """Rows (manual_id, page, row_no, name, number) of a table of contents (SEC-13, SEC-14).

    Lines join a row within two points of its last member; a row of one bare number and one other text without two dots is a chapter; an empty text counts as one.
    """
    order = W.partitionBy("manual_id", "page").orderBy("top", "line_no")
    new = F.coalesce(F.col("top") - F.lag("top").over(order) > TOC_ROW, F.lit(True)).cast("int")
    rows = lines.withColumn("new", new).withColumn("row_no", F.sum("new").over(order))
    t = strip(F.col("text"))
    number = t.rlike("^[0-9]{1,4}$")
    plain = ~number & ~F.contains("text", F.lit(".."))
    return (
        rows.groupBy("manual_id", "page", "row_no")
        .agg(F.sum(number.cast("int")).alias("numbers"), F.sum(plain.cast("int")).alias("names"), F.max(F.when(number, t)).cast("int").alias("number"), F.max(F.when(plain, t)).alias("name"))
        .filter((F.col("numbers") == 1) & (F.col("names") == 1) & (F.length("name") <= NAME_LENGTH) & F.col("name").rlike("[a-zA-Z]"))
        .select("manual_id", "page", "row_no", "name", "number")
    )


def toc_subentries(lines: DataFrame) -> DataFrame:
    """Rows (manual_id, line_no, entry_no, name, number): all `name..... number` parts of a line (TVF-3)."""
    pair = r"([^0-9].*?)\.{2,}\s*([0-9]{1,4})"
    names, numbers = F.regexp_extract_all("text", F.lit(pair), F.lit(1)), F.regexp_extract_all("text", F.lit(pair), F.lit(2))
    return lines.select("manual_id", "line_no", F.posexplode(F.arrays_zip(names.alias("name"), numbers.alias("number"))).alias("entry_no", "x")).select("manual_id", "line_no", "entry_no", F.btrim("x.name", F.lit(" ·")).alias("name"), F.col("x.number").cast("int").alias("number"))


def toc_chapters(lines: DataFrame, offset: int = 1) -> DataFrame:
    """Rows (manual_id, label, page_start, page_end, printed_page, evidence) from a contents page, all or nothing per manual (SEC-15).

    The contents are looked for within six pages of the first heading of that name on the first fifteen. Three rows are needed, their
    pages must rise, and half of the names (longer than three characters) must stand near the pages they name. The last chapter ends with the manual.
    evidence lists the sub-entries printed between a chapter's row and the next.
    """
    head = lines.filter((F.col("page") < TOC_PAGES) & normalise(F.col("text")).isin("table of contents", "contents")).groupBy("manual_id").agg(F.min(F.struct("line_no", "page"))["page"].alias("toc"))
    near = lines.join(head, "manual_id").filter((F.col("page") >= F.col("toc")) & (F.col("page") < F.col("toc") + TOC_WINDOW)).select(*lines.columns)
    pages = lines.groupBy("manual_id").agg((F.max("page") + 1).alias("n_pages"))
    w = W.partitionBy("manual_id").orderBy("page", "row_no")
    rows = toc_rows(near).withColumns(
        {"page_start": F.col("number") - offset, "next": F.lead("number").over(w) - offset, "rises": F.coalesce(F.col("number") > F.lag("number").over(w), F.lit(True)), "k": F.row_number().over(w)}
    )
    around = rows.select("manual_id", "k", normalise(F.col("name")).alias("norm"), F.explode(F.sequence(F.col("page_start") - 1, F.col("page_start") + 2)).alias("page")).filter("length(norm) > 3")
    body = lines.select("manual_id", "page", normalise(F.col("text")).alias("ln"))
    seen = around.join(body, ["manual_id", "page"]).filter(F.contains("ln", "norm") | F.contains("norm", "ln")).select("manual_id", "k").distinct().withColumn("seen", F.lit(1))
    whole = W.partitionBy("manual_id")
    gated = rows.join(seen, ["manual_id", "k"], "left").withColumns({"n": F.count("*").over(whole), "hits": F.count("seen").over(whole), "sorted": F.min(F.col("rises").cast("int")).over(whole)})
    good = gated.filter((F.col("n") >= TOC_ROWS) & (F.col("sorted") == 1) & (F.col("hits") * 2 >= F.col("n")))
    # Sub-entries fall to the last chapter row before their own row.
    order = W.partitionBy("manual_id", "page").orderBy("top", "line_no")
    new = F.coalesce(F.col("top") - F.lag("top").over(order) > TOC_ROW, F.lit(True)).cast("int")
    placed = near.withColumn("new", new).withColumn("row_no", F.sum("new").over(order))
    subs = toc_subentries(placed.select("manual_id", "line_no", "text")).join(placed.select("manual_id", "line_no", "page", "row_no", "top"), ["manual_id", "line_no"])
    marks = rows.select("manual_id", "page", "row_no", F.lit(-1).alias("line_no"), F.lit(0).alias("entry_no"), F.lit(None).cast("string").alias("sub"), "k").unionByName(
        subs.select("manual_id", "page", "row_no", "line_no", "entry_no", F.col("name").alias("sub"), F.lit(None).cast("int").alias("k"))
    )
    own = marks.withColumn("k", F.last("k", True).over(W.partitionBy("manual_id").orderBy("page", "row_no", "line_no", "entry_no").rowsBetween(W.unboundedPreceding, 0)))
    # The row of a chapter itself holds none of its sub-entries.
    clean = own.join(rows.select("manual_id", F.col("page").alias("page_"), F.col("row_no").alias("row_"), "k"), ["manual_id", "k"]).filter("sub is not null and not (page = page_ and row_no = row_)")
    told = clean.groupBy("manual_id", "k").agg(F.transform(F.sort_array(F.collect_list(F.struct("page", "row_no", "line_no", "entry_no", "sub"))), lambda x: x["sub"]).alias("evidence"))
    return good.join(told, ["manual_id", "k"], "left").join(pages, "manual_id").select(
        "manual_id", F.col("name").alias("label"), "page_start", F.coalesce("next", "n_pages").alias("page_end"), F.col("number").alias("printed_page"), F.coalesce("evidence", F.array().cast("array<string>")).alias("evidence")
    )


def heading_evidence(lines: DataFrame, chapters: DataFrame, ratio: float = HEADING_RATIO, cap: int = EVIDENCE) -> DataFrame:
    """Rows (manual_id, label, rank, text): the first large label-like lines of each chapter (SEC-16)."""
    median = lines.filter("size > 0").groupBy("manual_id").agg(F.median("size").alias("body"))
    pages = chapters.withColumn("page", F.explode(F.sequence("page_start", F.greatest("page_start", F.col("page_end") - 1)))).select("manual_id", "label", "page_start", "page")
    big = lines.join(median, "manual_id").filter((F.col("size") >= F.col("body") * ratio) & is_running_label(F.col("text")))
    got = big.join(pages, ["manual_id", "page"]).withColumn("norm", normalise(F.col("text"))).filter(F.col("norm") != normalise(F.col("label")))
    key = ["manual_id", "label", "page_start"]
    once = got.groupBy(*key, "norm").agg(F.min(F.struct("line_no", strip(F.col("text")).alias("text"))).alias("f"))
    rank = F.row_number().over(W.partitionBy(*key).orderBy("f.line_no"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= cap).select(*key, "rank", F.col("f.text").alias("text"))


def strategy(chapters: DataFrame, crumbed: DataFrame, indexed: DataFrame) -> DataFrame:
    """chapters (manual_id, chapter_no, nested) with strategy: nested bookmarks, else breadcrumbs, else an index, else font size (SEC-4).

    crumbed and indexed are the headings that those two ways give; a way that gives none is not taken.
    """
    by = ["manual_id", "chapter_no"]
    c = crumbed.select(*by).distinct().withColumn("crumbs", F.lit(True))
    e = indexed.select(*by).distinct().withColumn("index", F.lit(True))
    pick: Column = F.when(F.col("nested"), "bookmarks").when(F.col("crumbs"), "breadcrumbs").when(F.col("index"), "index").otherwise("font")
    return chapters.join(c, by, "left").join(e, by, "left").withColumn("strategy", pick).drop("crumbs", "index")
