"""Benchmark decontamination by spaced seeds: tolerant of substituted words, DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import cut, discard

#: Word positions that a seed looks at; it ignores the others within its span.
MASKS = ((0, 1, 3, 4, 6, 8), (0, 1, 2, 5, 7, 8), (0, 2, 3, 5, 6, 7))
SPAN = 9
#: With these, each alignment of SPAN to WINDOW words has a seed whichever of its words may differ. A longer one has one among MASKS.
EDGE_MASKS = ((1, 3, 4, 7, 8), (0, 3, 5, 6, 8), (0, 2, 3, 4, 6))
#: An overlap is a window of this many words of which this share agrees, at the same distance.
WINDOW = 13
SIMILARITY = 0.8
#: Seeds of a benchmark that are broadcast, at most (about 32 bytes each); more are joined by shuffle.
BROADCAST_SEEDS = 1_000_000
#: Scripts written without spaces between words: each character counts as a word.
UNSPACED = r"([\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}])"
#: They all lie here. A range is tested at once, where a script is looked up for each character.
HIGH = r"[\x{0E00}-\x{10FFFF}]"


def word_hashes(text: Column) -> Column:
    """64-bit hashes of a text's words: lower-cased runs of letters and digits, or single characters of UNSPACED."""
    text = F.coalesce(text, F.lit(""))
    spaced = F.when(text.rlike(HIGH), F.regexp_replace(text, UNSPACED, " $1 ")).otherwise(text)
    words = F.array_remove(F.split(F.lower(spaced), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _places(df: DataFrame, h: str, keep: list[str], everywhere: bool = True) -> DataFrame:
    """A row for each seed: seed, at (the window's first word) and the columns to keep.

    Seeds of EDGE_MASKS are formed everywhere, or only where a passage cut off by the text's edge can lie.

    The words of a window stand side by side after shifted copies of the array are zipped, so
    hashing and the join run in generated code and not in a lambda for each word.
    """
    shifted = ", ".join(f"slice({h}, {k + 1}, size({h}) - {SPAN - 1})" for k in range(SPAN))
    wide = df.filter(F.size(h) >= SPAN).select(*keep, F.size(h).alias("_n"), F.expr(f"posexplode(arrays_zip({shifted}))").alias("at", "z"))
    seeds = [F.xxhash64(*[F.col("z")[str(k)] for k in mask], F.lit(j)) for j, mask in enumerate(MASKS + EDGE_MASKS)]
    edge = F.lit(everywhere) | (F.col("at") < WINDOW - SPAN) | (F.col("at") > F.col("_n") - WINDOW)
    return wide.select(*keep, "at", F.explode(F.when(edge, F.array(*seeds)).otherwise(F.array(*seeds[: len(MASKS)]))).alias("seed"))


def _runs(df: DataFrame, h: str, keep: list[str], n: int) -> DataFrame:
    """Rows as those of _places: a seed for each run of n words, all of them."""
    shifted = ", ".join(f"slice({h}, {k + 1}, size({h}) - {n - 1})" for k in range(n))
    wide = df.filter(F.size(h) >= n).select(*keep, F.expr(f"posexplode(arrays_zip({shifted}))").alias("at", "z"))
    return wide.select(*keep, "at", F.xxhash64(*[F.col("z")[str(k)] for k in range(n)], F.lit(-n)).alias("seed"))


def find_overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    broadcast_seeds: int = BROADCAST_SEEDS,
) -> DataFrame:
    """Rows (doc_id, contaminated, items array<long>, n_overlaps, similarity): one per document.

    Seeds of documents and benchmark items are joined; hits of a document, an item and a
    distance between their places are merged, and each is verified on the words: some
    window of WINDOW words must agree in SIMILARITY of its places (at an item's edges of
    at least SPAN words, all of the item). items are those verified, ascending, n_overlaps counts the verified
    alignments (of equal items once), similarity is the best window's share.

    An item of fewer than SPAN words overlaps where all of it stands, word for word. Other items overlap no text of fewer than
    SPAN words. A null or empty text, or an item without words, overlaps nothing. Rows without an id are judged like all others.
    Rows with a repeated id are verified on their own texts; repeated rows get equal results. A very long text is one row, whose
    hits hold an item's words once and a number for each distance. An empty
    benchmark or table of documents gives no overlap or no rows. Items with equal words are compared as one and all named; items
    without an id are left out. Other columns are not read.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))
    return _verified(base, benchmark, item_col, item_text_col, broadcast_seeds, "doc_id", "_text").drop("_text")


def _verified(docs: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str, broadcast_seeds: int, id_col: str, text_col: str) -> DataFrame:
    """docs (an id, a text and what is to be kept beside them) with contaminated, items, n_overlaps and similarity."""
    items = cut(
        benchmark.select(F.col(item_col).cast("long").alias("item"), word_hashes(F.col(item_text_col)).alias("ih"))
        .filter("item is not null")
        .groupBy("ih")
        .agg(F.min("item").alias("item"), F.sort_array(F.collect_set("item")).alias("ids")),
        "items",
    )
    sizes = [r["n"] for r in items.filter(F.size("ih").between(1, WINDOW - 1)).select(F.size("ih").alias("n")).distinct().collect()]
    whole, everywhere = sorted(n for n in sizes if n < SPAN), any(n >= SPAN for n in sizes)
    places = _places(items, "ih", ["item"])
    for n in whole:
        places = places.unionByName(_runs(items.filter(F.size("ih") == n), "ih", ["item"], n))
    seeds = cut(places.withColumnRenamed("at", "item_at").distinct(), "seeds")
    n_seeds = seeds.count()
    if not n_seeds:
        return docs.select(
            *docs.columns, F.lit(False).alias("contaminated"), F.array().cast("array<long>").alias("items"), F.lit(0).cast("long").alias("n_overlaps"), F.lit(0.0).alias("similarity")
        )
    few = F.broadcast if n_seeds <= broadcast_seeds else lambda df: df
    # A row without an id goes by a hash of its text.
    own_id = F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text_col))
    rows = docs.select(own_id.alias("_id"), F.col(id_col).isNull().alias("_bare"), word_hashes(F.col(text_col)).alias("h"))
    found = _places(rows, "h", ["_id", "_bare"], everywhere)
    for n in whole:
        found = found.unionByName(_runs(rows, "h", ["_id", "_bare"], n))
    hits = (
        found
        .join(few(seeds), "seed")
        .select("_id", "_bare", "item", F.expr("at - item_at").alias("distance"))
        .distinct()
        .groupBy("_id", "_bare", "item")
        .agg(F.collect_list("distance").alias("distances"))
        .join(few(items), "item")
        .groupBy("_id", "_bare")
        .agg(F.collect_list(F.struct("ids", "distances", "ih")).alias("hits"))
    )
    # A hash join of texts to a table that grows with them: always by shuffle, so the cost stays in proportion.
    hits = cut(hits, "hits").hint("merge")
    discard(seeds)
    discard(items)
    # Of each item and distance: where the aligned words agree, from the first aligned word on, and the best window's share.
    first, length = "greatest(0, -d)", "(least(size(x.ih), size(h) - d) - greatest(0, -d))"
    agree = f"transform(sequence({first}, {first} + {length} - 1), k -> if(h[d + k] = x.ih[k], 1, 0))"
    share = f"""
        array_max(transform(array({agree}), g -> array_max(transform(sequence(0, greatest(0, size(g) - {WINDOW})),
            s -> aggregate(slice(g, s + 1, {WINDOW}), 0, (a, b) -> a + b))) / cast(least({WINDOW}, size(g)) as double)))
    """
    best = f"""
        transform(hits, x -> named_struct('ids', x.ids, 'shares', transform(filter(transform(
            filter(x.distances, d -> {length} >= least({SPAN}, size(x.ih))),
            d -> named_struct('n', {length}, 'share', {share})),
            y -> y.share >= if(y.n < {SPAN}, 1.0, {SIMILARITY})), y -> y.share)))
    """
    verified = (
        docs.join(hits, (own_id == hits["_id"]) & (F.col(id_col).isNull() == hits["_bare"]), "left")
        .withColumn("h", F.when(F.col("hits").isNotNull(), word_hashes(F.col(text_col))))
        .withColumn("best", F.expr(f"filter({best}, x -> size(x.shares) > 0)"))
    )
    return verified.select(
        *[docs[c] for c in docs.columns],
        F.coalesce(F.expr("size(best) > 0"), F.lit(False)).alias("contaminated"),
        F.coalesce(F.expr("array_sort(array_distinct(flatten(transform(best, x -> x.ids))))"), F.array().cast("array<long>")).alias("items"),
        F.coalesce(F.expr("aggregate(best, 0L, (a, x) -> a + size(x.shares))"), F.lit(0).cast("long")).alias("n_overlaps"),
        F.coalesce(F.expr("array_max(transform(best, x -> array_max(x.shares)))"), F.lit(0.0)).alias("similarity"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """docs without those that overlap the benchmark, as find_overlaps tells; all columns stay, whatever their names."""
    bare = docs.select(F.col(f"`{id_col}`").alias("_doc"), F.col(f"`{text_col}`").alias("_text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("_rest"))
    found = _verified(bare, benchmark, item_col, item_text_col, broadcast_seeds, "_doc", "_text").filter(~F.col("contaminated"))
    return found.select(*[F.col("_text").alias(c) if c == text_col else F.col("_rest")[c].alias(c) for c in docs.columns])
