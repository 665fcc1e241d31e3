"""Near-duplicates by the Jaccard similarity of word shingles: SimHash links, and MinHash bands for what they miss, find candidates; each is verified on its shingles."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm import simhash
from docloom.llm.common import components, cut, discard, with_least

SHINGLE = 5
SEED = 42
#: Shingle sets that share this part of their union are near-duplicates, in percent.
PERCENT = 80
#: A pair at the limit shares none of the bands with a chance of (1 - 0.8 ** 4) ** 20, about 3 in 100,000.
BANDS, ROWS = 20, 4
#: Up to this many members of a bucket are compared each with each.
FEW = 16
_CHUNK = 1 << 10
_RNG = np.random.default_rng(SEED)
_A = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_MIX = _RNG.integers(0, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Ascending distinct 64-bit hashes of a UTF-8 text's word shingles.

    A-Z are lower-cased and words are runs without ASCII white space. Fewer words than a
    shingle make one shingle; no words make none.
    """
    words = (text or b"").lower().split()
    if len(words) < shingle:
        grams, n = iter([b" ".join(words)]), min(len(words), 1)
    else:
        grams, n = map(b" ".join, zip(*(itertools.islice(words, k, None) for k in range(shingle)), strict=False)), len(words) - shingle + 1
    return np.unique(np.fromiter(itertools.islice(map(xxhash.xxh64_intdigest, grams, itertools.repeat(SEED)), n), np.uint64, n))


def node_of(own: np.ndarray) -> int:
    """A 64-bit hash that stands for a set of shingles."""
    return xxhash.xxh3_64_intdigest(own.tobytes(), SEED)


def minima(own: np.ndarray) -> np.ndarray:
    out = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), _CHUNK):
        np.minimum(out, (own[None, at : at + _CHUNK] * _A[:, None] + _B[:, None]).min(axis=1), out=out)
    return out


def _prints(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, fps, low = np.empty(b.num_rows, np.uint64), np.empty(b.num_rows, np.uint64), np.empty((b.num_rows, BANDS * ROWS), np.uint64)
            for k, x in enumerate(b.column(1)):
                text = x.as_py()
                own = shingles(text)
                nodes[k], fps[k], low[k] = node_of(own), simhash.simhash(text), minima(own)
            low >>= np.uint64(8)
            bands = (low.reshape(-1, BANDS, ROWS) * _MIX).sum(axis=2, dtype=np.uint64)
            bands ^= bands >> np.uint64(29)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS, dtype=np.int32)), pa.array(bands.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(nodes.view(np.int64)), pa.array(fps.view(np.int64)), lists], ["doc_id", "h", "node", "fp", "bands"])

    return docs.mapInArrow(run, "doc_id long, h long, node long, fp long, bands array<long>")


def fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) that connect what SimHash links: nodes (node, fp) of one fingerprint with the smallest, and the links between fingerprints."""
    least = cut(nodes.groupBy("fp").agg(F.min("node").alias("rep")), "fingerprints")
    alike = nodes.join(least, "fp").filter("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    return simhash.links(least).select("a", "b").unionByName(alike)


def _sets(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(1):
                own = shingles(x.as_py())
                node = np.array([node_of(own)], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array([own.view(np.int64)], pa.list_(pa.int64()))], ["node", "own"])

    return docs.mapInArrow(run, "node long, own array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose sets share percent of their union."""
    left = sets.select(F.col("node").alias("a"), F.col("own").alias("x")).hint("merge")
    right = sets.select(F.col("node").alias("b"), F.col("own").alias("y")).hint("merge")
    both = pairs.join(left, "a").join(right, "b").filter(f"100 * least(size(x), size(y)) >= {percent} * greatest(size(x), size(y))")
    shared = F.size(F.array_intersect("x", "y"))
    return both.withColumn("n", shared).filter(f"100 * n >= {percent} * (size(x) + size(y) - n)").select("a", "b")


def _shared(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    n = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * n >= percent * (len(x) + len(y) - n)


def forest(nodes: list[int], roots: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Verified links (node, node) that connect what all links between members of different roots connect: fewer than there are roots.

    A prefix filter, exact: two sets that share enough also share one of their rarest shingles, at places that their sizes bound. So members whose own
    edits are too many to link with anything meet nothing, and members that are connected already are passed over together.
    """
    up = {r: r for r in roots}

    def find(r: int) -> int:
        while up[r] != r:
            up[r] = up[up[r]]
            r = up[r]
        return r

    out: list[tuple[int, int]] = []
    need = lambda m, n: -(-percent * (m + n) // (100 + percent))
    order = sorted((k for k in range(len(nodes)) if len(sets[k])), key=lambda k: len(sets[k]))

    def link(x: int, y: int) -> bool:
        if 100 * len(sets[y]) < percent * len(sets[x]) or not _shared(sets[x], sets[y], percent):
            return False
        up[find(roots[x])] = find(roots[y])
        out.append((nodes[x], nodes[y]))
        return True

    if len(nodes) <= FEW:
        for x, y in itertools.combinations(reversed(order), 2):
            if find(roots[x]) != find(roots[y]):
                link(x, y)
        return out
    _, at, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(often), np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(often))
    ends = np.cumsum([len(x) for x in sets])
    #: Of a shingle: [a member's root, the members of that root with their places], smaller sets first.
    met: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    for x in order:
        size = len(sets[x])
        least = -(-percent * size // 100)
        first = size - least + 1
        own = rank[at[ends[x] - size : ends[x]]]
        own = np.sort(np.partition(own, first - 1)[:first]).tolist()
        tried: set[int] = set()
        for i, token in enumerate(own):
            if i > size - need(size, least):
                break
            for root, members in met.get(token, ()):
                if find(root) == find(roots[x]) or i > size - need(size, max(least, len(sets[members[0][0]]))):
                    continue
                for y, j in members:
                    other = len(sets[y])
                    if y in tried or other < least or max(i - size, j - other) > -need(size, other):
                        continue
                    tried.add(y)
                    if link(x, y):
                        break
        for i, token in enumerate(own[: size - need(size, size) + 1]):
            lists = met.setdefault(token, [])
            mine = next((m for r, m in lists if find(r) == find(roots[x])), None)
            if mine is None:
                lists.append((roots[x], mine := []))
            mine.append((x, i))
    return out


def _across(percent: int):
    """Links between members of different classes of a bucket; its rows (c, key, node, root, own) follow one another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                own, off = b.column(4).values.to_numpy(zero_copy_only=False), b.column(4).offsets.to_numpy()
                yield from zip(*(b.column(k).to_pylist() for k in range(4)), (own[i:j] for i, j in itertools.pairwise(off)), strict=True)

        for _, members in itertools.groupby(rows(), lambda r: r[:2]):
            _, _, nodes, roots, sets = zip(*members, strict=True)
            if found := forest(list(nodes), list(roots), list(sets), percent):
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def _classed(docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """Rows (doc_id, h, component_id, first): one per document, h a hash of its text, first the first row's (no id, id, h) of its class."""
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("text")).withColumn("h", text_hash("text"))
    prints = cut(_prints(base), "minima")
    own = F.struct(F.col("doc_id").isNull().alias("bare"), F.coalesce("doc_id", F.lit(0)).alias("id"), "h")
    distinct = cut(prints.groupBy("node").agg(F.min(own).alias("rep"), F.min("fp").alias("fp"), F.first("bands").alias("bands")), "nodes")
    keys = distinct.select("node", F.posexplode("bands").alias("c", "key"))
    buckets_ = cut(keys.groupBy("c", "key").agg(F.count("*").alias("n"), F.min("node").alias("low")).filter("n > 1"), "buckets")
    shared = cut(keys.join(buckets_, ["c", "key"]), "shared")
    linked = cut(fingerprint_pairs(distinct.select("node", "fp")), "linked")
    wanted = shared.select("node").union(linked.select("a")).union(linked.select("b")).distinct()
    reps = distinct.join(wanted, "node", "left_semi").select("rep.*")
    same = (F.coalesce(base["doc_id"], F.lit(0)) == reps["id"]) & (base["doc_id"].isNull() == reps["bare"]) & (base["h"] == reps["h"])
    sets = cut(_sets(base.join(reps.hint("merge"), same, "left_semi").select("doc_id", "text")).groupBy("node").agg(F.first("own").alias("own")), "sets")

    lows = shared.filter("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b"))
    stars = cut(_verified(linked.unionByName(lows).distinct(), sets, percent), "stars")
    roots = components(stars)
    rooted = cut(
        shared.filter("n > 2").join(roots, "node", "left").select("c", "key", "node", F.coalesce("root", "node").alias("root")), "rooted"
    )
    apart = rooted.groupBy("c", "key").agg(F.min("root").alias("m"), F.max("root").alias("x")).filter("m <> x").select("c", "key")
    # Sets are sent to their buckets, sorted, and links are verified there: no pairs are formed.
    buckets = rooted.join(apart, ["c", "key"]).join(sets, "node").select("c", "key", "node", "root", "own").repartition("c", "key").sortWithinPartitions("c", "key")
    across = cut(buckets.mapInArrow(_across(percent), "a long, b long").distinct(), "across")
    ends = components(stars.unionByName(across))
    for done in (buckets_, shared, linked, sets, stars, rooted, across):
        discard(done)
    classes = distinct.join(ends, "node", "left").select("node", "rep", F.coalesce("root", "node").alias("root"))
    named = with_least(classes, "root", "rep", "first").select("node", "first")
    return prints.select("doc_id", "h", "node").join(named, "node", "left").select(
        "doc_id", "h", F.when(~F.col("first.bare"), F.col("first.id")).alias("component_id"), "first"
    )


def text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """Rows (doc_id, component_id): the classes of documents linked by a similarity of percent or more.

    Documents with equal shingles are one node. Candidates are the links of the SimHash operator and, as pairs at 80 percent mostly differ in more bits
    than it allows, nodes that share a MinHash band; each is verified. Nodes that share a band are a bucket, whose
    members are verified against one of them; then only members of classes that are still apart are looked for
    by a prefix filter, so a group of near copies costs no pairs. component_id is the smallest doc_id reachable.

    A null or empty text and one of white space have no shingles and are alike; a very long text is one set of 8 bytes a shingle. A row without an id
    belongs to its class like any other, but gives it no name: a class of such rows only has a null component_id. A repeated id yields its rows again, each by
    its own text. An empty table gives no rows; other columns are not read.
    """
    return _classed(docs, id_col, text_col, percent).select("doc_id", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """docs with one row of each class of near_duplicates: the one with the smallest id, and of that id's texts the one with the smallest hash.

    Rows are told apart by id and text, so another text of an id that goes stays. Of rows equal in both one stays, the least by its other
    columns. Rows without an id come last in their class. All columns stay, whatever their names. An empty table stays empty.
    """
    found = cut(_classed(docs, id_col, text_col, percent).groupBy("doc_id", "h", "first").agg(F.count("*").alias("n")), "classes")
    own = F.struct(F.col("doc_id").isNull().alias("bare"), F.coalesce("doc_id", F.lit(0)).alias("id"), "h")
    # Most rows stand alone and need no row here; texts are never shuffled to a table by broadcast, so the cost stays in proportion.
    gone = found.filter(own != F.col("first")).select("doc_id", "h")
    again = found.filter((F.col("n") > 1) & (own == F.col("first"))).select("doc_id", "h")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), text_hash(f"`{text_col}`").alias("g"))
    here = lambda t: (F.coalesce(rows["id"], F.lit(0)) == F.coalesce(t["doc_id"], F.lit(0))) & (rows["id"].isNull() == t["doc_id"].isNull()) & (rows["g"] == t["h"])
    marked = gone.withColumn("again", F.lit(False)).unionByName(again.withColumn("again", F.lit(True))).hint("merge")
    back = rows.join(marked, here(marked), "left").select("row", "id", "g", "again")
    alone = back.filter("again is null").select("row")
    least = back.filter("again").groupBy("id", "g").agg(F.min("row").alias("row")).select("row")
    return alone.unionByName(least).select(*[F.col("row")[c].alias(c) for c in docs.columns])
