"""SimHash near-duplicates: pigeonhole blocks, verified by Hamming distance."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import components, cut

SHINGLE = 4
SEED = 42
MAX_BITS = 4
#: A bucket with more fingerprints than this is linked through midpoints.
BUCKET = 2048
#: Fingerprints are cut into this many blocks; a bucket shares BLOCKS - MAX_BITS of them.
BLOCKS = 6
_CHUNK = 1 << 16


def simhash(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit fingerprint of a UTF-8 text, as an unsigned integer.

    A-Z are lower-cased and words are runs without ASCII white space. Fewer words than a
    shingle make one shingle; no words make fingerprint zero. Shingles are hashed in
    chunks, so a text of any length needs bounded memory beyond its words.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams: Iterator[bytes] = iter([b" ".join(words)])
        n = 1
    else:
        grams = map(b" ".join, zip(*(itertools.islice(words, k, None) for k in range(shingle)), strict=False))
        n = len(words) - shingle + 1
    ones = np.zeros(64, np.int64)
    hashes = map(xxhash.xxh64_intdigest, grams, itertools.repeat(seed))
    for at in range(0, n, _CHUNK):
        size = min(_CHUNK, n - at)
        h = np.fromiter(itertools.islice(hashes, size), np.uint64, size)
        bits = np.unpackbits(h.astype("<u8").view(np.uint8), bitorder="little").reshape(size, 64)
        ones += np.add.reduceat(bits, np.arange(0, size, 255), axis=0).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id long, fp long) of all documents; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((simhash(x.as_py()) for x in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")
    ).mapInArrow(run, "doc_id long, fp long")


def block_masks(blocks: int = BLOCKS, max_bits: int = MAX_BITS) -> list[int]:
    """A mask for each choice of blocks - max_bits blocks, as signed 64-bit integers.

    max_bits differing bits touch at most max_bits blocks, so close fingerprints agree
    under one mask at least.
    """
    ends = [round(64 * k / blocks) for k in range(blocks + 1)]
    part = [((1 << ends[k + 1]) - (1 << ends[k])) for k in range(blocks)]
    masks = [sum(c) for c in itertools.combinations(part, blocks - max_bits)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _forest(fps: np.ndarray, reps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, smallest member of its part) of the links within a bucket."""
    if len(fps) == 2:
        if (int(fps[0]) ^ int(fps[1])).bit_count() > max_bits:
            return reps[:0], reps[:0]
        return reps.max(keepdims=True), reps.min(keepdims=True)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= max_bits
    label = reps.copy()
    while True:
        new = np.where(near, label[None, :], np.iinfo(np.int64).max).min(axis=1)
        if (new == label).all():
            break
        label = new
    own = label != reps
    return reps[own], label[own]


def links(distinct: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between rep ids that connect what links of distinct (fp, rep) connect.

    Fingerprints are joined on blocks. Within a bucket the links are verified by Hamming
    distance and only a spanning forest is returned, not the pairs. Members of a bucket
    beyond `bucket` fingerprints are instead joined on midpoints: two fingerprints
    differ in at most 2k bits exactly if some value lies within k bits of both. That
    costs each such member a fixed number of rows and covers all links among them.
    """
    keys = distinct.select(
        "fp", "rep", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in block_masks(blocks, max_bits)])).alias("c", "key")
    )
    counts = cut(keys.groupBy("c", "key").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    shared = keys.join(counts, ["c", "key"])
    small = (
        shared.filter(F.col("n") <= bucket)
        .groupBy("c", "key")
        .agg(F.collect_list("fp").alias("fps"), F.collect_list("rep").alias("reps"))
        .select("fps", "reps")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, r = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            off, fps = b.column(0).offsets.to_numpy(), b.column(0).values.to_numpy()
            reps = b.column(1).values.to_numpy()[b.column(1).offsets[0].as_py() :]
            base = off[0]
            for i, j in itertools.pairwise(off):
                x, y = _forest(fps[i:j].view(np.uint64), reps[i - base : j - base], max_bits)
                if len(x):
                    a.append(x)
                    r.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(r))], ["a", "b"])

    edges = small.mapInArrow(run, "a long, b long").distinct()
    if counts.filter(F.col("n") > bucket).limit(1).count():
        hot = shared.filter(F.col("n") > bucket).select("fp", "rep").distinct()
        edges = edges.unionByName(_midpoint_edges(hot, max_bits)).distinct()
    return edges


def _midpoint_edges(hot: DataFrame, max_bits: int) -> DataFrame:
    """Edges that connect fingerprints within max_bits through shared midpoints.

    Each fingerprint spreads over all values within ceil(max_bits / 2) bits; for an odd
    limit the ball on one side is smaller by one bit, which the distance column tells.
    """
    far, near = (max_bits + 1) // 2, max_bits // 2
    flips = [0]
    reach = [0]
    for k in range(1, far + 1):
        for bits in itertools.combinations(range(64), k):
            v = sum(1 << x for x in bits)
            flips.append(v - (1 << 64) if v >> 63 else v)
            reach.append(k)
    spread = hot.select(
        "rep", F.posexplode(F.array(*[F.lit(v).cast("long") for v in flips])).alias("i", "flip"), "fp"
    ).select("rep", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid"), F.when(F.col("i") < reach.count(0) + sum(r in range(1, near + 1) for r in reach), 0).otherwise(1).alias("outer"))
    if far == near:
        low = spread.groupBy("mid").agg(F.min("rep").alias("b"), F.count("*").alias("n")).filter("n > 1")
        return spread.join(low, "mid").select(F.col("rep").alias("a"), "b").filter("a <> b").distinct()
    low = spread.filter("outer = 0").groupBy("mid").agg(F.min("rep").alias("b"))
    return spread.join(low, "mid").select(F.col("rep").alias("a"), "b").filter("a <> b").distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS, blocks: int = BLOCKS, bucket: int = BUCKET
) -> DataFrame:
    """Rows (doc_id, fp long, component_id): the classes of documents linked by fingerprints.

    Copies are reduced to one fingerprint before any join. component_id is the smallest
    doc_id reachable. A null id takes part in nothing and gets a null component; a
    repeated id yields its rows again; an empty table yields no rows. Other columns are
    not read. Short and empty texts are linked like any other.
    """
    prints = cut(fingerprints(docs, id_col, text_col), "prints")
    distinct = cut(prints.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    roots = components(links(distinct, max_bits, blocks, bucket))
    classes = distinct.join(roots, distinct["rep"] == roots["node"], "left").select(
        "fp", F.coalesce("root", "rep").alias("component_id")
    )
    return prints.join(classes, "fp", "left").select(
        "doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    )
