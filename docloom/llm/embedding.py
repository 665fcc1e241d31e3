"""Embedding near-duplicates: spherical k-means cells, blocked cosine products within them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from docloom.llm.common import components, cut

THRESHOLD = 0.9
#: Vectors that the cells are fitted on, at most (about; rows are drawn by hash).
FIT_ROWS = 20_000
MAX_CELLS = 4096
#: Cells that a vector is compared in, its own included.
PROBES = 8
#: Rows of a block, at least and at most: a task holds two blocks, however large a cell is.
BLOCK, MAX_BLOCK = 256, 8192
#: Cosines that a worker holds at once.
STRIP = 1 << 20


def _unit(values: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision; scaled by their maximum first."""
    v = values.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _valid(values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a list array: lengths (0 where a vector links with nothing), offsets, flat values."""
    flat = values.values.to_numpy(zero_copy_only=False).astype(np.float64)
    off = values.offsets.to_numpy().astype(np.int64)
    size = np.diff(off)
    size[values.is_null().to_numpy(zero_copy_only=False)] = 0
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    nonzero = np.concatenate([[0], np.cumsum(flat != 0)])
    ok = (bad[off[1:]] == bad[off[:-1]]) & (nonzero[off[1:]] > nonzero[off[:-1]])
    return np.where(ok, size, 0), off, flat


def fit_cells(rows: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centres (k x d, unit length) of spherical k-means; starts from evenly spaced rows."""
    x = _unit(rows)
    k = min(k, len(x))
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        norm = np.sqrt((total * total).sum(axis=1, keepdims=True))
        c = np.where(norm > 1e-12, total / np.maximum(norm, 1e-12), c)
    return c


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = THRESHOLD,
    fit_rows: int = FIT_ROWS,
    cells: int | None = None,
    probes: int = PROBES,
    block: int = BLOCK,
) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept): one per input row.

    Cells are fitted on about fit_rows vectors of the commonest length, drawn by a hash
    of the id; every vector is indexed. A vector has a home cell and visits the next
    probes - 1 cells; it is compared with all members of each, in blocks. A pair that two
    cells see counts in the lower one. Pairs whose homes are farther apart than the
    probes reach are missed (measured recall: README); none below the threshold is
    returned. A cell of any size is dealt out as pairs of blocks, so no task holds it.

    Equal vectors are merged before they are indexed, summed in each task first: a vector that
    a third of all rows share is compared once and its number weighs in the counts.
    Members find their vector again by two 64-bit hashes.

    Null, zero and non-finite vectors link with nothing, nor do vectors of different
    length or rows with a null id. Rows with equal ids are vectors of their own in the
    counts, and one vertex in the components. An empty table yields no rows.
    """
    # Single-precision components travel as such; they are widened where they are compared.
    kind = "<f4" if vectors.schema[vector_col].dataType == ArrayType(FloatType(), vectors.schema[vector_col].dataType.containsNull) else "<f8"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    usable = F.expr("vec_id is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(v, x -> x <> 0)")
    base = cut(rows.filter(usable).groupBy("v").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("weight")).select("vec_id", "v", "weight"), "vectors")
    n = base.count()
    share = min(1.0, fit_rows / max(n, 1))
    drawn = base.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    top = drawn.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if top is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    dim = top["d"]
    sample = drawn.filter(F.size("v") == dim).select("vec_id", F.col("v")).toArrow()
    order = np.argsort(sample.column(0).to_numpy(), kind="stable")
    fit = np.stack(sample.column(1).combine_chunks().values.to_numpy().reshape(-1, dim)[order])
    k = cells or max(1, min(MAX_CELLS, len(fit) // 8 + 1, math.isqrt(n) + 1))
    centres = fit_cells(fit, k)
    k = len(centres)
    reach = min(probes, k)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, off, flat = _valid(b.column(1))
            ids = b.column(0)
            weights = b.column(2)
            out: list[list] = [[], [], [], [], []]
            own = np.flatnonzero(size)
            same = own[size[own] == dim]
            for at in range(0, len(same), 2048):
                part = same[at : at + 2048]
                rows = flat[off[part][:, None] + np.arange(dim)]
                score = _unit(rows) @ centres.T
                best = np.argpartition(-score, reach - 1, axis=1)[:, :reach]
                best = np.take_along_axis(best, np.argsort(-np.take_along_axis(score, best, axis=1), axis=1, kind="stable"), axis=1)
                for i, r, p in zip(part, rows, best.astype("<i4"), strict=True):
                    raw, all_p = r.astype(kind).tobytes(), p.tobytes()
                    for c in p:
                        out[0].append(int(c))
                        out[1].append(ids[i].as_py())
                        out[2].append(all_p)
                        out[3].append(raw)
                        out[4].append(weights[i].as_py())
            for i in own[size[own] != dim]:  # vectors of another length: one cell for each length
                c = -int(size[i])
                out[0].append(c)
                out[1].append(ids[i].as_py())
                out[2].append(np.array([c], "<i4").tobytes())
                out[3].append(flat[off[i] : off[i + 1]].astype(kind).tobytes())
                out[4].append(weights[i].as_py())
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.binary()), pa.array(out[4], pa.int64())],
                ["cell", "vec_id", "probes", "raw", "weight"],
            )

    # At most one row for each cell (their number is bounded) tells into how many blocks it is cut, and so
    # does one for each other length that fills more than a block.
    per_cell = base.mapInArrow(lambda it: _cells_only(assign(it)), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    counts = {r["cell"]: r["n"] for r in per_cell.filter("cell >= 0").collect()}
    width = min(max(block, 2 * math.ceil(sum(counts.values()) / max(len(counts), 1))), max(block, MAX_BLOCK))
    counts |= {r["cell"]: r["n"] for r in per_cell.filter((F.col("cell") < 0) & (F.col("n") > width)).collect()}
    parts = {c: math.ceil(m / width) for c, m in counts.items() if m > width}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in assign(batches):
            cell, ids = b.column(0).to_numpy(), b.column(1).to_numpy()
            take, left, right, mine = [], [], [], []
            for row, (c, i) in enumerate(zip(cell.tolist(), ids.tolist(), strict=True)):
                t = parts.get(c, 1)
                x = (i * 0x9E3779B97F4A7C15 >> 20) % t
                for y in range(t):
                    take.append(row)
                    left.append(min(x, y))
                    right.append(max(x, y))
                    mine.append(x)
            some = b.take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(left, pa.int32()), pa.array(right, pa.int32()), pa.array(mine, pa.int32())], [*some.schema.names, "x", "y", "mine"])

    dealt = base.mapInArrow(deal, "cell int, vec_id long, probes binary, raw binary, weight long, x int, y int, mine int")
    tiles = dealt.groupBy("cell", "x", "y").agg(F.collect_list(F.struct("vec_id", "mine", "probes", "raw", "weight")).alias("rows"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids_out, n_out, low_out = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for cell, x, y, rows in zip(*(b.column(j).to_pylist() for j in range(3)), b.column(3), strict=True):
                ids, links, low = _tile(cell, x, y, rows.values, threshold, kind)
                ids_out.append(ids)
                n_out.append(links)
                low_out.append(low)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z)) for z in (ids_out, n_out, low_out)], ["vec_id", "n", "low"])

    found = cut(tiles.mapInArrow(compare, "vec_id long, n long, low long"), "links")
    roots = components(found.select(F.col("vec_id").alias("a"), F.col("low").alias("b")))
    linked = found.groupBy("vec_id").agg(F.sum("n").alias("n")).join(roots, F.col("vec_id") == F.col("node"), "left").select(F.col("vec_id").alias("rep"), "n", "root")
    # Most vectors stand alone and link with nothing: they need no row here.
    known = (
        base.join(linked, F.col("vec_id") == F.col("rep"), "left")
        .filter("weight > 1 or n is not null")
        .select(*_keys(), (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n"), F.coalesce("root", "vec_id").alias("root"))
    )
    known = cut(known, "known").hint("merge")
    return (
        rows.select("vec_id", *[F.when(usable, k).alias(f"_{name}") for k, name in zip(_keys(), ("h", "g"), strict=True)])
        .join(known, (F.col("_h") == F.col("h")) & (F.col("_g") == F.col("g")), "left")
        .select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )


def _keys() -> list[Column]:
    return [F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), "v").alias("g")]


def _cells_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        c, n = np.unique(b.column(0).to_numpy(), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(n, pa.int64())], ["cell", "n"])


def _merge(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Give linked rows one root, the lowest; parent points to roots before and after."""
    while True:
        a, b = parent[i], parent[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (parent[parent] != parent).any():
            parent[:] = parent[parent]


def _tile(cell: int, x: int, y: int, rows: pa.StructArray, threshold: float, kind: str = "<f8") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a pair of blocks of a cell: ids with links, their number here, the smallest id reachable here.

    Cosines are formed a strip at a time, so dense blocks need no more memory than sparse ones.
    """
    rows = rows.take(pa.array(np.argsort(rows.field("vec_id").to_numpy(), kind="stable")))
    ids, mine, weight = (rows.field(c).to_numpy() for c in ("vec_id", "mine", "weight"))
    probes = [np.frombuffer(p, "<i4") for p in rows.field("probes").to_pylist()]
    v = _unit(np.stack([np.frombuffer(r, kind) for r in rows.field("raw").to_pylist()]))
    wide = max(map(len, probes))
    none = np.iinfo(np.int32).max
    seen = np.stack([np.pad(p, (0, wide - len(p)), constant_values=none) for p in probes])
    left, right = np.flatnonzero(mine == x), np.flatnonzero(mine == y)
    n, parent = np.zeros(len(ids), np.int64), np.arange(len(ids))
    step = max(1, STRIP // max(len(right), 1))
    for start in range(0, len(left), step):
        i, j = np.nonzero(v[left[start : start + step]] @ v[right].T >= threshold)
        i, j = left[start + i], right[j]
        keep = i < j if x == y else ids[i] != ids[j]
        i, j = i[keep], j[keep]
        # Both members of a pair may share several cells; the lowest counts it.
        here = np.empty(len(i), bool)
        for at in range(0, len(i), 1 << 16):
            p, q = seen[i[at : at + (1 << 16)]], seen[j[at : at + (1 << 16)]]
            here[at : at + len(p)] = np.where((p[:, :, None] == q[:, None, :]).any(axis=2), p, none).min(axis=1) == cell
        i, j = i[here], j[here]
        np.add.at(n, i, weight[j])
        np.add.at(n, j, weight[i])
        _merge(parent, i, j)
    own = np.flatnonzero(n)
    return ids[own], n[own], ids[parent[own]]
