"""Token files of directly addressable codes: any token is read without decoding a block.

An id is cut into chunks of CHUNK_BITS bits, lowest first. Level k holds the k-th chunk of
every id that has one, and a bitmap that tells which of them continue on level k + 1. A rank
directory counts the continuing ones before each 512 bits of the bitmap, so the place of an
id's next chunk is found by one table entry and the bits of one word group (Brisaboa, Ladra
and Navarro, 2013).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.tokens import encoder

MAGIC = b"DAC1"
RANK_BITS = 512
#: Tokens of a segment, about.
SEGMENT_TOKENS = 1 << 20


def encode_codes(ids: np.ndarray) -> bytes:
    """A segment: magic, ids, levels; for each level its size, chunks, bitmap and rank directory."""
    rest = np.asarray(ids, "<u4")
    levels = []
    while True:
        more = rest > 0xFF
        last = not more.any()
        chunks = (rest & 0xFF).astype(np.uint8).tobytes()
        if last:
            levels.append(struct.pack("<QB", len(rest), 0) + chunks)
            break
        padded = np.zeros(-(-len(more) // RANK_BITS) * RANK_BITS, bool)
        padded[: len(more)] = more
        ranks = np.concatenate([[0], np.cumsum(padded.reshape(-1, RANK_BITS).sum(axis=1))]).astype("<u4")
        levels.append(struct.pack("<QB", len(rest), 1) + chunks + np.packbits(padded, bitorder="little").tobytes() + ranks.tobytes())
        rest = rest[more] >> 8
    return MAGIC + struct.pack("<QB", len(ids), len(levels)) + b"".join(levels)


class Codes:
    """A view of a segment's bytes; len(), [i] and slice(start, stop) read only what they need."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != MAGIC:
            raise ValueError("not a segment of token codes")
        self.size, n_levels = struct.unpack_from("<QB", data, 4)
        at = 13
        self.levels: list[tuple] = []
        for _ in range(n_levels):
            n, more = struct.unpack_from("<QB", data, at)
            at += 9
            chunks = np.frombuffer(data, np.uint8, n, at)
            at += n
            bits = ranks = None
            if more:
                blocks = -(-n // RANK_BITS)
                bits = np.frombuffer(data, np.uint8, blocks * RANK_BITS // 8, at)
                at += len(bits)
                ranks = np.frombuffer(data, "<u4", blocks + 1, at)
                at += 4 * (blocks + 1)
            self.levels.append((chunks, bits, ranks))

    def __len__(self) -> int:
        return self.size

    @staticmethod
    def _rank(bits: np.ndarray, ranks: np.ndarray, i: int) -> int:
        """Continuing chunks before place i."""
        block = i // RANK_BITS
        first = block * RANK_BITS // 8
        whole = int(np.bitwise_count(bits[first : i // 8]).sum())
        part = int(bits[i // 8] & ((1 << i % 8) - 1)).bit_count() if i % 8 else 0
        return int(ranks[block]) + whole + part

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.size:
            raise IndexError(i)
        value = shift = 0
        for chunks, bits, ranks in self.levels:
            value |= int(chunks[i]) << shift
            shift += 8
            if bits is None or not bits[i // 8] >> i % 8 & 1:
                break
            i = self._rank(bits, ranks, i)
        return value

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop, in one pass over their chunks."""
        start, stop = max(0, start), min(stop, self.size)
        out = np.zeros(max(0, stop - start), "<u4")
        where = slice(None)
        shift = 0
        for chunks, bits, ranks in self.levels:
            if stop <= start:
                break
            out[where] |= chunks[start:stop].astype(np.uint32) << np.uint32(shift)
            shift += 8
            if bits is None:
                break
            first = start // 8
            more = np.unpackbits(bits[first : -(-stop // 8)], bitorder="little")[start - 8 * first : stop - 8 * first].astype(bool)
            where = np.flatnonzero(more) if isinstance(where, slice) else where[more]
            start = self._rank(bits, ranks, start) if start < len(chunks) else 0
            stop = start + int(more.sum())
        return out


WRITTEN = "part int, segment int, before long, doc_ids array<long>, ends array<long>, codes binary"


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", segment_tokens: int = SEGMENT_TOKENS, partitions: int | None = None) -> None:
    """Write the ids of all documents, each with end_id appended, in ascending doc_id order.

    The file set is a table of segments: part and segment give the order, before the ids
    of the part before it, doc_ids and ends the documents and where they end, codes the
    directly addressable ids. Documents are dealt by ranges of doc_id before they are
    encoded, so texts are encoded once and no task holds more than a segment, a longest
    document and its sort's buffers. Spark's commit makes a repeated task harmless.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(tokenizer)
        part = TaskContext.get().partitionId()
        end = np.array([end_id], "<u4")
        ids, ends, parts = [], [], []
        held = before = segment = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, before, segment
            row = [[part], [segment], [before], [ids[:]], [ends[:]], [encode_codes(np.concatenate(parts))]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            before, segment, held = before + held, segment + 1, 0
            for x in (ids, ends, parts):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], ["part", "segment", "before", "doc_ids", "ends", "codes"])

        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                t = encode(text.as_py())
                parts += [t, end]
                held += len(t) + 1
                ids.append(i)
                ends.append(held)
                if held >= segment_tokens:
                    yield flush()
        if ids:
            yield flush()

    (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
        .repartitionByRange(n, F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first())
        .mapInArrow(run, WRITTEN)
        .write.option("compression", "uncompressed")
        .parquet(path)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) from written files, by random access to each document.

    start counts the ids of all documents before it. The driver holds one number for each
    part, of which there are as many as partitions written.
    """
    table = spark.read.schema(WRITTEN).parquet(path)
    totals = {r["part"]: r["n"] for r in table.groupBy("part").agg(F.sum(F.element_at("ends", -1)).alias("n")).collect()}
    base, at = {}, 0
    for part in sorted(totals):
        base[part] = at
        at += totals[part]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, before, ids, ends, codes in zip(*(b.column(j) for j in range(5)), strict=True):
                c = Codes(codes.as_py())
                stops = np.array(ends.as_py(), np.int64)
                starts = np.concatenate([[0], stops[:-1]])
                crc = [zlib.crc32(c.slice(s, e).tobytes()) for s, e in zip(starts.tolist(), stops.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids.as_py(), pa.int64()), pa.array(starts + before.as_py() + base[part.as_py()]), pa.array(stops - starts), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return table.select("part", "before", "doc_ids", "ends", "codes").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokens_at(spark: SparkSession, path: str, doc_id: int, start: int, stop: int) -> list[int]:
    """Ids start to stop of one document: only segments that hold it are read."""
    rows = spark.read.schema(WRITTEN).parquet(path).filter(F.array_contains("doc_ids", doc_id)).limit(1).collect()
    if not rows:
        return []
    k = rows[0]["doc_ids"].index(doc_id)
    first = rows[0]["ends"][k - 1] if k else 0
    return Codes(rows[0]["codes"]).slice(first + start, min(first + stop, rows[0]["ends"][k])).tolist()
