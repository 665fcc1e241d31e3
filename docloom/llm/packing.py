"""Packing documents into training sequences of balanced attention cost."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.tokens import encoder

LENGTH = 2048
END_ID = 1
#: Tokens that a worker packs together, about.
GROUP_TOKENS = 1 << 21
#: Cost of a piece of n tokens: n + n * n / QUADRATIC_AT, so both terms are equal at that length.
QUADRATIC_AT = 1024

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double, sequence_cost double"


def cost(n: int) -> float:
    return n + n * n / QUADRATIC_AT


def pack(sizes: list[int], length: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents with these token counts.

    As many sequences are opened as the tokens need. Whole sequences are cut off long
    documents first. What is left goes in descending order to the sequence of the lowest
    cost that has room; what fits nowhere whole is cut at the sequence with the most room.
    So all sequences of a group are full but for the room of one.
    """
    out, rest, at = [], [], 0
    for d, n in enumerate(sizes):
        full = n // length
        for k in range(full):
            out.append((d, k * length, length, at, 0))
            at += 1
        if n % length:
            rest.append((n % length, d, full * length))
    total = sum(r[0] for r in rest)
    n_seq = -(-total // length)
    if not n_seq:
        return out
    room = np.full(n_seq, length)
    spent = np.zeros(n_seq)
    for n, d, start in sorted(rest, key=lambda r: (-r[0], r[1])):
        while n:
            fits = room >= n
            if fits.any():
                s = int(np.where(fits, spent, np.inf).argmin())
                take = n
            else:
                s = int(room.argmax())
                take = int(room[s])
            out.append((d, start, take, at + s, length - int(room[s])))
            room[s] -= take
            spent[s] += cost(take)
            n, start = n - take, start + take
    return out


def pack_documents(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID, group_tokens: int = GROUP_TOKENS
) -> DataFrame:
    """Rows for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, its cost and its sequence's.

    Each task packs the documents of its partition in groups of about group_tokens, in
    order of their tokens, so nothing is shuffled, memory is bounded by a group and the
    longest document, and a repeated task gives the same rows for the same partition.
    sequence_id has the partition in its upper bits. A null or empty text has one token, the end id. A very long
    text fills sequences of its own and its rest is packed like a document; those sequences cost the most that one can, whatever
    else is balanced. Documents of equal length are dealt in the order they stand in. A null id is kept; repeated ids and rows are packed apiece. An empty table
    yields no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(tokenizer)
        base = TaskContext.get().partitionId() << 40
        ids: list = []
        tokens: list[np.ndarray] = []
        held = done = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, done
            rows = pack([len(t) for t in tokens], length)
            spent = np.bincount([r[3] for r in rows], [cost(r[2]) for r in rows])
            cols = [
                [ids[d] for d, *_ in rows], [r[1] for r in rows], [r[2] for r in rows],
                [zlib.crc32(tokens[d][s : s + n].tobytes()) for d, s, n, _, _ in rows],
                [len(tokens[d]) for d, *_ in rows], [base + done + r[3] for r in rows], [r[4] for r in rows],
            ]
            done += 1 + max((r[3] for r in rows), default=-1)
            batch = pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.array([cost(r[2]) for r in rows], pa.float64()), pa.array([spent[r[3]] for r in rows], pa.float64())], [f.split()[0] for f in SCHEMA.split(", ")])
            ids.clear()
            tokens.clear()
            held = 0
            return batch

        end = np.array([end_id], "<u4")
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                t = np.concatenate([encode(text.as_py()), end])
                ids.append(i)
                tokens.append(t)
                held += len(t)
                if held >= group_tokens:
                    yield flush()
        if ids:
            yield flush()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, SCHEMA)
