"""Token counts by a linear longest-match automaton: word-piece lengths without the pieces."""

from __future__ import annotations

import json
import pickle
import re
import uuid
from collections import deque
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import publish
from docloom.llm.tokens import _byte_letters

#: Chunks whose counts a worker keeps, and bytes of such a chunk.
MEMO, LONGEST = 500_000, 64
#: Bytes of a vocabulary that is broadcast, at most; a larger one travels as a file that each machine fetches once.
VOCABULARY_BYTES = 64 << 20
#: Stands behind the last byte of a word.
END = 256

_FIELD = 40
_MASK = (1 << _FIELD) - 1
#: Words of a lower-cased text: letters (all beyond ASCII count as such), digits, or one sign.
_WORDS = re.compile(rb"[a-z\x80-\xff]+|[0-9]+|[^a-z0-9\x80-\xff]").findall


class Automaton:
    """A trie of the vocabulary with failure links and popped-token counts (Song et al., 2021).

    Pieces that begin a word hang from node 0, those that continue one from node 1. Where a
    node has no way on, the tokens of its path that are certain by then are popped: pops
    has their number, fail the node that stands for the rest. So a word takes time linear in its length,
    while the greedy search that it equals takes quadratic time.

    Pieces of last end a word and match nowhere else: a sign behind each word is their last symbol. The sign alone is a
    piece that counts nothing, so any piece may end a word too, and of equally long ones it doesn't matter which.
    """

    def __init__(self, begin: Iterable[bytes], go_on: Iterable[bytes] | None = None, last: Iterable[bytes] = ()) -> None:
        begin, last = set(begin) - {b""}, set(last) - {b""}
        go_on = begin if go_on is None else set(go_on) - {b""}
        self.next: list[dict[int, int]] = [{}, {}]
        ends: dict[int, int] = {}

        def add(root: int, piece: Iterable[int], tokens: int) -> None:
            at = root
            for c in piece:
                to = self.next[at].get(c)
                if to is None:
                    to = self.next[at][c] = len(self.next)
                    self.next.append({})
                at = to
            ends[at] = tokens

        for root, pieces in ((0, begin), (1, go_on)):
            for piece in pieces:
                add(root, piece, 1)
            for piece in last:
                add(root, (*piece, END), 1)
        add(1, (END,), 0)
        self.fail = [-1] * len(self.next)
        self.pops = [0] * len(self.next)
        queue = deque([0, 1])
        while queue:
            u = queue.popleft()
            for c, v in self.next[u].items():
                queue.append(v)
                if v in ends:
                    self.fail[v], self.pops[v] = 1, ends[v]
                    continue
                z, n = self.fail[u], self.pops[u]
                while z >= 0 and c not in self.next[z]:
                    n += self.pops[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[v], self.pops[v] = self.next[z][c], n

    def count(self, word: bytes) -> int:
        """Pieces of a word by greedy longest match; 0 if it can't be cut into pieces."""
        u, n = 0, 0
        for c in (*word, END):
            while c not in self.next[u]:
                if self.fail[u] < 0:
                    return 0
                n += self.pops[u]
                u = self.fail[u]
            u = self.next[u][c]
        while u > 1:
            if self.fail[u] < 0:
                return 0
            n += self.pops[u]
            u = self.fail[u]
        return n


def vocabulary(path: str) -> tuple[list[bytes], list[bytes]]:
    """The pieces of a byte-level vocabulary file as bytes, without special tokens: those that go anywhere, and those marked as a word's end."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    special = {t["content"] for t in made.get("added_tokens", [])}
    back = {c: b for b, c in _byte_letters().items()}
    mark = made["model"].get("end_of_word_suffix") or "\0"
    plain = [t for t in made["model"]["vocab"] if t not in special]
    as_bytes = lambda pieces: sorted(bytes(back[c] for c in p) for p in pieces if p and all(c in back for c in p))
    return as_bytes(t for t in plain if not t.endswith(mark)), as_bytes(t.removesuffix(mark) for t in plain if t.endswith(mark))


_BUILT: dict[str, Automaton] = {}


def _send(spark: SparkSession, value: tuple, limit: int) -> Callable[[], tuple]:
    """How a worker gets a value: by broadcast, or beyond limit bytes from a file that each machine fetches."""
    data = pickle.dumps(value)
    if len(data) <= limit:
        sent = spark.sparkContext.broadcast(value)
        return lambda: sent.value
    name = publish(spark, data, "vocabulary")

    def load() -> tuple:
        with open(SparkFiles.get(name), "rb") as f:
            return pickle.load(f)

    return load


def count_tokens(
    docs: DataFrame, pieces: list[bytes], id_col: str = "doc_id", text_col: str = "text", go_on: list[bytes] | None = None, last: list[bytes] = (), limit: int = VOCABULARY_BYTES
) -> DataFrame:
    """Rows (doc_id, n_bytes, n_words, n_tokens, n_unknown): one per document.

    A-Z are lower-cased; runs of letters, runs of digits and single signs are words. A word's
    tokens are the longest pieces from its left, as many as the automaton counts; a word
    that the pieces can't make up is one unknown token. go_on lists the pieces that continue a word, if
    they differ, last those that only end one. The vocabulary is sent to each worker, which builds the automaton once.
    Nothing is shuffled.

    A null or empty text counts as empty: all zero. A very long text is counted whole, in one task. Null or repeated ids and repeated
    rows give their own rows; an empty table gives none; other columns are not read.
    """
    key = uuid.uuid4().hex
    sent = _send(docs.sparkSession, (pieces, go_on, last), limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _BUILT.get(key)
        if machine is None:
            _BUILT.clear()
            machine = _BUILT[key] = Automaton(*sent())

        class Memo(dict):
            """Tokens, words and unknown words of a chunk, each in a field of an integer."""

            def __missing__(self, chunk: bytes) -> int:
                total = 0
                for w in _WORDS(chunk):
                    n = machine.count(w)
                    total += (n or 1) + (1 << _FIELD) + ((not n) << 2 * _FIELD)
                if len(self) < MEMO and len(chunk) <= LONGEST:
                    self[chunk] = total
                return total

        known = Memo().__getitem__
        for b in batches:
            texts = [x.as_py() or b"" for x in b.column(1)]
            sums = [sum(map(known, t.lower().split())) for t in texts]
            cols = [[len(t) for t in texts], [s >> _FIELD & _MASK for s in sums], [s & _MASK for s in sums], [s >> 2 * _FIELD for s in sums]]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols)], ["doc_id", "n_bytes", "n_words", "n_tokens", "n_unknown"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(
        run, "doc_id long, n_bytes long, n_words long, n_tokens long, n_unknown long"
    )
