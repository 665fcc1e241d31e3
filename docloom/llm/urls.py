"""URL filters: a sorted array of 64-bit digests, memory-mapped and confirmed on the stored strings."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from docloom.llm.common import publish

MAGIC = b"URLDIGS1"
#: Bytes of one index file, about; a larger list is cut into several, by digest, and each is searched for the digests in its range.
INDEX_BYTES = 1 << 30


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ://."""
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), upper, lower)
    return host, F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)


def _cut_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host, slash + path


def build_indexes(rules: Iterable[tuple[str, str]], index_bytes: int = INDEX_BYTES) -> list[bytes]:
    """Index files of (rule, verdict) in order of digest, each of about index_bytes at most. Of a rule given twice the last verdict holds."""
    rows = sorted((xxhash.xxh64_intdigest(r.encode()), r.encode(), v) for r, v in dict(rules).items())
    parts, held = [[]], 0
    for row in rows:
        size = len(row[1]) + 17
        # Equal digests stay in one file, so a digest is looked up in one.
        if parts[-1] and held + size > index_bytes and parts[-1][-1][0] != row[0]:
            parts.append([])
            held = 0
        parts[-1].append(row)
        held += size
    return [_index(p) for p in parts]


def _index(rows: list[tuple[int, bytes, str]]) -> bytes:
    """A file: header, sorted digests, offsets, path lengths, verdicts, strings. The header tells how many labels a rule's host has at most."""
    cut = [_cut_rule(r.decode()) for _, r, _ in rows]
    lengths, labels = sorted({len(p) for _, p in cut}), max((h.count(".") + 1 for h, _ in cut), default=0)
    strings = b"".join(r for _, r, _ in rows)
    return b"".join(
        [
            MAGIC,
            struct.pack("<QQQQ", len(rows), len(strings), len(lengths), labels),
            np.array([d for d, _, _ in rows], "<u8").tobytes(),
            np.cumsum([0, *(len(r) for _, r, _ in rows)]).astype("<u8").tobytes(),
            np.array(lengths, "<u8").tobytes(),
            bytes(v == "block" for _, _, v in rows),
            strings,
        ]
    )


class Index:
    """A memory-mapped index file; find() tells which candidates are rules, by digest and then by string."""

    def __init__(self, path: str) -> None:
        data = np.memmap(path, np.uint8, "r")
        if data[:8].tobytes() != MAGIC:
            raise ValueError("not an index of URL digests")
        n, n_bytes, n_lengths, self.labels = struct.unpack("<QQQQ", data[8:40].tobytes())
        at = 40
        self.keys = data[at : at + 8 * n].view("<u8")
        at += 8 * n
        self.ends = data[at : at + 8 * (n + 1)].view("<u8")
        at += 8 * (n + 1)
        self.lengths = data[at : at + 8 * n_lengths].view("<u8").astype(int).tolist()
        at += 8 * n_lengths
        self.block = data[at : at + n]
        at += n
        self.strings = data[at : at + n_bytes]

    def find(self, texts: list[bytes], digests: np.ndarray) -> np.ndarray:
        """The place of each text in the index, or -1."""
        out = np.full(len(texts), -1, np.int64)
        if not len(self.keys) or not texts:
            return out
        lo, hi = np.searchsorted(self.keys, digests, "left"), np.searchsorted(self.keys, digests, "right")
        for i in np.flatnonzero(hi > lo):
            for k in range(lo[i], hi[i]):  # equal digests of different strings: all are compared
                if self.strings[self.ends[k] : self.ends[k + 1]].tobytes() == texts[i]:
                    out[i] = k
                    break
        return out


class Rules:
    """Index files as one list of rules."""

    def __init__(self, paths: list[str]) -> None:
        self.files = [Index(p) for p in paths]
        self.lengths = sorted({n for f in self.files for n in f.lengths})
        self.labels = max(f.labels for f in self.files)

    def verdicts(self, texts: list[bytes]) -> np.ndarray:
        """Of each text 0 if it is no rule, 1 for allow, 2 for block."""
        digests = np.fromiter(map(xxhash.xxh64_intdigest, texts), np.uint64, len(texts))
        out = np.zeros(len(texts), np.int8)
        for f in self.files:
            place = f.find(texts, digests)
            at = np.flatnonzero(place >= 0)
            out[at] = 1 + f.block[place[at]]
        return out

    def candidates(self, host: str, path: str) -> list[bytes]:
        """Candidate rules of a URL, the longest first; of equal lengths the longer host."""
        labels = host.split(".") if host else []
        hosts = [".".join(labels[k:]) for k in range(max(0, len(labels) - self.labels), len(labels))]
        pairs = [(h, path[:n]) for h in hosts for n in self.lengths if n <= len(path)]
        return [f"{h}{p}".encode() for h, p in sorted(dict.fromkeys(pairs), key=lambda x: (-len(x[0]) - len(x[1]), -len(x[0])))]


_OPEN: dict[str, Rules] = {}


def filter_urls(
    pages: DataFrame, rules: list[tuple[str, str]], url_col: str = "url", default: str = "allow", index_bytes: int = INDEX_BYTES
) -> DataFrame:
    """pages with host, path, rule and verdict: the longest rule that fits, else null and the default.

    A rule is host/path-prefix; it fits its host and all subdomains where the URL's path
    starts with its own. The candidates of a URL (its host's suffixes by the path lengths that the rules
    have) are hashed by XXH64 and searched in the sorted digests, a batch at a time; a hit counts only
    if the stored string is equal, so collisions change nothing.

    The rules are the caller's list, so they fit the driver; executors fetch the index as files and map them. Without rules every
    page gets the default. A null or empty URL or one without :// has an empty host and path and
    gets the default; one of any length is judged whole. Columns of the four names are replaced, all others and all rows stay,
    with null and repeated ids and repeated rows as they are; an empty table gives no rows.
    """
    spark = pages.sparkSession
    names = [publish(spark, data, "urls") for data in build_indexes(rules, index_bytes)]
    host, path = split_url(F.col(url_col))
    new = ("host", "path", "rule", "verdict")
    keep = [c for c in pages.columns if c not in new]
    df = pages.select(*[F.col(f"`{c}`") for c in keep], host.alias("host"), path.alias("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if names[0] not in _OPEN:
            _OPEN[names[0]] = Rules([SparkFiles.get(n) for n in names])
        index = _OPEN[names[0]]
        for b in batches:
            hosts, paths = b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist()
            per = [index.candidates(h, p) for h, p in zip(hosts, paths, strict=True)]
            flat = [c for one in per for c in one]
            found = index.verdicts(flat)
            at, rule, verdict = 0, [], []
            for one in per:
                hit = np.flatnonzero(found[at : at + len(one)])
                if len(hit):
                    rule.append(one[hit[0]].decode())
                    verdict.append("block" if found[at + hit[0]] == 2 else "allow")
                else:
                    rule.append(None)
                    verdict.append(default)
                at += len(one)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], [*b.schema.names, "rule", "verdict"])

    schema = StructType([*df.schema.fields, StructField("rule", StringType()), StructField("verdict", StringType())])
    return df.mapInArrow(run, schema)
