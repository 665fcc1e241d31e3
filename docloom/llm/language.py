"""Language identification by fusing evidence: text, declared language, address suffix and host."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import cut, discard, free_names

#: Labelled rows of each label that the text model is fitted on, about; drawn by a hash of the text. A rarer label gives all its rows.
FIT_ROWS = 1000
BUCKETS = 1 << 15
#: Trigrams of a text that count at most as independent evidence.
EFFECTIVE = 60.0
#: Pseudo-documents of the level above that a host, domain, suffix or declaration starts with.
SMOOTHING = 20.0
ACCEPT = 0.6
#: Nats a letter trigram that a text may stay below its language's own mean, and standard errors beyond that.
SLACK, ERRORS = 2.5, 3.0
#: Neighbouring trigrams overlap: so many count as one observation.
OVERLAP = 3


@dataclass
class TextModel:
    languages: list[str]
    weights: np.ndarray  # BUCKETS x languages: log-likelihoods
    mean: np.ndarray  # by language: mean and deviation of the log-likelihood of its own letter trigrams
    spread: np.ndarray

    def log_likelihood(self, text: bytes | None) -> tuple[np.ndarray, int, bool]:
        """Tempered log-likelihoods of a text, how many of its bytes are letters and whether it fits a language at all.

        It fits if its letter trigrams are about as likely under some language as that language's own are. The
        standard error counts distinct trigrams, so repeating a word proves nothing.
        """
        total, n, letters = np.zeros(len(self.languages)), 0, 0
        inside, n_inside, seen = np.zeros(len(self.languages)), 0, np.zeros(BUCKETS, bool)
        for idx, has, inner in _trigrams(text):
            w = self.weights[idx]
            total += w.sum(axis=0, dtype=np.float64)
            n += len(idx)
            letters += int(has)
            inside += inner @ w
            n_inside += int(inner.sum())
            seen[idx[inner > 0]] = True
        fits = bool(n_inside and (inside / n_inside >= self.mean - SLACK - ERRORS * self.spread * np.sqrt(OVERLAP / np.count_nonzero(seen))).any())
        return total * min(1.0, EFFECTIVE / n) if n else total, letters, fits


def _trigrams(text: bytes | None, step: int = 1 << 20) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """Buckets of all byte trigrams of a text, in blocks, how many bytes are letters, and 1.0 for each letter trigram.

    A letter trigram has a letter in the middle, another beside it and no digit.
    """
    data = np.frombuffer((text or b"").lower(), np.uint8)
    for at in range(0, max(len(data) - 2, 0), step):
        b = data[at : at + step + 2].astype(np.uint32)
        letter, digit = (b >= 97) & (b <= 122) | (b >= 128), (b >= 48) & (b <= 57)
        inner = letter[1:-1] & (letter[:-2] | letter[2:]) & ~(digit[:-2] | digit[2:])
        yield (b[:-2] * 961 + b[1:-1] * 31 + b[2:]) & (BUCKETS - 1), int(letter.sum()), inner.astype(np.float32)


def fit(labelled: DataFrame, text_col: str, label_col: str, fit_rows: int = FIT_ROWS) -> TextModel:
    """A text model of all labels, each from about fit_rows of its rows.

    The executors count; the driver gets at most BUCKETS sums of each label. Null labels and null texts are left out; ties and
    repeated rows count as often as they stand. A table without labels gives a model without languages.
    """
    rows = labelled.filter(F.col(label_col).isNotNull()).select(F.col(label_col).cast("string").alias("label"), F.col(text_col).cast("binary").alias("text"))
    drawn = F.pmod(F.xxhash64("text", "label"), F.lit(1 << 30))
    # As many rows as there are labels. Written, so Spark knows their size and broadcasts them below its threshold before any text is shuffled.
    sizes = cut(rows.groupBy("label").agg(F.count("*").alias("n"), F.min(drawn).alias("least")), "labels")
    sample = rows.join(sizes, "label").filter((drawn * F.col("n") < fit_rows * (1 << 30)) | (drawn == F.col("least"))).select("label", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def out(label: str, own: np.ndarray) -> pa.RecordBatch:
            at = np.flatnonzero(own[0])
            return pa.RecordBatch.from_arrays([pa.array([label] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(own[0, at]), pa.array(own[1, at])], ["label", "bucket", "n", "inner"])

        for b in batches:
            for label, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if label not in sums and len(sums) >= 64:  # a task holds the sums of so many labels
                    yield out(*sums.popitem())
                own = sums.setdefault(label, np.zeros((2, BUCKETS), np.int64))
                for idx, _, inner in _trigrams(text.as_py()):
                    own[0] += np.bincount(idx, minlength=BUCKETS)
                    own[1] += np.bincount(idx[inner > 0], minlength=BUCKETS)
        for label, own in sums.items():
            yield out(label, own)

    counted = cut(sample.mapInArrow(count, "label string, bucket int, n long, inner long").groupBy("label", "bucket").agg(F.sum("n").alias("n"), F.sum("inner").alias("inner")), "trigrams")
    languages = [r["label"] for r in counted.select("label").distinct().orderBy("label").collect()]
    place = {label: k for k, label in enumerate(languages)}
    table, own = np.zeros((BUCKETS, len(languages))), np.zeros((BUCKETS, len(languages)))
    for b in counted.toArrow().to_batches():
        at = b.column(1).to_numpy(), np.array([place[x] for x in b.column(0).to_pylist()], np.int64)
        table[at], own[at] = b.column(2).to_numpy(), b.column(3).to_numpy()
    discard(counted)
    discard(sizes)
    weights = np.log((table + 0.5) / (table.sum(axis=0) + 0.5 * BUCKETS))
    own /= np.maximum(own.sum(axis=0), 1)
    mean = (own * weights).sum(axis=0)
    return TextModel(languages, weights.astype(np.float32), mean, np.sqrt((own * (weights - mean) ** 2).sum(axis=0)))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def domain_of(host: Column) -> Column:
    """The last two labels of a host."""
    return F.regexp_extract(host, r"([^.]*\.?[^.]*)$", 1)


def suffix_of(host: Column) -> Column:
    """The last label of a host of several, else empty."""
    return F.regexp_extract(host, r"\.([^.]+)$", 1)


def identify(docs: DataFrame, model: TextModel, text: Column, declared: Column | None = None, host: Column | None = None, accept: float = ACCEPT) -> DataFrame:
    """docs with language, posterior, text_language and accepted added.

    The log posterior of a language adds the text's tempered log-likelihood, the log-likelihoods of
    the declared language and of the address suffix, and the log of the host's prior.
    The latter three come from sums of the texts' posteriors over all rows, grouped by host and
    language evidence, less the row's own, so a text is never its own evidence: a host's sums are smoothed by its domain's, those by the sums of all. Sums are formed in each
    task before the shuffle, so a host with a third of all rows costs one row a task; tables are as
    long as there are hosts, and Spark broadcasts them only below its size threshold.

    accepted needs a posterior of at least `accept` and a text that fits some language of the model: one in another
    language or of random letters has a likeliest language, but is not accepted and does not count for its host. A null or empty text is never accepted and
    gets the likeliest language by the other evidence. Null evidence says nothing. A very long text is read in blocks, whole. Of languages
    equally likely the first by name is taken. Null and repeated ids are not looked at; of repeated rows each is evidence for the others.
    Columns of the four names are
    replaced; all others, whatever their names, and all rows stay. An empty table gives no rows. Without any label to fit on, language is null and nothing is accepted.
    """
    new = ("language", "posterior", "text_language", "accepted")
    keep = [c for c in docs.columns if c not in new]
    k = len(model.languages)
    if not k:
        return docs.select(*[F.col(f"`{c}`") for c in keep], F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("posterior"), F.lit(None).cast("string").alias("text_language"), F.lit(False).alias("accepted"))
    host = F.lit("") if host is None else F.coalesce(host, F.lit(""))
    declared = F.lit("") if declared is None else F.lower(F.coalesce(declared, F.lit("")))
    t_, h_, d_, m_, s_, hs_, ms_, ds_, ss_ = free_names([*docs.columns, *new], "_text", "_host", "_declared", "_domain", "_suffix", "_host_sums", "_domain_sums", "_said_sums", "_suffix_sums")
    base = docs.select(*[F.col(f"`{c}`") for c in keep], text.cast("binary").alias(t_), host.alias(h_), declared.alias(d_))
    kept = docs.sparkSession.sparkContext.broadcast(model)

    def posteriors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for b in batches:
            for t, h, d in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                ll, _, fits = kept.value.log_likelihood(t.as_py())
                if fits:
                    p = _softmax(ll)
                    for key in ((h, ""), ("", d)) if h else (("", d),):
                        if key in sums:
                            sums[key] += p
                        else:
                            sums[key] = p.copy()
            if len(sums) > 100_000:
                yield _sums(sums, k)
                sums.clear()
        if sums:
            yield _sums(sums, k)

    cols = [f"p{j}" for j in range(k)]
    narrow = base.select(t_, h_, d_)
    sums = cut(
        narrow.mapInArrow(posteriors, "host string, declared string, " + ", ".join(f"{c} double" for c in cols)).groupBy("host", "declared").agg(*[F.round(F.sum(c), 6).alias(c) for c in cols]),
        "priors",
    )
    vector = F.array(*[F.col(c) for c in cols])
    added = [F.sum(c).alias(c) for c in cols]
    hosts = sums.filter("host <> ''")
    everything = np.array(sums.filter("host = ''").agg(*[F.coalesce(F.sum(c), F.lit(0.0)) for c in cols]).first(), float)
    of_hosts = cut(hosts.select(F.col("host").alias(h_), vector.alias(hs_)), "hosts")
    domains = cut(hosts.groupBy(domain_of(F.col("host")).alias(m_)).agg(*added).select(m_, vector.alias(ms_)), "domains")
    said = cut(sums.filter("host = '' and declared <> ''").select(F.col("declared").alias(d_), vector.alias(ds_)), "declared")
    ending = cut(hosts.withColumn("key", suffix_of(F.col("host"))).filter("key <> ''").groupBy("key").agg(*added).select(F.col("key").alias(s_), vector.alias(ss_)), "suffixes")
    discard(sums)
    full = base.withColumns({m_: domain_of(F.col(h_)), s_: suffix_of(F.col(h_))})
    full = full.join(of_hosts, h_, "left").join(domains, m_, "left").join(said, d_, "left").join(ending, s_, "left")
    full = full.select(*[F.col(f"`{c}`") for c in keep], t_, hs_, ms_, ds_, ss_)

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = kept.value
        for b in batches:
            at = b.num_columns - 5
            out: tuple[list, list, list, list] = ([], [], [], [])
            rest = [b.column(at + j).to_pylist() for j in (1, 2, 3, 4)]
            for t, of_host, of_domain, of_declared, of_suffix in zip(b.column(at), *rest, strict=True):
                ll, letters, fits = m.log_likelihood(t.as_py())
                p = _softmax(ll + log_evidence(_softmax(ll) if fits else np.zeros(k), everything, of_host, of_domain, of_declared, of_suffix))
                best = int(p.argmax())
                out[0].append(m.languages[best])
                out[1].append(float(p[best]))
                out[2].append(m.languages[int(ll.argmax())] if letters else None)
                out[3].append(bool(fits and p[best] >= accept))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:at], pa.array(out[0], pa.string()), pa.array(out[1], pa.float64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.bool_())], [*b.schema.names[:at], *new]
            )

    schema = base.select(*[F.col(f"`{c}`") for c in keep]).schema
    for name, kind in zip(new, ("string", "double", "string", "boolean"), strict=True):
        schema = schema.add(name, kind)
    return full.mapInArrow(fuse, schema)


def log_evidence(own: np.ndarray, everything: np.ndarray, of_host: list | None, of_domain: list | None, of_declared: list | None, of_suffix: list | None) -> np.ndarray:
    """Log prior of the host plus log-likelihoods of declaration and suffix, from sums of posteriors less the row's own.

    A host without sums of its own has its domain's prior.
    """
    k = len(own)
    less = lambda v: np.maximum(np.asarray(v, float) - own, 0.0)
    share = lambda v: v / v.sum()
    rest = less(everything)
    prior = overall = share(rest + 1)
    if of_domain:
        prior = share(less(of_host or [0.0] * k) + SMOOTHING * share(less(of_domain) + SMOOTHING * overall))
    score = np.log(prior)
    for joint in (of_declared, of_suffix):
        if joint:
            score += np.log((less(joint) + overall * SMOOTHING / 10) / (rest + SMOOTHING))
    return score


def _sums(sums: dict[tuple, np.ndarray], k: int) -> pa.RecordBatch:
    keys, values = list(sums), np.stack(list(sums.values()))
    return pa.RecordBatch.from_arrays(
        [pa.array([h for h, _ in keys], pa.string()), pa.array([d for _, d in keys], pa.string()), *(pa.array(values[:, j]) for j in range(k))], ["host", "declared", *(f"p{j}" for j in range(k))]
    )
