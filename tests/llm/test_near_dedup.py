"""The pipeline's near-duplicates against brute force on the Jaccard similarity of five-word shingles."""

import numpy as np
import pytest

import corpus_pipeline
from docloom.llm import minhash

SF = "/root/testdata/sf0.001"


def grams(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])


def kept(rows):
    """Ids that stay: the smallest of each class of similarity 0.8."""
    ids, sets = [r[0] for r in rows], [grams(r[1]) for r in rows]
    label = list(ids)
    near = [[j for j in range(len(ids)) if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])] for i in range(len(ids))]
    while True:
        new = [min(label[j] for j in n) for n in near]
        if new == label:
            return {i for i, x in zip(ids, label, strict=True) if i == x}
        label = new


def edited():
    rng = np.random.default_rng(7)
    rows = []
    for _ in range(40):
        base = [f"w{k}" for k in rng.integers(0, 5000, 200)]
        for n in (0, 1, 2, 3, 4, 5, 6):  # similarities on both sides of 0.8
            w = list(base)
            for at in rng.choice(200, n, replace=False):
                w[at] = "other"
            rows.append((len(rows), " ".join(w)))
    chain = [f"c{k}" for k in range(400)]
    rows += [(1000 - k, " ".join(chain[7 * k : 7 * k + 100])) for k in range(40)]  # only neighbours are alike
    return rows + [(2000, "short"), (2001, "SHORT"), (2002, ""), (2003, None), (2004, "a b c d"), (2005, "a b c e")]


@pytest.mark.parametrize("source", ["edited", "documents"])
def test_stage_keeps_one_of_each_class(spark, source):
    df = spark.createDataFrame(edited(), "doc_id long, text string") if source == "edited" else spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, df, SF).collect()}
    assert got == kept(df.collect())


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "x y z"), (1, "x y z"), (1, "x y z"), (1, "other words"), (2, "x y z")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in minhash.near_duplicates(df).collect()), key=str)
    assert got == [(1, 1), (1, 1), (1, 1), (2, 1), (None, 1)]  # a row without an id is of its class, too
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_stage_tells_rows_apart_by_id_and_text(spark):
    long = " ".join(f"w{k}" for k in range(60))
    near, other = long + " tail", " ".join(f"v{k}" for k in range(60))
    rows = [(5, long, "a", 1), (7, near, "a", 2), (7, other, "a", 3), (8, other, "a", 4), (9, "same row", "x", 5), (9, "same row", "x", 5), (None, long, "n", 6), (None, "no id here at all", "n", 7), (10, None, "z", 8), (11, "", "z", 9), (12, "w " * 50000, "z", 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _gone string, row int").repartition(3)
    got = corpus_pipeline.near_dedup(spark, df, SF)
    assert got.columns == df.columns
    left = sorted(((r.doc_id, r.row) for r in got.collect()), key=str)
    assert left == sorted([(5, 1), (7, 3), (9, 5), (None, 7), (10, 8), (12, 10)], key=str)
    assert corpus_pipeline.near_dedup(spark, df.limit(0), SF).count() == 0


def test_stages_on_awkward_rows(spark):
    text = "The quick brown fox jumps over the lazy dog and then it goes home to sleep for a while in the evening"
    rows = [(1, text, None, "s", 1, "p", "q"), (1, text, "en", "s", 1, "p", "q"), (None, text + " again and again", "en", None, 1, "p", "q"), (3, None, "en", "s", None, "p", "q"), (4, "", "en", "s", 0, "p", "q"), (5, "the dog and the fox " * 20000, "en", "s", 1, "p", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _text string, accepted string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, df, SF)
        assert got.columns == df.columns, name
        kept = got.collect()
        assert all((r["_text"], r.accepted) == ("p", "q") for r in kept), name
        assert kept and stage(spark, df.limit(0), SF).count() == 0, name
        if name == "language_id":
            assert {r.lang for r in kept} == {"en"} and not {r.doc_id for r in kept} & {3, 4}


def near_copies(n, seed=3):
    """One text with one to eight of its words replaced by others, as in a large group of near copies."""
    rng = np.random.default_rng(seed)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for k in range(n):
        w = list(base)
        for at in rng.choice(150, rng.integers(1, 9), replace=False):
            w[at] = f"own{k}-{at}" if rng.random() < 0.8 else "common"
        rows.append((k, " ".join(w)))
    return rows


def test_group_of_near_copies_costs_no_pairs():
    """Links found within a bucket are fewer than its members and connect what all pairs connect."""
    for n in (10, 300):
        texts = [t for _, t in near_copies(n)]
        sets = [minhash.shingles(t.encode()).view(np.int64) for t in texts]
        links = minhash.forest(list(range(n)), list(range(n)), sets, 80)
        assert 0 < len(links) < n
        label = list(range(n))
        while True:
            new = list(label)
            for a, b in links:
                new[a] = new[b] = min(new[a], new[b])
            if new == label:
                break
            label = new
        want = kept(list(enumerate(texts)))
        assert {k for k in range(n) if label[k] == k} == want and 1 < len(want) < n


def test_stage_on_a_group_of_near_copies(spark):
    rows = near_copies(200)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, df, SF).collect()} == kept(rows)


def test_stage_takes_its_candidates_from_simhash_first(spark):
    """Texts that share no band, as their minima are given as different, are linked by their fingerprints."""
    df = spark.createDataFrame([(5, 7), (3, 7), (9, 7 ^ 0b1111), (4, ~7)], "node long, fp long")
    assert {tuple(sorted(r)) for r in minhash.fingerprint_pairs(df).collect()} == {(3, 5), (3, 9)}
