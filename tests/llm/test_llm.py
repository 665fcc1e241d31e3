"""The ten operators against brute force on small tables, with the awkward cases."""

import itertools
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from docloom.llm import decontaminate, embedding, language, licenses, packing, pii, queries, simhash, tokenfile, urls, wordpiece
from docloom.llm.common import components, new_path

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, label string, fp string, n int"
ODD = [(1, None, "en", "s"), (2, "", "en", "s"), (3, "   \t\n", "en", None), (4, "one", None, "s"), (5, "Same text here now twice", "en", "s"), (6, "Same text here now twice", "en", "s"),
       (6, "Same text here now twice", "en", "s"), (None, "no id at all", "en", "s"), (8, "word " * 30000, "en", "s"), (9, "Ünïcode 漢字 🙂 <|endoftext|> don't", "de", "t")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in ODD], DOC).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    return lambda text: np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def classes(near, ids):
    label = np.array(ids)
    while True:
        new = np.where(near, label[None, :], np.iinfo(np.int64).max).min(axis=1)
        if (new == label).all():
            return label.tolist()
        label = new


def slow_simhash(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([b" ".join(w)] if w else [])
    ones = [sum(xxhash.xxh64_intdigest(g, 42) >> b & 1 for g in grams) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def test_components(spark):
    rng = np.random.default_rng(1)
    e = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(k, k + 1) for k in range(1000, 1040)] + [(2000, 2000 + k) for k in range(1, 90)]
    got = {r.node: r.root for r in components(spark.createDataFrame(e, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in e:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    assert got == {x: find(x) for x in {n for a, b in e if a != b for n in (a, b)}}


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 2])
def test_simhash_on_documents(spark, docs, bucket):
    rows = docs.collect()
    got = {r.doc_id: r for r in simhash.near_duplicates(docs, bucket=bucket).collect()}
    fps = np.array([slow_simhash(r.text) for r in rows], np.uint64)
    assert [got[r.doc_id].fp & (1 << 64) - 1 for r in rows] == fps.tolist()
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    assert [got[r.doc_id].component_id for r in rows] == classes(near, [r.doc_id for r in rows])


@pytest.mark.parametrize("bits", [3, 4])
def test_blocks_and_midpoints_lose_no_link(spark, bits):
    rng = np.random.default_rng(bits)
    base = rng.integers(0, 1 << 63, 12)
    fps = sorted({int(b) ^ sum(1 << int(k) for k in rng.choice(63, rng.integers(0, 5), replace=False)) for b in base for _ in range(12)})
    df = spark.createDataFrame([(f, k) for k, f in enumerate(fps)], "fp long, rep long")
    a = np.array(fps, np.uint64)
    want = classes(np.bitwise_count(a[:, None] ^ a[None, :]) <= bits, list(range(len(fps))))
    for bucket in (2048, 1):
        roots = {r.node: r.root for r in components(simhash.links(df, max_bits=bits, bucket=bucket)).collect()}
        assert [roots.get(k, k) for k in range(len(fps))] == want


def test_simhash_odd_rows(spark, odd):
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(odd).collect()}
    assert {(1, 1), (2, 1), (3, 1), (5, 5), (6, 5), (None, None)} <= got
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 32))
    for k in range(0, 300, 3):  # pairs on both sides of the threshold
        y = rng.normal(size=32)
        y -= y @ x[k] / (x[k] @ x[k]) * x[k]
        c = rng.uniform(0.86, 0.99)
        x[k + 1] = c * x[k] / np.linalg.norm(x[k]) + np.sqrt(1 - c * c) * y / np.linalg.norm(y)
    x[400:500] = x[400] + rng.normal(size=(100, 32)) * 0.02
    rows = [(k, v.tolist(), 0) for k, v in enumerate(x)] + [(700, None, 0), (701, [0.0] * 32, 0), (702, [float("nan")] * 32, 0), (703, [1.0, 2.0], 0), (704, [2.0, 4.0], 0), (705, [], 0), (706, [float("inf")] * 32, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in embedding.near_duplicates(df, block=32, fit_rows=300).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    n = near.sum(axis=1) - 1
    found = sum(got[k].n_links for k in range(600))
    assert all(got[k].n_links <= n[k] for k in range(600))
    assert found >= 0.97 * n.sum()
    assert {got[k].component_id for k in range(400, 500)} == {400}
    assert got[703].n_links == got[704].n_links == 1
    assert all(got[k].n_links == 0 and got[k].kept for k in (700, 701, 702, 705, 706))
    assert embedding.near_duplicates(df.limit(0)).count() == 0


def test_equal_embeddings_weigh_in(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=16)
    b = a + rng.normal(size=16) * 0.01
    rows = [(k, a.tolist()) for k in range(10, 310)] + [(k, b.tolist()) for k in (3, 4)] + [(5, rng.normal(size=16).tolist()), (6, [3.0, 4.0]), (7, [-0.0, 1.0]), (8, [0.0, 1.0]), (None, a.tolist())]
    rows += [(k, [1.0, k / 1e4, 0.0]) for k in range(400, 500)]  # a third length, more than a block of it
    got = {r.vec_id: r for r in embedding.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=16).collect()}
    assert {got[k].n_links for k in range(10, 310)} == {301} == {got[3].n_links, got[4].n_links}
    assert {got[k].component_id for k in [3, 4, *range(10, 310)]} == {3} and got[3].kept and not got[10].kept
    assert got[5].n_links == got[6].n_links == 0 and got[7].n_links == got[8].n_links == 1 and got[8].component_id == 7
    assert {got[k].n_links for k in range(400, 500)} == {99} and {got[k].component_id for k in range(400, 500)} == {400}
    assert got[None].n_links == 0 and got[None].kept


def test_url_rules(spark):
    rows = [(1, "https://Blog.X.example.COM/en/7a?q=/de/"), (2, "http://example.com/en/8"), (3, "http://notexample.com/en/1"), (4, "http://example.net/de/81#x"), (5, "http://a.net/de/8"), (6, None), (7, "nothing"), (8, "ftp://b.org"), (9, "http://b.org/es/")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), queries.URL_RULES).collect()}
    assert got[1] == ("blog.x.example.com", "/en/7a", "example.com/en/7", "allow")
    assert got[2][2:] == ("com/en/", "block") and got[3][2:] == ("com/en/", "block")
    assert got[4][2:] == ("example.net/de/8", "block") and got[5][2:] == ("net/de/", "allow")
    assert got[6] == got[7] == ("", "", None, "allow") and got[8] == ("b.org", "", None, "allow") and got[9][3] == "block"


def test_word_pieces_equal_greedy_search(spark):
    rng = np.random.default_rng(3)
    for _ in range(30):
        begin = {bytes(rng.choice(list(b"abc"), rng.integers(1, 5)).tolist()) for _ in range(12)}
        go_on = {bytes(rng.choice(list(b"abc"), rng.integers(1, 5)).tolist()) for _ in range(12)}
        machine = wordpiece.Automaton(begin, go_on)
        for w in map(bytes, itertools.chain.from_iterable(itertools.product(b"abc", repeat=k) for k in range(1, 7))):
            at = n = 0
            while at < len(w):
                end = next((e for e in range(len(w), at, -1) if w[at:e] in (go_on if at else begin)), None)
                if end is None:
                    n = 0
                    break
                at, n = end, n + 1
            assert machine.count(w) == n


def test_token_counts_odd_rows(spark, odd):
    got = wordpiece.count_tokens(odd, [b"a", b"wo", b"rd", b"one"]).collect()
    assert len(got) == len(ODD)
    assert {(r.n_words, r.n_tokens, r.n_unknown) for r in got if r.doc_id == 8} == {(30000, 60000, 0)}
    assert {(r.n_words, r.n_tokens) for r in got if r.doc_id in (1, 2, 3)} == {(0, 0)}


def test_packing(spark, odd, docs, library):
    for df in (odd, docs):
        texts = {}
        for r in df.collect():
            texts.setdefault(r.doc_id, []).append(library(r.text))
        seqs, total = {}, 0
        pieces = {}
        for p in packing.pack_documents(df, queries.tokenizer_path()).collect():
            t = texts[p.doc_id][0]
            assert p.doc_tokens == len(t) and p.ids_crc32 == zlib.crc32(t[p.start : p.start + p.length].tobytes())
            pieces.setdefault(p.doc_id, []).append((p.start, p.length))
            seqs.setdefault(p.sequence_id, []).append((p.offset, p.length))
            total += p.length
        assert total == sum(len(t) for ts in texts.values() for t in ts)
        for s in seqs.values():
            at = 0
            for o, n in sorted(s):
                assert o == at
                at += n
            assert at <= packing.LENGTH
        parts = df.rdd.getNumPartitions()
        assert len(seqs) <= -(-total // packing.LENGTH) + parts
    assert packing.pack_documents(odd.limit(0), queries.tokenizer_path()).count() == 0


def test_token_files(spark, odd, docs, library):
    for df in (odd, docs):
        path = new_path(spark, "t")
        tokenfile.write(df, path, queries.tokenizer_path(), segment_tokens=5000, partitions=3)
        got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in tokenfile.read(spark, path).collect()))
        rows = sorted(df.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
        at, want = 0, []
        for r in rows:
            t = library(r.text)
            want.append((at, r.doc_id, len(t), zlib.crc32(t.tobytes())))
            at += len(t)
        assert got == want
    assert tokenfile.tokens_at(spark, path, 5, 3, 9) == library(docs.filter("doc_id = 5").first().text)[3:9].tolist()


def test_codes_round_trip():
    rng = np.random.default_rng(5)
    for size in (0, 1, 511, 512, 513, 5000):
        for top in (1, 256, 70_000, 1 << 32):
            ids = rng.integers(0, top, size, dtype=np.uint64).astype("<u4")
            c = tokenfile.Codes(tokenfile.encode_codes(ids))
            assert len(c) == size and c.slice(0, size).tolist() == ids.tolist()
            for a, b in rng.integers(0, size + 1, (10, 2)):
                assert c.slice(a, b).tolist() == ids[a:b].tolist()
            assert all(c[int(i)] == ids[i] for i in rng.integers(0, size, 20 if size else 0))


def test_decontamination(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    w = item.split()
    swapped = " ".join("X" if k in (4, 11, 17) else x for k, x in enumerate(w))
    noise = " ".join(f"n{k}" for k in range(60))
    rows = [(1, f"{noise} {item.upper()}! {noise}"), (2, f"{noise} {swapped} {noise}"), (3, noise), (4, " ".join(w[:6]) + " " + noise), (5, None), (6, ""), (7, " ".join(reversed(w))), (8, " ".join(w[:13])), (None, item)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, item string")
    bench = spark.createDataFrame([(10, item), (11, None), (12, "short one"), (13, item)], "item_id long, text string")
    got = {r.doc_id: (r.contaminated, r["items"]) for r in decontaminate.find_overlaps(df, bench).collect()}
    both = (True, [10, 13])  # items of equal words are all named
    assert got == {1: both, 2: both, 3: (False, []), 4: (False, []), 5: (False, []), 6: (False, []), 7: (False, []), 8: both, None: both}
    kept = decontaminate.decontaminate(df, bench)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {3, 4, 5, 6, 7}
    assert decontaminate.find_overlaps(df, bench.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.find_overlaps(df.limit(0), bench).count() == 0


def test_license_base_columns(spark, docs, odd):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    extra = spark.createDataFrame([(90, "CC-BY cc  by; All Rights... reserved ALL RIGHTS RESERVED"), (91, "gnu General-Public/License v3"), (92, "licensed under the MIT License")], "doc_id long, text string")
    for df in (docs.select("doc_id", "text"), extra, odd.select("doc_id", "text")):
        texts = {r.doc_id: r.text or "" for r in df.collect()}
        for r in licenses.scan(df).collect():
            w = word.findall(texts[r.doc_id].translate(low))
            places, labels = [], set()
            for phrase, label in licenses.BASE:
                p = phrase.split()
                at = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
                places += at
                labels |= {label} if at else set()
            assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(places), min(places, default=None), max(places, default=None))
            assert r.base_labels == ",".join(sorted(labels)) and labels <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    got = {r.doc_id: r for r in licenses.scan(extra).collect()}
    assert got[91].labels == "gpl,gpl-3.0" and got[92].labels == "mit" and got[92].score == 1.0
    assert [d.label for d in got[92].detections] == ["mit"]


def test_pseudonyms(spark):
    texts = ["card 4111 1111 1111 1111 and 4111111111111111", "on 2024-02-29 and 29.02.2024, not 2024-02-30", "call +1 (555) 123-4567 or 555-123-4567", "ip 10.0.0.1, mail A.b@x.example.com", None, "", "no digits",
             "token = \"0641917ea4e9feb9cda83477b57ac2654884f485\" 1234567890123456", "IBAN GB82 WEST 1234 5698 7654 32", "ssn 123-45-6789"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymise(df, "k").collect()}
    a, b = re.findall(r"[0-9]{16}", got[0].text.replace(" ", ""))
    assert a == b != "4111111111111111"
    d = [int(c) for c in a][::-1]
    assert (sum(d[::2]) + sum(sum(divmod(2 * c, 10)) for c in d[1::2])) % 10 == 0
    iso = re.search(r"on (\d{4})-(\d\d)-(\d\d) and (\d\d)\.(\d\d)\.(\d{4})", got[1].text)
    assert iso.groups()[:3] == iso.groups()[:2:-1] and "2024-02-29" not in got[1].text and "2024-02-30" in got[1].text
    assert re.fullmatch(r"call \+1 \(\d{3}\) \d{3}-\d{4} or \d{3}-\d{3}-\d{4}", got[2].text)
    x, y = (re.sub(r"\D", "", p)[-10:] for p in got[2].text.split(" or "))
    assert x == y != "5551234567"
    assert "10.0.0.1" not in got[3].text and "x.example.com" not in got[3].text
    assert got[4].text is None and got[5].text == "" and got[6].text == "no digits"
    assert "0641917e" not in got[7].text and "1234567890123456" in got[7].text and got[7].pii == "secret"
    assert got[8].pii == "iban" and "9876 54" not in got[8].text and got[9].pii == "ssn"
    assert pii.pseudonymise(df.limit(0), "k").count() == 0


def test_feistel_is_a_permutation(spark):
    df = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("s")).select(pii.permute_digits(F.col("s"), F.lit("k"), "t").alias("p"))
    assert sorted(r.p for r in df.collect()) == [f"{k:03d}" for k in range(1000)]


def test_language(spark, docs, odd):
    model = language.fit(docs, "text", "lang")
    found = language.identify(docs, model, F.col("text"), None, F.col("source")).collect()
    assert sum(r.language == r.lang for r in found) >= 0.98 * len(found)
    got = {(r.doc_id, r.accepted) for r in language.identify(odd, model, F.col("text"), F.col("lang"), F.col("source")).collect()}
    assert {(1, False), (2, False), (3, False), (8, True)} <= got
    empty = language.fit(docs.limit(0), "text", "lang")
    assert language.identify(odd, empty, F.col("text")).filter("accepted").count() == 0
    assert language.identify(odd.limit(0), model, F.col("text")).count() == 0


def test_pipeline_keeps_what_each_stage_should(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.columns
        docs = stage(spark, docs, SF)
        assert docs.columns == before, name
    rows = docs.collect()
    fps = np.array([slow_simhash(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()], np.uint64)
    assert 0 < len(rows) <= len(set(fps.tolist()))
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == {r.doc_id for r in rows}
