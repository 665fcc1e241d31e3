"""Operators whose results SQL can't give, against plain re-statements of their rules."""

import datetime
import hashlib
import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import decontaminate, language, packing, pii, queries, urls, wordpiece

SF = "/root/testdata/sf0.001"


def feistel(left, right, a, b, key, kind):
    for i in range(1, 9):
        text = f"{key}|{kind}|{a * 7919 + b}|{i}|{right}"
        left, right = right, (left + int(hashlib.sha256(text.encode()).hexdigest()[:15], 16)) % (a if i % 2 else b)
    return left, right


def digits(s, key, kind):
    n = len(s)
    a = n // 2
    x, y = feistel(int(s[:a]), int(s[a:]), 10**a, 10 ** (n - a), key, kind)
    return f"{x:0{a}d}{y:0{n - a}d}"


def ssn(s, key):
    area, group, serial = (int(x) for x in s.split("-"))
    x, y = feistel(area - (2 if area > 666 else 1), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, key, "ssn")
    return f"{x + (2 if x >= 665 else 1):03d}-{y // 9999 + 1:02d}-{y % 9999 + 1:04d}"


def day(d, key, late=False):
    n = (d - datetime.date(1700, 1, 1)).days
    while True:
        x, y = feistel(n // 773, n % 773, 189, 773, key, "date")
        n = x * 773 + y
        out = datetime.date(1700, 1, 1) + datetime.timedelta(n)
        if not late or out.day > 12:
            return out


def test_pseudonyms_equal_a_plain_feistel(spark):
    rng = np.random.default_rng(2)
    dates = [datetime.date(1980, 1, 1) + datetime.timedelta(int(k)) for k in rng.integers(0, 14000, 120)]
    ssns = [f"{a:03d}-{g:02d}-{n:04d}" for a, g, n in zip(rng.integers(1, 900, 200), rng.integers(1, 100, 200), rng.integers(1, 10000, 200), strict=True) if a != 666] + ["899-99-9999", "001-01-0001"]
    cards = ["4111111111111111", "5500005555555559", "340000000000009"]
    ips = [".".join(map(str, r)) for r in rng.integers(0, 256, (50, 4))]
    phones = [f"{a}-{b}-{c}" for a, b, c in zip(rng.integers(200, 999, 50), rng.integers(100, 999, 50), rng.integers(1000, 9999, 50), strict=True)]
    texts, want = [], []
    for d in dates:
        texts += [f"on {d.isoformat()} x", f"on {d:%d/%m/%Y} x"]
        want += [f"on {day(d, 'k').isoformat()} x", f"on {day(d, 'k'):%d/%m/%Y} x"]
        if d.day > 12:
            texts.append(f"on {d:%m/%d/%Y} x")
            want.append(f"on {day(d, 'k', True):%m/%d/%Y} x")
    for s in ssns:
        texts.append(f"ssn {s}.")
        want.append(f"ssn {ssn(s, 'k')}.")
    for c in cards:
        body = digits(c[:-1], "k", "card")
        total = sum(int(x) if k % 2 else sum(divmod(2 * int(x), 10)) for k, x in enumerate(body[::-1]))
        texts.append(f"card {c}.")
        want.append(f"card {body}{-total % 10}.")
    for i in ips:
        o = [int(x) for x in i.split(".")]
        x, y = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "k", "ip")
        texts.append(f"ip {i} x")
        want.append(f"ip {x // 256}.{x % 256}.{y // 256}.{y % 256} x")
    for p in phones:
        d = digits(p.replace("-", ""), "k", "phone")
        texts.append(f"tel {p} x")
        want.append(f"tel {d[:3]}-{d[3:6]}-{d[6:]} x")
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = [r.text for r in pii.pseudonymise(df, "k").orderBy("id").collect()]
    assert got == want
    made = [w for t, w in zip(texts, want, strict=True) if t.startswith("ssn")]
    assert not [m for m in made if re.match(r"ssn (000|666|9)", m) or "-00-" in m or "-0000" in m]


def test_no_two_dates_become_one_string(spark):
    days = [datetime.date(1980, 1, 1) + datetime.timedelta(k) for k in range(0, 14600, 3)]
    rows = [(k, f"{d:%d/%m/%Y}") for k, d in enumerate(days)] + [(len(days) + k, f"{d:%m/%d/%Y}") for k, d in enumerate(days) if d.day > 12]
    got = [r.text for r in pii.pseudonymise(spark.createDataFrame(rows, "id long, text string"), "k").collect()]
    assert len(set(got)) == len(rows)


def test_pseudonyms_on_awkward_rows(spark):
    rows = [(1, "ip 10.1.2.3", [1], "f", "c"), (1, "ip 10.1.2.3", [1], "f", "c"), (None, "a" * 70 + "@" + "b." * 3000 + "example", None, None, None), (4, None, [], "", ""), (5, "x " * 200000 + "tel 555-123-4567", [2], "f", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _found array<int>, _changed string, _KEY string")
    out = pii.pseudonymise(df, "k")
    got = out.collect()
    assert out.columns == [*df.columns, "n_pii", "pii"] and len(got) == 5 and "secret-key" not in pii.pseudonymise(df, "secret-key")._jdf.queryExecution().toString()
    by = {r.doc_id: r for r in got}
    assert by[1]["_found"] == [1] and by[1]["_changed"] == "f" and by[1]["_KEY"] == "c" and by[1].text != "ip 10.1.2.3" and len({r.text for r in got if r.doc_id == 1}) == 1
    assert "@mail.invalid" in by[None].text and "example" not in by[None].text and by[4].text is None and "555-123-4567" not in by[5].text
    assert pii.pseudonymise(df.limit(0), "k").count() == 0


def test_language_posteriors_equal_a_plain_sum(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(docs, "text", "lang")
    rows = queries.page_evidence(spark.read.parquet(f"{SF}/pages.parquet")).collect()
    rows += [(10**6 + k, t, d, h) for k, (t, d, h) in enumerate([("", "de", "a.example.de"), (None, None, None), ("nur ein wenig Text hier", "fr", "b.example.de"), ("nur ein wenig Text hier", "fr", "b.example.de")])]
    df = spark.createDataFrame(rows, "page_id long, words string, declared string, host string").withColumn("_text", F.lit("mine"))
    found = language.identify(df, model, F.col("words"), F.col("declared"), F.col("host"))
    assert found.columns[:5] == df.columns and found.limit(0).count() == 0
    got = {r.page_id: r for r in found.collect()}
    k = len(model.languages)
    soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    ll = [model.log_likelihood((r[1] or "").encode()) for r in rows]
    p = np.array([soft(x[0]) if x[2] else np.zeros(k) for x in ll])
    hosts = [r[3] or "" for r in rows]
    domains, suffixes = [".".join(h.split(".")[-2:]) for h in hosts], [h.rsplit(".", 1)[1] if "." in h else "" for h in hosts]
    said = [(r[2] or "").lower() for r in rows]
    for i, r in enumerate(rows):
        rest = [j for j in range(len(rows)) if j != i]
        total = lambda same, rest=rest: sum((p[j] for j in rest if same(j)), np.zeros(k))
        everything = total(lambda j: True)
        prior = overall = (everything + 1) / (everything + 1).sum()
        share = lambda v: v / v.sum()
        if hosts[i]:
            of_domain = share(total(lambda j: hosts[j] and domains[j] == domains[i]) + 20 * overall)
            prior = share(total(lambda j: hosts[j] == hosts[i]) + 20 * of_domain)
        score = ll[i][0] + np.log(prior)
        if said[i]:
            score = score + np.log((total(lambda j: said[j] == said[i]) + 2 * overall) / (everything + 20))
        if suffixes[i]:
            score = score + np.log((total(lambda j: suffixes[j] == suffixes[i]) + 2 * overall) / (everything + 20))
        want = soft(score)
        assert abs(got[r[0]].posterior - want.max()) < 1e-4 and (want.max() < 0.5001 or got[r[0]].language == model.languages[int(want.argmax())])
        assert got[r[0]]["_text"] == "mine"


def test_every_label_is_a_language(spark):
    rows = [(k, f"palabra{k % 7} texto", f"l{k % 90:02d}") for k in range(5000)] + [(9999, "zq zq zq zq", "rare")]
    model = language.fit(spark.createDataFrame(rows, "id long, text string, lang string"), "text", "lang", fit_rows=10)
    assert model.languages == [*(f"l{k:02d}" for k in range(90)), "rare"]


def test_token_counts_equal_greedy_search_on_documents(spark):
    pieces, last = wordpiece.vocabulary(queries.tokenizer_path())
    anywhere, at_end = set(pieces), set(last)
    memo = {}

    def slow(word):
        if word not in memo:
            at = n = 0
            while at < len(word):
                end = next((e for e in range(len(word), at, -1) if word[at:e] in anywhere or (e == len(word) and word[at:e] in at_end)), None)
                if end is None:
                    n = 0
                    break
                at, n = end, n + 1
            memo[word] = n
        return memo[word]

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: (r.text or "").encode().lower() for r in docs.collect()}
    for limit in (1 << 30, 10):  # by broadcast, and as a file
        for r in wordpiece.count_tokens(docs, pieces, last=last, limit=limit).collect():
            counts = [slow(w) for w in re.findall(rb"[a-z\x80-\xff]+|[0-9]+|[^a-z0-9\x80-\xff\s]", texts[r.doc_id])]
            assert (r.n_words, r.n_tokens, r.n_unknown) == (len(counts), sum(c or 1 for c in counts), counts.count(0))
    assert wordpiece.count_tokens(docs.limit(0), pieces, last=last).count() == 0
    m = wordpiece.Automaton([b"ca", b"t", b"c", b"a"], last=[b"cat", b"at"])
    assert [m.count(w) for w in (b"cat", b"catt", b"cats", b"cacat", b"ca")] == [1, 3, 0, 2, 1]


def test_packing_gives_the_longest_to_the_cheapest(spark):
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 1500, 200).tolist() + [5000, 2048]
    rows = packing.pack(sizes)
    rest = sorted([(n % 2048, d) for d, n in enumerate(sizes) if n % 2048], key=lambda x: (-x[0], x[1]))
    full = sum(n // 2048 for n in sizes)
    room, spent, want = [2048] * -(-sum(n for n, _ in rest) // 2048), {}, []
    spent = [0.0] * len(room)
    for n, d in rest:
        start = sizes[d] // 2048 * 2048
        while n:
            fits = [s for s in range(len(room)) if room[s] >= n]
            s = min(fits, key=lambda s: (spent[s], s)) if fits else max(range(len(room)), key=lambda s: (room[s], -s))
            take = min(n, room[s])
            want.append((d, start, take, full + s, 2048 - room[s]))
            room[s] -= take
            spent[s] += packing.cost(take)
            start, n = start + take, n - take
    assert [r for r in rows if r[2] < 2048 and r[3] >= full] == want
    free, at = {}, {}
    for n, d in rest:  # the same pieces by first fit
        s = next((s for s in range(10**6) if free.setdefault(s, 2048) >= n))
        free[s] -= n
        at[s] = at.get(s, 0.0) + packing.cost(n)
    assert np.std(spent) < np.std(list(at.values()))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = packing.pack_documents(docs, queries.tokenizer_path())
    assert got.groupBy("sequence_id").agg(F.sum("cost").alias("a"), F.max("sequence_cost").alias("b"), F.min("sequence_cost").alias("c")).filter("abs(a - b) > 1e-6 or b <> c").count() == 0


@pytest.mark.parametrize("seeds", [decontaminate.BROADCAST_SEEDS, 0])
def test_overlaps_equal_a_plain_alignment(spark, seeds):
    rng = np.random.default_rng(8)
    items = {k: [f"i{x}" for x in rng.integers(0, 60, rng.integers(4, 40))] for k in range(12)}
    items[50] = items[3]
    items[51] = ["one"] * 30
    rows = []
    for k in range(150):
        w = list(items[int(rng.integers(0, 12))])
        a = int(rng.integers(0, len(w)))
        w = w[a : a + int(rng.integers(3, 40))]
        for at in rng.choice(len(w), int(rng.integers(0, 4)) % (len(w) + 1), replace=False):
            w[at] = "sub"
        rows.append((None if k % 10 == 0 else k % 140, " ".join([f"n{x}" for x in rng.integers(0, 50, rng.integers(0, 20))] + w + [f"m{x}" for x in rng.integers(0, 50, rng.integers(0, 20))])))
    rows += [(500, "one " * 3000), (500, "two words"), (501, None), (502, "")]

    def share(t, i):
        best = 0.0
        for d in range(-len(i) + 1, len(t)):
            lo, hi = max(0, -d), min(len(i), len(t) - d)
            if hi - lo < min(9, len(i)):
                continue
            same = [t[d + k] == i[k] for k in range(lo, hi)]
            n = min(13, len(same))
            top = max(sum(same[s : s + n]) for s in range(len(same) - n + 1)) / n
            if top >= (1.0 if len(same) < 9 else 0.8):
                best = max(best, top)
        return best

    want = []
    for _, text in rows:
        shares = {k: share((text or "").split(), i) for k, i in items.items()}
        want.append((sorted(k for k, s in shares.items() if s), max(shares.values())))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    got = decontaminate.find_overlaps(df, bench, broadcast_seeds=seeds).collect()
    key = lambda x: (x[0] is None, x[0] or 0, str(x[1]), x[2])
    assert sorted(((r.doc_id, r["items"], round(r.similarity, 9)) for r in got), key=key) == sorted(((i, w, round(s, 9)) for (i, _), (w, s) in zip(rows, want, strict=True)), key=key)


def test_rule_lists_of_many_files(spark):
    rules = [(f"site{k}.example/p{k % 7}/", "block" if k % 3 else "allow") for k in range(500)] + queries.URL_RULES
    pages = [(k, f"http://a.b.site{k % 600}.example/p{k % 7}/x?q") for k in range(900)] + [(1, "http://" + "a." * 20000 + "com/en/" + "x" * 100000), (1, None), (None, ""), (2, "no scheme")]
    df = spark.createDataFrame([(*p, "mine", 1) for p in pages], "page_id long, url string, verdict string, _host int")
    one, many = (urls.filter_urls(df, rules, index_bytes=n) for n in (1 << 30, 2000))
    assert len(urls.build_indexes(rules, 2000)) > 5
    rows = sorted(many.collect(), key=str)
    assert rows == sorted(one.collect(), key=str) and len(rows) == len(pages)
    for r in rows:
        fits = [x for x, _ in rules if (r.host == x.split("/")[0] or r.host.endswith("." + x.split("/")[0])) and r.path.startswith("/" + x.partition("/")[2])]
        best = max(fits, key=len, default=None)
        assert r.rule == best and r.verdict == (dict(rules)[best] if best else "allow")
    assert urls.filter_urls(df.limit(0), rules).count() == 0
    assert {r.verdict for r in urls.filter_urls(df, []).collect()} == {"allow"}


def test_vocabulary_parts_its_word_ends():
    with open(queries.tokenizer_path(), encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    pieces, last = wordpiece.vocabulary(queries.tokenizer_path())
    assert 0 <= sum(t.endswith("</w>") for t in vocab) - len(last) < 5 and len(pieces) + len(last) > 0.99 * len(vocab)
