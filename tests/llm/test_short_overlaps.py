"""Overlaps of 9 to 13 words with every allowed substitution, items of fewer words and scripts without spaces."""

import itertools

from docloom.llm import decontaminate


def test_short_alignments_equal_brute_force(spark):
    noise = " ".join(f"n{k}" for k in range(20))
    items = {n: [f"i{n}x{k}" for k in range(n)] for n in range(9, 14)}
    items[40] = [f"long{k}" for k in range(40)]
    rows, want = [], {}

    def add(before, words, after, item):
        for n in range(4):
            for gone in itertools.combinations(range(len(words)), n):
                text = " ".join([before, *("X" if k in gone else w for k, w in enumerate(words)), after])
                rows.append((len(rows), text))
                want[len(rows) - 1] = [item] if len(words) - n >= 0.8 * len(words) else []

    for n in range(9, 14):
        add(noise, items[n], noise, n)
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    got = {r.doc_id: r["items"] for r in decontaminate.find_overlaps(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == want
    rows.clear(), want.clear()
    for n in range(9, 13):  # cut off by the document's edge; no short item in the benchmark
        add("", items[40][-n:], noise, 40)
        add(noise, items[40][:n], "", 40)
        add("", items[40][5 : 5 + n], "", 40)
    got = {r.doc_id: r["items"] for r in decontaminate.find_overlaps(spark.createDataFrame(rows, "doc_id long, text string"), bench.filter("item_id = 40")).collect()}
    assert got == want


def test_items_of_few_words_and_unspaced_scripts(spark):
    bench = spark.createDataFrame([(1, "Quite short one"), (2, "我们今天在学校学习数学和历史课程"), (3, "猫好"), (4, ""), (5, None)], "item_id long, text string")
    rows = [(1, "a quite SHORT, one b"), (2, "a quite short b one"), (3, "昨天他说我们今天在学校学习语学和历史课程。"), (4, "大猫好看"), (5, "猫不好"), (6, "one"), (7, "quite short one")]
    got = {r.doc_id: r["items"] for r in decontaminate.find_overlaps(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {1: [1], 2: [], 3: [2], 4: [3], 5: [], 6: [], 7: [1]}
