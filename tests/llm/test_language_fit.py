"""Texts in no modelled language are not accepted, however sure the closed set of languages is."""

import numpy as np
from pyspark.sql import functions as F

from docloom.llm import language

SF = "/root/testdata/sf0.001"
ITALIAN = "La repubblica italiana è una democrazia fondata sul lavoro e la sovranità appartiene al popolo che la esercita nelle forme e nei limiti della costituzione"
SWEDISH = "Alla människor är födda fria och lika i värde och rättigheter och de är utrustade med förnuft och samvete"


def test_only_modelled_languages_are_accepted(spark):
    rng = np.random.default_rng(3)
    word = lambda letters: "".join(rng.choice(list(letters), rng.integers(2, 9)))
    junk = [" ".join(word(letters) for _ in range(n)) for letters in ("abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщыьэюя") for n in (5, 20, 200) for _ in range(20)]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    clean = docs.filter("length(text) >= 30")
    model = language.fit(docs, "text", "lang")
    odd = spark.createDataFrame([(k, t, None, "s") for k, t in enumerate([*junk, ITALIAN, SWEDISH], 1 << 20)], docs.schema)
    got = language.identify(clean.unionByName(odd), model, F.col("text"), F.col("lang"), F.col("source")).collect()
    assert not [r.text for r in got if r.doc_id >= 1 << 20 and r.accepted]
    clean = [r for r in got if r.doc_id < 1 << 20]
    assert sum(r.accepted for r in clean) >= 0.99 * len(clean)
