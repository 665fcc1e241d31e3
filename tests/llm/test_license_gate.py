"""The gate lets through what the rules match on words."""

from docloom.llm import licenses


def test_provided_as_is_in_any_spelling(spark):
    texts = ["provided AS-IS", 'this work is provided "as\nis"', "Provided  as  is.", "provided for all"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licenses.scan(df).collect()}
    assert got == {0: "warranty", 1: "warranty", 2: "warranty", 3: ""}
