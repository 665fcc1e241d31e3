"""Secrets of any length and dates without leading zeros."""

import re

from docloom.llm import pii


def test_long_secrets_and_short_dates(spark):
    head = "aB3-" * 50
    texts = [f"token={head}{'x' * 796}END1 after", f"token={head}{'x' * 796}END2 after", f"sum {'0123456789abcdef' * 63} after", "on 3/4/1990, 29.2.2024, 2024-2-29, 29.02.2024 and 31.2.2024", f"password = {'q' * 200000}"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: r for r in pii.pseudonymise(df, "k").collect()}
    a, b = (re.fullmatch(r"token=(x[0-9a-f]{15}) after", got[k].text) for k in (0, 1))
    assert a.group(1) != b.group(1)
    assert re.fullmatch(r"sum x[0-9a-f]{15} after", got[2].text) and re.fullmatch(r"password = x[0-9a-f]{15}", got[4].text)
    d = re.fullmatch(r"on (\d{1,2}/\d{1,2}/\d{4}), (\d{1,2})\.(\d{1,2})\.(\d{4}), (\d{4})-(\d{1,2})-(\d{1,2}), (\d\d)\.(\d\d)\.(\d{4}) and 31\.2\.2024", got[3].text).groups()
    assert d[0] != "3/4/1990"
    assert len({(int(x), int(y), int(z)) for x, y, z in (d[1:4], d[6:3:-1], d[7:10])}) == 1 and (d[1], d[2], d[3]) != ("29", "2", "2024")
    assert got[3].pii == "date"
