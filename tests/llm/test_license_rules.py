"""Every license rule against strings made from its own pattern, and whole scans against a plain search with all rules and no gate."""

import random
import re
from re import _constants as C
from re import _parser as P

import pytest

from docloom.llm import licenses

SF = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def sample(tree, rng):
    """A string that a pattern without back references matches."""
    out = []
    for op, arg in tree:
        if op is C.LITERAL:
            out.append(chr(arg))
        elif op is C.IN:
            kind, value = rng.choice(arg)
            out.append(chr(value) if kind is C.LITERAL else chr(rng.randint(*value)))
        elif op is C.BRANCH:
            out.append(sample(rng.choice(arg[1]), rng))
        elif op is C.SUBPATTERN:
            out.append(sample(arg[3], rng))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, inner = arg
            out += [sample(inner, rng) for _ in range(rng.randint(low, min(int(high), low + 1)))]
        elif op not in (C.ASSERT, C.ASSERT_NOT):
            raise ValueError(op)
    return "".join(out)


def passes(text):
    return any(w in text for w in licenses.GATE) or any(w in text and re.search(p, text) for w, p in licenses.GATE_PAIRS)


def test_gate_and_keywords_hide_no_rule():
    rng = random.Random(5)
    hidden = set()
    for _, label, key, _, pattern in licenses.rules():
        for _ in range(12):
            s = sample(P.parse(pattern), rng)
            odd = "".join(rng.choice(["  ", "-", " \n", ". ", ": "]) if c == " " else c for c in s)
            if key not in s or not passes(s) or not passes(odd):
                hidden.add((label, key, s))
    assert not hidden


def test_rules_are_written_by_hand():
    assert len({r[2] for r in licenses.NAMES}) + len({r[3] for r in licenses.OTHERS}) + len({r[1] for r in licenses.SHORT}) > 250


def slow(text):
    """(labels, score) by a search with all rules over the whole text."""
    w = WORD.findall((text or "").translate(LOW))
    norm, found = " ".join(w), []
    for p, label, _, sure, pattern in licenses.rules():
        found += [(m.start(), -m.end(), p, label, sure) for m in re.finditer(pattern, norm)]
    kept = [x for x in found if not any(y is not x and y[0] <= x[0] and y[1] <= x[1] and (y[:2] != x[:2] or y[2] < x[2]) for y in found)]
    base = {label for phrase, label in licenses.BASE if f" {phrase} " in f" {norm} "}
    return ",".join(sorted({x[3] for x in kept} | base)), max([x[4] for x in kept], default=0.5 if base else 0.0)


NAMED = {
    "SPDX-License-Identifier: Apache-2.0": "apache-2.0", "SPDX-License-Identifier: MIT": "mit", "// SPDX-License-Identifier: MPL-2.0": "mpl-2.0", "SPDX-License-Identifier: ISC": "isc",
    "SPDX-License-Identifier: LGPL-2.1-or-later": "lgpl-2.1-or-later", "SPDX-License-Identifier: AGPL-3.0-only": "agpl-3.0", "SPDX-License-Identifier: BSD-3-Clause": "bsd-3-clause", "GPLv2 or later": "gpl-2.0-or-later",
    "licensed under Apache 2.0": "apache-2.0", "released under the LGPL v3": "lgpl-3.0", "Released under MIT.": "mit", "the Expat licence": "mit", "Mozilla Public Licence, version 2.0": "mpl-2.0", "Server Side Public License": "sspl-1.0",
    "Elastic License 2.0": "elastic-2.0", "Business Source License 1.1": "busl-1.1", "LaTeX Project Public License": "lppl-1.3c", "BEER-WARE": "beerware", "CeCILL-B": "cecill-b", "PHP License": "php-3.01", "Ruby's License": "ruby",
    "Copyright (c) 2020 A. Person": "copyright", "All rights\nreserved": "reserved", "tous droits réservés": "reserved", "CC BY-NC-SA 4.0": "cc-by-nc-sa", "https://creativecommons.org/licenses/by-sa/4.0": "cc", "University of Illinois/NCSA Open Source License": "ncsa",
}


def test_scans_equal_a_plain_search(spark):
    rng = random.Random(9)
    texts = [*NAMED, *(f"words before {s}, and after" for s in NAMED), "cc by sa and " * 300, "MIT License GPL-3.0 " * 700, "", None, "Ünlicensed, über alles RECHTE VORBEHALTEN"]
    texts += [" ".join(sample(P.parse(rng.choice(licenses.rules())[4]), rng) for _ in range(4)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id + 100000 as doc_id", "text"))
    want = {r.doc_id: r.text for r in df.collect()}
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    for i, text in want.items():
        if text is None or len(text) < 2500:
            assert (got[i].labels, got[i].score) == slow(text), text and text[:200]
    for k, label in enumerate(NAMED.values()):
        assert label in got[k].labels.split(","), (list(NAMED)[k], got[k].labels)
    assert {d.label for d in got[2 * len(NAMED)].detections} == {"cc-by-sa"} and len(got[2 * len(NAMED)].detections) == 300
    assert licenses.scan(df.limit(0)).count() == 0


@pytest.mark.parametrize("unit", ["cc by sa and ", "mit license, "])
def test_many_matches_take_time_in_proportion(spark, unit):
    df = spark.createDataFrame([(1, unit * 32_000)], "doc_id long, text string")
    assert len(licenses.scan(df).first().detections) == 32_000
