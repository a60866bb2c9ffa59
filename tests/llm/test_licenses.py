import re

import pytest

from kinweave.llm import licenses

from .helpers import documents, no_documents, odd_documents

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base(text):
    """Places of the base phrases, by comparing words one by one."""
    found = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places = [(i, label) for p, label in licenses.BASE.items() for i in range(len(found)) if found[i : i + len(p.split())] == p.split()]
    return len(found), sorted(places)


TEXTS = [
    "MIT License. Apache License, Version 2.0; CC BY cc by-nc",
    "cc by cc by cc-by",
    "the GNU General Public License, version 3, and the gnu general public licenses",
    "xmit license mit licensex İmit license émit license",
    "SPDX-License-Identifier: MIT OR GPL-2.0-only AND Apache-2.0",
    "",
    None,
]


def test_against_brute_force(spark):
    odd, rows = odd_documents(spark)
    for df, texts in ((documents(spark, TEXTS), dict(enumerate(TEXTS))), (odd, dict(rows))):
        for r in licenses.scan_licenses(df).collect():
            n, places = base(texts[r.doc_id])
            starts = [i for i, _ in places]
            assert (r.n_words, r.n_base) == (n, len(places))
            assert (r.first_word, r.last_word) == (min(starts, default=None), max(starts, default=None))
            labels = {x for _, x in places}
            assert r.base_labels == ",".join(sorted(labels)) and labels <= set(r.labels.split(",")) | {""}
            assert 0 <= r.score <= 1
    assert odd.count() == licenses.scan_licenses(odd).count()
    assert licenses.scan_licenses(no_documents(spark)).count() == 0


@pytest.mark.parametrize(
    ("text", "postfix", "value"),
    [
        ("MIT", ["mit"], 1.0),
        ("MIT OR GPL-2.0 AND Apache-2.0", ["mit", "gpl-2.0", "apache-2.0", "and", "or"], 1.0),
        ("(MIT OR GPL-2.0) AND CC-BY-NC-4.0", ["mit", "gpl-2.0", "or", "cc-by-nc-4.0", "and"], 0.2),
        ("GPL-2.0 WITH Classpath-exception-2.0", ["gpl-2.0", "classpath-exception-2.0", "with"], 0.75),
        ("MIT AND", ["mit"], 1.0),
        ("(MIT", ["mit"], 1.0),
        ("MIT some prose", ["mit"], 1.0),
        (") MIT", [], None),
        ("", [], None),
    ],
)
def test_expressions(text, postfix, value):
    found = licenses.to_postfix(text)
    assert found == postfix
    result = licenses.evaluate(found)
    assert (result[0] if result else None) == value


def test_method_labels(spark):
    rows = {r.doc_id: r for r in licenses.scan_licenses(documents(spark, TEXTS)).collect()}
    assert rows[0].labels == "apache,apache-2.0,cc-by,cc-by-nc,mit"
    assert rows[2].labels == "gpl,gpl-3.0" and rows[2].score == 0.5
    assert rows[4].labels == "apache-2.0,gpl-2.0-only,mit" and rows[4].score == 1.0
