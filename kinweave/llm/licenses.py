"""License scan: Aho-Corasick over words, and a shunting-yard evaluation of licence expressions.

A text is lower-cased (A-Z only) and cut into words of digits, a-z and characters beyond ASCII. One
automaton holds the base phrases, further notice phrases and the identifier tag; a hit counts where
whole words stand consecutively. Expressions behind an identifier tag are parsed by shunting-yard
(WITH binds before AND, AND before OR) and evaluated to the openness they offer: OR gives the larger
of its sides, AND the smaller, WITH raises its licence half of the way towards 1.

Cases: a null or empty text has no words, no hits, empty labels and score 0. Repeated rows give
repeated results; a null id is kept. Only the two named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_texts

BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notice phrases beyond the base ones, with their labels.
NOTICES = {
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "apache license version 2 0": "apache-2.0",
    "mozilla public license": "mpl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "cc0": "cc0",
    "dedicated to the public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}
TAG = "spdx license identifier"
#: How freely a text under the label can be used, 0 to 1; the longest label that starts an identifier counts.
OPENNESS = {
    "mit": 1.0, "apache": 1.0, "bsd": 1.0, "isc": 1.0, "cc0": 1.0, "unlicense": 1.0, "public-domain": 1.0,
    "cc-by": 0.9, "mpl": 0.7, "lgpl": 0.6, "cc-by-sa": 0.6, "gpl": 0.5, "agpl": 0.4, "cc-by-nd": 0.3,
    "cc-by-nc": 0.2, "cc-by-nc-sa": 0.2, "cc-by-nc-nd": 0.1, "all-rights-reserved": 0.0,
}
UNKNOWN = 0.1
WORD_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_EXPRESSION = re.compile(r"(?i)SPDX-License-Identifier\s*:[ \t]*([^\r\n]*)")
_TOKEN = re.compile(r"\s*([()]|[A-Za-z0-9][A-Za-z0-9.+:-]*)")
_RANK = {"or": 1, "and": 2, "with": 3}


def words_of(text: str | None) -> list[bytes]:
    """UTF-8 words; bytes of characters beyond ASCII all count as word characters."""
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_TABLE).split()


def openness(identifier: str) -> float:
    known = [k for k in OPENNESS if identifier == k or identifier.startswith(k) and not identifier[len(k)].isalpha()]
    return OPENNESS[max(known, key=len)] if known else UNKNOWN


def to_postfix(text: str) -> list[str]:
    """The longest expression at the start of text, in postfix order by shunting-yard; [] if there is none.

    It ends before the first token that cannot follow. Unclosed brackets close at the end, and
    operators without a right side are left out.
    """
    out: list[str] = []
    ops: list[str] = []
    operand_next, at = True, 0
    while m := _TOKEN.match(text, at):
        token = m[1].lower()
        if operand_next:
            if token == "(":
                ops.append(token)
            elif token == ")" or token in _RANK:
                break
            else:
                out.append(token.rstrip(".:") or token)
                operand_next = False
        elif token == ")":
            if "(" not in ops:
                break
            while (op := ops.pop()) != "(":
                out.append(op)
        elif token in _RANK:
            while ops and ops[-1] != "(" and _RANK[ops[-1]] >= _RANK[token]:
                out.append(ops.pop())
            ops.append(token)
            operand_next = True
        else:
            break
        at = m.end()
    if operand_next:  # brackets and the operator that wait for a right side
        while ops and ops[-1] == "(":
            ops.pop()
        if ops:
            ops.pop()
    return out + [op for op in reversed(ops) if op != "("]


def evaluate(postfix: Iterable[str]) -> tuple[float, list[str]] | None:
    """Openness and licence identifiers of a postfix expression."""
    stack: list[tuple[float, list[str]]] = []
    for token in postfix:
        if token in _RANK:
            if len(stack) < 2:
                return None
            (b, right), (a, left) = stack.pop(), stack.pop()
            if token == "with":  # an exception: it grants more than the licence alone
                stack.append((a + (1 - a) / 2, left))
            else:
                stack.append((max(a, b) if token == "or" else min(a, b), left + right))
        else:
            stack.append((openness(token), [token]))
    return stack[-1] if stack else None


def automaton(phrases: Iterable[str]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in phrases:
        key = f" {phrase} ".encode().decode("latin-1")
        found.add_word(key, (phrase, len(key)))
    found.make_automaton()
    return found


def scan_text(text: str | None, finder: ahocorasick.Automaton, base: dict, notices: dict) -> dict:
    words = words_of(text)
    line = b" " + b" ".join(words) + b" " if words else b""
    starts, labels, base_labels, spans, tagged = [], set(), set(), [], False
    flat = line.decode("latin-1")
    at = count = 0
    for end, (phrase, length) in finder.iter(flat):
        begin = end - length + 1
        if begin < at:  # an earlier start than the last one counted
            count -= flat.count(" ", begin, at)
        else:
            count += flat.count(" ", at, begin)
        at = begin
        spans.append((count, phrase))
        if phrase in base:
            starts.append(count)
            base_labels.add(base[phrase])
        elif phrase == TAG:
            tagged = True
        else:
            labels.add(notices[phrase])
    openings = [openness(x) for x in labels | {x for x in base_labels if not any(y.startswith(x) for y in labels)}]
    expressions = []
    if tagged:
        for m in _EXPRESSION.finditer(text):
            if (found := evaluate(to_postfix(m[1]))) is not None:
                openings.append(found[0])
                labels.update(found[1])
                expressions.append(m[1].strip())
    return {
        "n_words": len(words),
        "n_base": len(starts),
        "first_word": min(starts, default=None),
        "last_word": max(starts, default=None),
        "base_labels": ",".join(sorted(base_labels)),
        "labels": ",".join(sorted(labels | base_labels)),
        "score": min(openings, default=0.0),
        "matches": sorted(spans),
        "expressions": expressions,
    }


def scan_licenses(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict = BASE, notices: dict = NOTICES
) -> DataFrame:
    """One row per row of df: counts, labels, openness score, every match (start word, phrase) and expression.

    score: the least openness among the statements found (0 if none was found).
    """

    def start():
        finder = automaton([*base, *notices, TAG])

        def work(ids, texts):
            found = [scan_text(t, finder, base, notices) for t in texts]
            out = {k: [x[k] for x in found] for k in found[0]}
            out["matches"] = [[{"word": w, "phrase": p} for w, p in x] for x in out["matches"]]
            return out | {id_col: ids}

        return work

    long, text = T.LongType(), T.StringType()
    match = T.StructType([T.StructField("word", long), T.StructField("phrase", text)])
    fields = [
        *[T.StructField(n, long) for n in ("n_words", "n_base", "first_word", "last_word")],
        T.StructField("base_labels", text), T.StructField("labels", text), T.StructField("score", T.DoubleType()),
        T.StructField("matches", T.ArrayType(match)), T.StructField("expressions", T.ArrayType(text)),
    ]
    return map_texts(df, id_col, text_col, start, fields)
