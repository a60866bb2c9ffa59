import math
import re
from collections import Counter

import numpy as np
import pytest

from kinweave.llm import lm

from .helpers import documents, no_documents, odd_documents, words


def brute(texts, target, weight=lm.LAMBDA):
    """Every score in plain dictionaries, by models of all documents but the scored one. texts: by id."""
    tokens = {i: re.findall(r"[^\W\d_]+", (t or "").lower()) for i, t in texts.items()}
    known = {i: ["<s>", *x, "</s>"] for i, x in tokens.items() if x}
    vocabulary = {w for x in known.values() for w in x[1:]}
    out = {}
    for i in texts:
        if i not in known:
            out[i] = (0, None, None, None)
            continue
        h = []
        for of in (known.keys() & target, known.keys()):
            others = [known[j] for j in of if j != i]
            uni = Counter(w for x in others for w in x[1:])
            bi = Counter(p for x in others for p in zip(x, x[1:], strict=False))
            hist = Counter(w for x in others for w in x[:-1])
            logs = []
            for v, w in zip(known[i], known[i][1:], strict=False):
                single = (uni[w] + 1) / (sum(uni.values()) + len(vocabulary))
                logs.append(math.log2(weight * bi[v, w] / hist[v] + (1 - weight) * single if hist[v] else single))
            h.append(-sum(logs) / len(logs))
        out[i] = (len(tokens[i]), *h, h[0] - h[1])
    return out


@pytest.mark.parametrize("sizes", [{}, {"block_words": 100, "bucket_keys": 50}, {"block_words": 1}])
def test_against_brute_force(spark, sizes):
    texts = {i: " ".join(words(i % 7, 40 + i, 60)) for i in range(50)} | {50: None, 51: "", 52: "1 2"}
    texts |= {53: texts[3], 54: "one of a kind", 55: "kind kind kind"}
    target = {0, 7, 14, 50, 55}
    df = documents(spark, list(texts.values())).repartition(4)
    ids = spark.createDataFrame([(i,) for i in [*target, 0, None, 999]], "any long")
    expected = brute(texts, target)
    found = lm.score(df, ids, **sizes).collect()
    assert len(found) == len(texts)
    for r in found:
        n, *rest = expected[r.doc_id]
        assert r.n_words == n
        assert [r.h_target, r.h_background, r.score] == (pytest.approx(rest, rel=1e-9) if n else [None] * 3)


def test_a_shuffled_join_of_the_target_gives_the_same(spark, monkeypatch):
    df = documents(spark, [" ".join(words(i % 7, 40, 60)) for i in range(20)])
    ids = spark.createDataFrame([(i,) for i in range(0, 20, 3)], "doc_id long")
    sent = sorted(map(tuple, lm.score(df, ids).collect()))
    monkeypatch.setattr(lm, "BROADCAST_IDS", 0)
    assert np.allclose(sorted(map(tuple, lm.score(df, ids).collect())), sent)


def test_probabilities_of_a_history_sum_to_one():
    """p(w | v) over all w: each from a text of v and w, joined to a corpus of others that never has the last word."""
    rng = np.random.default_rng(5)
    size = 9
    hashes = lm._hashes([f"w{i}" for i in range(size)])
    order = np.argsort(hashes, kind="stable")
    corpus = [[*rng.integers(2, size - 1, 6), lm.END] for _ in range(8)]
    for v in range(2, size):
        sums = np.zeros(2)
        for w in (w for w in range(size) if w != lm.START):
            text = [v, w, lm.END] if w != lm.END else [v, lm.END]
            held = [*corpus, text]
            pairs = Counter(p for x in held for p in zip([lm.START, *x], x, strict=False))
            single = np.bincount(np.concatenate(held), minlength=size)
            own = np.array(text, np.int64)
            keys, place = lm._bigrams(own, np.array([0]), hashes)
            counts = np.zeros(len(keys), np.int64)
            counts[place] = [pairs[p] for p in zip([lm.START, *text], text, strict=False)]
            lost = lm.losses(
                own, np.array([len(text)]), np.array([True]), hashes, [single[order]] * 2, [counts] * 2, np.array([single.sum()] * 2),
                np.array([len(held)] * 2), size - 1, 0.6,
            )
            sums += np.exp2(-lost[:, 1])
        assert np.allclose(sums, 1), v


def test_odd_rows(spark):
    df, rows = odd_documents(spark)
    found = lm.score(df, spark.createDataFrame([(5,)], "doc_id long")).collect()
    assert len(found) == len(rows) and all((r.score is None) == (r.n_words == 0) for r in found)


def test_nothing(spark):
    ids = spark.createDataFrame([], "doc_id long")
    assert lm.score(no_documents(spark), ids).count() == 0
    assert lm.score(documents(spark, ["some words"]), ids).first().score == pytest.approx(0.0)
    assert lm.score(documents(spark, [None, "1"]), ids).count() == 2


def test_prefers_the_target_and_knows_copies(spark):
    texts = [" ".join(words(1, 200, 50)) for _ in range(10)] + [" ".join(words(2, 200, 50)) for _ in range(10)]
    found = {r.doc_id: r for r in lm.score(documents(spark, texts), spark.createDataFrame([(i,) for i in range(5)], "i long")).collect()}
    assert max(found[i].score for i in range(10)) < 0.01 < min(found[i].score for i in range(10, 20))
