import random
from collections import Counter

import numpy as np
import pytest

from kinweave.llm import omh

from .helpers import documents, no_documents, odd_documents, words


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b, 1):
            row[j] = last[j - 1] + 1 if x == y else max(last[j], row[j - 1])
    return row[-1]


def edited(tokens, edits, seed):
    rng, out = random.Random(seed), list(tokens)
    for _ in range(edits):
        i = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[i] = f"new{chr(97 + rng.randrange(26))}"
        elif kind == 1:
            del out[i]
        else:
            out.insert(i, f"more{chr(97 + rng.randrange(26))}")
    return out


@pytest.mark.parametrize("seed", range(40))
def test_similarity_is_the_alignment(seed):
    rng = random.Random(seed)
    a = [rng.randrange(8) for _ in range(rng.randint(1, 60))]
    b = edited(a, rng.randint(0, 20), seed) if len(a) > 25 else [rng.randrange(8) for _ in range(rng.randint(1, 60))]
    ids = {x: i for i, x in enumerate(dict.fromkeys([*a, *b]))}
    x, y = (np.array([ids[t] for t in s], dtype="<u4") for s in (a, b))
    share = lcs(a, b) / max(len(a), len(b))
    assert omh.similarity(x, y) == pytest.approx(share if share >= 0.8 else 0.0)


def test_sketch_keeps_order_and_repeats():
    one = omh.shingles(omh.hashed(list(words(1, 100))))
    assert (omh.sketch(one) == omh.sketch(one.copy())).all()
    two = np.concatenate([one[50:], one[:50]])
    assert (omh.sketch(one) == omh.sketch(two)).mean() < 0.7  # the same shingles in another order
    assert list(omh.occurrences(np.array([5, 7, 5, 5], dtype=np.uint64))) == [0, 0, 1, 2]
    assert len(omh.sketch(one[:0])) == 0 and len(omh.sketch(one[:1])) == omh.SKETCHES


@pytest.mark.parametrize("kind", ["substitute", "insert", "delete", "all"])
@pytest.mark.parametrize("size", [80, 400])
def test_recall_from_the_threshold_up(kind, size):
    """Of the pairs of each range of similarity nearly all agree on a sketch."""
    rng, found = np.random.default_rng(size), {}
    most = int(0.055 * size) + 1
    for n in range(700):
        a = rng.integers(0, 2**63, size, dtype=np.uint64).tolist()
        b = list(a)
        for _ in range(n % most + 1):
            i, how = int(rng.integers(len(b))), ["substitute", "insert", "delete"][int(rng.integers(3))] if kind == "all" else kind
            b[i : i + (how != "insert")] = [] if how == "delete" else [int(rng.integers(0, 2**63))]
        x, y = (omh.shingles(np.array(s, dtype=np.uint64)) for s in (a, b))
        share = omh.similarity(x.astype("<u4"), y.astype("<u4"))
        if share:
            found.setdefault(min(int(share * 20), 19), []).append(bool((omh.sketch(x) == omh.sketch(y)).any()))
    assert set(found) >= {16, 17, 18} and all(np.mean(v) >= 0.97 for v in found.values()), {k: np.mean(v) for k, v in found.items()}


def classes(df, **settings):
    return dict(omh.near_duplicates(df, **settings).collect())


def brute(texts):
    words_of = [omh.WORD.findall((t or "").lower()) for t in texts]
    size = omh.SHINGLE
    tokens = [[" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else [] for w in words_of]
    bags, parent = [Counter(t) for t in tokens], list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if texts[i] is None or texts[j] is None:
                continue
            a, b = tokens[i], tokens[j]
            least = 0.8 * max(len(a), len(b))
            if not a or not b:
                same = texts[i] == texts[j]
            else:  # an alignment can't match more words than both have
                same = (bags[i] & bags[j]).total() >= least and lcs(a, b) >= least
            if same:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in range(len(texts))}


def corpus(seed):
    """Originals, copies that differ in case and punctuation, near copies, and texts that only share a passage."""
    passage = words(99, 60, 400)
    texts = []
    for i in range(12):
        own = words(seed * 100 + i, 80 + 10 * i, 500)
        texts += [" ".join(own), " ".join(own).upper() + "!", *[" ".join(edited(own, k + 1, k)) for k in range(3)]]
        texts.append(" ".join([*words(seed * 100 + i + 50, 70, 500), *passage, *words(seed * 100 + i + 70, 70, 500)]))
    return [*texts, "", "", "...", None, None, "one two", "one two", "One, two!", "two one"]


@pytest.mark.parametrize("seed", range(2))
def test_against_brute_force(spark, seed):
    texts = corpus(seed)
    assert classes(documents(spark, texts).repartition(5)) == brute(texts)


def test_large_groups(spark):
    """Large buckets: a family of near copies, and many texts that share a frequent passage with pairs among them."""
    own, passage = words(5, 120, 400), words(6, 90, 400)
    family = [" ".join(edited(own, 2, k)) for k in range(60)]
    sharing = [[*words(1000 + i, 25, 900), *passage, *words(3000 + i, 25, 900)] for i in range(60)]
    pairs = [" ".join(edited(s, 2, i)) for i, s in enumerate(sharing[::4])]
    texts = [*family, *map(" ".join, sharing), *pairs]
    found = classes(documents(spark, texts))
    assert found == brute(texts)
    assert {found[i] for i in range(60)} == {0}
    for i in range(60):
        assert found[60 + i] == 60 + i
    for n, i in enumerate(range(0, 60, 4)):
        assert found[120 + n] == 60 + i


def test_pairs_inside_a_frequent_passage(spark):
    """Most common keys of these pairs lie in a passage of three quarters of each text."""
    passage = words(7, 75, 400)
    sharing = [[*words(5000 + i, 12, 900), *passage, *words(7000 + i, 13, 900)] for i in range(80)]
    for i in range(0, 80, 2):  # the own words differ in every fifth place
        own = [f"new{w}" if k in (3, 95) else w for k, w in enumerate(sharing[i])]
        sharing[i + 1] = own[:12] + passage + own[87:]
    texts = [" ".join(s) for s in sharing]
    assert classes(documents(spark, texts)) == brute(texts)


def test_original_of_different_copies(spark):
    """Copies that lack another block each are similar to the original, but not to each other."""
    own = words(8, 500, 2000)
    texts = [" ".join(own)]
    for k in range(100):
        at = k % 5 * 90
        copy = own[:at] + own[at + 90 :]
        copy[k * 4] = f"edit{k}"
        texts.append(" ".join(copy))
    assert set(classes(documents(spark, texts), sketches=2, ell=1).values()) == {0}


@pytest.mark.parametrize("worth", [0.0001, 0.05, 2.0])
def test_rounds_do_not_change_the_result(spark, worth):
    """A family whose members are similar to some others only, and texts with a common passage; with many rounds and none."""
    own, passage = words(15, 150, 400), words(16, 100, 400)
    texts = [" ".join(edited(own, 4, k)) for k in range(50)]
    texts += [" ".join([*words(1500 + i, 30, 900), *passage, *words(3500 + i, 30, 900)]) for i in range(30)]
    assert classes(documents(spark, texts), worth=worth) == brute(texts)


def test_one_row_of_an_id_stays(spark):
    texts = [" ".join(words(s, 60)) for s in (1, 2)]
    df = spark.createDataFrame([(1, texts[1], "b"), (1, texts[0], "a"), (2, texts[0], "c")], "doc_id long, text string, x string")
    kept = {tuple(r) for n in (1, 3) for r in omh.keep_one(df.repartition(n), omh.near_duplicates(df)).collect()}
    assert kept == {min((1, texts[0], "a"), (1, texts[1], "b"))}


def test_short_texts_and_odd_rows(spark):
    df, rows = odd_documents(spark)
    found = omh.near_duplicates(df).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r.class_id for r in found}
    assert by_id[1] == 1 and by_id[6] == 5 and by_id[8] == 8 and by_id[None] is None
    assert omh.near_duplicates(no_documents(spark)).count() == 0
    kept = omh.keep_one(df, omh.near_duplicates(df))
    assert kept.columns == df.columns
    ids = sorted(r.doc_id for r in kept.filter("doc_id IS NOT NULL").collect())
    assert ids == [1, 2, 3, 4, 5, 7, 8, 9, 10, 11] and kept.filter("doc_id IS NULL").count() == 1
