import itertools
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kinweave.llm import packing

from .helpers import documents, no_documents, odd_documents


def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@given(st.text(max_size=60) | st.lists(st.sampled_from(["<|endoftext|>", "<|endoftext", "|>", " ", "  \n", "'s", "a", "Wort", "1234", "é"])).map("".join))
@settings(max_examples=500, deadline=None)
def test_ids(text):
    assert list(_encode(text)) == _tokenizer.encode(text, add_special_tokens=False).ids


_encode, _tokenizer = packing.gpt_style_encoder(), tokenizer()


def check(df, texts, found, capacity):
    rows = found.collect()
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    copies = Counter(i for i, _ in texts)
    assert set(pieces) == set(copies)
    for i, text in dict(texts).items():
        ids = np.array([*_tokenizer.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        parts = sorted({(r.piece, r.start, r.length, r.ids_crc32) for r in pieces[i]})
        assert len(pieces[i]) == copies[i] * len(parts)
        at = 0
        for n, (piece, start, length, crc) in enumerate(parts):
            assert (piece, start) == (n, at) and (n == 0 or length == capacity) and 0 < length <= capacity
            assert crc == zlib.crc32(ids[at : at + length].tobytes())
            at += length
        assert at == len(ids)
    placed = {}
    for r in rows:
        placed.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in placed.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(placed), sum(r.length for r in rows)


@pytest.mark.parametrize("capacity", [1024, 16])
def test_odd_rows(spark, capacity):
    df, texts = odd_documents(spark)
    check(df, texts, packing.pack(df, capacity=capacity), capacity)


def test_empty(spark):
    assert packing.pack(no_documents(spark)).count() == 0


def test_many(spark):
    rng = random.Random(2)
    texts = ["word " * rng.randint(0, 900) for _ in range(400)]
    used, tokens = check(None, list(enumerate(texts)), packing.pack(documents(spark, texts).repartition(5)), 1024)
    assert used <= 1.02 * -(-tokens // 1024) + 1


def fewest(sizes, capacity):
    """Bins needed, by trying every assignment."""
    best = len(sizes)

    def place(i, loads):
        nonlocal best
        if len(loads) >= best:
            return
        if i == len(sizes):
            best = len(loads)
            return
        for j in {load: j for j, load in enumerate(loads)}.values():
            if loads[j] + sizes[i] <= capacity:
                place(i + 1, [*loads[:j], loads[j] + sizes[i], *loads[j + 1 :]])
        place(i + 1, [*loads, sizes[i]])

    place(0, [])
    return best


@given(st.lists(st.integers(1, 20), max_size=8))
@settings(max_examples=60, deadline=None)
def test_bin_completion_is_optimal_on_small_cases(sizes):
    plan = packing.complete_bins(dict(Counter(sizes)), 20)
    patterns, used = plan.patterns, Counter()
    for pattern, times in patterns:
        assert sum(pattern) <= 20
        for s in pattern:
            used[s] += times
    assert used == Counter(sizes)
    assert plan.proven and plan.sequences == fewest(sorted(sizes, reverse=True), 20)
    assert plan.bound == packing.lower_bound(dict(Counter(sizes)), 20) <= plan.sequences


def test_better_than_best_fit():
    # best fit pairs 6 with 4 and is left with more sequences than needed
    sizes = Counter([6, 5, 5, 4, 4, 3, 3])
    assert packing.complete_bins(dict(sizes), 10).sequences == 3


def test_better_than_best_fit_on_many_sizes():
    """Sequences of three pieces each without any waste: best fit doesn't find them again."""
    rng, sizes = random.Random(3), Counter()
    for _ in range(4000):
        a = rng.randint(400, 900)
        b = rng.randint(60, 1024 - a - 60)
        sizes.update([a, b, 1024 - a - b])
    plan = packing.complete_bins(dict(sizes))
    assert len(sizes) > 800 and plan.bound == 4000
    assert plan.sequences < sum(n for _, n in packing.best_fit(dict(sizes), 1024))


@given(st.lists(st.integers(1, 12), min_size=1, max_size=5), st.integers(1, 20))
@settings(max_examples=60, deadline=None)
def test_fillings_are_all_undominated_ones(sizes, room):
    counts = Counter(sizes)
    left = [counts.get(s, 0) for s in range(21)]
    found = [tuple(sorted(f)) for f in packing.fillings(left, room)]
    assert len(found) == len(set(found)) and (left == [counts.get(s, 0) for s in range(21)])
    every = {tuple(sorted(c)) for n in range(len(sizes) + 1) for c in itertools.combinations(sizes, n) if sum(c) <= room}
    assert set(found) <= every

    def covers(big, small):
        """Whether the pieces of small can be dealt to those of big, which has pieces for each."""
        if not small:
            return True
        return any(b >= small[0] and covers([*big[:i], b - small[0], *big[i + 1 :]], small[1:]) for i, b in enumerate(big))

    assert all(any(covers(list(f), sorted(c, reverse=True)) for f in found) for c in every)


def test_slots_cover_every_rank():
    patterns = [((5, 3), 4), ((5, 2, 2), 2), ((3,), 1)]
    places = {(s, first + i): (seq + i, off) for s, first, n, seq, off in packing.slots(patterns) for i in range(n)}
    assert Counter(s for s, _ in places) == {5: 6, 3: 5, 2: 4}
    assert len(set(places.values())) == len(places)
    assert all(sorted(r for x, r in places if x == s) == list(range(n)) for s, n in {5: 6, 3: 5, 2: 4}.items())
    assert list(itertools.chain(*[p for p, _ in patterns]))
