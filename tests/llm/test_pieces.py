import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinweave.llm import pieces

from .helpers import documents, no_documents, odd_documents

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = sentencepiece.SentencePieceProcessor(model_file=PATH)
VOCABULARY = pieces.load(PATH)


def test_vocabulary():
    assert VOCABULARY.pieces == [MODEL.id_to_piece(i) for i in range(len(MODEL))]
    assert VOCABULARY.scores == [MODEL.get_score(i) for i in range(len(MODEL))]
    assert VOCABULARY.model_type == "bpe" and len(VOCABULARY.byte_ids) == 256
    # units are safe: no piece goes on after a word's end
    assert not [p for p in VOCABULARY.index if pieces.SPACE in p.lstrip(pieces.SPACE) or "\n" in p]


@given(st.text(max_size=40) | st.text(alphabet="ab \n▁theing,.é", max_size=40))
@settings(max_examples=400, deadline=None)
def test_units_encode_like_the_whole(text):
    ids = [i for u in pieces.units_of(text) for i in pieces.encode_unit(u, VOCABULARY)]
    assert ids == MODEL.encode(text)


TEXTS = [
    "The quick brown fox, the quick brown fox; jumps  over   the lazy dog.\n\n  Indented\tline", "naïve café 日本語 \U0001f600", "▁a ▁▁ b",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", " ", "\n",
]


@pytest.mark.parametrize("min_count", [1, 3])
def test_against_sentencepiece(spark, min_count):
    odd, rows = odd_documents(spark)
    for df, texts in ((documents(spark, TEXTS * 2), list(enumerate(TEXTS * 2))), (odd, rows)):
        found = pieces.decode(pieces.encode(df, PATH, min_count=min_count), PATH)
        texts = dict(texts)
        for r in found.collect():
            assert r.ids == MODEL.encode(texts[r.doc_id] or "")
            assert r.decoded == (texts[r.doc_id] or "").replace("▁", " ") == MODEL.decode(r.ids)
        for r in pieces.encode_and_check(df, PATH, min_count=min_count).collect():
            text, ids = texts[r.doc_id] or "", np.array(MODEL.encode(texts[r.doc_id] or ""), dtype="<i4")
            assert (r.n_ids, r.ids_crc32, r.round_trip) == (len(ids), zlib.crc32(ids.tobytes()), "▁" not in text)
    assert pieces.encode(no_documents(spark), PATH).count() == 0
    assert pieces.encode_and_check(no_documents(spark), PATH).count() == 0


def test_long_unit(spark):
    text = "x" * 30_000
    row = pieces.encode(documents(spark, [text]), PATH).first()
    assert row.ids == MODEL.encode(text)


def unigram():
    rng = random.Random(4)
    names = ["".join(p) for n in (1, 2, 3) for p in itertools.product("ab", repeat=n)]
    scores = [-rng.uniform(1, 6) * (1 + 0.3 * len(n)) for n in names]
    return pieces.Vocabulary(["<unk>", *names], [0.0, *scores], [pieces.UNKNOWN, *[pieces.NORMAL] * len(names)], "unigram")


def every_segmentation(unit):
    if not unit:
        yield []
    for n in range(1, min(3, len(unit)) + 1):
        for rest in every_segmentation(unit[n:]):
            yield [unit[:n], *rest]


def test_viterbi(spark):
    vocabulary = unigram()
    low = pieces.unknown_score(vocabulary)
    units = sorted({"".join(random.Random(i).choice("abc") for _ in range(1 + i % 8)) for i in range(40)})

    def total(parts):
        if any(len(p) > 1 and p not in vocabulary.index for p in parts):
            return float("-inf")
        return sum(vocabulary.scores[vocabulary.index[p]] if p in vocabulary.index else low for p in parts)

    df = spark.createDataFrame([(u,) for u in units], "unit string")
    found = {r.unit: r.pieces for r in pieces.encode_units(df, vocabulary).collect()}
    for u in units:
        assert found[u] == pieces.viterbi(u, vocabulary)
        assert total(found[u]) == pytest.approx(max(map(total, every_segmentation(u))))


def test_relational_merges(spark):
    rng = random.Random(9)
    units = sorted({"▁" + "".join(rng.choice("thering ao") for _ in range(rng.randint(0, 14))).replace(" ", "") for _ in range(150)})
    df = spark.createDataFrame([(u,) for u in units], "unit string")
    found = pieces.encode_units(df, VOCABULARY)
    assert {r.unit: r.pieces for r in found.collect()} == {u: pieces.merge(u, VOCABULARY) for u in units}
    assert found.filter(F.array_join("pieces", "") != F.col("unit")).count() == 0
