"""Cross-entropy difference: documents scored by two n-gram models, of a target and of the background.

Both models are of bigrams, share the vocabulary of all words of all documents and the end of a text, and keep
every count. A document is scored by what the *other* documents hold: with c, n its own counts left out,

    p(w | v) = lambda * c(v, w) / c(v) + (1 - lambda) * (c(w) + 1) / (n + words),

and by the last fraction alone after a history that no other document has, so each history's probabilities
sum to 1. The background is all documents. The score is the mean over a text's words and its end of
log2 p_background - log2 p_target. Below 0 a document is nearer to the target.

1. Texts become blocks of about `block_words` words (one longer text is a block by itself), numbered by words of
   the block. Blocks are written once and never change. Each block's distinct words and bigrams become packs of 56-bit
   keys, dealt by their upper bits to buckets. The number of buckets follows the size of the texts.
2. Each bucket adds up its packs and answers every pack with the corpus's counts, in the pack's own order.
3. Each block meets its answers and scores its texts.

A task holds one bucket or one block. Nothing is cut by a bound or gathered on the driver but five totals, and
a frequent bigram is one entry of each block. Different bigrams with equal keys would share their counts: of m distinct
ones that befalls about m * m / 2**57 pairs.

Cases: null and empty texts, and texts without a word, have no words, null entropies and a null score, and
count nowhere. Without target documents that model is uniform. Rows repeat as they come, each a document of its own; a
null id is kept. Only the named columns are read. Ids listed twice as target count once. An empty table gives
an empty result.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import cut

WORD = re.compile(r"[^\W\d_]+")
LAMBDA = 0.6
#: Words of a block, and keys of a bucket, about.
BLOCK_WORDS, BUCKET_KEYS = 500_000, 1_000_000
#: Texts of a batch that are Python strings at once.
SLICE = 500
#: Target ids that may be broadcast (some 30 MB); more are joined by a shuffle, to the same result.
BROADCAST_IDS = 1_000_000
#: The first two words of every block.
END, START = 0, 1


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


_ZSTD = pa.Codec("zstd", compression_level=1)


def _packed(numbers: np.ndarray) -> bytes:
    """Compressed byte by byte of all numbers, as the upper bytes are alike; after the length."""
    planes = np.ascontiguousarray(numbers).view(np.uint8).reshape(len(numbers), numbers.itemsize).T.tobytes()
    return len(planes).to_bytes(8, "little") + _ZSTD.compress(planes, asbytes=True)


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    width, size = np.dtype(kind).itemsize, int.from_bytes(data[:8], "little")
    planes = np.frombuffer(_ZSTD.decompress(data[8:], size, asbytes=True), np.uint8)
    return planes.reshape(width, size // width).T.copy().view(kind).reshape(-1)


def _hashes(words) -> np.ndarray:
    return np.frombuffer(b"".join(blake2b(w.encode(), digest_size=8).digest() for w in words), np.uint64)


def _pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Keys of pairs of hashes, mixed so that their upper bits are even."""
    x = left * np.uint64(0x9E3779B97F4A7C15) + right
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted keys, and the place of each key among them."""
    order = np.argsort(keys, kind="stable")
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    return keys[order], place


def _bigrams(words: np.ndarray, starts: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted keys of a block's distinct bigrams, and the place of each word's bigram among them."""
    history = np.empty(len(words), np.int64)
    history[1:] = words[:-1]
    history[starts] = START
    pairs, inverse = np.unique(history * len(hashes) + words, return_inverse=True)
    keys, place = _places(_pair_keys(hashes[pairs // len(hashes)], hashes[pairs % len(hashes)]))
    return keys, place[inverse]


def _blocks(rows: DataFrame, block_words: int) -> DataFrame:
    """Rows (id, text, target) as blocks: a row (id, target, n) for each text, and one of all words, of each text's and of the hashes."""
    kinds = [("block", T.LongType()), ("id", rows.schema[0].dataType), ("target", T.BooleanType()), ("n", T.LongType()), ("place", T.IntegerType()),
             ("words", T.BinaryType()), ("sizes", T.BinaryType()), ("targets", T.BinaryType()), ("hashes", T.BinaryType())]
    schema = T.StructType([T.StructField(*k) for k in kinds])
    arrow = to_arrow_schema(schema)

    def batch(size: int, **columns) -> pa.RecordBatch:
        made = {k: v if isinstance(v, pa.Array) else pa.array(v, arrow.field(k).type) for k, v in columns.items()}
        return pa.RecordBatch.from_arrays([made[f.name] if f.name in made else pa.nulls(size, f.type) for f in arrow], schema=arrow)

    def block(number: int, ids: list, flags: list, texts: list, words: list):
        sizes = np.array([len(x) for x in texts])
        yield batch(len(texts), block=[number] * len(texts), id=pa.concat_arrays(ids), target=flags, n=np.maximum(sizes - 1, 0), place=np.arange(len(texts), dtype=np.int32))
        if sizes.any():
            held, flat = sizes > 0, np.concatenate(texts)
            yield batch(
                1, block=[number], words=[_packed(flat)], sizes=[_packed(sizes[held])], targets=[_packed(np.array(flags, np.int8)[held])],
                hashes=[_packed(_hashes(words))],
            )

    def run(batches):
        number = TaskContext.get().partitionId() << 32

        def empty():
            index = defaultdict(None, {"</s>": END, "<s>": START})  # neither is a word
            index.default_factory = index.__len__
            return index, [], [], [], 0

        index, ids, flags, texts, gathered = empty()
        for rows in (batch.slice(at, SLICE) for batch in batches for at in range(0, batch.num_rows, SLICE)):
            at = 0
            for i, (text, flag) in enumerate(zip(rows.column(1).to_pylist(), rows.column(2).to_pylist(), strict=True)):
                found = words_of(text)
                texts.append(np.array([*map(index.__getitem__, found), END] if found else [], np.int32))
                flags.append(flag)
                gathered += len(found) + 1
                if gathered >= block_words:
                    ids.append(rows.column(0).slice(at, i + 1 - at))
                    at = i + 1
                    yield from block(number, ids, flags, texts, list(index))
                    number += 1
                    index, ids, flags, texts, gathered = empty()
            ids.append(rows.column(0).slice(at))
        if texts:
            yield from block(number, ids, flags, texts, list(index))

    return rows.mapInArrow(run, schema)


def _read(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's words, the sizes of its texts that have any, whether those are the target's, and the hashes of its words."""
    kinds = {"words": np.int32, "sizes": np.int64, "targets": np.int8, "hashes": np.uint64}
    words, sizes, targets, hashes = (_unpacked(row[c], kind) for c, kind in kinds.items())
    return words.astype(np.int64), sizes, targets, hashes


def _buckets(keys: np.ndarray, bits: int):
    """(bucket, from, to) of sorted keys."""
    buckets = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    edges = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(keys)]
    return [(int(buckets[a]), a, b) for a, b in zip(edges, edges[1:], strict=False) if a < b]


def _packed_keys(keys: np.ndarray) -> bytes:
    return _packed(np.diff(keys >> np.uint64(8), prepend=np.uint64(0)))


def _packs(blocks: DataFrame, bits: int) -> DataFrame:
    """(block, bucket, data, n_all, n_target) of the rows of words. Packs of words have buckets below 0, those of bigrams others."""

    def run(batches):
        for row in (r for batch in batches for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
            words, sizes, targets, hashes = _read(row)
            target = np.repeat(targets, sizes) > 0
            single, place = _places(hashes)
            pairs, pair = _bigrams(words, np.cumsum(sizes) - sizes, hashes)
            for keys, places, of_words in ((single, place[words], True), (pairs, pair, False)):
                n, t = (np.bincount(x, minlength=len(keys)).astype(np.uint32) for x in (places, places[target]))
                made = [(-1 - k if of_words else k, _packed_keys(keys[a:b]), _packed(n[a:b]), _packed(t[a:b])) for k, a, b in _buckets(keys, bits)]
                columns = [pa.array(c, kind) for c, kind in zip(zip(*made, strict=True), (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]] * len(made)), *columns], names=["block", "bucket", "data", "n_all", "n_target"])

    return blocks.mapInArrow(run, "block long, bucket long, data binary, n_all binary, n_target binary")


def _vocabulary(blocks: DataFrame, bits: int) -> int:
    """How many words there are, ends among them."""

    def run(batches):
        for row in (r for batch in batches for r in batch.to_pylist()):
            keys = np.sort(np.delete(_unpacked(row["hashes"], np.uint64), START))
            bucket, data = zip(*((k, _packed_keys(keys[a:b])) for k, a, b in _buckets(keys, bits)), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(data, pa.binary())], names=["bucket", "data"])

    def different(packs: pa.Table) -> pa.Table:
        return pa.table({"different": [len(np.unique(np.concatenate(_keys(packs))))]})

    packs = blocks.select("hashes").mapInArrow(run, "bucket long, data binary")
    return packs.groupBy("bucket").applyInArrow(different, "different long").agg(F.sum("different")).first()[0] or 0


def _keys(packs: pa.Table) -> list[np.ndarray]:
    return [np.cumsum(_unpacked(x, np.uint64), dtype=np.uint64) for x in packs["data"].to_pylist()]


def _answer(packs: pa.Table) -> pa.Table:
    """The corpus's counts for every pack of one bucket."""
    keys = _keys(packs)
    sizes = np.cumsum([len(x) for x in keys])[:-1]
    distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    answers = {"block": packs["block"], "bucket": packs["bucket"]}
    for name in ("n_all", "n_target"):
        counts = np.concatenate([_unpacked(x, np.uint32) for x in packs[name].to_pylist()])
        sums = np.bincount(inverse, weights=counts, minlength=len(distinct)).astype(np.int64)[inverse]
        answers[name] = pa.array([_packed(x) for x in np.split(sums, sizes)], pa.binary())
    return pa.table(answers)


def _ranks(places: np.ndarray) -> np.ndarray:
    return np.argsort(np.argsort(places))


def _own(documents: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
    """How often each word's entry stands in its own document."""
    _, inverse, counts = np.unique(documents * size + places, return_inverse=True, return_counts=True)
    return counts.astype(np.int32)[inverse]


def losses(
    flat: np.ndarray, sizes: np.ndarray, target: np.ndarray, hashes: np.ndarray, words: np.ndarray, pairs: np.ndarray,
    totals: np.ndarray, documents: np.ndarray, vocabulary: int, weight: float,
) -> np.ndarray:
    """-log2 p, word by word of a block's texts, by (background, target).

    words, pairs: the corpus's counts by model and sorted key; totals, documents: its words with ends, and its texts.
    """
    starts = np.cumsum(sizes) - sizes
    keys, pair = _bigrams(flat, starts, hashes)
    place = _places(hashes)[1][flat]
    of = np.repeat(np.arange(len(sizes)), sizes)
    own_pair, own_word = _own(of, pair, len(keys)), _own(of, place, len(hashes))
    own_history = np.roll(own_word, 1)
    own_history[starts] = 1
    out = []
    for m, left_out in enumerate((np.ones(len(flat), np.int64), np.repeat(target, sizes).astype(np.int64))):
        word = words[m][place]
        history = np.roll(word, 1)
        history[starts] = documents[m]
        history = history - left_out * own_history
        follows = (pairs[m][pair] - left_out * own_pair) / np.maximum(1, history)
        single = (word - left_out * own_word + 1) / (totals[m] - left_out * np.repeat(sizes, sizes) + vocabulary)
        share = np.where(history > 0, weight, 0.0)
        out.append(-np.log2(share * follows + (1 - share) * single))
    return np.array(out)


def score(
    df: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", weight: float = LAMBDA,
    block_words: int = BLOCK_WORDS, bucket_keys: int = BUCKET_KEYS,
) -> DataFrame:
    """(id, n_words, h_target, h_background, score): cross-entropies in bits a word, and their difference.

    target_ids: a column of ids of the target's documents.
    """
    flags = target_ids.toDF("__id").filter("__id IS NOT NULL").distinct().withColumn("__target", F.lit(True))
    flags = cut(flags)
    flags = F.broadcast(flags) if flags.count() <= BROADCAST_IDS else flags.hint("merge")
    texts = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    size = texts.agg(F.sum(F.octet_length("__text"))).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, size / 6 / bucket_keys))))
    rows = texts.join(flags, "__id", "left").select("__id", "__text", F.coalesce("__target", F.lit(False)).alias("__target"))
    blocks = cut(_blocks(rows, block_words))
    documents, totals = np.zeros(2, np.int64), np.zeros(2, np.int64)
    for flag, count, words in blocks.filter("n > 0").groupBy("target").agg(F.count(F.lit(1)), F.sum(F.col("n") + 1)).collect():
        own = np.array([1, int(flag)])
        documents += own * count
        totals += own * words
    held = blocks.filter("words IS NOT NULL")
    vocabulary = _vocabulary(held, bits)
    packs = _packs(held.select("block", "words", "sizes", "targets", "hashes"), bits)
    answers = packs.groupBy("bucket").applyInArrow(_answer, "block long, bucket long, n_all binary, n_target binary")

    kinds = [("n_words", T.LongType()), ("h_target", T.DoubleType()), ("h_background", T.DoubleType()), ("score", T.DoubleType())]
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *[T.StructField(*k) for k in kinds]])
    arrow = to_arrow_schema(schema)

    def work(block: pa.Table, counts: pa.Table) -> pa.Table:
        whole = block["n"].is_null()
        rows = block.filter(pa.compute.invert(whole))
        n = rows["n"].to_numpy()
        none = n == 0
        means = np.zeros((2, len(n)))
        if not none.all():
            by_bucket = sorted(zip(*(counts[c].to_pylist() for c in ("bucket", "n_all", "n_target")), strict=True))
            models = []
            for own in ([x for x in by_bucket if x[0] < 0][::-1], [x for x in by_bucket if x[0] >= 0]):
                models.append([np.concatenate([_unpacked(x[m], np.int64) for x in own]) for m in (1, 2)])
            words, sizes, targets, hashes = _read(block.filter(whole).to_pylist()[0])
            lost = losses(words, sizes, targets, hashes, *models, totals, documents, vocabulary, weight)
            by_text = np.add.reduceat(lost, np.cumsum(sizes) - sizes, axis=1) / sizes
            # rows come in any order; the texts are told by their place
            means[:, ~none] = by_text[:, _ranks(rows["place"].to_numpy()[~none])]
        columns = [rows["id"], pa.array(n), *(pa.array(x, mask=none) for x in (means[1], means[0], means[1] - means[0]))]
        return pa.Table.from_arrays(columns, schema=arrow)

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(work, schema)
