"""Near-duplicates by Order MinHash over word shingles, verified by banded alignment.

A document is the sequence of its shingles (five words each, lower case). Order MinHash gives each shingle its
occurrence number, takes the `ell` smallest under each of `sketches` hash functions, and keeps them in text
order; documents that agree on one such tuple are candidates. A pair is linked if its aligned similarity
reaches the threshold: the shingles that can be matched in order, over the shingles of the longer text. Such
pairs differ by few edits, so the alignment needs a band around the diagonal only. Of linked pairs at
the threshold itself two thirds of all their shingles are common, so a pair misses all of 20 sketches of 3 with
a probability of 0.0009, and with less where it is more similar.

Nothing grows with the square of a group, and no candidate of a bucket is lost:
- Rows whose words are the same are copies: one of each (smallest id) stands for them.
- Buckets of different lengths are split by length (similar texts are at most a fourth longer, so each goes
  to two of the classes).
- In rounds, every text is compared with one text of its bucket, drawn by hash, unless they are in one
  component already, as long as that is worth it.
- Then all candidates in different components are compared but those that can't be similar: with all shingles
  in one order, similar texts share one of the first fifth of theirs. By rising frequency the frequent
  passages come last, so such candidates come from a join on rare shingles: in rounds between one text of
  each component drawn for each shingle, and at last between all that are still apart. No similar pair of a
  bucket is left in two components.

Cases: a text of fewer words than a shingle is one shingle; texts without any word are equal if they are the same
text. A null text is in a class of its own. Rows that share an id are one document. A row with a null id has
a null class. An empty table gives an empty result. Only the two named columns are read.
"""

from __future__ import annotations

import functools
import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..checkpoints import cut, few_files, release
from ..operators.graph import connected_components
from .common import map_texts

WORD = re.compile(r"[^\W_]+")
SHINGLE, SKETCHES, ELL, THRESHOLD = 5, 20, 3, 0.8
#: Rounds of draws go on while this share of the compared pairs is linked.
WORTH = 0.05
#: Texts drawn at once of each component that has a shingle.
DRAWS = 4
#: Shingles that a task hands on at once.
TOKENS = 500_000
_M1, _M2, _GOLDEN = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def hashed(words: list[str]) -> np.ndarray:
    """64-bit hashes of words."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingles(w: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the runs of `size` words; a shorter text is one run."""
    size = min(size, len(w))
    if not size:
        return w
    out = np.zeros(len(w) - size + 1, dtype=np.uint64)
    for i in range(size):
        out = out * np.uint64(_GOLDEN) + w[i : i + len(out)]
    return mix(out)


def occurrences(values: np.ndarray) -> np.ndarray:
    """How often each value came before."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(values) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    out = np.empty(len(values), dtype=np.uint64)
    out[order] = np.arange(len(values)) - starts[np.cumsum(new) - 1]
    return out


def sketch(values: np.ndarray, count: int = SKETCHES, ell: int = ELL) -> np.ndarray:
    """One 64-bit key for each hash function: the ell smallest labelled shingles in text order."""
    if not len(values):
        return np.zeros(0, dtype=np.int64)
    labelled = mix(values + occurrences(values) * np.uint64(_GOLDEN))
    seeds = mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(_GOLDEN))
    ranks = mix(labelled[None, :] ^ seeds[:, None])
    if len(values) > ell:
        at = np.sort(np.argpartition(ranks, ell - 1, axis=1)[:, :ell], axis=1)
    else:
        at = np.broadcast_to(np.arange(len(values)), ranks.shape)
    key = seeds.copy()
    for i in range(at.shape[1]):
        key = mix(key * np.uint64(_GOLDEN) + labelled[at[:, i]])
    return key.view(np.int64)


def _least(longer: int, threshold: float) -> int:
    """Shingles that a text similar to one of `longer` shingles, or fewer, has in common with it."""
    return int(np.ceil(threshold * longer - 1e-9))


def similarity(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """Shingles matched in order over those of the longer text, or 0 if that is below the threshold.

    A similar pair leaves at most (1 - threshold) of the longer text unmatched, so its alignment stays
    within that many places of the diagonal. A narrow band is tried first: what it matches is certain.
    """
    longer, shorter = max(len(a), len(b)), min(len(a), len(b))
    least = _least(longer, threshold)
    if not shorter or shorter < least:
        return 0.0
    same = a[:shorter] == b[:shorter]
    head = shorter if same.all() else int(np.argmin(same))
    rest = shorter - head
    same = a[len(a) - rest :][::-1] == b[len(b) - rest :][::-1]
    tail = rest if same.all() else int(np.argmin(same))
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    most = longer - least
    narrow = min(most, 8 + abs(len(a) - len(b)) + longer // 50)
    matched = 0
    for band in sorted({narrow, most}):
        matched = head + tail + _aligned(a, b, band)
        if matched >= least:
            return matched / longer
    return 0.0


def _aligned(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Longest common subsequence within the band: the longest rising run through the matching positions."""
    if not len(a) or not len(b):
        return 0
    order = np.argsort(b, kind="stable")
    ordered = b[order]
    low, high = np.searchsorted(ordered, a, side="left"), np.searchsorted(ordered, a, side="right")
    places = order.tolist()
    tails: list[int] = []
    for i in np.flatnonzero(high > low).tolist():
        first, last = low[i], high[i]
        if last - first > 1:  # places of the same word rise
            first, last = bisect_left(places, i - band, first, last), bisect_right(places, i + band, first, last)
            for j in reversed(places[first:last]):
                at = bisect_left(tails, j)
                if at == len(tails):
                    tails.append(j)
                else:
                    tails[at] = j
        else:
            j = places[first]
            if abs(i - j) <= band:
                at = bisect_left(tails, j)
                if at == len(tails):
                    tails.append(j)
                else:
                    tails[at] = j
    return len(tails)


def signatures(df: DataFrame, id_col: str, text_col: str, shingle: int, sketches: int, ell: int) -> DataFrame:
    """(id, text_key, size, sketch, seq): text_key is the same for texts of the same words, null for a null text.

    seq holds the shingles' hashes in order, 32 bits each; size is their number.
    """

    def start():
        def work(ids, texts):
            keys, sizes, found, seqs = [], [], [], []
            for text in texts:
                words = WORD.findall(text.lower()) if text is not None else []
                whole = " ".join(words) if words else f"\0{text}"
                keys.append(None if text is None else hashlib.md5(whole.encode("utf-8", "surrogatepass")).digest())
                runs = shingles(hashed(words), shingle)
                sizes.append(len(runs))
                found.append(sketch(runs, sketches, ell))
                seqs.append(runs.astype("<u4").tobytes())
            ends = np.cumsum([0, *map(len, found)])
            flat = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found)))
            return {id_col: ids, "text_key": keys, "size": sizes, "sketch": flat, "seq": seqs}

        return work

    fields = [("text_key", T.BinaryType()), ("size", T.LongType()), ("sketch", T.ArrayType(T.LongType())), ("seq", T.BinaryType())]
    return map_texts(df, id_col, text_col, start, [T.StructField(*f) for f in fields])


def _sequences(column: pa.BinaryArray) -> Iterator[np.ndarray]:
    """The sequences of a column, read where they lie; a null is empty."""
    return (np.frombuffer(x.as_buffer() or b"", "<u4") for x in column)


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose similarity reaches the threshold."""
    own = lambda x: texts.select(F.col("node").alias(x), F.col("seq").alias(f"seq_{x}"))
    both = pairs.join(own("b"), "b").join(own("a"), "a").select("a", "b", "seq_a", "seq_b")

    def run(batches):
        for batch in batches:
            left, right = _sequences(batch.column(2)), _sequences(batch.column(3))
            fine = [similarity(x, y, threshold) > 0 for x, y in zip(left, right, strict=True)]
            yield batch.select([0, 1]).filter(pa.array(fine, type=pa.bool_()))

    return both.mapInArrow(run, both.select("a", "b").schema).distinct()


def _buckets(texts: DataFrame, threshold: float) -> DataFrame:
    """(key, node): the classes of the sketches' buckets by length. A bucket of similar lengths is one class as it is."""
    keyed = texts.select("node", "size", F.explode("sketch").alias("key"))
    several = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("size").alias("shortest"), F.max("size").alias("longest"))
    rows = keyed.join(several.filter("n > 1"), "key")
    alike = F.col("shortest") >= threshold * F.col("longest")
    step = F.floor(F.log(F.greatest("size", F.lit(1))) / float(np.log(1 / threshold)) + 1e-9)
    classes = F.when(alike, F.array(F.col("key"))).otherwise(F.array(F.xxhash64("key", step), F.xxhash64("key", step + 1)))
    return rows.select(F.explode(classes).alias("key"), "node").distinct()


def _open(rows: DataFrame) -> DataFrame:
    """(key, node) of rows (key, node, comp) whose key has several components."""
    several = rows.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y")
    return rows.join(several.select("key"), "key", "left_semi").select("key", "node")


def _drawn(rows: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of the nodes of rows (key, node, comp) and the one drawn of their key, where that is in another component."""
    draw = F.min(F.struct(F.xxhash64("node", F.lit(turn)), "node", "comp")).alias("d")
    both = rows.join(rows.groupBy("key").agg(draw), "key").filter("comp <> d.comp")
    return both.select(F.least("node", "d.node").alias("a"), F.greatest("node", "d.node").alias("b")).distinct()


class _Comparisons:
    """The pairs compared so far, the links among them, and the components of these."""

    def __init__(self, texts: DataFrame, threshold: float):
        self.texts, self.threshold = texts, threshold
        self.pairs: list[DataFrame] = []
        self.links: list[DataFrame] = []
        self.compared, self.found = 0, 0
        self.labels: DataFrame | None = None

    def compare(self, pairs: DataFrame, rows: int | None = None) -> float:
        """Compares the pairs (a, b) that are new, `rows` at most; returns the share of them that is linked."""
        if self.pairs:
            rows = max(rows, self.compared) if rows is not None else None
            pairs = pairs.join(functools.reduce(DataFrame.union, self.pairs), ["a", "b"], "left_anti")
        self.pairs.append(pairs := cut(few_files(pairs, rows)))
        self.links.append(links := cut(_verified(pairs, self.texts, self.threshold)))
        compared, found = pairs.count(), links.count()
        self.compared, self.found = self.compared + compared, self.found + found
        if found or self.labels is None:
            if self.labels is not None:
                release(self.labels)
            self.labels = connected_components(functools.reduce(DataFrame.union, self.links), rows=self.found)
        return found / max(1, compared)

    def placed(self, rows: DataFrame) -> DataFrame:
        """rows with a node, each with its component comp; a node without a link is one by itself."""
        if self.labels is None:
            return rows.withColumn("comp", F.col("node"))
        return rows.join(self.labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))

    def release(self) -> None:
        release(*self.pairs, *self.links, *filter(None, [self.labels]))


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = SHINGLE, sketches: int = SKETCHES,
    ell: int = ELL, threshold: float = THRESHOLD, worth: float = WORTH,
) -> DataFrame:
    """(id, class_id) for every row: class_id is the smallest id of the row's class. worth sets the number of rounds, not the result."""
    rows = cut(signatures(df, id_col, text_col, shingle, sketches, ell).withColumnRenamed(id_col, "node"))
    fine = F.col("node").isNotNull() & F.col("text_key").isNotNull()
    first = F.any_value(F.struct("size", "sketch")).alias("x")
    texts = cut(rows.filter(fine).groupBy("text_key").agg(F.min("node").alias("node"), first).select("text_key", "node", "x.*"))
    ids, reps = cut(rows.select("node", "text_key")), cut(texts.select("text_key", "node"))
    left = cut(_buckets(texts, threshold))
    # sequences travel once, and one of each text with a candidate goes on
    wanted = texts.join(left.select("node").distinct(), "node", "left_semi").select("text_key", "node")
    own = rows.filter(fine).select("text_key", "node", "size", "seq").join(wanted, ["text_key", "node"], "left_semi")
    one = F.any_value(F.struct("size", "seq")).alias("x")
    candidates = cut(own.groupBy("text_key", "node").agg(one).select("node", "x.*"))
    release(texts, rows)
    done = _Comparisons(candidates, threshold)
    linked, turn, held = 1.0, 0, [ids, reps, candidates]
    while linked >= worth and (most := left.count()):
        turn += 1
        linked = done.compare(_drawn(done.placed(left), turn), most)
        held.append(left)
        left = cut(few_files(_open(done.placed(left)), most))
    if left.take(1):
        prefixes, linked = _prefixes(done.placed(left), candidates, threshold), 1.0
        while linked >= worth:
            turn += 1
            linked = done.compare(_candidates(_drawn_by_token(done.placed(prefixes), turn), threshold))
        done.compare(_candidates(done.placed(prefixes), threshold))
        held.append(prefixes)
    # copies follow their text's representative
    classes = done.placed(reps).select("text_key", F.col("comp").alias("class_id"))
    placed = ids.filter(fine).join(classes, "text_key").select("node", "class_id")
    rest = ids.filter(~fine)
    out = placed.union(rest.select("node", F.col("node").alias("class_id"))).withColumnRenamed("node", id_col)
    out = cut(few_files(out, ids.count()))
    release(*held, left)
    done.release()
    return out


def keep_one(df: DataFrame, classes: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of df that stay: of each class the one of smallest id. Rows with a null id stay.

    Where several rows have that id, one stays: the first by their columns' values in order.
    """
    chosen = classes.filter(F.col(id_col) == F.col("class_id")).groupBy(id_col).agg(F.count(F.lit(1)).alias("n"))
    chosen = cut(chosen)
    rows = df.join(chosen.select(id_col), id_col, "left_semi").select(*df.columns)
    if chosen.filter("n > 1").take(1):
        once = rows.join(chosen.filter("n = 1").select(id_col), id_col, "left_semi").select(*df.columns)
        several = rows.join(chosen.filter("n > 1").select(id_col), id_col, "left_semi")
        whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
        first = several.groupBy(F.col(id_col).alias("__id")).agg(F.min(whole).alias("__row"))
        rows = once.union(first.select(*[F.col("__row")[c].alias(c) for c in df.columns]))
    return rows.union(df.filter(F.col(id_col).isNull()))


def _tokens(seq: np.ndarray) -> np.ndarray:
    """The shingles of a sequence, each with its occurrence number, as one hash each."""
    runs = seq.astype(np.uint64)
    return mix(runs + occurrences(runs) * np.uint64(_GOLDEN)).view(np.int64)


def _prefixes(rows: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(token, node, size, after, keys): the shingles by which candidates of rows (key, node, comp) can be similar.

    Of n shingles, similar texts share `least` or more, so with all shingles in one order they share one of their
    first n - least + 1. A shingle that no other component has is never shared; those come first, then
    the others by their number of texts. `after` counts a text's shingles from this one on.
    """
    nodes = rows.groupBy("node", "comp").agg(F.collect_set("key").alias("keys"))  # twice `sketches` at most
    nodes = cut(nodes.join(texts.select("node", "size", "seq"), "node"))

    def run(batches):
        for batch in batches:
            at, sizes = 0, np.cumsum(batch.column(2).to_numpy(zero_copy_only=False))
            while at < len(sizes):  # some texts at once, or a long one
                end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + TOKENS)))
                found = [_tokens(x) for x in _sequences(batch.column(3).slice(at, end - at))]
                again = pa.array(np.repeat(np.arange(at, end), [len(x) for x in found]))
                columns = [*[batch.column(i).take(again) for i in range(3)], pa.array(np.concatenate(found))]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "comp", "size", "token"])
                at = end

    kinds = nodes.select("node", "comp", "size").schema.fields
    tokens = nodes.select("node", "comp", "size", "seq").mapInArrow(run, T.StructType([*kinds, T.StructField("token", T.LongType())]))
    tokens = cut(tokens)
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("x"), F.max("comp").alias("y"))
    mine = tokens.join(counts.filter("x <> y").select("token", "n"), "token")
    ordered = mine.groupBy("node", "size").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("shared"))
    apart = F.col("size") - F.size("shared")
    most = F.greatest(F.lit(0), F.col("size") - _needed(F.col("size"), threshold) + 1 - apart)
    first = F.slice("shared", F.lit(1), most.cast("int"))
    found = ordered.select("node", "size", apart.alias("apart"), F.posexplode(first).alias("i", "t"))
    found = found.select("node", "size", (F.col("size") - F.col("apart") - F.col("i")).alias("after"), "t.token")
    found = cut(found.join(nodes.select("node", "keys"), "node"))
    release(nodes, tokens)
    return found


def _needed(longer: Column, threshold: float) -> Column:
    return F.ceil(threshold * longer - 1e-9)


def _drawn_by_token(prefixes: DataFrame, turn: int) -> DataFrame:
    """Of each token's rows a few of each component, drawn by hash."""
    draws = [F.min(F.struct(F.xxhash64("node", F.lit(turn), F.lit(i)), "node"))["node"].alias(f"d{i}") for i in range(DRAWS)]
    drawn = prefixes.groupBy("token", "comp").agg(*draws)
    drawn = drawn.select("token", F.explode(F.array_distinct(F.array(*[f"d{i}" for i in range(DRAWS)]))).alias("node"))
    return prefixes.join(drawn, ["token", "node"], "left_semi")


def _candidates(prefixes: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of prefixes' nodes of two components that share a key and a token, with enough shingles after it.

    Components are paired first: texts of one component, however many have a token, never meet.
    """
    comps = prefixes.select("token", "comp").distinct()
    both = comps.withColumnRenamed("comp", "comp_a").join(comps.withColumnRenamed("comp", "comp_b"), "token").filter("comp_a < comp_b")
    for x in "ab":
        own = [F.col(c).alias(f"{c}_{x}") for c in ("comp", "node", "size", "after", "keys")]
        both = both.join(prefixes.select("token", *own), ["token", f"comp_{x}"])
    need = _needed(F.greatest("size_a", "size_b"), threshold)
    both = both.filter((F.col("after_a") >= need) & (F.col("after_b") >= need) & F.arrays_overlap("keys_a", "keys_b"))
    return both.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()
