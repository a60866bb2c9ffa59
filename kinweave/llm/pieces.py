"""SentencePiece encoding and decoding over a relational lattice.

A text with spaces written as U+2581 is cut into units where no piece can cross: before a run of U+2581,
and around line ends. For the units that are frequent in the whole corpus the lattice is relational:
explode a unit's substrings of bounded length, equi-join them to the piece table, group the edges by
unit, and fold them with a higher-order aggregate:

- model type "unigram": Viterbi, the path of the largest sum of scores;
- model type "bpe": merges in order of score. The scores of a BPE model are merge ranks, and the path of
  their largest sum isn't what SentencePiece returns, so Viterbi can't be used for it.

The units' ids are broadcast (`max_units` at most, none longer than MAX_LENGTH characters, as a fold costs the
square of the length). The pass over the texts looks units up and encodes the remaining, rare or long ones
by the same rules in place. Characters without a piece become bytes.

Cases: null and empty texts have no ids and decode to the empty text. Rows repeat as they come; a null
id is kept; ids outside the vocabulary are refused. U+2581 in a text decodes to a space. Models that need a character map aren't supported.
"""

from __future__ import annotations

import heapq
import re
import struct
import zlib
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, map_texts
from .counts import batches_of, most_frequent

SPACE = "▁"
UNIT = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
MAX_UNITS, MIN_COUNT, MAX_LENGTH = 400_000, 5, 64
NONE = float("inf")
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


@dataclass
class Vocabulary:
    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    model_type: str
    index: dict[str, int] = field(default_factory=dict)  # of the pieces that text can become
    byte_ids: dict[int, int] = field(default_factory=dict)

    def __post_init__(self):
        self.index = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == NORMAL}
        self.byte_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        self.costs = {p: -self.scores[i] for p, i in self.index.items()}
        self.longest = max(map(len, self.index), default=1)

    @property
    def unknown(self) -> int:
        return self.kinds.index(UNKNOWN)


def _fields(data: bytes):
    """(number, value) of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            size = varint()
            yield tag >> 3, data[at : at + size]
            at += size
        else:
            size = 4 if kind == 5 else 8
            yield tag >> 3, data[at : at + size]
            at += size


def load(path: str) -> Vocabulary:
    """A .model file: pieces with scores and kinds, and the model type."""
    with open(path, "rb") as file:
        model = list(_fields(file.read()))
    pieces, scores, kinds = [], [], []
    for number, value in model:
        if number == 1:
            own = dict(_fields(value))
            pieces.append(own[1].decode())
            scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
            kinds.append(own.get(3, NORMAL))
    trainer = next((dict(_fields(v)) for n, v in model if n == 2), {})
    normalizer = next((dict(_fields(v)) for n, v in model if n == 3), {})
    if normalizer.get(2) or normalizer.get(4, 1):
        raise ValueError("only models without a character map and without removal of white space are supported")
    return Vocabulary(pieces, scores, kinds, {1: "unigram", 2: "bpe"}[trainer.get(3, 1)])


def units_of(text: str | None) -> list[str]:
    return UNIT.findall(SPACE + text.replace(" ", SPACE)) if text else []


# Encoding of one unit in Python: for the rare ones, and to test the relational form.


def with_bytes(symbols: list[str], vocabulary: Vocabulary) -> list[int]:
    out: list[int] = []
    for s in symbols:
        if (i := vocabulary.index.get(s)) is not None:
            out.append(i)
        elif vocabulary.byte_ids:
            out.extend(vocabulary.byte_ids[b] for b in s.encode("utf-8", "surrogatepass"))
        else:
            out.append(vocabulary.unknown)
    return out


def merge(unit: str, vocabulary: Vocabulary) -> list[str]:
    """Adjacent symbols are merged, the best score first and then the leftmost, until no merge is left."""
    if len(unit) > MAX_LENGTH:
        return _merge_long(unit, vocabulary)
    cost = vocabulary.costs.get
    parts = list(unit)
    costs = [cost(a + b, NONE) for a, b in zip(parts, parts[1:], strict=False)]
    while costs and (best := min(costs)) < NONE:
        i = costs.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del costs[i]
        if i < len(costs):
            costs[i] = cost(parts[i] + parts[i + 1], NONE)
        if i:
            costs[i - 1] = cost(parts[i - 1] + parts[i], NONE)
    return parts


def _merge_long(unit: str, vocabulary: Vocabulary) -> list[str]:
    """The same with a heap, whose time doesn't grow with the square of the length."""
    costs = vocabulary.costs
    symbols: list[str | None] = list(unit)
    after, before = list(range(1, len(unit) + 1)), list(range(-1, len(unit) - 1))
    heap: list[tuple[float, int, str]] = []

    def offer(i: int, j: int) -> None:
        joined = symbols[i] + symbols[j]
        if (c := costs.get(joined)) is not None:
            heapq.heappush(heap, (c, i, joined))

    for i in range(len(unit) - 1):
        offer(i, i + 1)
    while heap:
        _, i, joined = heapq.heappop(heap)
        if symbols[i] is None or (j := after[i]) >= len(unit) or symbols[i] + symbols[j] != joined:
            continue
        symbols[i], symbols[j] = joined, None
        after[i] = after[j]
        if after[i] < len(unit):
            before[after[i]] = i
            offer(i, after[i])
        if before[i] >= 0:
            offer(before[i], i)
    return [s for s in symbols if s is not None]


def viterbi(unit: str, vocabulary: Vocabulary) -> list[str]:
    """The segmentation of the largest sum of scores; characters without a piece cost more than any piece. Ties: the longest last piece."""
    low = unknown_score(vocabulary)
    best: list[tuple[float, int]] = [(0.0, 0)]
    for j in range(1, len(unit) + 1):
        options = []
        for i in range(max(0, j - vocabulary.longest), j):
            k = vocabulary.index.get(unit[i:j])
            if k is not None or i == j - 1:
                options.append((best[i][0] + (vocabulary.scores[k] if k is not None else low), -i))
        score, start = max(options)
        best.append((score, -start))
    out, j = [], len(unit)
    while j:
        out.append(unit[best[j][1] : j])
        j = best[j][1]
    return out[::-1]


def unknown_score(vocabulary: Vocabulary) -> float:
    return min((vocabulary.scores[i] for i in vocabulary.index.values()), default=0.0) - 10.0


def encode_unit(unit: str, vocabulary: Vocabulary) -> list[int]:
    return with_bytes((merge if vocabulary.model_type == "bpe" else viterbi)(unit, vocabulary), vocabulary)


# The relational lattice.


def piece_table(spark: SparkSession, vocabulary: Vocabulary) -> DataFrame:
    """(piece, id, score): as many rows as the vocabulary has pieces."""
    rows = pa.table({
        "piece": list(vocabulary.index), "id": pa.array(list(vocabulary.index.values()), pa.int32()),
        "score": [float(vocabulary.scores[i]) for i in vocabulary.index.values()],
    })
    return spark.createDataFrame(rows)


def lattice(units: DataFrame, table: DataFrame, longest: int) -> DataFrame:
    """(unit, edges): edges (start, end, id, score), by start and end, of the pieces found in each unit."""
    starts = units.select("unit", F.explode(F.sequence(F.lit(1), F.length("unit"))).alias("at"))
    lengths = F.sequence(F.lit(1), F.least(F.lit(longest), F.length("unit") - F.col("at") + 1))
    spans = starts.select("unit", "at", F.explode(lengths).alias("len"))
    spans = spans.select("unit", "at", "len", F.substring("unit", F.col("at"), F.col("len")).alias("piece"))
    edges = spans.join(F.broadcast(table), "piece")  # as many rows as the vocabulary has
    edge = F.struct((F.col("at") - 1).alias("start"), (F.col("at") + F.col("len") - 1).alias("end"), "id", "score")
    found = edges.groupBy("unit").agg(F.sort_array(F.collect_list(edge)).alias("edges"))
    return units.join(found, "unit", "left").select("unit", F.coalesce("edges", F.array().cast(found.schema["edges"].dataType)).alias("edges"))


def fold_viterbi(unit: Column, edges: Column, low: float) -> Column:
    """Ends of the best path's pieces: a fold over the positions that keeps the best (score, start) of each."""
    n = F.length(unit)
    first = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("back")))

    def step(best: Column, j: Column) -> Column:
        into = F.filter(edges, lambda e: e["end"] == j)
        reach = lambda start: F.element_at(best, start + 1)["score"]
        options = F.transform(
            into, lambda e: F.struct((reach(e["start"]) + e["score"]).alias("score"), (-e["start"]).alias("back"))
        )
        alone = F.struct((reach(j - 1) + F.lit(low)).alias("score"), (1 - j).alias("back"))
        options = F.when(F.exists(into, lambda e: e["start"] == j - 1), options).otherwise(F.concat(options, F.array(alone)))
        chosen = F.array_max(options)
        return F.concat(best, F.array(F.struct(chosen["score"].alias("score"), (-chosen["back"]).alias("back"))))

    best = F.aggregate(F.sequence(F.lit(1), n), first, step)

    def back(ends: Column, _: Column) -> Column:
        start = F.element_at(best, F.element_at(ends, 1) + 1)["back"]
        return F.when(F.element_at(ends, 1) > 0, F.concat(F.array(start), ends)).otherwise(ends)

    return F.aggregate(F.sequence(F.lit(1), n), F.array(n), back)


def fold_merges(unit: Column, edges: Column) -> Column:
    """Ends of the pieces after all merges: each step of the fold joins the best adjacent pair, then the leftmost."""
    n = F.length(unit)
    first = F.sequence(F.lit(0), n)
    by_span = F.map_from_entries(F.transform(edges, lambda e: F.struct((e["start"] * 4096 + e["end"] - e["start"]).alias("k"), e["score"])))

    def step(state: Column, _: Column) -> Column:
        bounds = state["bounds"]
        inner = F.sequence(F.lit(2), F.size(bounds) - 1)

        def offer(i: Column) -> Column:
            start, end = F.element_at(bounds, i - 1), F.element_at(bounds, i + 1)
            return F.struct(F.element_at(state["scores"], start * 4096 + end - start).alias("score"), (-i).alias("i"))

        offers = F.when(F.size(bounds) > 2, F.filter(F.transform(inner, offer), lambda o: o["score"].isNotNull()))
        chosen = F.array_max(offers)
        rest = F.concat(F.slice(bounds, F.lit(1), -chosen["i"] - 1), F.slice(bounds, 1 - chosen["i"], F.size(bounds)))
        return F.struct(F.coalesce(rest, bounds).alias("bounds"), state["scores"].alias("scores"))

    begin = F.struct(first.alias("bounds"), by_span.alias("scores"))
    return F.aggregate(F.sequence(F.lit(1), n), begin, step, lambda s: s["bounds"])


def encode_units(units: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(unit, pieces): the strings of each distinct unit's pieces, single characters where there is none."""
    table = piece_table(units.sparkSession, vocabulary)
    edges = lattice(units, table, vocabulary.longest)
    bounds = (
        fold_merges(F.col("unit"), F.col("edges")) if vocabulary.model_type == "bpe"
        else fold_viterbi(F.col("unit"), F.col("edges"), unknown_score(vocabulary))
    )
    placed = edges.select("unit", bounds.alias("bounds"))
    spans = F.transform(
        F.sequence(F.lit(2), F.size("bounds")),
        lambda i: F.substring("unit", F.element_at("bounds", i - 1) + 1, F.element_at("bounds", i) - F.element_at("bounds", i - 1)),
    )
    return placed.select("unit", spans.alias("pieces"))


def count_units(df: DataFrame, text_col: str) -> DataFrame:
    """(unit, n) over all rows."""

    def run(batches):
        counts: Counter = Counter()

        def flush():
            yield from batches_of([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["unit", "n"])
            counts.clear()

        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(units_of(text))
                if len(counts) > 300_000:
                    yield from flush()
        yield from flush()

    return df.select(text_col).mapInArrow(run, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))


def frequent_units(df: DataFrame, vocabulary: Vocabulary, text_col: str, max_units: int, min_count: int) -> dict[str, bytes]:
    """Ids of the frequent units (32-bit little-endian), by the relational lattice."""
    counts = cut(count_units(df, text_col).filter((F.col("n") >= min_count) & (F.length("unit") <= MAX_LENGTH)))
    units = most_frequent(counts, "n", max_units, min_count).select("unit")
    table = encode_units(cut(units.repartition(units.sparkSession.sparkContext.defaultParallelism * 4)), vocabulary).toArrow()
    out: dict[str, bytes] = {}
    for batch in table.to_batches():
        for unit, symbols in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            out[unit] = packed(with_bytes(symbols, vocabulary))
    return out


def packed(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<i4").tobytes()


def _text_encoder(vocabulary: Vocabulary, known: dict[str, bytes]) -> Callable[[str | None], bytes]:
    """Ids of a text, 32-bit little-endian. Keeps those of up to 100,000 rare units."""
    get, rare = known.get, {}

    def rare_unit(unit: str) -> bytes:
        if (ids := rare.get(unit)) is None:
            if len(rare) > 100_000:
                rare.clear()
            ids = rare[unit] = packed(encode_unit(unit, vocabulary))
        return ids

    return lambda text: b"".join([get(u) or rare_unit(u) for u in units_of(text)])


def _prepared(df: DataFrame, path: str, text_col: str, max_units: int, min_count: int):
    vocabulary = load(path)
    known = frequent_units(df, vocabulary, text_col, max_units, min_count)
    return df.sparkSession.sparkContext.broadcast((vocabulary, known))


def encode(
    df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", max_units: int = MAX_UNITS, min_count: int = MIN_COUNT
) -> DataFrame:
    """(id, text, ids) for every row of df."""
    sent = _prepared(df, path, text_col, max_units, min_count)

    def start():
        one = _text_encoder(*sent.value)

        def work(ids, texts):
            found = [one(t) for t in texts]
            ends = np.cumsum([0, *[len(x) // 4 for x in found]])
            flat = np.frombuffer(b"".join(found), dtype="<i4")
            return {id_col: ids, "text": texts, "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))}

        return work

    fields = [T.StructField("text", T.StringType()), T.StructField("ids", T.ArrayType(T.IntegerType(), False))]
    return map_texts(df, id_col, text_col, start, fields, batch_chars=2_000_000)


def encode_and_check(
    df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", max_units: int = MAX_UNITS, min_count: int = MIN_COUNT
) -> DataFrame:
    """(id, n_ids, ids_crc32, round_trip) for every row of df: encodes, decodes, and keeps digests of the ids only.

    ids_crc32 is over the ids as 32-bit little-endian numbers; round_trip is whether they decode to the text.
    """
    sent = _prepared(df, path, text_col, max_units, min_count)

    def start():
        one, parts = _text_encoder(*sent.value), byte_parts(sent.value[0])

        def work(ids, texts):
            out = {id_col: ids, "n_ids": [], "ids_crc32": [], "round_trip": []}
            for text in texts:
                found = one(text)
                out["n_ids"].append(len(found) // 4)
                out["ids_crc32"].append(zlib.crc32(found))
                out["round_trip"].append(decode_ids(np.frombuffer(found, dtype="<i4").tolist(), parts) == (text or ""))
            return out

        return work

    fields = [T.StructField("n_ids", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("round_trip", T.BooleanType())]
    return map_texts(df, id_col, text_col, start, fields)


def decode_ids(ids: list[int], parts: list[bytes]) -> str:
    text = b"".join(map(parts.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
    return text[1:] if text[:1] == " " else text


def byte_parts(vocabulary: Vocabulary) -> list[bytes]:
    return [
        bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.encode()
        for p, k in zip(vocabulary.pieces, vocabulary.kinds, strict=True)
    ]


def decode(df: DataFrame, path: str, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """df with the text of its ids in a column named `to`, which must be new."""
    if to in df.columns:
        raise ValueError(f"df already has {to}")
    sent, at = df.sparkSession.sparkContext.broadcast(load(path)), df.columns.index(ids_col)

    def run(batches):
        parts = byte_parts(sent.value)
        for batch in batches:
            column = batch.column(at)
            flat, ends = column.values.to_numpy(), column.offsets.to_numpy()
            texts = [decode_ids(flat[a:b].tolist(), parts) for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, to])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(to, T.StringType())]))
