"""Best-fit packing of tokenised documents into sequences, by bin completion.

1. Every text is tokenised and cut: pieces of `capacity` tokens from its end, the first one shorter.
   A piece is numbered among those of its length within its Spark partition, in the same pass.
2. Sizes are whole numbers up to the capacity, so the packing problem is the histogram of sizes, of
   `capacity` entries however many documents there are. Bin completion runs on it on the driver: around
   the largest remaining size it enumerates undominated fillings, prunes by waste bounds, and starts from
   the best-fit solution as the incumbent. The result is a list of patterns with their multiplicities. The
   search ends where the incumbent meets the lower bound, or after `nodes` patterns.
3. A piece finds its place from its size and its rank among the pieces of that size.

Cases: a null text is empty and gives one piece, the end token alone. An empty table gives an empty
result. Repeated rows are packed one by one. A null id is kept. Only the two named columns are read.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, map_texts

CAPACITY, END_ID = 1024, 2
#: Patterns that the search may try.
NODES = 12_000
#: Orders of fillings: where the larger size of a pair stands in their sum.
LEANS = (0.5, 1.0, 0.6, 0.9, 0.7, 0.8)


def bpe_encoder(path: str, pattern: str, special: dict[str, int]) -> Callable[[str], np.ndarray]:
    """Ids of a byte-level BPE vocabulary. The special tokens' strings have ids of their own wherever they stand."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    encoding = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: encoding.encode_to_numpy(text, allowed_special="all")


def gpt_style_encoder() -> Callable[[str], np.ndarray]:
    """The ids of byte_bpe_50k.json, made from the file of the same vocabulary that is read fastest."""
    import public_tokenizers

    return bpe_encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, {"<|endoftext|>": 50256})


def cut_points(n: int, capacity: int) -> list[int]:
    first = n % capacity or capacity
    return [0, *range(first, n + 1, capacity)]


def tokenize(
    df: DataFrame, id_col: str, text_col: str, encoder: Callable[[], Callable], capacity: int, end_id: int
) -> DataFrame:
    """Pieces, with their partition and the local rank among its pieces of the same length."""

    def start():
        encode, seen, part = encoder(), Counter(), TaskContext.get().partitionId()

        def work(ids, texts):
            out: dict[str, list] = {k: [] for k in (id_col, "piece", "start", "length", "ids_crc32", "part", "nth")}
            for doc, text in zip(ids, texts, strict=True):
                tokens = np.append(encode(text or ""), end_id).astype("<u4")
                at = cut_points(len(tokens), capacity)
                for i, (a, b) in enumerate(zip(at, at[1:], strict=False)):
                    values = (doc, i, a, b - a, zlib.crc32(tokens[a:b].tobytes()), part, seen[b - a])
                    for k, v in zip(out, values, strict=True):
                        out[k].append(v)
                    seen[b - a] += 1
            return out

        return work

    kinds = {"piece": T.IntegerType(), "part": T.IntegerType()}
    fields = [T.StructField(k, kinds.get(k, T.LongType())) for k in ("piece", "start", "length", "ids_crc32", "part", "nth")]
    return map_texts(df, id_col, text_col, start, fields)


# Packing of the histogram. A pattern is a tuple of sizes, largest first.


@dataclass
class Plan:
    """Patterns with their multiplicities. `bound` sequences are needed at least; `proven`: no fewer are possible."""

    patterns: list[tuple[tuple[int, ...], int]]
    bound: int
    proven: bool

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.patterns)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit-decreasing patterns: the largest size opens sequences, and what fits closest follows."""
    left, out = {s: n for s, n in counts.items() if n}, []
    while left:
        pattern, room = [], capacity
        spare = dict(left)
        while fitting := [s for s in spare if s <= room]:
            size = max(fitting)
            pattern.append(size)
            room -= size
            spare[size] -= 1
            if not spare[size]:
                del spare[size]
        need = Counter(pattern)
        times = min(left[s] // n for s, n in need.items())
        for s, n in need.items():
            left[s] -= times * n
            if not left[s]:
                del left[s]
        out.append((tuple(pattern), times))
    return out


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Martello and Toth's L2: sizes over capacity - k stand alone, and those of k or more need room."""
    best = -(-sum(s * n for s, n in counts.items()) // capacity)
    sizes = np.zeros(capacity + 1, dtype=np.int64)
    for s, n in counts.items():
        sizes[s] = n
    number = np.concatenate([np.cumsum(sizes[::-1])[::-1], [0]])  # of sizes at least s
    total = np.concatenate([np.cumsum((sizes * np.arange(capacity + 1))[::-1])[::-1], [0]])
    half = capacity // 2
    for k in range(1, half + 1):
        alone = int(number[capacity - k + 1])
        large = int(number[half + 1]) - alone
        room = large * capacity - int(total[half + 1] - total[capacity - k + 1])
        small = int(total[k] - total[half + 1])
        best = max(best, alone + large + max(0, -(-(small - room) // capacity)))
    return best


def reachable(left: list[int], room: int) -> tuple[list[int], list[int]]:
    """The sizes left up to the room, and for each i the sums that the first i of them reach, as bits."""
    mask, bits, sizes, sums = (1 << (room + 1)) - 1, 1, [], [1]
    for s in range(1, room + 1):
        if n := min(left[s], room // s):
            k = 1
            while n > 0:  # multiplicities by doubling
                bits |= bits << (s * min(k, n))
                n -= k
                k *= 2
            bits &= mask
            sizes.append(s)
            sums.append(bits)
    return sizes, sums


def _of_sum(
    left: list[int], sizes: list[int], sums: list[int], i: int, total: int, rest: int, chosen: tuple[int, ...] = ()
) -> Iterator[tuple[int, ...]]:
    """All undominated fillings of just this sum with the first i sizes after the chosen ones, those with the largest sizes first.

    Sizes come in falling order, so whatever could replace one, or two together, has been chosen or not by then.
    """
    if not total:
        yield chosen
        return
    i = min(i, bisect_right(sizes, total))
    while i and sums[i] >> total & 1:
        i -= 1
        s = sizes[i]
        if any(left[t] > chosen.count(t) for t in range(s + 1, s + rest + 1)):
            continue
        room = total + rest + sum(chosen)
        if any(s + c <= room and left[s + c] > chosen.count(s + c) for c in set(chosen)):
            continue
        most = min(left[s], total // s)
        if most > 1 and 2 * s <= room and left[2 * s] > chosen.count(2 * s):
            most = 1
        for times in range(most, 0, -1):
            if sums[i] >> (total - times * s) & 1:
                yield from _of_sum(left, sizes, sums, i, total - times * s, rest, chosen + (s,) * times)


def fillings(left: list[int], room: int, lean: float = 1.0) -> Iterator[tuple[int, ...]]:
    """The undominated fillings of the room, fullest first.

    A filling is dominated if one of its sizes, or two together, could be replaced by one larger size that
    still fits; such a replacement leaves smaller pieces, which are easier to place. Among the fullest, pairs
    come first, from that whose larger size is nearest to the share `lean` of the sum.
    """
    sizes, sums = reachable(left, room)
    fullest = sums[-1].bit_length() - 1
    if not fullest:
        yield ()
        return
    if left[fullest]:
        yield (fullest,)
        if fullest == room:  # a single piece fills it: it dominates every other filling
            return
    pairs = [(a, fullest - a) for a in range(fullest - 1, (fullest - 1) // 2, -1) if left[a] and left[fullest - a] > (2 * a == fullest)]
    if lean < 1:
        pairs.sort(key=lambda f: abs(f[0] - lean * fullest))
    yield from pairs
    for total in range(fullest, 0, -1):
        if sums[-1] >> total & 1:
            yield from (f for f in _of_sum(left, sizes, sums, len(sizes), total, room - total) if total < fullest or len(f) > 2)


def complete_bins(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> Plan:
    """Patterns that place every size, in as few sequences as the search finds.

    Branch and bound over patterns: the largest size left opens the next sequence, its undominated fillings are
    the branches, each used as often as the counts allow, and once. A branch is cut where its waste so far, or
    the sizes over half the capacity, leave no way to a better result. Best fit is the first incumbent. The search
    starts anew for each order of the fillings in LEANS, and shares `nodes` patterns among them: that bounds
    the effort, not the pieces. The plan holds the lower bound, so the gap is known.
    """
    best = best_fit(counts, capacity)
    bound = lower_bound(counts, capacity) if counts else 0
    plan = Plan(best, bound, False)
    ended = False
    for i, lean in enumerate(LEANS):
        if plan.sequences == bound or ended:
            break
        ended = _search(counts, capacity, plan, lean, nodes * (i + 1) // len(LEANS) - nodes * i // len(LEANS))
    plan.proven = ended or plan.sequences == bound
    return plan


def _search(counts: dict[int, int], capacity: int, plan: Plan, lean: float, nodes: int) -> bool:
    """Improves the plan; True if all branches were seen. State is changed in place and undone on the way back."""
    left = [0] * (capacity + 1)
    for s, n in counts.items():
        left[s] = n
    tokens = sum(s * n for s, n in counts.items())
    over_half = sum(n for s, n in counts.items() if 2 * s > capacity)
    fewest, used, waste, top = plan.sequences, 0, 0, capacity
    path: list[tuple[tuple[int, ...], int, int]] = []  # pattern, times, the top size before
    branches: list[Iterator[tuple[tuple[int, ...], int]]] = []

    def options(top: int) -> Iterator[tuple[tuple[int, ...], int]]:
        left[top] -= 1  # the one that opens the sequence
        found = fillings(left, capacity - top, lean)
        while True:
            f = next(found, None)
            left[top] += 1
            if f is None:
                return
            pattern = (top, *f)
            times = min(left[s] // n for s, n in Counter(pattern).items())
            yield pattern, times
            if times > 1:
                yield pattern, 1
            left[top] -= 1

    while True:
        while top and not left[top]:
            top -= 1
        if not top and used < fewest:
            plan.patterns, fewest = [(p, n) for p, n, _ in path], used
            if fewest == plan.bound:
                return True
        hopeless = not top or tokens + waste > (fewest - 1) * capacity or used + over_half >= fewest
        if not hopeless:
            if nodes <= 0:
                return False
            branches.append(options(top))
        while branches:
            if len(path) == len(branches):  # back from a branch
                pattern, times, top = path.pop()
                for s in pattern:
                    left[s] += times
                    over_half += times * (2 * s > capacity)
                used -= times
                waste -= times * (capacity - sum(pattern))
            if (step := next(branches[-1], None)) is not None:
                break
            branches.pop()
        else:
            return True
        pattern, times = step
        nodes -= 1
        path.append((pattern, times, top))
        for s in pattern:
            left[s] -= times
            over_half -= times * (2 * s > capacity)
        used += times
        waste += times * (capacity - sum(pattern))


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(size, first rank, ranks, first sequence, offset) for each place of each pattern."""
    out, used, sequence = [], Counter(), 0
    for pattern, times in patterns:
        offset = 0
        for size in pattern:
            out.append((size, used[size], times, sequence, offset))
            used[size] += times
            offset += size
        sequence += times
    return sorted(out)


def pack(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", encoder: Callable[[], Callable] = gpt_style_encoder,
    capacity: int = CAPACITY, end_id: int = END_ID, nodes: int = NODES,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = cut(tokenize(df, id_col, text_col, encoder, capacity, end_id))
    counts = pieces.groupBy("part", "length").agg((F.max("nth") + 1).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = cut(counts.select("part", "length", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    histogram = {r[0]: r[1] for r in bases.groupBy("length").agg(F.sum("n")).collect()}  # `capacity` rows at most
    full = histogram.pop(capacity, 0)
    patterns = complete_bins(histogram, capacity, nodes).patterns
    plan = slots([((capacity,), full)] if full else []) + [
        (s, r, n, q + full, o) for s, r, n, q, o in slots(patterns)
    ]
    plan.sort()
    ranked = pieces.join(bases, ["part", "length"]).select(
        id_col, "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank")
    )
    sent = df.sparkSession.sparkContext.broadcast(np.array(plan, dtype=np.int64).reshape(-1, 5))

    def place(batches):
        size, first, _, sequence, offset = sent.value.T
        shift = np.int64(1) << 48
        keys = size * shift + first
        for batch in batches:
            length, rank = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("length", "rank"))
            i = np.searchsorted(keys, length * shift + rank, side="right") - 1
            columns = [*batch.columns[:5], pa.array(sequence[i] + rank - first[i]), pa.array(offset[i])]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:5], "sequence_id", "offset"])

    schema = T.StructType(
        [*ranked.schema.fields[:5], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    )
    return ranked.mapInArrow(place, schema)
