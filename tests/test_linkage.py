"""Fixtures by hand, invariants, and random tables against a plain model."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from kinweave import checkpoints
from kinweave.config import LinkageConfig
from kinweave.operators import blocking, candidates, dedupe, graph, order, tokens
from kinweave.plans.linkage import link_records
from kinweave.sources.delimited import output_name, read_delimited, write_cluster_lines

ATTRS = ("attr_1", "attr_2", "attr_3", "attr_4")
CONFIG = LinkageConfig(ATTRS, (1, 1, 1, 1), total=1)
ONE = LinkageConfig(("attr_1",), (1,), total=1)


def table(spark, rows, n=4):
    """Records whose attributes are the given values, filled with empty ones."""
    rows = [(i, *[*r, *[""] * (n - len(r))]) for i, r in enumerate(rows)]
    names = [f"attr_{i}" for i in range(1, n + 1)]
    df = spark.createDataFrame(rows, "row_id long, " + ", ".join(f"{x} string" for x in names))
    return dedupe.records(df, "row_id", names)


def pairs(df):
    return {tuple(r) for r in df.collect()}


def clusters(df):
    out = {}
    for u, leader in df.select("u", "leader").collect():
        out.setdefault(leader, set()).add(u)
    return {frozenset(x) for x in out.values()}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def model(rows):
    """Unique rows in order, links, components and leader clusters, one step after another."""
    keys, groups = ["".join(r) for r in rows], {}
    for i, k in enumerate(keys):
        groups.setdefault(k.rstrip("0"), i)
    longest = max(map(len, keys), default=0)
    uniq = sorted(groups.values(), key=lambda i: (keys[i].ljust(longest, "0"), i))
    near = {}
    for a in uniq:
        for b in uniq:
            d = [distance(x, y) for x, y in zip(rows[a], rows[b], strict=True)]
            if a != b and max(d) <= 1 and sum(d) <= 1:
                near.setdefault(a, set()).add(b)
    comp, lead = {}, {}
    for a in sorted(uniq):
        stack = [a]
        while stack and a not in comp:
            reached = {a}
            while stack:
                for x in near.get(stack.pop(), ()):
                    if x not in reached:
                        reached.add(x)
                        stack.append(x)
            for x in reached:
                comp[x] = min(reached)
    for a in uniq:
        if a not in lead:
            lead[a] = a
            for b in near.get(a, ()):
                lead.setdefault(b, a)
    links = {(a, b) for a in near for b in near[a] if a < b}
    return links, comp, lead


def test_normalise(spark):
    rows = table(spark, [["O'Neil-Smith, Jr."], [None]]).orderBy("row_id").collect()
    assert [r.attr_1 for r in rows] == ["oneilsmith jr", ""]


@pytest.mark.parametrize(
    ("rows", "parity", "strict"),
    [
        ([["ab", "c"], ["a", "bc"]], 1, 2),
        ([["ann", "lee", "x", "199"], ["ann", "lee", "x", "1990"]], 1, 2),
        ([["a"], ["a"], ["a"]], 1, 1),
    ],
)
def test_duplicate_keys(spark, rows, parity, strict):
    df = table(spark, rows)
    assert dedupe.exact_groups(df, CONFIG).count() == parity
    assert dedupe.exact_groups(df, LinkageConfig(ATTRS, (1, 1, 1, 1), key_mode="strict")).count() == strict


@pytest.mark.parametrize(
    ("a", "b", "block", "head"),
    [
        ("smith", "smyth", True, False),
        ("smith", "pmith", False, True),
        ("smith", "mith", False, True),
        ("abc", "abd", False, False),
        ("1main", "1mayn", True, False),
    ],
)
def test_candidates(spark, a, b, block, head):
    uniq = dedupe.unique_records(table(spark, [[a], [b]]), CONFIG)
    assert bool(pairs(candidates.block_pairs(uniq, CONFIG))) == block
    assert bool(pairs(candidates.headless_pairs(uniq, CONFIG))) == head
    assert bool(pairs(candidates.links(uniq, CONFIG))) == (block or head)
    assert pairs(candidates.exact_links(uniq, CONFIG)) == {(0, 1)}


@pytest.mark.parametrize(
    ("rows", "linked"),
    [
        ([["smith", "jonas"], ["smyth", "jonas"]], True),
        ([["smith", "jonas"], ["smyth", "jones"]], False),
        ([["smith", ""], ["smith", "a"]], True),
        ([["x" * 80], ["x" * 79 + "y"]], True),
    ],
)
def test_link_predicate(spark, rows, linked):
    uniq = dedupe.unique_records(table(spark, rows), CONFIG)
    assert bool(pairs(candidates.links(uniq, CONFIG))) == linked


@pytest.mark.parametrize(
    ("words", "expected"),
    [
        (["annal", "annel", "annelx"], {frozenset({0, 1}), frozenset({2})}),
        (["annal", "annalx", "annel"], {frozenset({0, 1, 2})}),
    ],
)
def test_leaders(spark, words, expected):
    result = link_records(table(spark, [[w] for w in words]), CONFIG)
    assert result.components.select("comp").distinct().count() == 1
    assert clusters(result.clusters) == expected


def pairs_by_hand(words, share):
    return {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if i < j and share(a, b)}


def moves_no_pairs(df):
    """Whether nothing is shuffled or grouped once the pairs are made."""
    above = df._jdf.queryExecution().executedPlan().toString().split("Generate explode")[0]
    return "Exchange" not in above and "Aggregate" not in above


def super_keys(word):
    """Independent of the package: first character and cyclic three letters."""
    s = word.ljust(3, "a")
    return {s[0] + (s + s)[j : j + 3] for j in range(len(s))}


def crowded():
    """Records of few names, one of them in 40 records, each with another second attribute."""
    rng = random.Random(1)
    words = ["smith"] * 40 + [rng.choice(["smyth", "smit", "pmith", "mith", "jones", "", "a", "0", "00"]) for _ in range(50)]
    return words, [[w, f"x{i}y"] for i, w in enumerate(words)]


@pytest.mark.parametrize("listed", [4, 512])
def test_block_pairs_are_made_from_values(spark, monkeypatch, listed):
    monkeypatch.setattr(candidates, "LISTED", listed, raising=False)
    words, rows = crowded()
    found = candidates.block_pairs(dedupe.unique_records(table(spark, rows), CONFIG), CONFIG)
    assert moves_no_pairs(found)
    assert sorted(map(tuple, found.collect())) == sorted(pairs_by_hand(words, lambda a, b: super_keys(a) & super_keys(b)))


def test_headless_pairs_are_made_from_values(spark, monkeypatch):
    monkeypatch.setattr(candidates, "LISTED", 4, raising=False)
    words, rows = crowded()
    uniq = dedupe.unique_records(table(spark, rows), CONFIG)
    keys = lambda w: {w.rstrip("0"), w[1:].rstrip("0")}
    found = candidates.headless_pairs(uniq, CONFIG)
    assert moves_no_pairs(found)
    assert sorted(map(tuple, found.collect())) == sorted(pairs_by_hand(words, lambda a, b: keys(a) & keys(b)))


def test_unconnected_pairs_leave_out_components(spark, sf_dir, monkeypatch):
    from kinweave.plans import queries

    assert moves_no_pairs(queries.unconnected_pairs(spark, sf_dir))
    monkeypatch.setattr(candidates, "LISTED", 4)
    words, rows = crowded()
    known = spark.createDataFrame([(i, i % 3) for i in range(len(rows))], "u long, comp long")
    found = candidates.block_pairs(dedupe.unique_records(table(spark, rows), CONFIG), CONFIG, known)
    every = pairs_by_hand(words, lambda a, b: super_keys(a) & super_keys(b))
    assert sorted(map(tuple, found.collect())) == sorted((a, b) for a, b in every if a % 3 != b % 3)


def test_headless_links(spark):
    uniq = dedupe.unique_records(table(spark, random_rows(3, 90)), CONFIG)
    assert pairs(candidates.headless_links(uniq, CONFIG)) == pairs(candidates.verified(candidates.headless_pairs(uniq, CONFIG), uniq, CONFIG))
    one = dedupe.unique_records(table(spark, [["smith"], ["pmith"], ["smyth"]], n=1), ONE)
    assert pairs(candidates.headless_links(one, ONE)) == {(0, 1)}


def test_adjacent_headless_misses_what_lies_apart(spark):
    # all share the headless key "nnal"; in record order the second stands between the linked ones
    rows = [["annal", "x"], ["bnnal", "qqq"], ["cnnal", "x"]]
    uniq = dedupe.unique_records(table(spark, rows), CONFIG)
    every = candidates.verified(candidates.headless_pairs(uniq, CONFIG), uniq, CONFIG)
    assert pairs(every) == {(0, 2)}
    assert not pairs(candidates.verified(candidates.headless_neighbours(uniq, CONFIG), uniq, CONFIG))


def test_token_gate(spark):
    df = table(spark, [["smithers", "abc"], ["smithers", "abd"]])
    gated = LinkageConfig(ATTRS, (1, 1, 1, 1), token_gate=True)
    assert link_records(df, CONFIG).links.count() == 1
    assert link_records(df, gated).links.count() == 0


def test_adjacent_mode_and_exact_mode(spark):
    df = table(spark, [["abc"], ["abd"], ["smith"], ["pmith"]])
    assert pairs(link_records(df, LinkageConfig(ATTRS, (1, 1, 1, 1), candidates="exact")).links) == {(0, 1), (2, 3)}
    assert pairs(link_records(df, LinkageConfig(ATTRS, (1, 1, 1, 1), headless="adjacent")).links) == {(2, 3)}


def random_rows(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice("ab0") for _ in range(rng.randint(0, 6))) for _ in range(12)]

    def edit(w):
        i = rng.randint(0, len(w))
        return rng.choice([w[:i] + rng.choice("ab0") + w[i:], w[:i] + w[i + 1 :], w])

    return [[edit(rng.choice(words)), rng.choice("xy"), rng.choice(["", "z"]), edit(rng.choice(words[:2]))] for _ in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_random_tables(spark, seed):
    rows = random_rows(seed, 90)
    links, comp, lead = model(rows)
    for partitions in (1, 7):
        result = link_records(table(spark, rows).repartition(partitions), LinkageConfig(ATTRS, (1, 1, 1, 1), candidates="exact"))
        assert pairs(result.links) == links
        assert dict(result.components.collect()) == comp
        assert dict(result.clusters.collect()) == lead
    block = link_records(table(spark, rows), CONFIG)
    literal = candidates.verified(
        candidates.block_pairs(block.unique, CONFIG).union(candidates.headless_pairs(block.unique, CONFIG)).distinct(), block.unique, CONFIG
    )
    assert pairs(block.links) == pairs(literal) <= links
    # invariants: every record is in one cluster, and unions are what components save
    assert block.cluster_members.count() == len(rows)
    row = block.summary.first()
    assert row.accepted_unions == row.unique_records - row.components and row.clusters >= row.components


def test_hot_group_uses_neighbourhoods(spark):
    words = [f"{a}{b}{c}" for a in "abcd" for b in "abcd" for c in "abcd"]
    uniq = dedupe.unique_records(table(spark, [[w] for w in words]), CONFIG)
    expected = {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if i < j and distance(a, b) <= 1}
    assert len(words) > candidates.SMALL and pairs(candidates.exact_links(uniq, CONFIG)) == expected


def test_total_of_two(spark):
    cfg = LinkageConfig(ATTRS, (1, 2, 1, 1), total=2)
    rows = [["smith", "jonas", "x"], ["smyth", "jones", "x"], ["smith", "jon", "x"], ["smyth", "jones", "y"]]
    uniq = dedupe.unique_records(table(spark, rows), cfg)
    assert pairs(candidates.exact_links(uniq, cfg)) == {(0, 1), (0, 2), (1, 3)}


def test_total_beyond_attributes_joins_blocks(spark):
    result = link_records(table(spark, [["smithers"], ["smythers"], ["jones"]], n=1), ONE)
    assert pairs(result.links) == {(0, 1)} and result.component_links.count() == 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (7, 7), (200, 200)]
    found = dict(graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 200}
    star = [(5, i) for i in range(6, 60)]
    assert set(dict(graph.connected_components(spark.createDataFrame(star, "a long, b long")).collect()).values()) == {5}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_small_tables_of_components_take_few_files(spark, monkeypatch):
    written, settings = [], {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}

    def listed(df):
        out = checkpoints.cut(df)
        written.append(sorted(p.name for p in Path(out._kinweave_path.removeprefix("file:")).iterdir() if p.suffix != ".crc"))
        return out

    monkeypatch.setattr(graph, "cut", listed)
    edges = spark.range(3000).selectExpr("id AS a", "id + IF(id % 10 = 9, 0, 1) AS b")
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = dict(graph.connected_components(edges).collect())
        rounds = written[1:]
        assert len(rounds) > 3 and all(len(names) == 1 and names[0].startswith("part-") for names in rounds)
        written.clear()
        assert dict(graph.connected_components(edges, rows=3000).collect()) == found and len(written[0]) == 1
        several = checkpoints.cut(checkpoints.few_files(spark.range(0, 50_000, 1, 8), 50_000))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found == {i: i - i % 10 for i in range(3000)}
    assert several.count() == 50_000 and len(several.inputFiles()) == 3


def test_merged_components(spark):
    a = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 4)], "u long, comp long")
    b = spark.createDataFrame([(1, 1), (2, 2), (3, 2), (4, 4)], "u long, comp long")
    assert dict(graph.merged_components(a, b).collect()) == {1: 1, 2: 1, 3: 1, 4: 4}


def test_order(spark):
    df = spark.range(100).select((F.lit(99) - F.col("id")).alias("x")).repartition(5)
    assert {r.place: r.x for r in order.ranked(df, ["x"], "place").collect()} == {i: i for i in range(100)}
    assert dict(order.dense_ids(spark.createDataFrame([("b",), ("a",), ("b",)], "k string"), "k", "i").collect()) == {"a": 0, "b": 1}
    assert order.sampled(df, 7, F.col("x")).distinct().count() == 7
    assert order.assign_buckets({0: 10, 1: 4, 2: 4, 3: 4}, 2) == {0: 1, 1: 0, 2: 0, 3: 0}  # ties go to the higher bin


def test_chunks_hold_all_pairs(spark):
    uniq = dedupe.unique_records(table(spark, random_rows(5, 60)), CONFIG)
    stats = blocking.block_stats(blocking.super_blocks(uniq, "attr_1"))
    chunks = blocking.chunk_costs(stats, 5)
    assert chunks.agg(F.sum("n_pairs")).first()[0] == stats.agg(F.sum("n_pairs")).first()[0]
    assert chunks.agg(F.sum("n_blocks")).first()[0] == stats.count()


def test_attribute_clusters(spark):
    uniq = dedupe.unique_records(table(spark, [["smith"], ["smyth"], ["jones"]]), CONFIG)
    found = {r.u: r.cluster for r in tokens.attribute_clusters(uniq, CONFIG).filter("attr = 1").collect()}
    assert found == {0: "smith", 1: "smith", 2: "jones"}


def test_text_source_and_sink(spark, tmp_path):
    path = tmp_path / "people.txt"
    path.write_text("1,Ann,Smith-Jones,x,\n2,Ann,Smithjones,x,\n3,Bob,Miller,y,z\n")
    rows = read_delimited(spark, str(path))
    assert rows.columns == ["row_id", "rec_id", *ATTRS]
    assert [r.attr_2 for r in rows.orderBy("row_id").collect()] == ["smithjones", "smithjones", "miller"]
    result = link_records(rows, CONFIG)
    out = str(tmp_path / output_name("people"))
    write_cluster_lines(result.cluster_lines, out)
    assert sorted(r[0] for r in spark.read.text(out).collect()) == ["1,1,", "3,"]
    bad = tmp_path / "bad.txt"
    bad.write_text("a,b\nc\n")
    with pytest.raises(Exception, match="ragged"):
        read_delimited(spark, str(bad)).collect()
    empty = tmp_path / "empty.txt"
    empty.write_text("")
    with pytest.raises(ValueError, match="empty"):
        read_delimited(spark, str(empty))


def test_empty_records(spark):
    result = link_records(table(spark, []), CONFIG)
    assert result.cluster_members.count() == 0 and result.summary.first().clusters == 0


def test_running_groups(spark, tmp_path):
    from kinweave.streaming import running_groups

    path = str(tmp_path / "stream")
    table(spark, [["ann"], ["ann"], ["bob"]]).write.parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    query = running_groups(stream, CONFIG).writeStream.outputMode("complete").format("memory").queryName("groups").start()
    query.processAllAvailable()
    query.stop()
    assert {(r.u, r.n_dups) for r in spark.table("groups").collect()} == {(0, 2), (2, 1)}
