"""Every query of the library against its SQL in DuckDB, at the smallest scale."""

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from kinweave.plans import oracles
from kinweave.plans import queries as library

TABLES = ["part", "customer", "supplier", "documents"]


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query(spark, sf_dir, duck, name):
    df = library.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    found = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    rows = duck.execute(oracles.oracle_sql()[name]).fetchall()
    names = [x[0] for x in duck.description]
    assert sorted(names) == columns
    assert found == sorted((tuple(r[names.index(c)] for c in columns) for r in rows), key=repr)


@pytest.mark.parametrize(
    ("name", "links", "components", "clusters"), [("parts", 1, 199, 199), ("customers", 5, 145, 145)]
)
def test_expected_counts(spark, sf_dir, name, links, components, clusters):
    row = getattr(library, name)(spark, sf_dir).summary.first()
    assert (row.links, row.components, row.clusters) == (links, components, clusters)


@pytest.mark.parametrize("name", ["merged_components", "unconnected_pairs"])
def test_headless_pass_starts_from_links(spark, sf_dir, monkeypatch, name):
    """Its components need the linked pairs, never all pairs that share a key."""
    from kinweave.operators import candidates

    def refuse(*_):
        raise AssertionError("all pairs of headless keys were asked for")

    monkeypatch.setattr(candidates, "headless_pairs", refuse)
    assert library.queries()[name](spark, sf_dir).count() > 0


def test_word_components(spark, sf_dir):
    found = library.word_components(spark, sf_dir)
    assert found.count() == 2555 and found.select("first_word").distinct().count() == 2401


def test_word_components_broadcasts_no_large_table(spark, sf_dir, monkeypatch):
    """With no table counted as small, neither the links nor a round of the components goes through the driver."""
    from kinweave import checkpoints
    from kinweave.operators import graph

    monkeypatch.setattr(checkpoints, "FEW", 0, raising=False)
    plans, keep = [], graph.cut
    add = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(graph, "cut", lambda df: add(df) or keep(df))
    add(library.word_components(spark, sf_dir))
    assert len(plans) > 3 and not [p for p in plans if "Broadcast" in p]


def test_bucket_assignment(spark, sf_dir):
    rows = library.bucket_assignment(spark, sf_dir).collect()
    loads = [0, 0, 0]
    for r in sorted(rows):
        assert r.bin == max(b for b in range(3) if loads[b] == min(loads))
        loads[r.bin] += r.n


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 200
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_optional_folders(tmp_path):
    """The library's queries stay when the training-data operators are removed, though the pipeline's file is there."""
    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "kinweave", tmp_path / "kinweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for file in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (root / file).exists():
            shutil.copy(root / file, tmp_path)
    code = "import __spark_entry__ as e; print(*e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    found = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "", "PYTHONPATH": str(tmp_path)})
    assert found.returncode == 0, found.stderr
    names = found.stdout.split()
    assert set(names) == set(library.queries())


def test_size_estimates_stay_small(spark):
    """A table that went through many joins and cuts is known by its true size."""
    from kinweave.checkpoints import cut, release

    df = cut(spark.range(1000).selectExpr("id AS a", "id + 1 AS b"))
    for _ in range(6):
        after = cut(df.join(df.selectExpr("a AS b", "b AS c"), "b", "left").selectExpr("a", "coalesce(c, b) AS b"))
        release(df)
        df = after
    assert df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1_000_000


def test_cut_keeps_names_that_clash(spark):
    from kinweave.checkpoints import cut

    df = cut(spark.sql("SELECT 1 AS a, 2 AS A, 3 AS `x.y`, NULL AS n").selectExpr("*"))
    assert df.columns == ["a", "A", "x.y", "n"] and tuple(df.first()) == (1, 2, 3, None)
