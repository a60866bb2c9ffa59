"""The whole linkage: records to clusters."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..config import LinkageConfig
from ..operators import candidates, dedupe, graph, tokens


@dataclass
class LinkageResult:
    """Tables of a run; each is made once, when it is first asked for."""

    rows: DataFrame
    cfg: LinkageConfig

    @cached_property
    def unique(self) -> DataFrame:
        return cut(dedupe.unique_records(self.rows, self.cfg))

    @cached_property
    def members(self) -> DataFrame:
        return dedupe.members(self.rows, self.cfg)

    @cached_property
    def gate(self) -> DataFrame | None:
        return cut(tokens.gate(self.unique, self.cfg)) if self.cfg.token_gate else None

    @cached_property
    def links(self) -> DataFrame:
        return cut(candidates.links(self.unique, self.cfg, self.gate))

    @cached_property
    def components(self) -> DataFrame:
        return cut(graph.components(self.unique, self.links))

    @cached_property
    def component_links(self) -> DataFrame:
        """All linked pairs inside components, whether they were candidates or not, and without the gate."""
        if self.cfg.total < len(self.cfg.attrs):
            found = candidates.exact_links(self.unique, self.cfg)
        else:
            keys = self.components.withColumnRenamed("comp", "block")
            found = candidates.verified(candidates.self_join(keys, ["block"]), self.unique, self.cfg)
        label = lambda u, c: self.components.select(F.col("u").alias(u), F.col("comp").alias(c))
        both = found.join(label("u1", "comp"), "u1").join(label("u2", "comp2"), "u2")
        return cut(both.filter("comp = comp2").select("comp", "u1", "u2"))

    @cached_property
    def clusters(self) -> DataFrame:
        return cut(graph.leader_clusters(self.unique, self.component_links))

    @property
    def cluster_members(self) -> DataFrame:
        """(leader, u, row_id, rec_id, rep_rec_id): every record with its cluster."""
        reps = self.unique.select("u", F.col("rec_id").alias("rep_rec_id"))
        return self.clusters.join(reps, "u").join(self.members, "u").select("leader", "u", "row_id", "rec_id", "rep_rec_id")

    @property
    def cluster_lines(self) -> DataFrame:
        """(leader, line): ids of a cluster, each with a comma behind it; a duplicate shows its representative's id."""
        order = self.unique.select("u", "ord_key")
        rows = self.cluster_members.join(order, "u").withColumn("o", F.struct(F.col("u") != F.col("leader"), "ord_key", "u", "row_id"))
        listed = rows.groupBy("leader").agg(F.sort_array(F.collect_list(F.struct("o", "rep_rec_id"))).alias("ids"))
        return listed.select("leader", F.concat(F.array_join("ids.rep_rec_id", ","), F.lit(",")).alias("line"))

    @property
    def summary(self) -> DataFrame:
        """One row of counts. accepted_unions: links that joined two components."""
        n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
        groups = self.components.groupBy("comp").agg(F.count(F.lit(1)).alias("n"))
        parts = [
            ("total_records", self.rows, None), ("unique_records", self.unique, None), ("links", self.links, None),
            ("components", groups, None), ("clusters", self.clusters.filter("u = leader"), None),
            ("largest_component", groups, F.max("n")),
        ]
        found = {name: (n(df, name) if agg is None else df.agg(agg.alias(name))).first()[0] or 0 for name, df, agg in parts}
        found["accepted_unions"] = found["unique_records"] - found["components"]
        row = self.rows.sparkSession.range(1)
        return row.select(*[F.lit(int(v)).cast("long").alias(k) for k, v in found.items()])


def link_records(rows: DataFrame, cfg: LinkageConfig) -> LinkageResult:
    """rows: (row_id, rec_id, attributes) as of dedupe.records() or read_delimited()."""
    return LinkageResult(rows, cfg)
