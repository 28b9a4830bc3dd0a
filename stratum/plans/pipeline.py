"""Whole runs: a table to findings, graph tables and answers."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.operators import anchors, discovery, graph, lattice, search
from stratum.runtime import saved
from stratum.sources import files


@dataclass
class Options:
    """What an upload asks for."""

    where: str | None = None
    categories: list[str] = field(default_factory=list)
    bins: dict[str, int] = field(default_factory=dict)
    time: str | None = None
    tz: str = "UTC"


def prepared(df: DataFrame, o: Options) -> DataFrame:
    """Filter, categories, bands and times of an upload, with row ids."""
    df = files.apply_bins(files.apply_categories(files.filter_rows(df, o.where), o.categories), o.bins)
    return files.read_times(df, o.time, o.tz) if o.time else df


def findings(df: DataFrame, row_id: str, o: Options) -> DataFrame:
    """Profile the table, leave out nested dimensions and colinear metrics, choose the dimensions and mine them."""
    profile = sorted(discovery.profile_columns(df, [c for c in df.columns if c != row_id]).collect(), key=lambda r: df.columns.index(r["column"]))  # a row a column
    metrics, dims = [r["column"] for r in profile if r["role"] == "metric"], [r["column"] for r in profile if r["role"] == "dimension"]
    if not metrics or len(dims) < 2:
        raise files.IngestionError("a table needs a metric and two dimensions")
    known = {r["column"]: r for r in profile}
    for r in discovery.nested_dimensions(df, dims).where("nested").collect():  # a row for each pair of columns
        coarse, fine = sorted((r["a"], r["b"]), key=lambda c: (known[c]["n_distinct"], df.columns.index(c)))
        if fine in dims and coarse in dims and known[coarse]["top_share"] < 0.95 and len(dims) > 2:
            dims.remove(fine)
    if len(metrics) > 1:
        for r in discovery.correlated_metrics(df, metrics).where("colinear").collect():
            late = max(r["a"], r["b"], key=df.columns.index)
            if late in metrics:
                metrics.remove(late)
    chosen = [r["dim"] for r in discovery.chosen_dimensions(discovery.dimension_power(df, dims, metrics)).collect()]
    return search.mine(df, chosen, metrics)


def mine_file(spark: SparkSession, path: str, o: Options) -> DataFrame:
    df = prepared(files.read_table(spark, path), o)
    return findings(files.with_row_id(df), "row_id", o)


def compile_graph(insights: DataFrame, activations: DataFrame | None = None) -> DataFrame:
    """All edges of a set of findings: schema and structural planes, and activations if given."""
    s = lattice.scopes(insights)
    sib = saved(lattice.siblings(s), "siblings")
    e = graph.schema_plane(insights).unionByName(graph.edges(lattice.specialisations(s), "child", "parent", "SPECIALIZES")).unionByName(graph.edges(sib, "a", "b", "SIBLING"))
    e = e.unionByName(graph.edges(lattice.contrasts(sib.select("a", "b"), s), "a", "b", "CONTRASTS", F.least(F.lit(1.0), F.col("strength") / 10)))
    if activations is None:
        return e
    act = activations.groupBy("id", "anchor").agg(F.max("strength").alias("strength"))
    return e.unionByName(graph.edges(act, "id", "anchor", "ACTIVATES", F.col("strength"))).unionByName(graph.edges(anchors.co_occurrences(act), "a", "b", "CO_OCCURS", F.col("weight")))


def answer(insights: DataFrame, activations: DataFrame, target: str, attribute: str, value: str, direction: int, most: int = 10) -> DataFrame:
    """(node, score, hops, via): findings that answer a parsed question, best first."""
    e = saved(compile_graph(insights, activations), "graph")
    s = lattice.scopes(insights)
    found = graph.seeds(graph.seed_scores(insights, target, attribute, value, direction), s.select("id", F.to_json("conds").alias("scope")))
    return graph.walk(e, found.withColumnRenamed("id", "node"), s.select("id", "weight")).orderBy(F.desc("score"), "node").limit(most)
