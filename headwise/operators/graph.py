"""Decision graph as a node table and an edge table, and its questions as joins.

``nodes``: label, id, then properties (NULL where a label lacks one). ``edges``: type, source label and id, target label
and id, then properties. Identity is (label, id) for nodes and (type, source, target) for edges; loading the same thing
twice changes nothing.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from headwise.functions.frames import constant_rows
from headwise.schemas import DECISION_LABELS

NODE_ID = ["label", "id"]
EDGE_ID = ["type", "src_label", "src_id", "dst_label", "dst_id"]
RUN, LINE, VEHICLE, HOUR = "DecisionAggregateRun", "Linha", "Veiculo", "FaixaHoraria"
METRIC, SEGMENT = "LineHourMetric", "CriticalSegment"
MEANS = ["pred_atraso_aproximado_min", "real_atraso_aproximado_min", "n_registros"]


class Graph(NamedTuple):
    nodes: DataFrame
    edges: DataFrame


def _text(column: str) -> Column:
    return F.col(column).cast("string")


def _hour_label() -> Column:
    return F.concat(_text("hour"), F.lit(":00-"), _text("hour"), F.lit(":59"))


def _nodes(frame: DataFrame, label: str, node_id: Column, **props: Column) -> DataFrame:
    return frame.select(
        F.lit(label).alias("label"), node_id.alias("id"), *[column.alias(name) for name, column in props.items()]
    )


def _edges(
    frame: DataFrame, kind: str, source: tuple[str, Column], target: tuple[str, Column], **props: Column
) -> DataFrame:
    return frame.select(
        F.lit(kind).alias("type"),
        F.lit(source[0]).alias("src_label"), source[1].alias("src_id"),
        F.lit(target[0]).alias("dst_label"), target[1].alias("dst_id"),
        *[column.alias(name) for name, column in props.items()],
    )


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _merge(frame: DataFrame, identity: list[str]) -> DataFrame:
    """One row per identity. Within a run every property is set to one value only, so ``max`` picks the known one."""
    props = [F.max(c).alias(c) for c in frame.columns if c not in identity]
    return frame.groupBy(*identity).agg(*props) if props else frame.select(*identity).distinct()


def run_node(spark: SparkSession, run_id: str, **meta: str) -> DataFrame:
    return constant_rows(spark, [(RUN, run_id, *meta.values())], ["label", "id", *meta])


def _ranking(
    ranking: DataFrame, run_id: str, kind: str, label: str, key: str, code: str, rank_name: str, extra: list[str],
    **node_props: Column,
) -> Graph:
    shared = {c: F.col(c) for c in [*MEANS, *extra]}
    nodes = _nodes(
        ranking, label, _text(key),
        **{code: F.col(key).try_cast("int")},
        **node_props,
        **{rank_name: F.col("rank")},
        **{f"latest_{c}": F.col(c) for c in [*MEANS, *[e for e in extra if e != "n_dias"]]},
        latest_prediction_source=F.col("prediction_source"),
        aggregate_run_id=F.lit(run_id),
    )
    edges = _edges(
        ranking, kind, (RUN, F.lit(run_id)), (label, _text(key)),
        rank=F.col("rank"), prediction_source=F.col("prediction_source"), **shared,
    )
    return Graph(nodes, edges)


def line_rank_graph(ranking: DataFrame, run_id: str) -> Graph:
    return _ranking(ranking, run_id, "RANKS_LINE", LINE, "cod_linha", "code", "latest_line_rank", [])


def hour_rank_graph(ranking: DataFrame, run_id: str) -> Graph:
    return _ranking(ranking, run_id, "RANKS_HOUR", HOUR, "hour", "hour", "latest_hour_rank", [],
                    hour_label=_hour_label())


def vehicle_rank_graph(ranking: DataFrame, run_id: str) -> Graph:
    return _ranking(ranking, run_id, "RANKS_VEHICLE", VEHICLE, "cod_veiculo", "code", "latest_vehicle_rank",
                    ["mean_abs_gap_pred_real", "n_dias"])


def _composite(run_id: str, *columns: str) -> Column:
    return F.concat_ws("|", F.lit(run_id), *[_text(c) for c in columns])


def _line_nodes(frame: DataFrame) -> DataFrame:
    return _nodes(frame, LINE, _text("cod_linha"), code=F.col("cod_linha").try_cast("int"))


def _hour_nodes(frame: DataFrame) -> DataFrame:
    return _nodes(frame, HOUR, _text("hour"), hour=F.col("hour").try_cast("int"), hour_label=_hour_label())


def _vehicle_nodes(frame: DataFrame) -> DataFrame:
    return _nodes(frame, VEHICLE, _text("cod_veiculo"), code=F.col("cod_veiculo").try_cast("int"))


def line_hour_graph(compare: DataFrame, run_id: str) -> Graph:
    metric = _composite(run_id, "cod_linha", "hour")
    props = [
        "prediction_source", *MEANS, "baseline_pred_atraso_aproximado_min", "baseline_real_atraso_aproximado_min",
        "baseline_n_registros", "pred_minus_baseline",
    ]
    return Graph(
        _union([
            _nodes(compare, METRIC, metric, **{c: F.col(c) for c in props}, aggregate_run_id=F.lit(run_id)),
            _merge(_line_nodes(compare), NODE_ID), _merge(_hour_nodes(compare), NODE_ID),
        ]),
        _union([
            _edges(compare, "INCLUDES_LINE_HOUR", (RUN, F.lit(run_id)), (METRIC, metric)),
            _edges(compare, "HAS_LINE_HOUR_METRIC", (LINE, _text("cod_linha")), (METRIC, metric)),
            _edges(compare, "AT_HOUR", (METRIC, metric), (HOUR, _text("hour"))),
        ]),
    )


def segment_graph(segments: DataFrame, run_id: str) -> Graph:
    segment = _composite(run_id, "cod_linha", "hour", "cod_veiculo")
    props = ["prediction_source", "mean_abs_error", *MEANS]
    return Graph(
        _union([
            _nodes(segments, SEGMENT, segment, **{c: F.col(c) for c in props}, aggregate_run_id=F.lit(run_id)),
            _merge(_line_nodes(segments), NODE_ID), _merge(_vehicle_nodes(segments), NODE_ID),
            _merge(_hour_nodes(segments), NODE_ID),
        ]),
        _union([
            _edges(segments, "INCLUDES_SEGMENT", (RUN, F.lit(run_id)), (SEGMENT, segment)),
            _edges(segments, "OF_LINE", (SEGMENT, segment), (LINE, _text("cod_linha"))),
            _edges(segments, "OF_VEHICLE", (SEGMENT, segment), (VEHICLE, _text("cod_veiculo"))),
            _edges(segments, "AT_HOUR", (SEGMENT, segment), (HOUR, _text("hour"))),
        ]),
    )


# part of the graph -> (data set it is built from, builder)
PARTS = {
    "lines": ("line_ranking", line_rank_graph),
    "hours": ("hour_ranking", hour_rank_graph),
    "vehicles": ("vehicle_instability", vehicle_rank_graph),
    "line_hours": ("line_hour_compare", line_hour_graph),
    "segments": ("segment_error", segment_graph),
}


def decision_graph(
    spark: SparkSession, aggregates: dict[str, DataFrame], run_id: str, parts: tuple[str, ...] = tuple(PARTS), **meta: str
) -> Graph:
    """Graph of one run, whole or in parts, each node and edge once."""
    built = [PARTS[part][1](aggregates[PARTS[part][0]], run_id) for part in parts]
    nodes = _union([run_node(spark, run_id, **meta), *[g.nodes for g in built]])
    return Graph(_merge(nodes, NODE_ID), _merge(_union([g.edges for g in built]), EDGE_ID))


def _overlay(old: DataFrame, new: DataFrame, identity: list[str]) -> DataFrame:
    names = [*identity, *dict.fromkeys(c for c in [*old.columns, *new.columns] if c not in identity)]
    o, n = old.alias("o"), new.alias("n")
    same = reduce(lambda a, b: a & b, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in identity])

    def value(name: str) -> Column:
        known = [F.col(f"{tag}.{name}") for tag, f in (("n", new), ("o", old)) if name in f.columns]
        return F.coalesce(*known).alias(name)

    return o.join(n, same, "full").select(*[value(c) for c in names])


def upsert(old: Graph, new: Graph) -> Graph:
    """Create or update by identity; a value given by ``new`` wins, anything else is kept."""
    return Graph(_overlay(old.nodes, new.nodes, NODE_ID), _overlay(old.edges, new.edges, EDGE_ID))


def purge(graph: Graph, labels: list[str] | None = None) -> Graph:
    """Remove nodes of the given labels with their edges. Edges carry both end labels, so this is a filter."""
    gone = DECISION_LABELS if labels is None else labels
    return Graph(
        graph.nodes.where(~F.col("label").isin(gone)),
        graph.edges.where(~F.col("src_label").isin(gone) & ~F.col("dst_label").isin(gone)),
    )


def unique_violations(nodes: DataFrame) -> DataFrame:
    """Per label: nodes, distinct ids and ids that occur more than once (zero in a merged graph)."""
    return nodes.groupBy("label", "id").agg(F.count(F.lit(1)).alias("c")).groupBy("label").agg(
        F.sum("c").alias("nodes"),
        F.count(F.lit(1)).alias("distinct_ids"),
        F.count_if(F.col("c") > 1).alias("violations"),
    )


def _of_run(graph: Graph, run_id: str, kind: str) -> DataFrame:
    edge = F.col("type") == kind
    return graph.edges.where(edge & (F.col("src_label") == RUN) & (F.col("src_id") == run_id))


def _ends(edges: DataFrame, kind: str, side: str, node: str) -> DataFrame:
    """Edges of a kind as a two-column mapping: the id on ``side`` as ``node``, the other end as ``other``."""
    other = {"src": "dst", "dst": "src"}[side]
    return edges.where(F.col("type") == kind).select(F.col(f"{side}_id").alias(node), F.col(f"{other}_id").alias("other"))


def top_ranked(graph: Graph, run_id: str, kind: str, label: str, code: str, name: str, props: list[str],
               k: int = 10) -> DataFrame:
    """Targets of a ranking edge, best rank first."""
    ends = graph.nodes.where(F.col("label") == label).select(F.col("id").alias("dst_id"), F.col(code).alias(name))
    return (
        _of_run(graph, run_id, kind).select("dst_id", "rank", *props).join(ends, "dst_id")
        .select(name, "rank", *props).orderBy("rank").limit(k)
    )


def top_lines(graph: Graph, run_id: str) -> DataFrame:
    return top_ranked(graph, run_id, "RANKS_LINE", LINE, "code", "cod_linha", MEANS)


def top_hours(graph: Graph, run_id: str) -> DataFrame:
    return top_ranked(graph, run_id, "RANKS_HOUR", HOUR, "hour", "hour", MEANS)


def top_vehicles(graph: Graph, run_id: str) -> DataFrame:
    return top_ranked(graph, run_id, "RANKS_VEHICLE", VEHICLE, "code", "cod_veiculo",
                      ["mean_abs_gap_pred_real", *MEANS])


def gap_vs_baseline(graph: Graph, run_id: str, k: int = 10) -> DataFrame:
    """Line and hour where the model is furthest above its baseline. An unknown gap sorts as the largest."""
    metrics = graph.nodes.where(F.col("label") == METRIC).select(
        F.col("id").alias("m"), *MEANS, "baseline_pred_atraso_aproximado_min", "pred_minus_baseline"
    )
    lines = graph.nodes.where(F.col("label") == LINE).select(F.col("id").alias("line_id"), F.col("code").alias("cod_linha"))
    hours = graph.nodes.where(F.col("label") == HOUR).select(F.col("id").alias("hour_id"), "hour")
    at_hour = _ends(graph.edges.where(F.col("src_label") == METRIC), "AT_HOUR", "src", "m")
    of_line = _ends(graph.edges, "HAS_LINE_HOUR_METRIC", "dst", "m")
    return (
        _of_run(graph, run_id, "INCLUDES_LINE_HOUR").select(F.col("dst_id").alias("m"))
        .join(metrics, "m")
        .join(at_hour.withColumnRenamed("other", "hour_id"), "m").join(hours, "hour_id")
        .join(of_line.withColumnRenamed("other", "line_id"), "m").join(lines, "line_id")
        .select("cod_linha", "hour", "pred_atraso_aproximado_min", "baseline_pred_atraso_aproximado_min",
                "pred_minus_baseline", "n_registros")
        .orderBy(F.desc_nulls_first("pred_minus_baseline"), "cod_linha", "hour")
        .limit(k)
    )


def overview(graph: Graph, run_id: str, best: int = 5) -> DataFrame:
    """The run with its best-ranked lines, hours and vehicles."""
    ranks = graph.edges.where(F.col("type").isin("RANKS_LINE", "RANKS_HOUR", "RANKS_VEHICLE"))
    return ranks.where(
        (F.col("src_label") == RUN) & (F.col("src_id") == run_id) & (F.col("rank") <= best)
    ).select("type", F.col("src_id").alias("run_id"), "dst_label", "dst_id", "rank")


def line_focus(graph: Graph, run_id: str, segments: int = 6) -> DataFrame:
    """The worst line, its segments with the largest error, and their vehicles."""
    worst = (
        _of_run(graph, run_id, "RANKS_LINE").orderBy("rank").limit(1)
        .select(F.col("dst_id").alias("line_id"), F.col("rank").alias("line_rank"))
    )
    errors = graph.nodes.where(F.col("label") == SEGMENT).select(F.col("id").alias("segment_id"), "mean_abs_error")
    of_line = _ends(graph.edges, "OF_LINE", "src", "segment_id").withColumnRenamed("other", "line_id")
    of_vehicle = _ends(graph.edges, "OF_VEHICLE", "src", "segment_id").withColumnRenamed("other", "vehicle_id")
    included = _of_run(graph, run_id, "INCLUDES_SEGMENT").select(F.col("dst_id").alias("segment_id"))
    return (
        of_line.join(worst, "line_id").join(included, "segment_id").join(errors, "segment_id")
        .join(of_vehicle, "segment_id")
        .select("line_id", "line_rank", "segment_id", "mean_abs_error", "vehicle_id")
        .orderBy(F.desc("mean_abs_error"), "segment_id")
        .limit(segments)
    )


def segment_focus(graph: Graph, run_id: str) -> DataFrame:
    """The segment with the largest error and everything it is attached to."""
    errors = graph.nodes.where(F.col("label") == SEGMENT).select(
        F.col("id").alias("segment_id"), "mean_abs_error", "n_registros"
    )
    worst = (
        _of_run(graph, run_id, "INCLUDES_SEGMENT").select(F.col("dst_id").alias("segment_id"))
        .join(errors, "segment_id").orderBy(F.desc("mean_abs_error"), "segment_id").limit(1)
    )
    out = worst
    for kind, name in (("OF_LINE", "line_id"), ("OF_VEHICLE", "vehicle_id"), ("AT_HOUR", "hour_id")):
        side = _ends(graph.edges.where(F.col("src_label") == SEGMENT), kind, "src", "segment_id")
        out = out.join(side.withColumnRenamed("other", name), "segment_id")
    return out.select("segment_id", "mean_abs_error", "n_registros", "line_id", "vehicle_id", "hour_id")
