"""Silver rows seen through the semantic mapping: links to entities, typed properties, catalogue and rule hits.

All of it is narrow per row except the two distinct counts; rows come tagged with ``table_name``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from headwise.functions.frames import constant_rows
from headwise.functions.rules import gps_is_invalid
from headwise.schemas import DATA_PROPERTIES, OBJECT_LINKS, SEMANTIC_RULES, SILVER_TABLES, TABLE_CLASS

EVENT_KEY = ["table_name", "event_id", "gps_idx"]


def semantic_links(tagged: DataFrame) -> DataFrame:
    """(event key, predicate, class, object) for every mapped, known value."""
    links = []
    for predicate, target, column, tables in OBJECT_LINKS:
        value = F.col(column).cast("string")
        if tables != SILVER_TABLES:
            value = F.when(F.col("table_name").isin(tables), value)
        links.append(F.struct(F.lit(predicate).alias("predicate"), F.lit(target).alias("target_class"),
                              value.alias("object")))
    return tagged.select(*EVENT_KEY, F.inline(F.array(*links))).where(F.col("object").isNotNull())


def semantic_properties(tagged: DataFrame) -> DataFrame:
    """(event key, property, type, literal); doubles keep a numeric column so that no precision is lost in text."""
    facts = []
    for column, name, kind in DATA_PROPERTIES:
        number = kind == "xsd:double"
        facts.append(F.struct(
            F.lit(name).alias("property"), F.lit(kind).alias("xsd"),
            (F.lit(None) if number else F.col(column)).cast("string").alias("literal_text"),
            (F.col(column) if number else F.lit(None)).cast("double").alias("literal_double"),
        ))
    known = F.col("literal_text").isNotNull() | F.col("literal_double").isNotNull()
    return tagged.select(*EVENT_KEY, F.inline(F.array(*facts))).where(known)


def semantic_entities(tagged: DataFrame) -> DataFrame:
    """Every linked entity once, with the number of rows that link to it."""
    return semantic_links(tagged).groupBy("target_class", "object").agg(F.count(F.lit(1)).alias("n_links"))


def semantic_summary(tagged: DataFrame) -> DataFrame:
    """Classes, properties, rules and tables that the data actually uses.

    One scan counts the known values of every mapped column per table; which names are in use follows from those few
    rows, without building a single link.
    """
    spark = tagged.sparkSession
    mapped = dict.fromkeys([column for _, _, column, _ in OBJECT_LINKS] + [column for column, _, _ in DATA_PROPERTIES])
    known = tagged.groupBy("table_name").agg(*[F.count(c).alias(c) for c in mapped])

    def name(kind: str, value: Column, present: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.when(present, value).alias("name"))

    names = [name("table", F.col("table_name"), F.lit(True)), name("class", F.col("semantic_class"), F.lit(True))]
    for predicate, target, column, tables in OBJECT_LINKS:
        used = (F.col(column) > 0) & F.col("table_name").isin(tables)
        names += [name("property", F.lit(predicate), used), name("class", F.lit(target), used)]
    names += [name("property", F.lit(prop), F.col(column) > 0) for column, prop, _ in DATA_PROPERTIES]
    used_names = known.join(_mapping(spark), "table_name", "left").select(F.inline(F.array(*names)))
    rules = _rules(spark).select(F.lit("rule").alias("kind"), F.col("rule_id").alias("name"))
    distinct = used_names.unionByName(rules).where(F.col("name").isNotNull()).distinct()
    return distinct.agg(*[
        F.count_if(F.col("kind") == kind).alias(label)
        for kind, label in (("class", "classes"), ("property", "properties"), ("rule", "rules"), ("table", "silver_tables"))
    ])


def _mapping(spark: SparkSession) -> DataFrame:
    return constant_rows(spark, list(TABLE_CLASS.items()), ["table_name", "semantic_class"])


def _rules(spark: SparkSession) -> DataFrame:
    return constant_rows(spark, SEMANTIC_RULES, ["rule_id", "code", "priority"])


def semantic_table_class(tagged: DataFrame) -> DataFrame:
    """Tables in the data with their class, unmapped tables kept, and their rows."""
    rows = tagged.groupBy("table_name").agg(F.count(F.lit(1)).alias("n_rows"))
    return rows.join(_mapping(tagged.sparkSession), "table_name", "left").select(
        F.col("table_name").alias("silver_table"), "semantic_class", "n_rows"
    ).orderBy("silver_table")


def semantic_rule_hits(points: DataFrame) -> DataFrame:
    """Rules by priority with the number of rows each of them touches; one pass for all three."""
    hits = {
        "tcc:RegraFallbackChaves":
            F.col("id_empresa").isNull() | F.col("cod_linha").isNull() | F.col("cod_veiculo").isNull(),
        "tcc:RegraTimestampCanonico": F.col("event_ts").isNull(),
        "tcc:RegraGPSInvalido": gps_is_invalid(),
    }
    counts = points.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(t).alias(str(i)) for i, t in enumerate(hits.values())])
    per_rule = counts.select(F.inline(F.array(*[
        F.struct(F.lit(rule).alias("rule_id"), F.col("n").alias("rows_checked"), F.col(str(i)).alias("rows_touched"))
        for i, rule in enumerate(hits)
    ])))
    return _rules(points.sparkSession).join(per_rule, "rule_id").select(
        "rule_id", "code", "priority", "rows_checked", "rows_touched"
    ).orderBy("priority")
