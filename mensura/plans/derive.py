"""Inputs derived from the given tables by SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels", "conversations")

#: Gold extractions: one for each line of an order.
GOLD = """
    SELECT l_orderkey AS doc_id,
           CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS BIGINT) AS ord,
           l_quantity AS value, CASE WHEN l_partkey % 7 = 0 THEN l_quantity + 5.0 END AS value_max, l_partkey % 7 = 0 AS is_range,
           CASE l_suppkey % 4 WHEN 0 THEN '%' WHEN 1 THEN 'ppm' WHEN 2 THEN 'g/t' END AS unit, concat('It had ', CAST(l_partkey AS STRING), ' parts.') AS sentence,
           CASE l_returnflag WHEN 'A' THEN 'Bulk Concentration' WHEN 'N' THEN 'Individual Entity Concentration' ELSE 'Process Metric' END AS metric_type,
           CASE l_partkey % 5 WHEN 0 THEN 'Nd' WHEN 1 THEN 'TREO' WHEN 2 THEN 'REEs' WHEN 3 THEN 'La2O3' ELSE 'monazite' END AS target_entity,
           CASE l_linestatus WHEN 'O' THEN 'oxide' ELSE 'element' END AS entity_type,
           CASE l_linenumber % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'average' ELSE 'up_to' END AS context_modifier
    FROM lineitem
"""
SYSTEMS = "SELECT arm, seed FROM (VALUES ('base', 0), ('base', 1), ('tuned', 0), ('tuned', 1)) AS t(arm, seed)"
#: Predictions of two arms and two seeds: gold rows dropped, shifted and relabelled by arithmetic, and some invented.
PRED = f"""
    SELECT arm, seed, doc_id, ord * 2 + extra AS ord,
           CASE WHEN extra = 1 THEN value + 1000.0 WHEN h = 5 THEN value * 1.005 WHEN h = 6 THEN value * 1.02 ELSE value END AS value,
           value_max, is_range, CASE WHEN h = 7 THEN 'ppb' ELSE unit END AS unit, CASE WHEN h = 12 THEN 'Not there.' ELSE sentence END AS sentence,
           CASE WHEN h = 8 THEN 'Invalid Candidate' ELSE metric_type END AS metric_type, CASE WHEN h = 9 THEN 'Pr' WHEN h = 13 AND target_entity = 'REEs' THEN 'r.e.e' ELSE target_entity END AS target_entity,
           entity_type, CASE WHEN h = 10 THEN 'less_than' ELSE context_modifier END AS context_modifier
    FROM (SELECT g.*, s.arm, s.seed, e.extra, (g.doc_id * 31 + g.ord * 17 + s.seed * 7 + CASE s.arm WHEN 'base' THEN 0 ELSE 13 END) % 20 AS h
          FROM ({GOLD}) g CROSS JOIN ({SYSTEMS}) s CROSS JOIN (VALUES (0), (1)) AS e(extra)) x
    WHERE (extra = 0 AND h >= CASE arm WHEN 'base' THEN 4 ELSE 2 END) OR (extra = 1 AND h = 11)
"""
#: A run log from the events.
LOG = "SELECT user_id AS i, event_id AS seq, CASE WHEN event_type = 'error' OR event_id % 3 = 0 THEN 'failed' END AS error, value AS result FROM events"
#: Abstracts: documents, some of which state a value.
ABSTRACTS = """
    SELECT doc_id, CASE doc_id % 10 WHEN 0 THEN concat('The TREO of ', CAST(doc_id AS STRING), ' ppm. ', text) WHEN 1 THEN concat('TREO of 0.3% in ore. ', text) WHEN 2 THEN concat('Content of the REE: 5 g/t. ', text)
                   WHEN 3 THEN concat(text, ' See Google Scholar') WHEN 4 THEN concat(text, '...') WHEN 5 THEN concat('A. Bo;C. Du;E. F. Gu;H. Ik; ', text) WHEN 6 THEN '' ELSE text END AS abstract
    FROM documents
"""
#: Samples for voting: each line of an order as seen by up to three samples.
SAMPLES = f"""
    SELECT doc_id, sample, ord, CAST(value AS STRING) AS value, CAST(value_max AS STRING) AS value_max, unit, target_entity, is_range, sentence,
           CASE WHEN (doc_id + ord + sample) % 5 = 0 THEN 'Process Metric' ELSE metric_type END AS metric_type, entity_type, context_modifier
    FROM ({GOLD}) g CROSS JOIN (VALUES (0), (1), (2)) AS s(sample) WHERE (doc_id * 7 + ord * 3 + sample) % 4 <> 0
"""


#: Lines (or orders, if there are more) in one partition where tables are dealt out by order: with all systems' rows beside them some 250 MB to sort.
LINES = 100_000


def sql(spark: SparkSession, sf_dir: str, query: str, parts: int = 0) -> DataFrame:
    """A query over the given tables, as temporary views; only the tables that it names are read.
    With ``parts``, orders and lineitem are dealt out by order first, so that what groups by it moves no row again."""
    for name in TABLES:
        if name in query:
            table, key = spark.read.parquet(f"{sf_dir}/{name}.parquet"), {"orders": "o_orderkey", "lineitem": "l_orderkey"}.get(name)
            (table.repartition(parts, key) if parts and key else table).createOrReplaceTempView(name)
    return spark.sql(query)


def order_parts(spark: SparkSession, sf_dir: str) -> int:
    """How many parts the lines and orders want, a few at least."""
    return max(8, *[-(-spark.read.parquet(f"{sf_dir}/{t}.parquet").count() // LINES) for t in ("lineitem", "orders")])
