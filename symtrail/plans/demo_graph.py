"""The star schema as a property graph: the shape every graph operator takes, at table scale.

Regions define nations, nations define customers and suppliers, customers call orders, orders call
parts, suppliers import parts, and every third part overrides the part at a quarter of its key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from symtrail.operators import graph as G
from symtrail.session import spread, stored, table_schema

REPO = "shop"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    return spark.read.schema(table_schema(spark, path)).parquet(path)


def texts(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A text table spread over the cores: what follows is heavy per row."""
    return spread(table(spark, sf_dir, name), key)


def _uid(prefix: str, key: str):
    return F.concat(F.lit(f"{prefix}:"), F.col(key).cast("string"))


def build_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`uid, repo_id, kind, name, qualified_name, rel_path, start_line`."""
    def nodes(name, prefix, key, kind, label, owner, path):
        leaf = F.concat(F.lit(label), F.col(key).cast("string"))
        return table(spark, sf_dir, name).select(
            _uid(prefix, key).alias("uid"), F.lit(REPO).alias("repo_id"), F.lit(kind).alias("kind"), leaf.alias("name"),
            F.concat_ws(".", owner, leaf).alias("qualified_name"), path.alias("rel_path"),
            F.col(key).cast("bigint").alias("start_line"))

    none, geo = F.lit(None).cast("string"), F.lit("geo.py")
    nation = lambda c: F.concat(F.lit("nation"), F.col(c).cast("string"))
    customer = F.concat(F.lit("customer"), F.col("o_custkey").cast("string"))
    py = lambda c: F.concat(c, F.lit(".py"))
    return (nodes("region", "R", "r_regionkey", "module", "region", none, geo)
            .unionByName(nodes("nation", "N", "n_nationkey", "module", "nation", none, geo))
            .unionByName(nodes("customer", "C", "c_custkey", "class", "customer", nation("c_nationkey"), py(nation("c_nationkey"))))
            .unionByName(nodes("supplier", "S", "s_suppkey", "class", "supplier", nation("s_nationkey"), py(nation("s_nationkey"))))
            .unionByName(nodes("part", "P", "p_partkey", "function", "part", none, py(F.col("p_brand"))))
            .unionByName(nodes("orders", "O", "o_orderkey", "function", "order", customer, py(customer))))


def build_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`repo_id, src, tgt, kind, origin_path`, distinct by key; every end exists."""
    def links(df, src, tgt, kind, path):
        return df.select(F.lit(REPO).alias("repo_id"), src.alias("src"), tgt.alias("tgt"), F.lit(kind).alias("kind"), path.alias("origin_path"))

    t = lambda name: table(spark, sf_dir, name)
    nation = lambda c: F.concat(F.lit("nation"), F.col(c).cast("string"), F.lit(".py"))
    customer = F.concat(F.lit("customer"), F.col("o_custkey").cast("string"), F.lit(".py"))
    items = t("lineitem")
    # Dealt out by the join's key, which also brings equal rows together: one shuffle for both.
    calls = items.select("l_orderkey", "l_partkey").repartition("l_orderkey").distinct().join(
        t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    imports = items.select("l_suppkey", "l_partkey").distinct().join(
        t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    over = t("part").filter("p_partkey > 0 and p_partkey % 3 = 0").withColumn("base", F.floor(F.col("p_partkey") / 4).cast("bigint"))
    return (links(t("nation"), _uid("R", "n_regionkey"), _uid("N", "n_nationkey"), "DEFINES", F.lit("geo.py"))
            .unionByName(links(t("customer"), _uid("N", "c_nationkey"), _uid("C", "c_custkey"), "DEFINES", F.lit("geo.py")))
            .unionByName(links(t("supplier"), _uid("N", "s_nationkey"), _uid("S", "s_suppkey"), "DEFINES", F.lit("geo.py")))
            .unionByName(links(t("orders"), _uid("C", "o_custkey"), _uid("O", "o_orderkey"), "CALLS", customer))
            .unionByName(links(calls, _uid("O", "l_orderkey"), _uid("P", "l_partkey"), "CALLS", customer))
            .unionByName(links(imports, _uid("S", "l_suppkey"), _uid("P", "l_partkey"), "IMPORTS", nation("s_nationkey")))
            .unionByName(links(over, _uid("P", "p_partkey"), _uid("P", "base"), "OVERRIDES", F.concat("p_brand", F.lit(".py")))))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symbol table with degrees, written once and scanned by every query."""
    def build():
        plain = build_symbols(spark, sf_dir)
        return plain.join(G.degrees(plain, edges(spark, sf_dir)), "uid")

    return stored(spark, f"demo symbols {sf_dir}", build)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edge table, partitioned by kind so that a traversal reads only the kinds it follows."""
    return stored(spark, f"demo edges {sf_dir}", lambda: build_edges(spark, sf_dir), ("kind",))


#: The same two tables for the reference SQL.
SQL = """
sym AS (
  SELECT concat('R:', r_regionkey) uid, 'module' kind, concat('region', r_regionkey) AS name, concat('region', r_regionkey) qualified_name,
         'geo.py' rel_path, CAST(r_regionkey AS BIGINT) start_line FROM region
  UNION ALL SELECT concat('N:', n_nationkey), 'module', concat('nation', n_nationkey), concat('nation', n_nationkey), 'geo.py', CAST(n_nationkey AS BIGINT) FROM nation
  UNION ALL SELECT concat('C:', c_custkey), 'class', concat('customer', c_custkey), concat('nation', c_nationkey, '.customer', c_custkey),
         concat('nation', c_nationkey, '.py'), CAST(c_custkey AS BIGINT) FROM customer
  UNION ALL SELECT concat('S:', s_suppkey), 'class', concat('supplier', s_suppkey), concat('nation', s_nationkey, '.supplier', s_suppkey),
         concat('nation', s_nationkey, '.py'), CAST(s_suppkey AS BIGINT) FROM supplier
  UNION ALL SELECT concat('P:', p_partkey), 'function', concat('part', p_partkey), concat('part', p_partkey), concat(p_brand, '.py'), CAST(p_partkey AS BIGINT) FROM part
  UNION ALL SELECT concat('O:', o_orderkey), 'function', concat('order', o_orderkey), concat('customer', o_custkey, '.order', o_orderkey),
         concat('customer', o_custkey, '.py'), CAST(o_orderkey AS BIGINT) FROM orders),
edge AS (
  SELECT concat('R:', n_regionkey) src, concat('N:', n_nationkey) tgt, 'DEFINES' kind, 'geo.py' origin_path FROM nation
  UNION ALL SELECT concat('N:', c_nationkey), concat('C:', c_custkey), 'DEFINES', 'geo.py' FROM customer
  UNION ALL SELECT concat('N:', s_nationkey), concat('S:', s_suppkey), 'DEFINES', 'geo.py' FROM supplier
  UNION ALL SELECT concat('C:', o_custkey), concat('O:', o_orderkey), 'CALLS', concat('customer', o_custkey, '.py') FROM orders
  UNION ALL SELECT DISTINCT concat('O:', l_orderkey), concat('P:', l_partkey), 'CALLS', concat('customer', o_custkey, '.py')
         FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  UNION ALL SELECT DISTINCT concat('S:', l_suppkey), concat('P:', l_partkey), 'IMPORTS', concat('nation', s_nationkey, '.py')
         FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
  UNION ALL SELECT concat('P:', p_partkey), concat('P:', p_partkey // 4), 'OVERRIDES', concat(p_brand, '.py')
         FROM part WHERE p_partkey > 0 AND p_partkey % 3 = 0),
deg AS (
  SELECT s.uid, count(e.uid) degree FROM sym s
  LEFT JOIN (SELECT src uid FROM edge UNION ALL SELECT tgt FROM edge WHERE tgt <> src) e ON e.uid = s.uid GROUP BY s.uid)
"""
