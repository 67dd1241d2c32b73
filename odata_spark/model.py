"""The entity data model over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .edm import EntitySpec, Nav, Registry, ServiceOptions
from .service import Service
from .sources import files


def _one(name: str, target: str, *on: tuple[str, str]) -> Nav:
    return Nav(name, target, on)


def _many(name: str, target: str, *on: tuple[str, str]) -> Nav:
    return Nav(name, target, on, many=True)


def specs(folder: str) -> dict[str, EntitySpec]:
    table = lambda name: files(f"{folder}/{name}.parquet")

    def supplied(spark: SparkSession) -> DataFrame:
        return table("lineitem")(spark).select("l_partkey", "l_suppkey")

    def turns(spark: SparkSession) -> DataFrame:
        return table("conversations")(spark).withColumn("prev_turn", F.col("turn") - 1)

    found = [
        EntitySpec("Region", ("r_regionkey",), table("region"), navs=(_many("nations", "Nation", ("r_regionkey", "n_regionkey")),)),
        EntitySpec("Nation", ("n_nationkey",), table("nation"), navs=(_one("region", "Region", ("n_regionkey", "r_regionkey")), _many("customers", "Customer", ("n_nationkey", "c_nationkey")), _many("suppliers", "Supplier", ("n_nationkey", "s_nationkey")))),
        EntitySpec("Customer", ("c_custkey",), table("customer"), searchable=("c_name", "c_mktsegment"), navs=(_one("nation", "Nation", ("c_nationkey", "n_nationkey")), _many("orders", "Order", ("c_custkey", "o_custkey")))),
        EntitySpec("Order", ("o_orderkey",), table("orders"), etag="o_orderdate", navs=(_one("customer", "Customer", ("o_custkey", "c_custkey")), _many("items", "LineItem", ("o_orderkey", "l_orderkey")))),
        EntitySpec("LineItem", ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), table("lineitem"), navs=(_one("order", "Order", ("l_orderkey", "o_orderkey")), _one("part", "Part", ("l_partkey", "p_partkey")), _one("supplier", "Supplier", ("l_suppkey", "s_suppkey")))),
        EntitySpec("Part", ("p_partkey",), table("part"), searchable=("p_name",), navs=(_many("items", "LineItem", ("p_partkey", "l_partkey")), Nav("suppliers", "Supplier", (("p_partkey", "l_partkey"),), True, supplied, (("l_suppkey", "s_suppkey"),)))),
        EntitySpec("Supplier", ("s_suppkey",), table("supplier"), navs=(_one("nation", "Nation", ("s_nationkey", "n_nationkey")), _many("items", "LineItem", ("s_suppkey", "l_suppkey")), Nav("parts", "Part", (("s_suppkey", "l_suppkey"),), True, supplied, (("l_partkey", "p_partkey"),)))),
        EntitySpec("Document", ("doc_id",), table("documents"), searchable=("text",), navs=(_one("label", "Label", ("doc_id", "doc_id")),)),
        EntitySpec("Label", ("doc_id",), table("labels"), navs=(_one("document", "Document", ("doc_id", "doc_id")),)),
        EntitySpec("Conversation", ("conv_id", "turn"), turns, computed=frozenset({"prev_turn"}), navs=(_one("previous", "Conversation", ("conv_id", "conv_id"), ("prev_turn", "turn")),)),
        EntitySpec("Event", ("event_id",), table("events")),
        EntitySpec("Page", ("page_id",), table("pages")),
        EntitySpec("Benchmark", ("item_id",), table("benchmark"), set_name="Benchmark"),
        EntitySpec("Embedding", ("vec_id",), table("embeddings")),
    ]
    return {s.name: s for s in found}


def service(spark: SparkSession, folder: str, change: Callable[[dict[str, EntitySpec]], None] | None = None, options: ServiceOptions = ServiceOptions()) -> Service:
    """change may replace specs before they are registered."""
    found = specs(folder)
    if change:
        change(found)
    return Service(Registry(spark, list(found.values()), options))
