"""Correlation graph of hosts, services, vulnerabilities, credentials and paths.

entities: (capture_id, ts, type, value). Entities that stand in one capture belong
together; captures come in the order of (ts, capture_id). Edges are equi-joins on the
capture of distinct values, so a capture costs the product of its distinct hosts and
distinct partners; credentials count every mention.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrollsift.functions import text as T

HOST_TYPES = ("ip_address", "hostname")
PATH_TYPES = ("file_path_unix", "file_path_windows")


def _mentions(entities: DataFrame, cond) -> DataFrame:
    """Distinct values of a capture with how often each is mentioned."""
    return entities.filter(cond).groupBy("capture_id", "ts", "value").agg(F.count("*").alias("n"))


def hosts(entities: DataFrame) -> DataFrame:
    return _mentions(entities, F.col("type").isin(*HOST_TYPES)).withColumnsRenamed({"value": "host", "n": "host_mentions"})


def edges(entities: DataFrame, cond) -> DataFrame:
    """(capture_id, ts, host, value, copies): a host beside a value in one capture."""
    other = _mentions(entities, cond).drop("ts")
    return hosts(entities).join(other, "capture_id").select("capture_id", "ts", "host", "value", (F.col("host_mentions") * F.col("n")).alias("copies"))


def host_ports(entities: DataFrame) -> DataFrame:
    ports = edges(entities, F.col("type") == "port").withColumn("port", T.parse_port(F.col("value")))
    return ports.filter("port is not null")


def host_services(entities: DataFrame) -> DataFrame:
    named = edges(entities, F.col("type") == "service_version").withColumn("s", T.parse_service(F.col("value")))
    return named.filter("s is not null").select("capture_id", "ts", "host", F.col("s.name").alias("service"), F.col("s.version").alias("version"))


def host_vulnerabilities(entities: DataFrame) -> DataFrame:
    return edges(entities, F.col("type") == "cve").withColumnRenamed("value", "cve")


def host_credentials(entities: DataFrame) -> DataFrame:
    return edges(entities, F.col("type").startswith("credential_"))


def host_paths(entities: DataFrame) -> DataFrame:
    return edges(entities, F.col("type").isin(*PATH_TYPES)).withColumnRenamed("value", "path")


def edge_rows(entities: DataFrame) -> DataFrame:
    """(kind, host, value, detail, ts, capture_id, copies): all edges of the graph and its hosts, as one table.

    A batch of captures appends its rows; ``nodes`` of the whole table is the graph after it.
    """
    shape = lambda d, kind, value, detail, copies: d.select(
        F.lit(kind).alias("kind"), "host", F.col(value).cast("string").alias("value") if value else F.lit(None).cast("string").alias("value"),
        F.col(detail).alias("detail") if detail else F.lit(None).cast("string").alias("detail"), "ts", "capture_id", F.col(copies).alias("copies"),
    )
    parts = [
        shape(hosts(entities), "host", None, None, "host_mentions"),
        shape(host_ports(entities), "port", "port", None, "copies"),
        shape(host_services(entities).withColumn("copies", F.lit(1).cast("long")), "service", "service", "version", "copies"),
        shape(host_vulnerabilities(entities), "cve", "cve", None, "copies"),
        shape(host_credentials(entities), "credential", "value", None, "copies"),
        shape(host_paths(entities), "path", "path", None, "copies"),
    ]
    return reduce(DataFrame.unionByName, parts)


def append_edges(entities: DataFrame, folder: str) -> DataFrame:
    """Add a batch of captures to a stored graph; returns its edge table."""
    edge_rows(entities).write.mode("append").parquet(folder)
    return entities.sparkSession.read.parquet(folder)


def nodes(edges: DataFrame) -> DataFrame:
    """Each host with its ports, services, vulnerabilities, credentials, paths and times.

    All services of a host stand at its least port, the latest named service wins;
    the first time is that of the first capture in order. A host's lists hold its
    distinct values; ``edge_rows`` has them as rows.
    """
    of = lambda kind, value: F.when(F.col("kind") == kind, value)
    listed = lambda kind, value="value": F.array_sort(F.collect_set(of(kind, F.col(value))))
    port = F.col("value").cast("int")
    at = F.struct("ts", "capture_id")
    out = edges.groupBy("host").agg(
        F.min_by("ts", of("host", at)).alias("first_seen"),
        F.max(of("host", F.col("ts"))).alias("last_seen"),
        F.array_sort(F.collect_set(of("port", port))).alias("ports"),
        F.max_by("value", of("service", F.struct("ts", "capture_id", "value"))).alias("latest_service"),
        listed("cve").alias("vulnerabilities"),
        F.coalesce(F.sum(of("credential", F.col("copies"))), F.lit(0)).alias("credentials"),
        listed("path").alias("paths"),
    )
    at_port = F.when((F.size("ports") > 0) & F.col("latest_service").isNotNull(), F.create_map(F.array_min("ports"), "latest_service"))
    return out.select("host", "first_seen", "last_seen", "ports", at_port.alias("services"), "vulnerabilities", "credentials", "paths")


def host_nodes(entities: DataFrame) -> DataFrame:
    return nodes(edge_rows(entities))


def host(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.filter(F.col("host") == name)


def service(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.filter(F.col("service") == name)


def hosts_json(nodes: DataFrame) -> DataFrame:
    """(host, node): each host as a JSON object."""
    return nodes.select("host", F.to_json(F.struct(*nodes.columns)).alias("node"))


def service_vulnerabilities(entities: DataFrame) -> DataFrame:
    """(service, cve): the host of the vulnerability was one of the service's by then."""
    since = host_services(entities).groupBy("service", "host").agg(F.min(F.struct("ts", "capture_id")).alias("since"))
    vulns = host_vulnerabilities(entities).groupBy("host", "cve").agg(F.max(F.struct("ts", "capture_id")).alias("at"))  # the last mention decides
    return since.join(vulns, "host").filter("since <= at").select("service", "cve").distinct()


def service_nodes(entities: DataFrame) -> DataFrame:
    nodes = host_services(entities).groupBy("service").agg(F.array_sort(F.collect_set("host")).alias("hosts"), F.array_sort(F.collect_set("version")).alias("versions"))
    vulns = service_vulnerabilities(entities).groupBy("service").agg(F.array_sort(F.collect_set("cve")).alias("vulnerabilities"))
    return nodes.join(vulns, "service", "left").withColumn("vulnerabilities", F.coalesce("vulnerabilities", F.array().cast("array<string>")))


def vulnerable_hosts(entities: DataFrame, cve: str) -> DataFrame:
    return host_vulnerabilities(entities).filter(F.col("cve") == cve).select("host").distinct()


def vulnerabilities(entities: DataFrame) -> DataFrame:
    """Vulnerabilities that some host has."""
    return host_vulnerabilities(entities).select("cve").distinct()


def stats(entities: DataFrame) -> DataFrame:
    """One row: hosts, services, vulnerabilities, ports over all hosts, credentials over all hosts."""
    kinds = [
        hosts(entities).select(F.lit("hosts").alias("k"), F.col("host").alias("v"), F.lit(1).cast("long").alias("n")).distinct(),
        host_services(entities).select(F.lit("services").alias("k"), F.col("service").alias("v"), F.lit(1).cast("long").alias("n")).distinct(),
        host_vulnerabilities(entities).select(F.lit("vulnerabilities").alias("k"), F.col("cve").alias("v"), F.lit(1).cast("long").alias("n")).distinct(),
        host_ports(entities).select(F.lit("ports").alias("k"), F.concat_ws(" ", "host", "port").alias("v"), F.lit(1).cast("long").alias("n")).distinct(),
        host_credentials(entities).select(F.lit("credentials").alias("k"), "value", F.col("copies").alias("n")),
    ]
    rows = kinds[0]
    for k in kinds[1:]:
        rows = rows.union(k)
    total = lambda k: F.coalesce(F.sum(F.when(F.col("k") == k, F.col("n"))), F.lit(0))
    return rows.agg(
        total("hosts").alias("total_hosts"), total("services").alias("total_services"), total("vulnerabilities").alias("total_vulnerabilities"),
        total("ports").alias("total_ports"), total("credentials").alias("total_credentials"),
    )


def stats_json(entities: DataFrame) -> DataFrame:
    return stats(entities).select(F.to_json(F.struct("*")).alias("stats"))
