"""Queries of entities, tools and the correlation graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrollsift.functions import defaults as D
from scrollsift.functions import text as T
from scrollsift.functions.patterns import Registry
from scrollsift.operators import entities as E
from scrollsift.operators import graph as G
from scrollsift.operators import report as R
from scrollsift.plans import common as C
from scrollsift.sources import tables

REGISTRY = Registry()
INDEX = {e[0]: i for i, e in enumerate(D.ENTITIES)}
ROW = ["capture_id", "pattern_idx", "type", "value", "start", "end"]


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return tables.captures(spark, d).select("capture_id", "ts", "output")


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return tables.spread(tables.read(spark, d, "pages")).select(F.col("page_id").alias("capture_id"), F.col("page_id").alias("ts"), F.coalesce("html", F.lit("")).alias("output"))


def _found(spark, d, types=None):
    return E.extract(_documents(spark, d), REGISTRY, types)


def entity_all(spark, d):
    return C.plain(_found(spark, d).select(*ROW, "confidence", "redact"))


def entity_context(spark, d):
    return C.plain(_found(spark, d, ["email", "ip_address"]).select(*ROW, "context"))


def entity_by_confidence(spark, d):
    return C.plain(E.at_least(_found(spark, d), 0.85).select(*ROW))


def entity_count_by_type(spark, d):
    return E.count_by_type(_found(spark, d))


def entity_types_per_capture(spark, d):
    return E.types_per_capture(_found(spark, d)).select("capture_id", F.array_join("types", ",").alias("types"))


def entities_recent(spark, d):
    return C.plain(E.recent(_found(spark, d)).select(*ROW))


def redacted_projection(spark, d):
    return C.plain(E.redacted_samples(_found(spark, d)))


def capture_metadata(spark, d):
    joined = lambda c: F.array_join(c, ",").alias(c)
    return E.capture_metadata(_found(spark, d)).select("capture_id", joined("entity_types"), "entity_count", joined("hosts"), joined("vulnerabilities"), "has_sensitive")


def pages_entities(spark, d):
    return C.plain(E.extract(_pages(spark, d), REGISTRY, ["hostname", "file_path_unix", "xss_marker", "version"]).select(*ROW))


def host_paths(spark, d):
    found = E.extract(_pages(spark, d), REGISTRY, [*G.HOST_TYPES, *G.PATH_TYPES])
    return G.host_paths(found).groupBy("host").agg(F.count_distinct("path").alias("n_paths"), F.sum("copies").alias("copies"))


def _by_type(kind: str):
    def query(spark, d):
        return C.plain(E.of_type(_found(spark, d, [kind]), kind).select(*ROW))

    return query


GRAPH_TYPES = [*G.HOST_TYPES, "port", "service_version", "cve", "credential_password", "credential_api_key", "credential_token", "credential_ssh_key", *G.PATH_TYPES]
CVE = "CVE-2021-44017"


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return C.order_captures(spark, d).select("capture_id", "ts", "output")


def _graph(spark: SparkSession, d: str) -> DataFrame:
    """Entities of the order captures that the graph is made of."""
    return E.extract(_orders(spark, d), REGISTRY, GRAPH_TYPES)


def tool_detect(spark, d):
    return E.with_tool(C.order_captures(spark, d), REGISTRY).select("capture_id", "command", "tool")


def output_sections(spark, d):
    lines = E.with_tool(C.order_captures(spark, d), REGISTRY).withColumn("line", F.explode(T.lines(F.col("output"))))
    return E.classified_lines(lines, REGISTRY).select("capture_id", "tool", "line", F.array_join("sections", ",").alias("sections"))


def entity_sensitive(spark, d):
    return C.plain(E.sensitive(E.extract(_orders(spark, d), REGISTRY)).select(*ROW))


def entities_of_capture(spark, d):
    return C.plain(E.of_capture(E.extract(_orders(spark, d), REGISTRY), 26).select(*ROW))


def entity_hints(spark, d):
    """Only the types that the capture's tool hints at."""
    rows = E.with_tool(C.order_captures(spark, d), REGISTRY).select("capture_id", "tool", "output")
    return C.plain(E.extract(rows, REGISTRY, by_tool=True).select(*ROW))


def chunk_metadata(spark, d):
    return E.chunk_metadata(_orders(spark, d).select(F.col("capture_id").alias("id"), F.col("output").alias("text")), REGISTRY)


def _joined(metadata: DataFrame) -> DataFrame:
    joined = lambda c: F.array_join(c, ",").alias(c)
    return metadata.select("capture_id", joined("entity_types"), "entity_count", joined("hosts"), joined("vulnerabilities"), "has_sensitive")


def metadata_round_trip(spark, d):
    """Metadata as JSON and back; every tenth row's JSON is broken and gives empty metadata."""
    encoded = E.metadata_json(E.capture_metadata(_graph(spark, d)))
    broken = F.when(F.col("capture_id") % 10 == 0, F.lit("{")).otherwise(F.col("metadata"))
    return _joined(E.metadata_decoded(encoded.withColumn("metadata", broken)))


def enrich_capture(spark, d):
    return _joined(E.enrich(_graph(spark, d), tables.shared_folder(spark, "enriched")))


def parse_port(spark, d):
    return C.plain(E.extract(_orders(spark, d), REGISTRY, ["port"]).select("capture_id", "value", T.parse_port(F.concat(F.lit("9"), "value")).alias("port")))


def parse_service(spark, d):
    s = T.parse_service(F.col("value"))
    return E.extract(_orders(spark, d), REGISTRY, ["service_version"]).select("capture_id", "value", s["name"].alias("name"), s["version"].alias("version"))


def _shown(nodes: DataFrame) -> DataFrame:
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    services = F.array_join(F.transform(F.map_entries(F.coalesce("services", F.create_map().cast("map<int,string>"))), lambda e: F.concat_ws("=", e.key, e.value)), ",").alias("services")
    return C.plain(nodes.select("host", "first_seen", "last_seen", joined("ports"), services, joined("vulnerabilities"), "credentials", joined("paths")))


def host_nodes(spark, d):
    return _shown(G.host_nodes(_graph(spark, d)))


def host_lookup(spark, d):
    return _shown(G.host(G.host_nodes(_graph(spark, d)), "10.0.0.1"))


def graph_incremental(spark, d):
    """Two batches of captures added to a stored graph, one after the other."""
    folder, found = tables.shared_folder(spark, "graph"), _graph(spark, d)
    G.append_edges(found.filter("capture_id % 2 = 1"), folder)
    return _shown(G.nodes(G.append_edges(found.filter("capture_id % 2 = 0"), folder)))


def hosts_export(spark, d):
    rows = G.hosts_json(G.host_nodes(_graph(spark, d)))
    part = lambda name: F.get_json_object("node", f"$.{name}")
    return rows.select("host", part("host").alias("named"), part("last_seen").cast("long").alias("last_seen"), F.json_array_length(part("vulnerabilities")).cast("long").alias("n_vulnerabilities"))


def host_credentials(spark, d):
    return G.host_credentials(_graph(spark, d)).select("capture_id", "host", "value", "copies")


def _services(nodes: DataFrame) -> DataFrame:
    joined = lambda c: F.array_join(c, ",").alias(c)
    return nodes.select("service", joined("hosts"), joined("versions"), joined("vulnerabilities"))


def service_nodes(spark, d):
    return _services(G.service_nodes(_graph(spark, d)))


def service_lookup(spark, d):
    return _services(G.service(G.service_nodes(_graph(spark, d)), "nginx"))


def service_vuln_ordered(spark, d):
    return G.service_vulnerabilities(_graph(spark, d))


def vulnerable_hosts(spark, d):
    return G.vulnerable_hosts(_graph(spark, d), CVE)


def vulnerability_list(spark, d):
    return G.vulnerabilities(_graph(spark, d)).orderBy("cve")


def graph_stats(spark, d):
    return C.plain(G.stats(_graph(spark, d)))


def graph_stats_export(spark, d):
    return G.stats_json(_graph(spark, d))


def report_hosts(spark, d):
    return C.plain(R.hosts(_graph(spark, d)))


def report_findings(spark, d):
    return R.findings(_graph(spark, d)).select("cve", F.array_join("hosts", ",").alias("hosts"), "first_seen")


def report_credentials(spark, d):
    return R.credentials(_graph(spark, d))


QUERIES = {
    f.__name__: f
    for f in (
        entity_all, entity_context, entity_by_confidence, entity_sensitive, entity_count_by_type, entity_types_per_capture, entities_recent, redacted_projection, capture_metadata,
        pages_entities, host_paths, tool_detect, output_sections, entities_of_capture, entity_hints, chunk_metadata, metadata_round_trip, enrich_capture, parse_port, parse_service, host_nodes,
        host_lookup, graph_incremental, hosts_export, host_credentials, service_nodes, service_lookup, service_vuln_ordered, vulnerable_hosts, vulnerability_list, graph_stats,
        graph_stats_export, report_hosts, report_findings, report_credentials,
    )
}
HIT_TYPES = ("ip_address", "email", "hostname", "hash_sha1", "base64", "version")
QUERIES |= {f"entity_extract_{t}": _by_type(t) for t in HIT_TYPES}
#: The types that the documents have nothing of are found in the order captures.
OTHER_TYPES = [e[0] for e in D.ENTITIES if e[0] not in HIT_TYPES]


def _of_orders(kind: str):
    def query(spark, d):
        return C.plain(E.of_type(E.extract(_orders(spark, d), REGISTRY, [kind]), kind).select(*ROW))

    return query


QUERIES |= {f"entity_extract_{t}": _of_orders(t) for t in OTHER_TYPES}


def _matches(source: str, kinds=None) -> str:
    """All matches of the patterns over (capture_id, output), in SQL."""
    parts = []
    for i, (kind, pattern, confidence, window, redact) in enumerate(D.ENTITIES):
        if kinds is None or kind in kinds:
            p = C.quoted(pattern)
            parts.append(
                f"SELECT capture_id, output, {i} AS pattern_idx, '{kind}' AS type, {confidence} AS confidence, {window} AS w, {str(redact).lower()} AS redact, "
                f"regexp_extract_all(output, {p}) AS v, string_split_regex(output, {p}) AS g FROM {source}"
            )
    return f"""
raw AS ({" UNION ALL ".join(parts)}),
each AS (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM raw),
sized AS (SELECT *, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(v[1:i-1], lambda x: length(x))), 0) AS s FROM each),
found AS (SELECT capture_id, CAST(pattern_idx AS BIGINT) AS pattern_idx, type, v[i] AS value, CAST(s AS BIGINT) AS "start", CAST(s + length(v[i]) AS BIGINT) AS "end",
  CAST(confidence AS DOUBLE) AS confidence, redact, substring(output, CAST(greatest(s - w, 0) + 1 AS BIGINT), CAST(s + length(v[i]) + w - greatest(s - w, 0) AS BIGINT)) AS context FROM sized)"""


COLS = 'capture_id, pattern_idx, type, value, "start", "end"'
FOUND = f"WITH {C.CAPTURES}, {_matches('caps')}"
PAGES = f"WITH caps AS (SELECT page_id AS capture_id, page_id AS ts, coalesce(html, '') AS output FROM pages), "
ORDER_FOUND = f"WITH {C.ORDER_CAPTURES}, {_matches('caps')}"
FIX = f"WITH {C.ORDER_CAPTURES}, {_matches('caps', GRAPH_TYPES)}, e AS (SELECT capture_id, capture_id AS ts, type, value FROM found)," + """
h AS (SELECT capture_id, ts, value AS host, count(*) AS m FROM e WHERE type IN ('ip_address', 'hostname') GROUP BY ALL),
o AS (SELECT capture_id, type, value, count(*) AS n FROM e GROUP BY ALL),
x AS (SELECT capture_id, ts, host, type, value, m * n AS copies FROM h JOIN o USING (capture_id)),
ports AS (SELECT *, CASE WHEN regexp_full_match(split_part(value, '/', 1), '[0-9]{1,5}') AND CAST(split_part(value, '/', 1) AS INT) <= 65535 THEN CAST(split_part(value, '/', 1) AS INT) END AS port FROM x WHERE type = 'port'),
svc AS (SELECT *, split_part(value, '/', 1) AS service, split_part(value, '/', 2) AS version FROM x WHERE type = 'service_version' AND len(string_split(value, '/')) = 2),
cves AS (SELECT *, value AS cve FROM x WHERE type = 'cve'),
sv AS (SELECT DISTINCT service, cve FROM (SELECT service, host, min(ts) AS since FROM svc GROUP BY ALL) JOIN cves USING (host) WHERE since <= cves.ts),
p AS (SELECT host, string_agg(DISTINCT CAST(port AS VARCHAR), ',') AS ports, list_sort(list(DISTINCT port)) AS pl, min(port) AS lp FROM ports WHERE port IS NOT NULL GROUP BY host),
ls AS (SELECT host, first(service ORDER BY ts DESC, capture_id DESC, service DESC) AS latest FROM svc GROUP BY host),
vh AS (SELECT host, list_sort(list(DISTINCT cve)) AS vl FROM cves GROUP BY host),
ch AS (SELECT host, sum(copies) AS c FROM x WHERE type LIKE 'credential_%' GROUP BY host),
ph AS (SELECT host, list_sort(list(DISTINCT value)) AS pa FROM x WHERE type LIKE 'file_path_%' GROUP BY host),
t AS (SELECT host, first(ts ORDER BY ts, capture_id) AS first_seen, max(ts) AS last_seen FROM h GROUP BY host),
nodes AS (SELECT * FROM t LEFT JOIN p USING (host) LEFT JOIN ls USING (host) LEFT JOIN vh USING (host) LEFT JOIN ch USING (host) LEFT JOIN ph USING (host))"""
_LIST = lambda c: f"coalesce(array_to_string({c}, ','), '')"
_METADATA = """capture_id, array_to_string(list_sort(list(DISTINCT type)), ',') AS entity_types, count(*) AS entity_count,
  coalesce(string_agg(value, ',' ORDER BY pattern_idx, "start") FILTER (type IN ('ip_address', 'hostname')), '') AS hosts,
  coalesce(string_agg(value, ',' ORDER BY pattern_idx, "start") FILTER (type = 'cve'), '') AS vulnerabilities, bool_or(redact) AS has_sensitive"""
_SECTIONS = " UNION ALL ".join(f"SELECT capture_id, tool, i, line, {n} AS nth, '{s}' AS section FROM l WHERE tool = '{name}' AND regexp_matches(line, {C.quoted(p)})" for name, _, _, outputs in D.TOOLS for n, (p, s) in enumerate(outputs))
_HINTED = " OR ".join([f"(tool = '{n}' AND type IN ({', '.join(map(C.quoted, hints))}))" for n, _, hints, _ in D.TOOLS if hints] + ["tool IS NULL", "tool IN (" + ", ".join([C.quoted(n) for n, _, hints, _ in D.TOOLS if not hints] or ["''"]) + ")"])
_TOOL = "coalesce(" + ", ".join("CASE WHEN " + " OR ".join(f"regexp_matches(command, {C.quoted(p)})" for p in ps) + f" THEN '{n}' END" for n, ps, _, _ in D.TOOLS) + ")"

ORACLES = {
    "entity_all": f"{FOUND} SELECT {COLS}, confidence, redact FROM found",
    "entity_context": f"WITH {C.CAPTURES}, {_matches('caps', ['email', 'ip_address'])} SELECT {COLS}, context FROM found",
    "entity_by_confidence": f"{FOUND} SELECT {COLS} FROM found WHERE CAST(confidence AS FLOAT) >= CAST(0.85 AS FLOAT)",
    "entity_sensitive": f"{ORDER_FOUND} SELECT {COLS} FROM found WHERE redact",
    "entity_count_by_type": f"{FOUND} SELECT type, count(*) AS n FROM found GROUP BY type",
    "entity_types_per_capture": f"{FOUND} SELECT capture_id, array_to_string(list_sort(list(DISTINCT type)), ',') AS types FROM found GROUP BY capture_id",
    "entities_recent": f'{FOUND} SELECT {COLS} FROM found ORDER BY capture_id DESC, pattern_idx DESC, "start" DESC LIMIT 10',
    "redacted_projection": f'{FOUND}, s AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY capture_id, "start", pattern_idx) AS sample FROM found) SELECT type, sample, capture_id, CASE WHEN redact THEN \'[REDACTED]\' ELSE value END AS value FROM s WHERE sample <= 3',
    "capture_metadata": f"{FOUND} SELECT {_METADATA} FROM found GROUP BY capture_id",
    "pages_entities": f"{PAGES} {_matches('caps', ['hostname', 'file_path_unix', 'xss_marker', 'version'])} SELECT {COLS} FROM found",
    "host_paths": f"""{PAGES} {_matches('caps', [*G.HOST_TYPES, *G.PATH_TYPES])},
hs AS (SELECT capture_id, value AS host, count(*) AS m FROM found WHERE type IN {G.HOST_TYPES} GROUP BY ALL), ps AS (SELECT capture_id, value AS path, count(*) AS n FROM found WHERE type IN {G.PATH_TYPES} GROUP BY ALL)
SELECT host, count(DISTINCT path) AS n_paths, CAST(sum(m * n) AS BIGINT) AS copies FROM hs JOIN ps USING (capture_id) GROUP BY host""",
    "tool_detect": f"WITH {C.ORDER_CAPTURES} SELECT capture_id, command, {_TOOL} AS tool FROM caps",
    "output_sections": f"""WITH {C.ORDER_CAPTURES}, c AS (SELECT *, {_TOOL} AS tool, string_split(output, chr(10)) AS p FROM caps), l AS (SELECT capture_id, tool, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS line FROM c), s AS ({_SECTIONS})
SELECT capture_id, tool, line, string_agg(section, ',' ORDER BY nth) AS sections FROM s GROUP BY capture_id, tool, i, line""",
    "entities_of_capture": f"{ORDER_FOUND} SELECT {COLS} FROM found WHERE capture_id = 26",
    "entity_hints": f"{ORDER_FOUND}, t AS (SELECT capture_id, {_TOOL} AS tool FROM caps) SELECT {COLS} FROM found JOIN t USING (capture_id) WHERE {_HINTED}",
    "chunk_metadata": f"{ORDER_FOUND} SELECT caps.capture_id AS id, count(found.capture_id) AS entity_count, coalesce(bool_or(redact), false) AS has_sensitive FROM caps LEFT JOIN found USING (capture_id) GROUP BY caps.capture_id",
    "metadata_round_trip": f"""WITH {C.ORDER_CAPTURES}, {_matches('caps', GRAPH_TYPES)}, m AS (SELECT {_METADATA} FROM found GROUP BY capture_id)
SELECT capture_id, CASE WHEN capture_id % 10 = 0 THEN '' ELSE entity_types END AS entity_types, CASE WHEN capture_id % 10 = 0 THEN 0 ELSE entity_count END AS entity_count, CASE WHEN capture_id % 10 = 0 THEN '' ELSE hosts END AS hosts,
  CASE WHEN capture_id % 10 = 0 THEN '' ELSE vulnerabilities END AS vulnerabilities, capture_id % 10 <> 0 AND has_sensitive AS has_sensitive FROM m""",
    "enrich_capture": f"WITH {C.ORDER_CAPTURES}, {_matches('caps', GRAPH_TYPES)} SELECT {_METADATA} FROM found GROUP BY capture_id",
    "parse_port": f"WITH {C.ORDER_CAPTURES}, {_matches('caps', ['port'])} SELECT capture_id, value, CAST(CASE WHEN CAST('9' || split_part(value, '/', 1) AS INT) <= 65535 THEN CAST('9' || split_part(value, '/', 1) AS INT) END AS BIGINT) AS port FROM found",
    "parse_service": f"WITH {C.ORDER_CAPTURES}, {_matches('caps', ['service_version'])} SELECT capture_id, value, CASE WHEN len(string_split(value, '/')) = 2 THEN split_part(value, '/', 1) END AS name, CASE WHEN len(string_split(value, '/')) = 2 THEN split_part(value, '/', 2) END AS version FROM found",
    "host_nodes": f"""{FIX} SELECT host, CAST(first_seen AS BIGINT) AS first_seen, CAST(last_seen AS BIGINT) AS last_seen, {_LIST('pl')} AS ports, CASE WHEN lp IS NOT NULL AND latest IS NOT NULL THEN lp || '=' || latest ELSE '' END AS services,
  {_LIST('vl')} AS vulnerabilities, CAST(coalesce(c, 0) AS BIGINT) AS credentials, {_LIST('pa')} AS paths FROM nodes""",
    "service_nodes": f"""{FIX}, n AS (SELECT service, list_sort(list(DISTINCT host)) AS hl, list_sort(list(DISTINCT version)) AS ve FROM svc GROUP BY service), v AS (SELECT service, list_sort(list(cve)) AS cl FROM sv GROUP BY service)
SELECT service, {_LIST('hl')} AS hosts, {_LIST('ve')} AS versions, {_LIST('cl')} AS vulnerabilities FROM n LEFT JOIN v USING (service)""",
    "service_vuln_ordered": f"{FIX} SELECT service, cve FROM sv",
    "vulnerable_hosts": f"{FIX} SELECT DISTINCT host FROM cves WHERE cve = '{CVE}'",
    "vulnerability_list": f"{FIX} SELECT DISTINCT cve FROM cves ORDER BY cve",
    "graph_stats": f"""{FIX} SELECT (SELECT count(DISTINCT host) FROM h) AS total_hosts, (SELECT count(DISTINCT service) FROM svc) AS total_services, (SELECT count(DISTINCT cve) FROM cves) AS total_vulnerabilities,
  (SELECT count(*) FROM (SELECT DISTINCT host, port FROM ports WHERE port IS NOT NULL)) AS total_ports, CAST((SELECT coalesce(sum(c), 0) FROM ch) AS BIGINT) AS total_credentials""",
    "report_hosts": f"{FIX} SELECT host, CAST(coalesce(len(pl), 0) AS BIGINT) AS n_ports, CAST(coalesce(len(vl), 0) AS BIGINT) AS n_vulnerabilities, CAST(coalesce(c, 0) AS BIGINT) AS credentials, CAST(first_seen AS BIGINT) AS first_seen, CAST(last_seen AS BIGINT) AS last_seen FROM nodes",
}
_NODE = ORACLES["host_nodes"]
ORACLES |= {
    "graph_incremental": _NODE,
    "host_lookup": f"{_NODE} WHERE host = '10.0.0.1'",
    "hosts_export": f"{FIX} SELECT host, host AS named, CAST(last_seen AS BIGINT) AS last_seen, CAST(coalesce(len(vl), 0) AS BIGINT) AS n_vulnerabilities FROM nodes",
    "host_credentials": f"{FIX} SELECT capture_id, host, value, copies FROM x WHERE type LIKE 'credential_%'",
    "service_lookup": f"SELECT * FROM ({ORACLES['service_nodes']}) WHERE service = 'nginx'",
    "graph_stats_export": f"""WITH s AS ({ORACLES["graph_stats"]}) SELECT '{{"total_hosts":' || total_hosts || ',"total_services":' || total_services || ',"total_vulnerabilities":' || total_vulnerabilities || ',"total_ports":' || total_ports || ',"total_credentials":' || total_credentials || '}}' AS stats FROM s""",
    "report_findings": f"{FIX} SELECT cve, array_to_string(list_sort(list(DISTINCT host)), ',') AS hosts, min(ts) AS first_seen FROM cves GROUP BY cve",
    "report_credentials": f"{FIX} SELECT type, count(*) AS n, count(DISTINCT capture_id) AS n_captures FROM found WHERE redact GROUP BY type",
}
ORACLES |= {f"entity_extract_{t}": f"WITH {C.CAPTURES}, {_matches('caps', [t])} SELECT {COLS} FROM found" for t in HIT_TYPES}
ORACLES |= {f"entity_extract_{t}": f"WITH {C.ORDER_CAPTURES}, {_matches('caps', [t])} SELECT {COLS} FROM found" for t in OTHER_TYPES}
