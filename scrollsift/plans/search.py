"""Queries of the indexes, retrieval and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrollsift.functions import defaults as D
from scrollsift.functions.patterns import Registry
from scrollsift.operators import embedding as M
from scrollsift.operators import index as I
from scrollsift.operators import retrieval as V
from scrollsift.plans import common as C
from scrollsift.plans import filters
from scrollsift.sources import tables
from scrollsift.streaming import ingest

REGISTRY = Registry()
TEXT, PHRASE, K = "the token and thing", "of the", 10
#: Least fused score of a filtered search.
LEAST = 0.0105
FUSION = V.Fusion()


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return tables.spread(tables.read(spark, d, "documents")).select(F.col("doc_id").alias("id"), "text")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return tables.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


#: Indexes of this process, by application and folder of tables: built at the first query, read by later ones.
_built: dict[tuple, object] = {}


def _once(spark: SparkSession, d: str, kind: str, build):
    key = (spark.sparkContext.applicationId, d, kind)
    if key not in _built:
        _built[key] = build(tables.shared_folder(spark, kind))
    return _built[key]


def _keywords(spark: SparkSession, d: str) -> I.KeywordIndex:
    return _once(spark, d, "keywords", lambda folder: I.KeywordIndex.create(_docs(spark, d), folder))


def _cells(spark: SparkSession, d: str) -> I.VectorIndex:
    width = lambda: _vectors(spark, d).select(F.size("vector")).first()[0]
    return _once(spark, d, "vectors", lambda folder: I.VectorIndex.create(_vectors(spark, d), folder, width()))


def _query_vector(spark: SparkSession, d: str) -> list[float]:
    """The vector that the registered searches ask with: a parameter of theirs, one row."""
    return list(_vectors(spark, d).filter("id = 0").first()["vector"])


def _captures(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a command and a tool, some of them unknown."""
    docs = tables.read(spark, d, "documents")
    command = F.when(F.col("doc_id") % 3 == 0, F.lit("nmap -sV x")).when(F.col("doc_id") % 3 == 1, F.lit("curl x"))
    return docs.select(F.col("doc_id").alias("capture_id"), F.col("source").alias("session_id"), command.alias("command"), F.col("doc_id").alias("ts")).withColumn("tool", REGISTRY.detect_tool(F.col("command")))


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).withColumns({"capture_id": F.col("id"), "blob_hash": F.sha2(F.coalesce("text", F.lit("")), 256)})


def knn_cosine(spark, d):
    return I.knn(_vectors(spark, d), _query_vector(spark, d), K)


def knn_batch(spark, d):
    """Every vector whose id is divisible by 50 against all vectors."""
    return I.knn_blocks(_vectors(spark, d), _vectors(spark, d).filter("id % 50 = 0"), K)


def knn_index(spark, d):
    """The stored index, all cells: what the exact search gives."""
    return _cells(spark, d).search(_query_vector(spark, d), K, None)


def vector_index_rows(spark, d):
    return C.plain(_cells(spark, d).rows().groupBy("id").agg(F.count("*").alias("n")))


def bm25_topk(spark, d):
    return _keywords(spark, d).bm25(TEXT, K)


def bm25_all(spark, d):
    return _keywords(spark, d).bm25("moron worthless")


def bm25_phrase(spark, d):
    return _keywords(spark, d).phrase(PHRASE)


def keyword_load(spark, d):
    """A loaded index answers as the one that was built."""
    return I.KeywordIndex.load(spark, _keywords(spark, d).folder).bm25(TEXT, K)


def _changed(spark, d):
    """An index of the documents with odd ids, to which the even ones are added; every third is taken out."""
    docs = _docs(spark, d)

    def build(folder):
        index = I.KeywordIndex.create(docs.filter("id % 2 = 1"), folder)
        index.add(docs.filter("id % 2 = 0"))
        index.delete(docs.filter("id % 3 = 0"))
        return index

    return _once(spark, d, "changed", build)


def keyword_changes(spark, d):
    return _changed(spark, d).bm25(TEXT, K)


def keyword_merge(spark, d):
    return _once(spark, d, "merged", lambda _: _changed(spark, d).merge()).bm25(TEXT, K)


def keyword_size(spark, d):
    return _changed(spark, d).size()


def keyword_postings(spark, d):
    p = I.postings(_docs(spark, d))
    return C.plain(p.select("term", "id", "dl", "tf", F.element_at("positions", 1).alias("first")))


def _rankings(spark, d):
    return V.ranked(I.knn(_vectors(spark, d), _query_vector(spark, d), K), K), V.ranked(_keywords(spark, d).bm25(TEXT, K), K)


def rrf_fusion(spark, d):
    return V.fuse(*_rankings(spark, d))


def rrf_weighted(spark, d):
    return V.fuse(*_rankings(spark, d), V.Fusion(10.0, 0.2, 0.8))


def dedup_first(spark, d):
    found, again = _keywords(spark, d).bm25(TEXT, K), _keywords(spark, d).bm25("thing", K)
    return V.first_per_id(found.unionByName(again))


def _hits(out: DataFrame) -> DataFrame:
    return out.select("id", "score", "session_id", "command", "tool", "ts")


def _search(query: V.Query, rerank: bool = False):
    def run(spark, d):
        return _hits(V.search(query, _query_vector(spark, d), _chunks(spark, d), _captures(spark, d), _vectors(spark, d), _keywords(spark, d), FUSION, rerank))

    return run


SEARCHES = {
    "hybrid_search": V.Query(TEXT, K),
    "hydrate_filter_tool": V.Query(TEXT, K, tool="nmap"),
    "hydrate_filter_session": V.Query(TEXT, 10 * K, session="src0"),
    "hydrate_filter_time": V.Query(TEXT, K, since=100, until=600),
    "hydrate_min_similarity": V.Query(TEXT, K, min_similarity=LEAST),
    "search_prefilter": V.Query(TEXT, K, session="src1", prefilter=True),
}


def rerank(spark, d):
    return _search(V.Query(TEXT, K), True)(spark, d)


def search_context(spark, d):
    found = V.search(V.Query(TEXT, 3), _query_vector(spark, d), _chunks(spark, d), _captures(spark, d), _vectors(spark, d), _keywords(spark, d))
    return V.context(found)


def search_listing(spark, d):
    query = V.Query(TEXT, K)
    return V.listing(V.search(query, _query_vector(spark, d), _chunks(spark, d), _captures(spark, d), _vectors(spark, d), _keywords(spark, d)))


PROVIDER = M.HashingProvider()


def _embedded(spark, d) -> DataFrame:
    """Vectors of all conversation turns, stored at the first query."""

    def build(folder):
        M.embedded(_turn_texts(spark, d), PROVIDER).write.parquet(folder)
        return folder

    return spark.read.parquet(_once(spark, d, "embedded", build))


def _turn_texts(spark, d) -> DataFrame:
    turns = tables.spread(tables.read(spark, d, "conversations"))
    return turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")


def embed_hash(spark, d):
    """The parts of each vector that aren't zero."""
    parts = _embedded(spark, d).select("id", "model", F.posexplode_outer("vector").alias("place", "value"))
    return C.plain(parts.filter("value != 0 or value is null").select("id", "model", "place", F.round(F.col("value").cast("double"), 4).alias("value")))


def semantic_step(spark, d):
    """A query's text is embedded, then the nearest vectors are found."""
    return V.nearest(_embedded(spark, d).filter("vector is not null").select("id", "vector"), TEXT, K, PROVIDER).select("id", F.round("score", 4).alias("score"))


def embed_job(spark, d):
    """Chunks into both indexes; turns with an empty text fail."""
    texts = _turn_texts(spark, d).withColumn("text", F.when(F.col("id") % 7 != 0, F.col("text")))

    def build(folder):
        none = spark.createDataFrame([], "id long, vector array<float>")
        vectors = I.VectorIndex.create(none, f"{folder}/vectors", PROVIDER.dimension)
        keywords = I.KeywordIndex.create(spark.createDataFrame([], "id long, text string"), f"{folder}/keywords")
        return M.process(texts, PROVIDER, keywords, vectors), keywords, vectors

    counts, keywords, vectors = _once(spark, d, "job", build)
    sizes = [i.agg(F.count("*").alias(n)).scalar().alias(n) for i, n in ((keywords.sizes(), "in_keywords"), (vectors.rows(), "in_vectors"))]
    return counts.select("processed", "failed", *sizes)


def streamed(spark, d) -> str:
    """Folder of the stateful first tier over conversations, run once to the end of what is there."""

    def run(name):
        schema = spark.read.parquet(f"{d}/conversations.parquet").schema
        stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(_folder(spark, d, name))
        turns = stream.select(F.col("turn").alias("capture_id"), F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("ts"), F.coalesce("text", F.lit("")).alias("output"))
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        query = ingest.tier1(turns, REGISTRY).writeStream.format("parquet").option("path", f"{name}/out").option("checkpointLocation", f"{name}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        return name

    return _once(spark, d, "stream", run)


def stream_tier1(spark, d):
    """What the stateful first tier keeps of the conversations."""
    return C.plain(spark.read.parquet(f"{streamed(spark, d)}/out").select("session_id", "capture_id", "line_no", "occurrence"))


def _folder(spark: SparkSession, d: str, name: str) -> str:
    """A landing folder with the table's rows as one batch of files."""
    spark.read.parquet(f"{d}/conversations.parquet").write.parquet(f"{name}/landing")
    return f"{name}/landing"


QUERIES = {
    f.__name__: f
    for f in (
        knn_cosine, knn_batch, knn_index, vector_index_rows, bm25_topk, bm25_all, bm25_phrase, keyword_load, keyword_changes, keyword_merge, keyword_size, keyword_postings,
        rrf_fusion, rrf_weighted, dedup_first, rerank, search_context, search_listing, embed_hash, semantic_step, embed_job, stream_tier1,
    )
}
QUERIES |= {name: _search(q) for name, q in SEARCHES.items()}

TOKENS = f"toks AS (SELECT doc_id AS id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '' AND strlen(t) <= {D.TOKEN_BYTES}) AS t FROM documents)"


def _bm25(query: str, name: str, k: int | None, source: str = "toks") -> str:
    terms = sorted(set(I.query_terms(query)))
    counts = ", ".join(f"len(list_filter(t, lambda w: w = '{w}')) AS tf{i}" for i, w in enumerate(terms))
    stats = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(terms)))
    score = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * {D.BM25_K1 + 1} / (tf{i} + {D.BM25_K1} * (1 - {D.BM25_B} + {D.BM25_B} * dl / avgdl))" for i in range(len(terms)))
    score = score.replace("n - df", "CAST(n AS DOUBLE) - df").replace(" tf", " CAST(1 AS DOUBLE) * tf")
    some = " OR ".join(f"tf{i} > 0" for i in range(len(terms)))
    end = f" ORDER BY score DESC, id LIMIT {k}" if k else ""
    return f"{name}c AS (SELECT id, len(t) AS dl, {counts} FROM {source}), {name}s AS (SELECT count(*) AS n, avg(dl) AS avgdl, {stats} FROM {name}c), {name} AS (SELECT id, round({score}, 6) AS score FROM {name}c, {name}s WHERE {some}{end})"


def _knn(k: int) -> str:
    return f"sem AS (SELECT vec_id AS id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 6) AS score FROM embeddings ORDER BY score DESC, id LIMIT {k})"


def _fuse(k: float, a: float, b: float) -> str:
    d = lambda x: f"CAST({x} AS DOUBLE)"
    return f"""both_ AS (SELECT id, {d(a)} / ({d(k)} + row_number() OVER (ORDER BY score DESC, id)) AS s FROM sem UNION ALL SELECT id, {d(b)} / ({d(k)} + row_number() OVER (ORDER BY score DESC, id)) FROM kw),
fused AS (SELECT id, round(sum(s), 6) AS score FROM both_ GROUP BY id)"""


def _grams(source: str, name: str = "") -> str:
    """The hashed vector of each text of (id, text), in parts."""
    return f"""{name}words AS (SELECT id, unnest(string_split_regex(trim(lower(text)), '\\s+')) AS w FROM {source}),
{name}grams AS (SELECT id, unnest(list_concat([w], list_transform(range(1, greatest(length(w) - 1, 1)), lambda i: w[i:i + 2]))) AS g FROM {name}words WHERE w <> ''),
{name}hashes AS (SELECT id, CAST('0x' || left(md5(g), 8) AS BIGINT) AS h FROM {name}grams),
{name}parts AS (SELECT id, h % {PROVIDER.dimension} AS place, CAST(sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END) AS DOUBLE) AS x FROM {name}hashes GROUP BY ALL),
{name}norms AS (SELECT id, sqrt(sum(x * x)) AS n FROM {name}parts GROUP BY id)"""


_GRAMS = f"WITH t AS (SELECT conv_id * 1000 + turn AS id, coalesce(text, '') AS text FROM conversations), {_grams('t')}"
N = K * D.SEARCH_MULTIPLIER
HYDRATED = """caps AS (SELECT doc_id AS id, source AS session_id, doc_id AS ts, CASE doc_id % 3 WHEN 0 THEN 'nmap -sV x' WHEN 1 THEN 'curl x' ELSE '(unknown)' END AS command,
  CASE doc_id % 3 WHEN 0 THEN 'nmap' WHEN 1 THEN 'curl' ELSE 'unknown' END AS tool, text FROM documents),
hyd AS (SELECT id, score, session_id, command, tool, ts, text FROM fused JOIN caps USING (id))"""
SEARCH = f"WITH {TOKENS}, {_bm25(TEXT, 'kw', N)}, {_knn(N)}, {_fuse(D.RRF_K, D.SEMANTIC_WEIGHT, D.KEYWORD_WEIGHT)}, {HYDRATED}"
BEST = "SELECT id, score, session_id, command, tool, ts FROM hyd {} ORDER BY score DESC, id LIMIT " + str(K)
_TERMS = sorted(set(I.query_terms(TEXT)))
FUSED = f"WITH {TOKENS}, {_bm25(TEXT, 'kw', K)}, {_knn(K)}"

ORACLES = {
    "stream_tier1": filters.ORACLES["tier1_conversations"],
    "knn_cosine": f"WITH {_knn(K)} SELECT id, score FROM sem",
    "bm25_topk": f"WITH {TOKENS}, {_bm25(TEXT, 'kw', K)} SELECT id, score FROM kw",
    "bm25_all": f"WITH {TOKENS}, {_bm25('moron worthless', 'kw', None)} SELECT id, score FROM kw",
    "bm25_phrase": f"WITH {TOKENS} SELECT id FROM toks WHERE contains(' ' || array_to_string(t, ' ') || ' ', ' {PHRASE} ')",
    "keyword_postings": f"WITH {TOKENS}, e AS (SELECT id, len(t) AS dl, unnest(t) AS term, unnest(range(0, len(t))) AS pos FROM toks) SELECT term, id, dl, count(*) AS tf, CAST(min(pos) AS BIGINT) AS first FROM e GROUP BY term, id, dl",
    "rrf_fusion": f"{FUSED}, {_fuse(D.RRF_K, D.SEMANTIC_WEIGHT, D.KEYWORD_WEIGHT)} SELECT id, score FROM fused",
    "rrf_weighted": f"{FUSED}, {_fuse(10.0, 0.2, 0.8)} SELECT id, score FROM fused",
    "dedup_first": f"WITH {TOKENS}, {_bm25(TEXT, 'kw', K)}, {_bm25('thing', 'kx', K)} SELECT id, max(score) AS score FROM (SELECT * FROM kw UNION ALL SELECT * FROM kx) GROUP BY id",
    "hybrid_search": f"{SEARCH} {BEST.format('')}",
    "hydrate_filter_tool": f"""{SEARCH} {BEST.format("WHERE tool = 'nmap'")}""",
    "hydrate_filter_session": f"""WITH {TOKENS}, {_bm25(TEXT, 'kw', 10 * N)}, {_knn(10 * N)}, {_fuse(D.RRF_K, D.SEMANTIC_WEIGHT, D.KEYWORD_WEIGHT)}, {HYDRATED}
SELECT id, score, session_id, command, tool, ts FROM hyd WHERE session_id = 'src0' ORDER BY score DESC, id LIMIT {10 * K}""",
    "hydrate_min_similarity": f"""{SEARCH} {BEST.format(f"WHERE score >= {LEAST}")}""",
    "search_prefilter": f"""WITH {TOKENS}, {_bm25(TEXT, 'every', None)}, kw AS (SELECT every.* FROM every JOIN documents ON doc_id = id WHERE source = 'src1' ORDER BY score DESC, id LIMIT {N}),
sem AS (SELECT vec_id AS id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 6) AS score
  FROM embeddings JOIN documents ON doc_id = vec_id WHERE source = 'src1' ORDER BY score DESC, id LIMIT {N}),
{_fuse(D.RRF_K, D.SEMANTIC_WEIGHT, D.KEYWORD_WEIGHT)}, {HYDRATED} {BEST.format('')}""",
    "search_listing": f"""{SEARCH} SELECT id, score, tool, command, CASE WHEN length(text) <= 80 THEN text ELSE left(text, 80) || '...' END AS preview FROM hyd ORDER BY score DESC, id LIMIT {K}""",
    "knn_batch": f"""WITH s AS (SELECT q.vec_id AS query, v.vec_id AS id, round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score
  FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0) SELECT query, id, score FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, id) <= {K}""",
    "knn_index": f"WITH {_knn(K)} SELECT id, score FROM sem",
    "vector_index_rows": "SELECT vec_id AS id, count(*) AS n FROM embeddings GROUP BY vec_id",
    "keyword_load": f"WITH {TOKENS}, {_bm25(TEXT, 'kw', K)} SELECT id, score FROM kw",
    "keyword_changes": f"WITH {TOKENS}, left_ AS (SELECT * FROM toks WHERE id % 3 <> 0), {_bm25(TEXT, 'kw', K, 'left_')} SELECT id, score FROM kw",
    "keyword_merge": f"WITH {TOKENS}, left_ AS (SELECT * FROM toks WHERE id % 3 <> 0), {_bm25(TEXT, 'kw', K, 'left_')} SELECT id, score FROM kw",
    "keyword_size": "SELECT count(*) AS documents, count(DISTINCT doc_id) AS ids FROM documents WHERE doc_id % 3 <> 0",
    "embed_hash": f"{_GRAMS} SELECT t.id, '{PROVIDER.model}' AS model, place, round(x / n, 4) AS value FROM t LEFT JOIN parts USING (id) LEFT JOIN norms USING (id) WHERE x IS NULL OR x <> 0",
    "semantic_step": f"""{_GRAMS}, {_grams(f"(SELECT 0 AS id, {C.quoted(TEXT)} AS text)", "q")}
SELECT id, round(s, 4) AS score FROM (SELECT parts.id, sum(parts.x / norms.n * qparts.x / qnorms.n) AS s FROM parts JOIN norms USING (id) LEFT JOIN qparts USING (place) LEFT JOIN qnorms ON true GROUP BY parts.id)
ORDER BY round(coalesce(s, 0), 6) DESC, id LIMIT {K}""",
    "embed_job": f"""WITH t AS (SELECT conv_id * 1000 + turn AS id, CASE WHEN (conv_id * 1000 + turn) % 7 <> 0 THEN text END AS text FROM conversations),
g AS (SELECT regexp_matches(coalesce(text, ''), '\\S') AS good FROM t)
SELECT count(*) FILTER (good) AS processed, count(*) FILTER (NOT good) AS failed, count(*) FILTER (good) AS in_keywords, count(*) FILTER (good) AS in_vectors FROM g""",
    "hydrate_filter_time": f"{SEARCH} {BEST.format('WHERE ts BETWEEN 100 AND 600')}",
    "rerank": f"""{SEARCH}, cand AS (SELECT * FROM hyd ORDER BY score DESC, id LIMIT {D.RERANK_LIMIT}),
re AS (SELECT cand.id, round(len(list_intersect(list_distinct(t), {_TERMS})) / CAST({len(_TERMS)} AS DOUBLE), 6) AS score, session_id, command, tool, ts FROM cand JOIN toks ON toks.id = cand.id)
SELECT * FROM re ORDER BY score DESC, id LIMIT {K}""",
    "search_context": f"WITH {TOKENS}, {_bm25(TEXT, 'kw', 6)}, {_knn(6)}, {_fuse(D.RRF_K, D.SEMANTIC_WEIGHT, D.KEYWORD_WEIGHT)}, {HYDRATED}, b AS (SELECT * FROM hyd ORDER BY score DESC, id LIMIT 3) SELECT string_agg(text, chr(10) || '---' || chr(10) ORDER BY score DESC, id) AS context FROM b",
}
