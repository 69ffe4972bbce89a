"""The registered queries of the engine's own operators, and their SQL twins.

The tables hold no marker of a high-risk request, so the safety queries write markers into the
texts by a rule on the key, in Spark and in SQL alike. Vector searches ask with every vector
whose id is divisible by 50 against all vectors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from careflow.functions.identity import bucket, pseudonymize, split_of
from careflow.functions.text import MARKERS
from careflow.operators import audit, curate, evaluate, flow, index, lexical, linked, records, retrieve, safety, temporal
from careflow.sources import fhir, tables
from careflow.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL twin if there is one."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


# --- the pieces that the SQL twins share ------------------------------------------------------

_RULE = "CASE {k} % 10 WHEN 0 THEN text || ' PRESCREVA agora' WHEN 1 THEN 'Dose EXATA ' || text WHEN 2 THEN text || ' sem validação médica' WHEN 3 THEN text || ' receita' ELSE text END"
_FOLD = "lower(replace(replace(replace(replace({t}, 'ß', 'ss'), 'ẞ', 'ss'), 'ſ', 's'), 'ẚ', 'aʾ'))"
_RISKY = "(" + " OR ".join(f"contains(n, '{m}')" for m in MARKERS) + ")"
_DOCS = f"docs AS (SELECT doc_id, lang, source, {_RULE.format(k='doc_id')} AS text FROM documents), folded AS (SELECT *, {_FOLD.format(t='text')} AS n FROM docs)"
_DECISION = f"CASE WHEN n IS NULL THEN NULL WHEN {_RISKY} THEN 'human_review' ELSE 'allow' END"
_REASON = f"CASE WHEN n IS NULL THEN NULL WHEN {_RISKY} THEN '{safety.REASON_REVIEW}' ELSE '{safety.REASON_ALLOW}' END"
_BUCKET = "('0x' || substr(sha256(CAST({k} AS VARCHAR)), 1, 8))::UBIGINT % 10"
_SPLIT = f"CASE WHEN {_BUCKET} < 8 THEN 'train' WHEN {_BUCKET} < 9 THEN 'validation' ELSE 'test' END"
_STANDARD = "trim(regexp_replace(regexp_replace({t}, '\\r\\n?', chr(10), 'g'), '[ \\t]+', ' ', 'g'))"
_NEAR = """near AS (SELECT query_id, neighbour, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, neighbour) AS rank FROM (
    SELECT q.vec_id AS query_id, v.vec_id AS neighbour, round(list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) AS score
    FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0)) WHERE rank <= 5)"""


def injected(df: DataFrame, key: Column) -> DataFrame:
    """Texts with the markers that the rule gives their key."""
    k, t = key % 10, F.col("text")
    text = F.when(k == 0, F.concat(t, F.lit(" PRESCREVA agora"))).when(k == 1, F.concat(F.lit("Dose EXATA "), t)).when(k == 2, F.concat(t, F.lit(" sem validação médica"))).when(k == 3, F.concat(t, F.lit(" receita"))).otherwise(t)
    return df.withColumn("text", text)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return injected(table(spark, sf_dir, "documents"), F.col("doc_id"))


# --- safety -----------------------------------------------------------------------------------


@query(f"WITH {_DOCS} SELECT lang, {_DECISION} AS decision, count(*) AS n FROM folded GROUP BY ALL")
def safety_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return safety.assess(_docs(spark, sf_dir)).groupBy("lang", "decision").agg(F.count("*").alias("n"))


@query(f"WITH {_DOCS} SELECT doc_id, {_DECISION} AS decision, {_REASON} AS reason FROM folded")
def safety_assess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return safety.assess(_docs(spark, sf_dir)).select("doc_id", "decision", "reason")


@query(f"WITH turns AS (SELECT conv_id, turn, {_RULE.format(k='(conv_id * 100 + turn)')} AS text FROM conversations WHERE role = 'user'), folded AS (SELECT *, {_FOLD.format(t='text')} AS n FROM turns) SELECT conv_id, turn, {_DECISION} AS decision FROM folded")
def safety_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").filter("role = 'user'")
    return safety.assess(injected(turns, F.col("conv_id") * 100 + F.col("turn"))).select("conv_id", "turn", "decision")


@query(f"WITH {_DOCS} SELECT doc_id, marker FROM folded JOIN (SELECT unnest([{', '.join(repr(m) for m in MARKERS)}]) AS marker) ON contains(n, marker)")
def safety_markers_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return safety.markers_hit(_docs(spark, sf_dir), "doc_id")


# --- audit ------------------------------------------------------------------------------------


@query("SELECT c_custkey, substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 16) AS patient_id_hash FROM customer")
def pseudonymize_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", pseudonymize(F.col("c_custkey")).alias("patient_id_hash"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("trace-"), F.col("event_id").cast("string")).alias("trace_id"),
        F.col("event_type").alias("route"),
        F.when(F.col("user_id") % 7 != 0, F.col("user_id").cast("string")).alias("patient_id"),
        F.when(F.col("event_id") % 3 == 0, F.array(F.lit("protocol-a"), F.concat(F.lit('p"'), F.col("event_type")))).alias("sources"),
        F.when(F.col("event_id") % 2 == 0, "allow").alias("safety_status"),
        (F.col("event_id") % 5 == 0).alias("human_review"),
        F.col("ts").cast("timestamp").alias("at"),
    )


_EVENTS = """ev AS (SELECT CASE WHEN epoch_us(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END || '+00:00' AS timestamp, 'trace-' || event_id AS trace_id, event_type AS route,
    CASE WHEN user_id % 7 <> 0 THEN substr(sha256(CAST(user_id AS VARCHAR)), 1, 16) END AS patient_id_hash, event_id % 3 = 0 AS has, CASE WHEN event_id % 2 = 0 THEN 'allow' END AS safety_status, event_id % 5 = 0 AS human_review FROM events)"""


@query(f"WITH {_EVENTS} SELECT timestamp, trace_id, route, patient_id_hash, CASE WHEN has THEN 'protocol-a|p\"' || route ELSE '' END AS sources, safety_status, human_review FROM ev")
def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_events(_events(spark, sf_dir), "at").withColumn("sources", F.array_join("sources", "|"))


@query(
    f"""WITH {_EVENTS} SELECT '{{"human_review": ' || human_review || ', "patient_id_hash": ' || coalesce('"' || patient_id_hash || '"', 'null') || ', "route": "' || route || '", "safety_status": ' || coalesce('"' || safety_status || '"', 'null')
    || ', "sources": ' || CASE WHEN has THEN '["protocol-a", "p\\"' || route || '"]' ELSE '[]' END || ', "timestamp": "' || timestamp || '", "trace_id": "' || trace_id || '"}}' AS line FROM ev"""
)
def audit_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.json_lines(audit.audit_events(_events(spark, sf_dir), "at"))


# --- curation ---------------------------------------------------------------------------------


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.dedup_exact(table(spark, sf_dir, "documents"))


@query("SELECT d.doc_id, d.lang, d.source FROM documents d LEFT JOIN labels l USING (doc_id) WHERE length(d.text) >= 50 AND trim(d.text) <> '' AND coalesce(l.quality, 1) = 1")
def curate_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.valid(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "lang", "source")


@query(f"SELECT doc_id, sha256({_STANDARD.format(t='text')}) AS text_hash FROM documents")
def standardise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.standardise(table(spark, sf_dir, "documents")).select("doc_id", F.sha2("text", 256).alias("text_hash"))


@query(
    r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '<email>', 'g'),
    '\b[0-9]{1,3}(\.[0-9]{1,3}){3}\b', '<ip>', 'g'), '\b[0-9]{4}([ -]?[0-9]{4}){3}\b', '<number>', 'g')) AS text_hash FROM documents"""
)
def mask_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.masked(table(spark, sf_dir, "documents")).select("doc_id", F.sha2("text", 256).alias("text_hash"))


@query(f"SELECT doc_id, source, {_SPLIT.format(k='source')} AS split FROM documents")
def split_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.split(table(spark, sf_dir, "documents"), "source").select("doc_id", "source", "split")


@query(f"SELECT {_SPLIT.format(k='doc_id')} AS split, ({_BUCKET.format(k='doc_id')})::BIGINT::INT AS bucket, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY ALL")
def split_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", split_of(F.col("doc_id")).alias("split"), bucket(F.col("doc_id"), 10).alias("bucket"))
    return rows.groupBy("split", "bucket").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


_SHARD = "source || '/' || CAST(doc_id // 20 AS VARCHAR)"


@query(
    f"""WITH RECURSIVE d AS (SELECT doc_id, text, coalesce({_SHARD}, 'text:' || coalesce(sha256(text), '')) AS g FROM documents),
    e AS (SELECT DISTINCT a.g AS a, b.g AS b FROM d a JOIN d b ON a.text = b.text AND a.g <> b.g),
    r AS (SELECT DISTINCT g, g AS c FROM d UNION SELECT r.g, e.b FROM r JOIN e ON e.a = r.c),
    c AS (SELECT g, min(c) AS component FROM r GROUP BY g)
    SELECT doc_id, component, {_SPLIT.format(k='component')} AS split FROM d JOIN c USING (g)"""
)
def split_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of a source (20 ids each) stay whole, and shards that share a text stay together."""
    docs = table(spark, sf_dir, "documents").withColumn("shard", F.concat("source", F.lit("/"), F.expr("CAST(doc_id div 20 AS STRING)")))
    return linked.linked_split(docs, "shard", "text").select("doc_id", "component", "split")


@query(f"WITH s AS (SELECT doc_id, lower({_STANDARD.format(t='text')}) AS t, {_SPLIT.format(k='doc_id')} AS split FROM documents) SELECT doc_id FROM s WHERE split = 'test' AND t IN (SELECT t FROM s WHERE split = 'train')")
def split_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.overlap(table(spark, sf_dir, "documents"))


@query("SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON b.text <> '' AND contains(d.text, b.text)")
def leakage_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(
    r"""WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
    g AS (SELECT doc_id, i - 1 AS d, array_to_string(w[i:i + 7], ' ') AS t FROM (SELECT *, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
    h AS (SELECT item_id, i - 1 AS p, array_to_string(w[i:i + 7], ' ') AS t FROM (SELECT *, unnest(range(1, len(w) - 6)) AS i FROM b WHERE len(w) >= 8)),
    m AS (SELECT doc_id, item_id, d, d - p AS g, d - row_number() OVER (PARTITION BY doc_id, item_id, d - p ORDER BY d) AS r FROM g JOIN h USING (t)),
    r AS (SELECT doc_id, item_id, min(d) AS doc_at, min(d) - g AS item_at, count(*) + 7 AS n_words FROM m GROUP BY doc_id, item_id, g, r)
    SELECT doc_id, item_id, doc_at, item_at, n_words FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_words DESC, doc_at, item_at) AS k FROM r) WHERE k = 1"""
)
def leakage_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest runs of eight words or more that documents share with evaluation passages."""
    return curate.shared_runs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("SELECT conv_id, sha256(string_agg('<' || coalesce(role, '') || '> ' || coalesce(text, ''), chr(10) ORDER BY turn)) AS chat_hash, count(*) AS n_turns FROM conversations GROUP BY conv_id")
def chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.chat_rows(table(spark, sf_dir, "conversations")).select("conv_id", F.sha2("chat", 256).alias("chat_hash"), "n_turns")


# --- retrieval --------------------------------------------------------------------------------


@query("SELECT doc_id, ((pos - pos % 160) / 160)::BIGINT AS chunk_no, sha256(substring(text, (pos + 1)::BIGINT, 200)) AS chunk_hash FROM (SELECT doc_id, text, unnest(generate_series(0, length(text) - 1, 160)) AS pos FROM documents WHERE length(text) > 0)")
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.chunks(table(spark, sf_dir, "documents")).select("doc_id", "chunk_no", F.sha2("chunk", 256).alias("chunk_hash"))


def _asked(vectors: DataFrame) -> DataFrame:
    return vectors.filter("vec_id % 50 = 0")


def _nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return retrieve.topk(_asked(vectors), vectors)


@query(f"WITH {_NEAR} SELECT query_id, rank::INT AS rank, neighbour, round(score, 6) AS score FROM near")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir).withColumn("score", F.round("score", 6))


@query()
def ann_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest vectors by an inverted-file index that is built and searched."""
    vectors = table(spark, sf_dir, "embeddings")
    return index.build(vectors, tables.scratch(spark, "index")).search(_asked(vectors))


def _mmr_sql(picks: int = 5, pool: int = 20) -> str:
    """The greedy picks one after the other, each a query over the pool and what was taken before."""
    parts = [_NEAR.replace("rank <= 5)", f"rank <= {pool})"), """u AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS l FROM embeddings),
    alike AS (SELECT a.query_id, a.neighbour AS n1, b.neighbour AS n2, list_inner_product(x.e, y.e) / (x.l * y.l) AS s FROM near a JOIN near b ON a.query_id = b.query_id JOIN u x ON x.vec_id = a.neighbour JOIN u y ON y.vec_id = b.neighbour)""",
    "t1 AS (SELECT query_id, 1 AS rank, neighbour, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(0.5 * score, 9) DESC, neighbour) AS r FROM (SELECT query_id, neighbour, score FROM near)) WHERE r = 1)"]
    for k in range(2, picks + 1):
        parts.append(f"""t{k} AS (SELECT * FROM t{k - 1} UNION ALL SELECT query_id, {k} AS rank, neighbour, score FROM (SELECT n.query_id, n.neighbour, n.score, row_number() OVER (PARTITION BY n.query_id ORDER BY round(0.5 * n.score - 0.5 * x.m, 9) DESC, n.neighbour) AS r
            FROM near n JOIN (SELECT a.query_id, a.n1, max(a.s) AS m FROM alike a JOIN t{k - 1} t ON t.query_id = a.query_id AND t.neighbour = a.n2 GROUP BY ALL) x ON x.query_id = n.query_id AND x.n1 = n.neighbour
            WHERE NOT EXISTS (SELECT 1 FROM t{k - 1} t WHERE t.query_id = n.query_id AND t.neighbour = n.neighbour)) WHERE r = 1)""")
    return f"WITH {', '.join(parts)} SELECT query_id, rank::INT AS rank, neighbour, round(score, 6) AS score FROM t{picks}"


@query(_mmr_sql())
def mmr_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return retrieve.mmr(_asked(vectors), vectors).withColumn("score", F.round("score", 6))


@query(
    f"""WITH {_NEAR}, two AS (SELECT near.*, CASE WHEN a.label = b.label THEN 1.0 ELSE 0.0 END::DOUBLE AS second FROM near JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = neighbour)
    SELECT query_id, neighbour, rank::INT AS rank, row_number() OVER (PARTITION BY query_id ORDER BY second DESC, score DESC, neighbour)::INT AS new_rank FROM two"""
)
def rerank_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    two = _with_labels(spark, sf_dir)
    return retrieve.rerank(two, F.when(F.col("query_label") == F.col("label"), 1.0).otherwise(0.0)).select("query_id", "neighbour", "rank", "new_rank")


def _with_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    labels = vectors.select(F.col("vec_id").alias("neighbour"), "label")
    asked = _asked(vectors).select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label"))
    return _nearest(spark, sf_dir).join(labels, "neighbour").join(asked, "query_id")


@query(f"WITH {_NEAR} SELECT query_id, array_to_string(list_sort(list(DISTINCT neighbour)), ',') AS sources FROM near GROUP BY query_id")
def source_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.sources(_nearest(spark, sf_dir)).withColumn("sources", F.array_join(F.col("sources").cast("array<string>"), ","))


@query(
    f"""WITH {_NEAR}, r AS (SELECT query_id, rank, a.label = b.label AS ok FROM near JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = neighbour),
    q AS (SELECT query_id, min(CASE WHEN ok THEN rank END) AS first, avg(CASE WHEN ok THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS share, count(*) FILTER (WHERE ok) AS hits FROM r GROUP BY query_id),
    t AS (SELECT a.vec_id AS query_id, count(b.vec_id) AS n_relevant FROM embeddings a LEFT JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 GROUP BY 1)
    SELECT count(*) AS n_queries, round(avg((first IS NOT NULL)::INT::DOUBLE), 6) AS hit_at_k, round(avg(share), 6) AS precision_at_k,
    round(avg(CASE WHEN n_relevant > 0 THEN hits::DOUBLE / n_relevant ELSE 0.0::DOUBLE END), 6) AS recall_at_k, round(avg(coalesce(1.0::DOUBLE / first, 0.0::DOUBLE)), 6) AS mrr FROM q JOIN t USING (query_id)"""
)
def hit_at_k_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    sizes = vectors.groupBy("label").agg((F.count("*") - 1).alias("n_relevant"))  # a query isn't relevant to itself
    totals = _asked(vectors).select(F.col("vec_id").alias("query_id"), "label").join(sizes, "label").select("query_id", "n_relevant")
    return evaluate.retrieval(_with_labels(spark, sf_dir), F.col("query_label") == F.col("label"), totals)


@query(
    f"""WITH {_NEAR}, s AS (SELECT query_id, list(neighbour) AS sources FROM near GROUP BY query_id), e AS (SELECT a.vec_id AS query_id, min(b.vec_id) AS source FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY 1)
    SELECT count(*) AS n, round(avg(list_contains(sources, source)::INT::DOUBLE), 6) AS correct_source FROM s JOIN e USING (query_id)"""
)
def correct_source_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The expected source of a query is the first vector of its label (the second one for the first itself)."""
    vectors = table(spark, sf_dir, "embeddings")
    two = vectors.groupBy("label").agg(F.min("vec_id").alias("one")).join(vectors, "label").filter("vec_id <> one").groupBy("label", "one").agg(F.min("vec_id").alias("two"))
    expected = vectors.join(two, "label").select(F.col("vec_id").alias("query_id"), F.when(F.col("vec_id") == F.col("one"), F.col("two")).otherwise(F.col("one")).alias("source"))
    return evaluate.correct_source(retrieve.sources(_nearest(spark, sf_dir)), expected, "query_id")


@query("SELECT lang, count(*) AS n, count(quality) AS n_judged, round(avg(quality::DOUBLE), 6) AS score, round(avg((quality >= 1)::INT::DOUBLE), 6) AS grounded FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def groundedness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels of quality stand in for judgments of answers."""
    return evaluate.groundedness(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "lang", "doc_id", "quality")


@query(
    r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w FROM documents), c AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 6))::BIGINT % 64 AS place, count(*) AS n FROM w GROUP BY ALL),
    f AS (SELECT place, count(*) AS df FROM c GROUP BY place), x AS (SELECT doc_id, place, n * (ln((1.0::DOUBLE + (SELECT count(DISTINCT doc_id) FROM documents)) / (1.0::DOUBLE + df)) + 1.0) AS x FROM c JOIN f USING (place))
    SELECT doc_id, place::INT AS place, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 6) AS weight FROM x"""
)
def embed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The components of each document's embedding that aren't 0."""
    found = retrieve.embed(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.posexplode("embedding").alias("place", "weight")).filter("weight <> 0").withColumn("weight", F.round("weight", 6))


_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"
_BM25 = f"""w AS (SELECT doc_id, {_TERMS} AS w FROM documents), c AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM w) GROUP BY ALL),
    f AS (SELECT term, ln(1.0::DOUBLE + (n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS weight FROM c, (SELECT count(*) AS n FROM documents) GROUP BY term, n),
    a AS (SELECT item_id AS query_id, term FROM (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark)),
    x AS (SELECT query_id, doc_id, round(sum(tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(w) / mean)) * weight), 6) AS score FROM a JOIN c USING (term) JOIN f USING (term) JOIN w USING (doc_id), (SELECT avg(len(w)) AS mean FROM w) GROUP BY ALL),
    bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM x) WHERE rank <= 10)"""


@query(f"WITH {_BM25} SELECT query_id, rank, doc_id, score FROM bm")
def lexical_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents with the highest BM25 for each passage, by an index that is built and searched."""
    built = lexical.build(table(spark, sf_dir, "documents"), tables.scratch(spark, "lexical"))
    return built.search(table(spark, sf_dir, "benchmark"))


@query(
    f"""WITH {_BM25}, v AS (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, round(list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) AS s FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id IN (SELECT item_id FROM benchmark)),
    vk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS rank FROM v) WHERE rank <= 10),
    u AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT query_id, doc_id, rank FROM bm UNION ALL SELECT query_id, doc_id, rank FROM vk) GROUP BY ALL)
    SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM u) WHERE rank <= 10"""
)
def fused_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each passage's BM25 ranking fused with that of the vector of its id (vectors stand in for documents of their ids)."""
    vectors, passages = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "benchmark")
    asked = vectors.join(passages.select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi")
    near = retrieve.topk(asked, vectors, 10).withColumnRenamed("neighbour", "doc_id")
    return lexical.fuse([lexical_topk(spark, sf_dir), near])


# --- records ----------------------------------------------------------------------------------


@query("SELECT c_custkey, o_orderkey, o_totalprice, o_orderpriority FROM customer JOIN orders ON o_custkey = c_custkey")
def patient_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = records.lookup(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), "c_custkey", "o_custkey")
    return found.select("c_custkey", "o_orderkey", "o_totalprice", "o_orderpriority")


@query(
    """SELECT c_custkey, c_mktsegment, o_orderkey, o_totalprice FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) o ON o_custkey = c_custkey AND r = 1"""
)
def patient_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = records.latest(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), "c_custkey", "o_custkey", ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_totalprice"])
    return found.select("c_custkey", "c_mktsegment", "o_orderkey", "o_totalprice")


@query(
    """SELECT c_mktsegment AS variant, count(*) AS n, round(avg(o_totalprice), 4) AS score FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL"""
)
def variant_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = records.lookup(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), "c_custkey", "o_custkey")
    return evaluate.by_variant(found.withColumn("variant", F.col("c_mktsegment")), "variant", F.col("o_totalprice")).withColumn("score", F.round("score", 4))


def _paired_sql(rounds: int = 96) -> str:
    """Both variants' scores, and each round's weighted mean difference from the same hashes."""
    weight = " + ".join(f"(u >= {p})::INT" for p in evaluate.POISSON)
    mmr = _mmr_sql()
    return f"""{mmr[: mmr.rindex(') SELECT')]}), s1 AS (SELECT query_id, avg((a.label IS NOT DISTINCT FROM b.label)::INT::DOUBLE) AS first FROM near JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = neighbour WHERE rank <= 5 GROUP BY 1),
    s2 AS (SELECT query_id, avg((a.label IS NOT DISTINCT FROM b.label)::INT::DOUBLE) AS second FROM t5 JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = neighbour GROUP BY 1),
    q AS (SELECT * FROM s1 JOIN s2 USING (query_id)), w AS (SELECT r, second - first AS d, ('0x' || substr(sha256(query_id || ':' || (r // 16)), (r % 16 * 4 + 1)::BIGINT, 4))::INT AS u FROM q, range({rounds}) AS t(r)),
    b AS (SELECT r, sum(d * ({weight})) / nullif(sum({weight}), 0) AS d FROM w GROUP BY r)
    SELECT count(*) AS n, round(avg(first), 6) AS first, round(avg(second), 6) AS second, round(avg(second - first), 6) AS difference, (SELECT round(quantile_cont(d, 0.025), 6) FROM b) AS low, (SELECT round(quantile_cont(d, 0.975), 6) FROM b) AS high FROM q"""


@query(_paired_sql())
def variant_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of neighbours with the query's label, exact search against MMR, with an interval of the difference."""
    vectors = table(spark, sf_dir, "embeddings")
    labels = [vectors.select(F.col("vec_id").alias(c), F.col("label").alias(f"{c}_label")) for c in ("query_id", "neighbour")]
    share = lambda found, name: found.join(labels[0], "query_id").join(labels[1], "neighbour").groupBy("query_id").agg(F.avg(F.col("query_id_label").eqNullSafe(F.col("neighbour_label")).cast("double")).alias(name))
    return evaluate.paired_difference(share(_nearest(spark, sf_dir), "first").join(share(retrieve.mmr(_asked(vectors), vectors), "second"), "query_id"), "query_id", "first", "second")


@query(
    """WITH newest AS (SELECT o_custkey, max_by(o_orderpriority, o_orderkey) AS got FROM orders GROUP BY 1), first AS (SELECT o_custkey, min_by(o_orderpriority, o_orderkey) AS want FROM orders GROUP BY 1)
    SELECT count(*) AS n, round(avg((want IS NOT DISTINCT FROM got)::INT::DOUBLE), 6) AS exact_rate FROM first LEFT JOIN newest USING (o_custkey)"""
)
def exact_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey")
    want, got = (orders.agg(f("o_orderpriority", "o_orderkey").alias("value")) for f in (F.min_by, F.max_by))
    return evaluate.exact_rate(want, got, "o_custkey", "value")


_AT = "ts - INTERVAL 25 YEAR"  # the events lie 25 years behind the orders
_HOUR = 3_600_000_000


def _earlier_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("o_custkey"), F.expr(_AT).alias("at"))


@query(
    f"""WITH p AS (SELECT event_id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM events JOIN orders ON o_custkey = user_id AND o_orderdate <= {_AT} GROUP BY event_id)
    SELECT event_id, user_id AS o_custkey, o_orderkey, o_totalprice, o_orderpriority FROM events LEFT JOIN p USING (event_id) LEFT JOIN orders USING (o_orderkey)"""
)
def patient_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the newest order of its user at that time."""
    found = temporal.as_of(_earlier_events(spark, sf_dir), table(spark, sf_dir, "orders"), ["o_custkey"], "at", "o_orderdate", ["o_orderkey", "o_totalprice", "o_orderpriority"], ["o_orderkey"])
    return found.drop("at")


@query(f"SELECT event_id, o_orderkey FROM events JOIN orders ON o_custkey = user_id AND o_orderdate < {_AT} + INTERVAL 1 HOUR AND {_AT} < o_orderdate + INTERVAL 60 DAY")
def encounters_overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of an hour that overlap the 60 days of an order of their user."""
    events = _earlier_events(spark, sf_dir).withColumn("until", F.expr("at + INTERVAL 1 HOUR"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", F.expr("o_orderdate + INTERVAL 60 DAY").alias("o_until"))
    return temporal.overlaps(events, orders, ["o_custkey"], ("at", "until"), ("o_orderdate", "o_until"), 60 * 24 * _HOUR).select("event_id", "o_orderkey")


@query(
    f"""WITH p AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
    s AS (SELECT *, count(*) FILTER (WHERE before IS NULL OR epoch_us(ts) - epoch_us(before) > {6 * _HOUR}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM p)
    SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, count(*) AS n FROM s GROUP BY user_id, s"""
)
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users' events by gaps of more than six hours."""
    found = temporal.sessions(table(spark, sf_dir, "events"), "user_id", "ts", 6 * _HOUR)
    return found.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


# --- flow and routing -------------------------------------------------------------------------


@query("SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS steps FROM conversations GROUP BY conv_id")
def processing_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("said"))
    return said.select("conv_id", F.array_join(F.col("said.role"), ">").alias("steps"))


@query(
    f"WITH {_DOCS}, r AS (SELECT CASE WHEN doc_id % 10 IN (0, 1, 2) THEN 'human_review' ELSE 'allow' END AS expected, {_DECISION} AS got FROM folded) SELECT expected, count(*) AS n, round(avg((expected = got)::INT::DOUBLE), 6) AS accuracy FROM r GROUP BY expected"
)
def routing_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = safety.assess(_docs(spark, sf_dir))
    return evaluate.routing(docs, F.when((F.col("doc_id") % 10).isin(0, 1, 2), "human_review").otherwise("allow"), F.col("decision"))


@query(f"WITH {_DOCS} SELECT CASE WHEN doc_id % 10 IN (0, 1, 2) THEN 'human_review' ELSE 'allow' END AS expected, {_DECISION} AS got, count(*) AS n FROM folded GROUP BY ALL")
def routing_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = safety.assess(_docs(spark, sf_dir))
    return evaluate.confusion(docs, F.when((F.col("doc_id") % 10).isin(0, 1, 2), "human_review").otherwise("allow"), F.col("decision"))


@query(
    f"""WITH {_DOCS}, r AS (SELECT CASE WHEN doc_id % 10 IN (0, 1, 2) THEN 'human_review' ELSE 'allow' END AS expected, {_DECISION} AS got, lang, source FROM folded)
    SELECT expected, lang, source, grouping(expected, lang, source)::BIGINT AS grouping, count(*) AS n, round(avg((expected = got)::INT::DOUBLE), 6) AS accuracy FROM r GROUP BY CUBE (expected, lang, source)"""
)
def routing_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routing accuracy over category, language and source, and all their combinations."""
    docs = safety.assess(_docs(spark, sf_dir)).withColumn("expected", F.when((F.col("doc_id") % 10).isin(0, 1, 2), "human_review").otherwise("allow"))
    return evaluate.metric_cube(docs, ["expected", "lang", "source"], F.col("expected") == F.col("decision"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as requests; two of three have a patient, every fifth of those an unknown one."""
    turns = table(spark, sf_dir, "conversations").filter("role = 'user'")
    key = F.col("conv_id") * 100 + F.col("turn")
    turns = injected(turns, key).withColumn("k", key)
    return turns.select(F.concat(F.lit("t-"), F.col("k").cast("string")).alias("trace_id"), F.col("text").alias("question"), F.when(F.col("k") % 3 != 0, F.when(F.col("k") % 5 == 0, "unknown").otherwise((F.col("k") % 100 + 1).cast("string"))).alias("patient_id"), "conv_id")


_FLOW = f"""WITH t AS (SELECT conv_id * 100 + turn AS k, conv_id, {_RULE.format(k='(conv_id * 100 + turn)')} AS text FROM conversations WHERE role = 'user'),
    r AS (SELECT *, {_FOLD.format(t='text')} AS n, CASE WHEN k % 3 <> 0 THEN CASE WHEN k % 5 = 0 THEN 'unknown' ELSE CAST(k % 100 + 1 AS VARCHAR) END END AS pid FROM t),
    c AS (SELECT r.*, p.c_mktsegment AS ctx, d.doc_id AS src FROM r LEFT JOIN customer p ON CAST(p.c_custkey AS VARCHAR) = pid LEFT JOIN documents d ON d.doc_id = r.conv_id AND r.k % 2 = 0),
    s AS (SELECT *, {_DECISION} AS safety_status, coalesce(trim(text) <> '', false) AS valid FROM c),
    v AS (SELECT *, CASE WHEN src IS NULL AND ctx IS NULL THEN 'no_context' WHEN src IS NULL THEN 'no_protocol' ELSE 'none' END AS fallback FROM s),
    w AS (SELECT *, safety_status IS DISTINCT FROM 'allow' OR NOT valid OR fallback = 'no_context' AS review FROM v)"""


@query(
    f"""{_FLOW}
    SELECT 't-' || k AS trace_id, CASE WHEN NOT valid THEN 'invalid' WHEN pid IS NOT NULL THEN 'clinical_question' ELSE 'protocol_question' END AS route, safety_status, fallback, review AS requires_human_review,
    CASE WHEN review THEN 'pending' ELSE 'not_needed' END AS verdict, CASE WHEN NOT review THEN 'Sources: ' || coalesce('doc-' || src, '') END AS response,
    'validate_input>classify_request' || CASE WHEN ctx IS NOT NULL THEN '>retrieve_patient' ELSE '' END || CASE WHEN src IS NOT NULL THEN '>retrieve_protocol' ELSE '' END || '>build_context>generate_answer>validate_answer' || CASE WHEN review THEN '>human_review' ELSE '' END || '>format_response' AS steps FROM w"""
)
def flow_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _flow(spark, sf_dir)
    return done.select("trace_id", "route", "safety_status", "fallback", "requires_human_review", "verdict", "response", F.array_join("processing_steps", ">").alias("steps"))


def _flow(spark: SparkSession, sf_dir: str, verdicts: DataFrame | None = None) -> DataFrame:
    asked = requests(spark, sf_dir)
    patients = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("patient_id"), F.col("c_mktsegment").alias("patient_context"))
    docs = table(spark, sf_dir, "documents").select("doc_id")
    protocols = asked.filter("try_cast(substring(trace_id, 3) as long) % 2 = 0").join(docs, F.col("conv_id") == docs["doc_id"]).select("trace_id", F.array(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))).alias("sources"))
    return flow.run(asked.drop("conv_id"), patients, protocols, verdicts)


@query(f"{_FLOW} SELECT 't-' || k AS trace_id, CASE WHEN NOT review THEN 'not_needed' WHEN k % 4 = 0 THEN 'approved' WHEN k % 4 = 1 THEN 'rejected' ELSE 'pending' END AS verdict, CASE WHEN NOT review OR k % 4 = 0 THEN CASE WHEN valid AND fallback <> 'no_context' THEN 'Sources: ' || coalesce('doc-' || src, '') END END AS response FROM w")
def flow_reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews that came in for half of the requests."""
    k = F.expr("try_cast(substring(trace_id, 3) as long)") % 4
    verdicts = requests(spark, sf_dir).filter(k <= 1).select("trace_id", F.when(k == 0, "approved").otherwise("rejected").alias("verdict"))
    return _flow(spark, sf_dir, verdicts).select("trace_id", "verdict", "response")


_REVIEWS = """a AS (SELECT 't-' || k AS trace_id, TIMESTAMP '2026-01-01' + to_minutes(k::INT) AS asked, k FROM w WHERE review),
    g AS (SELECT trace_id, asked + to_hours((k % 7)::INT) AS moment, 'approved' AS verdict FROM a WHERE k % 4 = 0 UNION ALL SELECT trace_id, asked + to_hours(2), 'rejected' FROM a WHERE k % 4 = 1
        UNION ALL SELECT trace_id, asked + to_hours(3), 'approved' FROM a WHERE k % 4 = 1 UNION ALL SELECT 'x' || trace_id, asked, 'approved' FROM a WHERE k % 4 = 3),
    f AS (SELECT trace_id, min((moment, verdict)) AS f FROM g JOIN a USING (trace_id) WHERE moment >= asked AND moment <= asked + INTERVAL 4 HOUR GROUP BY trace_id), s AS (SELECT a.*, f[1] AS taken, f[2] AS taken_verdict FROM a LEFT JOIN f USING (trace_id)),
    o AS (SELECT trace_id, 'ask' AS action, asked AS moment, NULL AS verdict FROM s UNION ALL SELECT trace_id, 'remind', asked + INTERVAL 1 HOUR, NULL FROM s WHERE taken IS NULL OR taken > asked + INTERVAL 1 HOUR
        UNION ALL SELECT trace_id, 'expire', asked + INTERVAL 4 HOUR, NULL FROM s WHERE taken IS NULL UNION ALL SELECT trace_id, 'resume', taken, taken_verdict FROM s WHERE taken IS NOT NULL
        UNION ALL SELECT g.trace_id, CASE WHEN s.trace_id IS NULL OR g.moment < asked THEN 'unknown' WHEN taken IS NULL THEN 'late' ELSE 'repeated' END, g.moment, g.verdict FROM g LEFT JOIN s USING (trace_id) WHERE taken IS NULL OR (g.moment, g.verdict) IS DISTINCT FROM (taken, taken_verdict))"""


@query(f"{_FLOW.replace('s AS (', 's0 AS (').replace('FROM s)', 'FROM s0)')}, {_REVIEWS} SELECT trace_id, action, epoch_us(moment) AS at_us, verdict, 1::BIGINT AS n FROM o")
def flow_review_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews of the flow's requests: asked, reminded after an hour, expired after four, resumed by verdicts, of which some are late, repeated or unknown."""
    k = F.expr("try_cast(substring(trace_id, 3) as long)")
    asked = _flow(spark, sf_dir).filter("requires_human_review").select("trace_id", k.alias("k")).withColumn("asked_at", F.expr("timestamp'2026-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, k)"))
    later = lambda hours: F.expr(f"asked_at + make_interval(0, 0, 0, 0, {hours})")
    given = lambda when, id_, at, verdict: asked.filter(when).select(id_.alias("trace_id"), at.alias("given_at"), F.lit(verdict).alias("verdict"))
    own = F.col("trace_id")
    verdicts = [given("k % 4 = 0", own, later("cast(k % 7 as int)"), "approved"), given("k % 4 = 1", own, later(2), "rejected"), given("k % 4 = 1", own, later(3), "approved"), given("k % 4 = 3", F.concat(F.lit("x"), own), F.col("asked_at"), "approved")]
    found = flow.review_actions(asked, reduce(DataFrame.unionByName, verdicts), _HOUR, 4 * _HOUR)
    return found.select("trace_id", "action", F.unix_micros("at").alias("at_us"), "verdict", "n")


@query(
    f"""{_FLOW} SELECT 't-' || k AS trace_id, CASE WHEN NOT valid THEN 'invalid' WHEN pid IS NOT NULL THEN 'clinical_question' ELSE 'protocol_question' END AS route, substr(sha256(pid), 1, 16) AS patient_id_hash,
    coalesce('doc-' || src, '') AS sources, safety_status, review AS human_review FROM w"""
)
def flow_audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events at the end of the flow, but for their time."""
    return flow.audit_log(_flow(spark, sf_dir)).withColumn("sources", F.array_join("sources", "|")).drop("timestamp")


@query(f"{_FLOW} SELECT 't-' || k AS trace_id, unnest(list_concat(CASE WHEN ctx IS NULL THEN ['retrieve_patient'] ELSE [] END, CASE WHEN src IS NULL THEN ['retrieve_protocol'] ELSE [] END)) AS missing FROM w")
def path_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps that a request's way lacks."""
    return evaluate.missing_steps(_flow(spark, sf_dir), ["validate_input", "retrieve_patient", "retrieve_protocol", "build_context", "format_response"])


# --- readers and writers ----------------------------------------------------------------------


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def ingest_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as CSV and read back by an explicit schema."""
    rows, path = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"), tables.scratch(spark, "records")
    rows.write.option("header", "true").csv(path)
    return tables.records(spark, path, rows.schema)


@query("SELECT item_id, sha256(text || chr(10)) AS text_hash FROM benchmark")
def load_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages written as a text file each, and loaded as whole documents."""
    path = tables.scratch(spark, "passages")
    table(spark, sf_dir, "benchmark").select("text", F.col("item_id").alias("item")).write.partitionBy("item").text(path)
    found = tables.documents(spark, f"{path}/item=*")
    return found.select(F.regexp_extract("origin", "item=([0-9]+)", 1).cast("long").alias("item_id"), F.sha2("text", 256).alias("text_hash"))


@query(ORACLE["routing_accuracy"])
def metric_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics written as CSV and read back."""
    path, metrics = tables.scratch(spark, "metrics"), routing_accuracy(spark, sf_dir)
    tables.write_metrics(metrics, path, "csv")
    return tables.records(spark, path, metrics.schema)


@query(f"SELECT doc_id, {_SPLIT.format(k='doc_id')} AS split FROM documents")
def manifest_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split manifest written as JSON and read back."""
    path = tables.scratch(spark, "manifest")
    tables.write_manifest(curate.split(table(spark, sf_dir, "documents"), "doc_id"), path, "doc_id")
    return tables.records(spark, path, spark.createDataFrame([], "doc_id long, split string").schema, "json")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS patient_id, c_mktsegment AS family, o_orderstatus AS status, epoch_us(o_orderdate) AS start_us FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def fhir_encounters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as FHIR bundles, a patient each, and read back as tables."""
    order = F.struct(F.lit("Encounter").alias("resourceType"), F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("status"), F.struct(F.concat(F.lit("Patient/"), F.col("o_custkey").cast("string")).alias("reference")).alias("subject"), F.struct(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("start")).alias("period"))
    visits = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(F.to_json(F.struct(order.alias("resource")))).alias("visits"))
    person = F.struct(F.lit("Patient").alias("resourceType"), F.col("c_custkey").cast("string").alias("id"), F.array(F.struct(F.col("c_mktsegment").alias("family"))).alias("name"))
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.to_json(F.struct(person.alias("resource"))).alias("person"))
    all_ = F.array_join(F.array_compact(F.concat(F.array("person"), F.coalesce("visits", F.array().cast("array<string>")))), ",")
    path = tables.scratch(spark, "bundles")
    visits.join(people, "o_custkey", "full").select(F.concat(F.lit('{"resourceType":"Bundle","entry":['), all_, F.lit("]}")).alias("value")).write.text(path)
    found = fhir.entries(fhir.read(spark, path))
    who = fhir.table(found, "patients").select(F.col("id").alias("patient_id"), "family")
    return fhir.table(found, "encounters").join(who, "patient_id", "left").select("id", "patient_id", "family", "status", F.unix_micros("start").alias("start_us"))
