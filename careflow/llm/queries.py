"""The registered queries of this subpackage, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, brown, digests, edits, ego, minhash, mixing, quality, repair, spelling, tokenfile, toxicity, wrapper
from .common import table


def op1_grid_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors of one label, cosine 0.93 or more."""
    return ego.near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.93)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base quality rules and robust outliers by language and source."""
    return quality.judge(table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE of every whole document, encoded and decoded."""
    return bpe.encode_documents(table(spark, sf_dir, "documents"))


def op4_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every whole document before and after three edits at places set by its id."""
    docs = table(spark, sf_dir, "documents")
    place = lambda k: F.pmod(F.crc32(F.concat_ws("/", F.col("doc_id").cast("string"), F.lit(k)).cast("binary")), F.length(F.coalesce("text", F.lit(""))) + 1)
    edit = lambda k, delete, insert: F.struct(place(k).alias("at"), F.lit(delete).cast("long").alias("delete"), F.lit(insert).alias("insert"))
    docs = docs.withColumn("edits", F.array(edit("a", 0, " inserted words"), edit("b", 7, ""), edit("c", 3, "\n\nA new line: it's 2024. ")))
    return edits.apply(edits.plant(docs, edits_col="edits")).select("doc_id", "n_tokens_before", "n_edits", "n_tokens", "n_chars", "n_encoded_chars")


def op5_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-likelihood of every whole document under a class-based bigram model."""
    return brown.score(table(spark, sf_dir, "documents"))


def op6_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return wrapper.main_text(table(spark, sf_dir, "pages"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every whole document."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in a mixture of its sources by the square roots of their sizes."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.withColumnsRenamed({"mixed_id": "doc_id", "mixed_source": "source"})


def op9_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every whole document, written in bit-plane blocks and read back."""
    return tokenfile.store(table(spark, sf_dir, "documents"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate documents: three-word shingles, 85 % or more in common."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their near words and the form that a rarer spelling belongs to."""
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_digest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies among documents; of equal texts the row with the largest id stays."""
    return digests.dedup(table(spark, sf_dir, "documents"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations: their faults, and the cheapest edits that make their roles grammatical."""
    return repair.damaged_and_repaired(table(spark, sf_dir, "conversations"))


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base statistics and rules of operator 2 alone."""
    docs = table(spark, sf_dir, "documents")
    return quality.statistics(docs.select("doc_id", "text"), "text").select("doc_id", *quality.BASE, "base_failed")


QUERIES = {f.__name__: f for f in (op1_grid_order, op2_quality, op3_byte_bpe, op4_edit_counts, op5_brown, op6_wrappers, op7_toxicity, op8_mixing, op9_token_blocks, op10_minhash, op11_spelling, op12_digest_index, op13_repair, quality_base)}

_WORDS = r"regexp_extract_all({t}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Learned, iterative or byte-level results have no SQL twin; tests/llm has plain versions of them.
ORACLE: dict[str, str] = {
    "op1_grid_order": """WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL), f AS (SELECT *, sqrt(list_inner_product(e, e)) AS l FROM e),
    links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM f a JOIN f b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.l > 0 AND b.l > 0 WHERE list_inner_product(a.e, b.e) / (a.l * b.l) >= 0.93),
    reach AS (SELECT vec_id, vec_id AS r FROM embeddings UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON links.a = reach.r),
    n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
    SELECT vec_id, coalesce(any_value(n), 0) AS n_links, min(r) AS component_id, min(r) = vec_id AS kept FROM reach LEFT JOIN n USING (vec_id) GROUP BY vec_id""",
    "op10_minhash": f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(t=_LOWER)} AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS x FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
    links AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * p.both >= 85 * (x.n + y.n - p.both)),
    reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r)
    SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(r) AS component_id, min(r) = doc_id AS kept FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id""",
    "op11_spelling": r"""WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
    r AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents) WHERE length(run) >= 5 GROUP BY ALL),
    b AS (SELECT *, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + unicode(c) // 64, 128 + unicode(c) % 64] END)) AS bytes FROM r),
    h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, t.t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM b, t),
    d AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
    w AS (SELECT word, sum(n)::BIGINT AS n FROM d WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
    g AS (SELECT word, n, unnest(list_transform(range(length(word)), lambda i: left(word, i) || '*' || substr(word, i + 2))) AS gap FROM w),
    s AS (SELECT DISTINCT word, n, unnest(list_transform(range(length(word) + 1), lambda i: left(word, i) || '*' || substr(word, i + 1))) AS gap FROM w),
    pairs AS (SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS m FROM g a JOIN g b ON a.gap = b.gap AND a.word <> b.word),
    longer AS (SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS m FROM s a JOIN g b ON a.gap = b.gap),
    near AS (SELECT * FROM pairs UNION ALL SELECT * FROM longer UNION ALL SELECT other, m, word, n FROM longer),
    best AS (SELECT word, count(*) AS n_near, arg_max(other, (m, -r)) AS other, max(m) AS m FROM (SELECT *, row_number() OVER (ORDER BY other) AS r FROM near) GROUP BY word),
    f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * w.n THEN other END AS form, CASE WHEN m >= 2 * w.n THEN m END AS form_n FROM w LEFT JOIN best USING (word)),
    way AS (SELECT word, coalesce(form, word) AS goal, 0 AS k FROM f UNION ALL SELECT way.word, f.form, k + 1 FROM way JOIN f ON f.word = way.goal WHERE f.form IS NOT NULL)
    SELECT word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, arg_max(goal, k) AS root FROM way GROUP BY word) USING (word)""",
    "op12_digest_index": """SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "quality_base": f"""WITH w AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS.format(t="coalesce(text, '')")} AS w FROM documents),
    x AS (SELECT doc_id, unnest(list_transform(generate_series(1, len(w) - 2), lambda i: [i::VARCHAR, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]])) AS x FROM w WHERE len(w) >= 3),
    r AS (SELECT doc_id, x[1]::BIGINT AS i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x[2]) AS c FROM x) WHERE c > 1),
    c AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM r, (VALUES (0), (1), (2)) AS t(d) GROUP BY doc_id),
    b AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
        list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS l, coalesce(n, 0) AS n_repeat_words FROM w LEFT JOIN c USING (doc_id))
    SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b""",
}
