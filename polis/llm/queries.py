"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .alignment import align
from .decontamination import decontaminate
from .language_id import identify
from .language_model import score_documents
from .mixing import mix
from .near_dedup import near_duplicates
from .pivot_search import top_k
from .simhash import simhash_duplicates
from .suffix_dedup import dedup_substrings
from .token_counts import token_counts
from .toxicity import score_toxicity
from .vector_codes import compress
from .warc import read_warc, write_warc


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_read(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_read(spark, sf_dir, "documents"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents"), numerator=85, denominator=100, words=5)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), threshold=0.3)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(_read(spark, sf_dir, "documents"), length=100)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["stop"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_read(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_read(spark, sf_dir, "documents"))


def op9_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_read(spark, sf_dir, "embeddings"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, verified for each page, from archives that were written and
    read back. Null html is an empty payload; long payloads go in segments; a null page_id stays null and is the smallest where
    payloads are equal; of repeated rows each is a record, those of the page kept are responses; an empty table gives no rows;
    other columns go."""
    pages = _read(spark, sf_dir, "pages")
    path = common.shared_path(spark, "warc")
    write_warc(pages, path)
    kind = pages.schema["page_id"].dataType
    read = common.cut(
        read_warc(spark, path).select("page_id", "record_type", F.octet_length("payload").cast("long").alias("bytes"), F.sha1("payload").alias("digest"), "payload_digest", "refers_to", "verified"), "pages"
    )
    # A revisit has the size of the response that it refers to.
    whole = read.filter("record_type = 'response'").select(F.col("page_id").alias("of"), F.col("bytes").alias("of_bytes"), F.col("digest").alias("of_digest")).distinct()
    on = (F.col("refers_to") == F.col("of")) & (F.col("payload_digest") == F.col("of_digest"))
    return read.join(whole, on, "left").select(
        F.col("page_id").cast(kind).alias("page_id"),
        F.coalesce("bytes", "of_bytes").alias("payload_bytes"),
        F.coalesce("digest", "of_digest").alias("payload_digest"),
        "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
        "verified",
    )


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(_read(spark, sf_dir, "documents"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_duplicates(_read(spark, sf_dir, "documents"), bits=4, words=4)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(_read(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6, scale=4096)


#: DuckDB SQL; the words of a text are runs of other than ASCII white space.
_VECTORS = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

_WARC = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n, sha1(coalesce(html, '')) AS d FROM pages),
g AS (SELECT d, max(page_id) AS kept FROM p WHERE n >= 1000 GROUP BY d)
SELECT p.page_id, p.n AS payload_bytes, p.d AS payload_digest,
  CASE WHEN g.kept IS NULL OR g.kept = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN g.kept <> p.page_id THEN g.kept END AS refers_to, true AS verified
FROM p LEFT JOIN g ON p.d = g.d AND p.n >= 1000
"""

_SHINGLES = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS c FROM r GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.c AS component_id, c.c = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN c ON c.a = d.doc_id
"""

_REPEATS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(0, length(h) // 2 - 99))) AS p FROM d)),
f AS (SELECT s, min({'d': doc_id, 'p': p}) AS m FROM w GROUP BY s HAVING count(*) > 1),
g AS (SELECT w.doc_id, w.p FROM w JOIN f USING (s) WHERE {'d': w.doc_id, 'p': w.p} <> f.m),
i AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS new FROM g),
j AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM i),
s AS (SELECT doc_id, k, min(p) AS a, max(p) + 100 AS b FROM j GROUP BY doc_id, k),
t AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS l FROM s),
x AS (SELECT t.doc_id, sum(b - a) AS removed, count(*) AS spans, string_agg(substr(h, 2 * l + 1, 2 * (a - l)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept
  FROM t JOIN d USING (doc_id) GROUP BY t.doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN x USING (doc_id)
"""

_MIX = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5('6/' || CAST(doc_id AS VARCHAR)) AS place FROM documents),
z AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
s AS (SELECT source, source_size, CAST([1, 2, 3][(row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1] AS DOUBLE) AS weight, CAST(source_size AS DOUBLE) * 3 AS cap FROM z),
l AS (SELECT 0 AS i, CAST(0 AS DOUBLE) AS level UNION ALL
  SELECT i + 1, (SELECT CASE WHEN sum(CASE WHEN cap <= weight * level THEN 0.0 ELSE weight END) = 0 THEN CAST('Infinity' AS DOUBLE)
    ELSE greatest(level, (sum(source_size) - sum(CASE WHEN cap <= weight * level THEN cap ELSE 0.0 END)) / sum(CASE WHEN cap <= weight * level THEN 0.0 ELSE weight END)) END FROM s) FROM l WHERE i < 50),
t AS (SELECT source, source_size, least(cap, weight * level) AS target FROM s, (SELECT level FROM l WHERE i = 50)),
o AS (SELECT d.doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN least(3, CAST(floor(target / source_size) AS BIGINT)) ELSE 0 END AS whole,
  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, CAST(whole * size + greatest(0, least(size, CAST(floor(target - whole * source_size) AS BIGINT) - start)) AS BIGINT) AS taken FROM o)
SELECT doc_id, size, source_size, target, taken, CASE WHEN size > 0 THEN CAST(taken AS DOUBLE) / size ELSE 0.0 END AS epochs_taken FROM k
"""

_K_MEANS = """
WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT row, part, list_slice(v, part * (len(v) // 8) + 1, (part + 1) * (len(v) // 8)) AS v FROM k, range(8) t(part)),
c0 AS MATERIALIZED (SELECT part, row - 1 AS entry, v AS c FROM x WHERE row <= 16),
"""


def _k_means(rounds: int) -> str:
    """The rounds written out one after another."""
    sql = _K_MEANS
    for r in range(rounds + 1):
        distance = "list_sum(list_transform(list_zip(x.v, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        sql += f"a{r} AS MATERIALIZED (SELECT x.row, x.part, min({{'d': CAST({distance} AS BIGINT), 'e': c.entry}}) AS best, any_value(x.v) AS v FROM x JOIN c{r} c ON c.part = x.part GROUP BY x.row, x.part),\n"
        if r < rounds:
            sql += f"m{r} AS MATERIALIZED (SELECT part, entry, list(m ORDER BY place) AS c FROM (SELECT part, best.e AS entry, i AS place, CAST(floor(CAST(sum(v[i]) AS DOUBLE) / count(*)) AS BIGINT) AS m FROM a{r}, range(1, len(v) + 1) t(i) GROUP BY 1, 2, 3) GROUP BY 1, 2),\n"
            sql += f"c{r + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.c, c.c) AS c FROM c{r} c LEFT JOIN m{r} m ON m.part = c.part AND m.entry = c.entry),\n"
    return (
        sql
        + f"""
f AS (SELECT row, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{rounds} GROUP BY row),
s AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM f JOIN k USING (row) GROUP BY label),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds})
SELECT k.vec_id, f.code, f.error, s.label_error, h.codebooks_sha256 FROM k JOIN f USING (row) JOIN s ON s.label IS NOT DISTINCT FROM k.label, h
"""
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_language_id, op3_near_dedup, op4_toxicity, op5_suffix_dedup, op6_mixing, op7_decontamination, op8_language_model, op9_pivot_search, op10_warc,
        op11_alignment, op12_simhash, op13_vector_codes,
    )
}
SQL = {"op3_near_dedup": _SHINGLES, "op5_suffix_dedup": _REPEATS, "op6_mixing": _MIX, "op9_pivot_search": _VECTORS, "op10_warc": _WARC, "op13_vector_codes": _k_means(6)}
