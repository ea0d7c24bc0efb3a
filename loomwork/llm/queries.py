"""The queries of this subpackage by name, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontamination, language, lines, simhash, substrings, token_counts, toxicity, vectors, warc
from .batches import table

#: The vocabulary file on the driver; nothing is copied from there into the repository.
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), language.held_out("doc_id")
    labels = table(spark, sf_dir, "labels")
    net = toxicity.learn(docs.filter(~held_out), labels.filter(~held_out))
    return toxicity.score(docs, net).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    samples = language.learn(docs.filter(~language.held_out("doc_id")))
    return language.predict(docs, samples).select("doc_id", language.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP5_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM d, unnest(range(1, len(w) - 18)) AS t(i)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
word AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
seen AS (SELECT word.doc_id, p, word, max(rep.i) OVER (PARTITION BY word.doc_id ORDER BY p ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) IS NULL AS kept
         FROM word LEFT JOIN rep ON rep.doc_id = word.doc_id AND rep.i = word.p),
got AS (SELECT doc_id, sum(kept::int) AS n_kept, string_agg(word, ' ' ORDER BY p) FILTER (WHERE kept) AS body FROM seen GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n_kept, 0))::BIGINT AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM d LEFT JOIN got USING (doc_id)
"""


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.written(table(spark, sf_dir, "pages"))
    return warc.read(spark, folder, payloads=False).drop("url")


OP6_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
w AS (SELECT d, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN top <> page_id THEN top END AS refers_to
FROM p LEFT JOIN w USING (d)
"""


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counts(table(spark, sf_dir, "documents"), BYTE_BPE)


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.remove_repeated_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


OP9_SQL = """
WITH raw AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents),
lined AS (SELECT doc_id, p, line, trim(line, ' ' || chr(9) || chr(13) || chr(12) || chr(11)) AS t FROM raw),
num AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS i FROM lined WHERE t <> ''),
win AS (SELECT *, t AS a, lead(t) OVER w AS b, lead(t, 2) OVER w AS c FROM num WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, i) AS k FROM win WHERE c IS NOT NULL) WHERE k > 1),
gone AS (SELECT DISTINCT num.doc_id, num.p FROM num JOIN rep ON rep.doc_id = num.doc_id AND num.i BETWEEN rep.i AND rep.i + 2),
body AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.p) AS body FROM lined l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.p = l.p WHERE g.p IS NULL GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_lines, coalesce(g.n, 0)::BIGINT AS n_removed, sha256(CASE WHEN d.text IS NOT NULL THEN coalesce(b.body, '') END) AS text_sha256
FROM documents d LEFT JOIN body b USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM num GROUP BY doc_id) n USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g USING (doc_id)
"""


def op10_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode(table(spark, sf_dir, "documents"), BYTE_BPE)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    q.__name__: q
    for q in (
        op1_decontamination,
        op2_embedding_near_dedup,
        op3_toxicity,
        op4_language_id,
        op5_substring_dedup,
        op6_warc,
        op7_token_counts,
        op8_simhash_near_dedup,
        op9_line_dedup,
        op10_bpe_encoding,
    )
}
SQL: dict[str, str] = {"op5_substring_dedup": OP5_SQL, "op6_warc": OP6_SQL, "op9_line_dedup": OP9_SQL}
