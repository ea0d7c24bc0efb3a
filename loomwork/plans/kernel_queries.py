"""Queries of byte kernels and of groupings that are sequential within a group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..operators import similarity, statistics
from ..operators.lineage import cut
from .registry import query

TEXTS = "SELECT doc_id AS k, source AS g, text FROM documents"


@query(None, texts=TEXTS)
def f5_fuzzy_hash(texts: DataFrame) -> DataFrame:
    return texts.select("k", kernels.fuzzy(F.col("text").cast("binary")).alias("fuzzy"))


@query(None, texts=TEXTS)
def f6_chunks(texts: DataFrame) -> DataFrame:
    return kernels.chunks(texts, "k", "text", 128, 512, 2048)


@query(None, texts=TEXTS)
def a17_merkle_roots(texts: DataFrame) -> DataFrame:
    parts = kernels.chunks(texts, "k", "text", 128, 512, 2048)
    return kernels.merkle_roots(parts, "k", "ord", "sha256")


@query("SELECT k, round(list_entropy(string_split(text, '')), 6) AS bits FROM texts", texts="SELECT doc_id AS k, md5(text) AS text FROM documents")
def a18_byte_entropy(texts: DataFrame) -> DataFrame:
    return texts.select("k", F.round(kernels.byte_function(kernels.byte_entropy, "double")(F.col("text").cast("binary")), 6).alias("bits"))


@query(None, items="SELECT source AS g, doc_id AS k, n_chars AS n FROM documents")
def g6_first_fit(items: DataFrame) -> DataFrame:
    return similarity.first_fit(items, "g", "k", "n", 20_000, 100)


@query(None, sets="SELECT l_suppkey AS k, l_partkey AS e FROM lineitem", nodes="SELECT s_suppkey AS k FROM supplier")
def g3_upgma(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    pairs = cut(similarity.similar_pairs(sets, "k", "e", 0.08))
    group = similarity.groups(pairs, nodes, "k")
    near = pairs.join(group, F.col("a") == F.col("k")).select(F.col("group").alias("g"), "a", "b", (1 - F.col("similarity")).alias("distance"))
    return similarity.upgma(near, "g")


@query(
    """WITH s AS (SELECT k, o, i AS pos, substring(b, CAST(2 * i - 1 AS BIGINT), 2) AS b FROM (SELECT k, o, b, unnest(range(1, length(b) // 2 + 1)) AS i FROM (SELECT k, o, hex(encode(v)) AS b FROM reads))),
 n AS (SELECT k, pos, b, count(*) AS n, min(o) AS o FROM s GROUP BY ALL), w AS (SELECT k, pos, b, row_number() OVER (PARTITION BY k, pos ORDER BY n DESC, o) AS r FROM n)
 SELECT k, string_agg(b, '' ORDER BY pos) AS voted FROM w WHERE r = 1 GROUP BY k""",
    reads="SELECT conv_id AS k, turn AS o, text AS v FROM conversations",
)
def a9_byte_vote(reads: DataFrame) -> DataFrame:
    out = statistics.byte_vote(reads.withColumn("v", F.col("v").cast("binary")), ["k"], "v", "o")
    return out.select("k", F.hex("v").alias("voted"))
