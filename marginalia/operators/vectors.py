"""Vectors of chunks: cosine search, hybrid ranking, upsert and delete.

Rows are ``doc_path, chunk_idx, chunk_id, embedding, text, heading_path``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.functions.text import idf, normalise, query_terms, term_count, term_frequency, token_count

# Defaults of the hybrid ranking and of its candidate pool.
HYBRID_LIMIT = 10
VECTOR_WEIGHT = 0.6
POOL_FACTOR = 3
POOL_MIN = 20


def fit(vector: Column, dimensions: int) -> Column:
    """Pad with zeros or cut to the index dimension."""
    zeros = F.array_repeat(F.lit(0.0).cast("float"), dimensions)
    return F.slice(F.concat(vector.cast("array<float>"), zeros), 1, dimensions)


def cosine_to(query: Sequence[float]):
    """Arrow function giving the cosine with ``query``; a zero vector gives 0."""
    q = np.asarray(query, dtype=np.float32).astype(np.float64)
    q_norm = float(np.sqrt(q @ q))

    @F.arrow_udf(T.DoubleType())
    def cosine(vectors: pa.Array) -> pa.Array:
        sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
        if vectors.null_count == 0 and len(vectors) and (sizes == len(q)).all():
            m = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(q)).astype(np.float64)
        else:
            m = np.zeros((len(vectors), len(q)))
            for row, v in enumerate(vectors.to_pylist()):
                part = (v or [])[: len(q)]
                m[row, : len(part)] = part
        norms = np.sqrt(np.einsum("ij,ij->i", m, m)) * q_norm
        dots = m @ q
        return pa.array(np.divide(dots, norms, out=np.zeros_like(dots), where=norms != 0))

    return cosine


def similarities(vectors: DataFrame, query: Sequence[float]) -> DataFrame:
    """Every vector with its similarity to one query vector, which travels in the task."""
    return vectors.withColumn("similarity", cosine_to(query)(F.col("embedding")))


def top_k(vectors: DataFrame, query: Sequence[float], k: int, ties: Sequence[str] = ("doc_path", "chunk_idx")) -> DataFrame:
    """The ``k`` nearest vectors. Each task keeps only its own best ``k``."""
    return similarities(vectors, query).drop("embedding").orderBy(F.desc("similarity"), *ties).limit(k)


def hybrid_search(
    vectors: DataFrame,
    query: str,
    query_vector: Sequence[float],
    k: int = HYBRID_LIMIT,
    vector_weight: float = VECTOR_WEIGHT,
    directory: str | None = None,
    prefilter: bool = False,
    ties: Sequence[str] = ("doc_path", "chunk_idx"),
    texts: DataFrame | None = None,
) -> DataFrame:
    """Vector candidates re-ranked with keyword scores.

    With ``texts`` (tie columns plus ``text``) the vector scan does not carry
    the text. The candidates, at most ``max(3k, 20)`` rows, are fetched first
    and their keys become a pushed-down filter on the stored texts.

    The directory is a raw prefix applied after the candidates are taken, so
    fewer than ``k`` rows may remain; ``prefilter=True`` restricts first.
    The candidate pool has at most ``max(3k, 20)`` rows, which bounds the
    unpartitioned windows below.
    """
    inside = F.col("doc_path").startswith(directory or "")
    source = vectors.filter(inside) if prefilter else vectors
    pool = top_k(source, query_vector, max(POOL_FACTOR * k, POOL_MIN), ties)
    rank = F.row_number().over(Window.orderBy(F.desc("similarity"), *ties))
    pool = pool.withColumn("vector_rank", rank).filter(inside)
    if texts is not None:
        rows = pool.collect()
        pool = pool.sparkSession.createDataFrame(rows, pool.schema)
        wanted = texts.filter(F.col(ties[0]).isin(sorted({r[ties[0]] for r in rows})))
        pool = wanted.join(F.broadcast(pool), list(ties))

    terms = query_terms(query)
    unique = list(dict.fromkeys(terms))
    whole = Window.partitionBy()
    counted = pool.select(
        "*", token_count(F.col("text")).alias("_t"), *[term_count(F.col("text"), t).alias(f"_k{i}") for i, t in enumerate(unique)]
    ).select(
        "*",
        F.count(F.lit(1)).over(whole).alias("_n"),
        *[F.count_if(F.col(f"_k{i}") > 0).over(whole).alias(f"_d{i}") for i in range(len(unique))],
    )
    lexical = F.lit(0.0)
    for term in terms:
        i = unique.index(term)
        lexical = lexical + term_frequency(F.col(f"_k{i}"), F.col("_t")) * idf(F.col("_n"), F.col(f"_d{i}"))
    rated = counted.withColumn("_lex", lexical).select(
        *pool.columns,
        normalise(F.col("similarity"), F.max("similarity").over(whole)).alias("vector_score"),
        normalise(F.col("_lex"), F.max("_lex").over(whole)).alias("lexical_score"),
    )
    score = F.lit(vector_weight) * F.col("vector_score") + F.lit(1 - vector_weight) * F.col("lexical_score")
    return rated.withColumn("score", score).orderBy(F.desc("score"), "vector_rank").limit(k).drop("vector_rank", "similarity")


def upsert(store: DataFrame, new: DataFrame, dimensions: int) -> DataFrame:
    """Replace all chunks of every document in ``new``."""
    fitted = new.withColumn("embedding", fit(F.col("embedding"), dimensions))
    return delete(store, new.select("doc_path").distinct()).unionByName(fitted)


def delete(store: DataFrame, docs: DataFrame) -> DataFrame:
    """Drop all chunks of the listed documents; unknown ones are ignored."""
    return store.join(docs.select("doc_path"), "doc_path", "left_anti")


def index_size(store: DataFrame) -> DataFrame:
    """Documents and chunks, both; per-document counts combine before the shuffle."""
    per_doc = store.groupBy("doc_path").agg(F.count(F.lit(1)).alias("c"))
    return per_doc.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("c"), F.lit(0)).alias("chunks"))


def point_id(doc_path: Column, chunk_idx: Column) -> Column:
    """Stable UUID-shaped id of a chunk."""
    digest = F.sha2(F.concat(doc_path, F.lit("::"), chunk_idx.cast("string")), 256)
    spans = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(digest, start, size) for start, size in spans])
