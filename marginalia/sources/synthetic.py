"""A vault of markdown notes derived from the ``documents`` table.

One note per document: front matter, a title, and one ``## Part i`` section per
text line, each ending in a wikilink.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_path() -> Column:
    return F.concat("source", F.lit("/"), "lang", F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit(".md"))


def vault_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths only; the text column is never read."""
    return table(spark, sf_dir, "documents").select("doc_id", doc_path().alias("path"))


def vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), "doc_id")
    clean = F.expr(r"regexp_replace(regexp_replace(text, '[^\\p{L}\\p{N} ,\n]', ' '), ' +', ' ')")
    lines = F.filter(F.transform(F.split(clean, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    content = F.expr(
        r"concat('---\ntitle: Doc ', doc_id, '\nlang: ', lang, '\n---\n\n# Doc ', doc_id, '\n\n', "
        r"array_join(transform(ls, (x, i) -> concat('## Part ', i, '\n\n', x, "
        r"' [[doc-', (doc_id*31 + i*17) % 997, ']]\n')), '\n'))"
    )
    # The generator keeps the assembled text a plain column, as a stored note
    # would be; filters on it would otherwise repeat the assembly below the shuffle.
    return docs.select("doc_id", "source", "lang", doc_path().alias("path"), lines.alias("ls")).select(
        "doc_id", "source", "lang", "path", F.explode_outer(F.array(content)).alias("content")
    )


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per non-empty text line: ``doc_id, line, text``."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return docs.select("doc_id", F.posexplode_outer(F.split("text", "\n")).alias("line", "text")).filter("text <> ''")
