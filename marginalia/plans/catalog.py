"""Named queries over the test tables, one per operator of the engine."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.functions.frontmatter import frontmatter_json, set_frontmatter
from marginalia.functions.paths import safe_note_path
from marginalia.functions.text import (
    mentions_any,
    proximity,
    render_template,
    round3,
    term_count,
    term_frequency,
    term_hits,
    token_count,
    tokens,
    word_count,
)
from marginalia.operators import edits, fuzzy, links, notes, overview, vectors, workflow
from marginalia.operators.chunks import chunk_notes, outline, read_sections
from marginalia.operators.diff import line_changes
from marginalia.operators.headings import heading_trails
from marginalia.operators.hints import with_hints
from marginalia.operators.search import fragment_search, global_search, score_rows
from marginalia.session import materialise, shared_dir, spread
from marginalia.sources import files
from marginalia.sources.embedders import HashingEmbedder, embed_query
from marginalia.sources.index_store import IndexStore, build_changes, build_index
from marginalia.sources.synthetic import doc_path, document_lines, table, vault, vault_listing
from marginalia.sources.watch import Watch
from marginalia.streaming import debounce
from marginalia.streaming.workflow_state import workflow_states

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

PAIR = "the of"
TRIPLE = "of the and"
FUZZY_QUERIES = ["smal rign", "BLUE wigdet", "hot gaer", "zzz"]
HOUR_MS = 3_600_000
EVENT_MOVES = {"view": "search", "click": "open_note", "purchase": "save", "signup": "done", "error": "reset"}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def r6(x: Column | str) -> Column:
    """Six digits, halves (within the last bits) up, spelled out: engines round exact halves differently."""
    value = F.col(x) if isinstance(x, str) else x
    return F.floor(value * F.lit(1e6) + F.lit(0.5000001)) / F.lit(1e6)


def md5(x: str) -> Column:
    return F.md5(F.col(x))


# ---- notes ----


@query
def list_notes(spark, sf):
    return notes.list_notes(vault_listing(spark, sf))


@query
def list_notes_dir(spark, sf):
    return notes.list_notes(vault_listing(spark, sf), "src1/en/")


@query
def note_stat(spark, sf):
    return notes.stat(vault(spark, sf))


@query
def read_note(spark, sf):
    """Every note, and a missing one for each label."""
    asked = vault_listing(spark, sf).select("path").union(table(spark, sf, "labels").select(F.concat(F.lit("missing/doc-"), "doc_id", F.lit(".md"))))
    return notes.read_notes(vault(spark, sf), asked).select("path", md5("content").alias("content_md5"), "error_code")


@query
def vault_files(spark, sf):
    """Notes written as files to the shared folder, listed and read back."""
    root = f"{shared_dir(spark).removeprefix('file://').removeprefix('file:')}/files-{uuid.uuid4().hex}"
    os.makedirs(root)
    files.write_files(root, vault(spark, sf), overwrite=True).write.format("noop").mode("overwrite").save()
    rows = files.read_files(spark, root, files.list_files(spark, root))
    return rows.select("path", "size_bytes", md5("content").alias("content_md5"))


@query
def vault_errors(spark, sf):
    """Notes and failures by kind: folders that are not there, and notes that went between listing and reading."""
    root = f"{shared_dir(spark).removeprefix('file://').removeprefix('file:')}/errors-{uuid.uuid4().hex}"
    os.makedirs(root)
    files.write_files(root, vault(spark, sf), overwrite=True).write.format("noop").mode("overwrite").save()
    marked = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id").select(doc_path().alias("path"), "toxic", "doc_id")
    absent = marked.select(F.concat(F.lit("absent/"), F.col("doc_id").cast("string")).alias("folder"))
    seen = files.walk(spark, root, table(spark, sf, "documents").select(F.col("source").alias("folder")).distinct().union(absent))
    listing = materialise(seen.filter("kind = 'file'").select("path", "size_bytes", "modified_at"), "listing")
    files.delete_files(root, marked.filter("toxic = 1")).write.format("noop").mode("overwrite").save()
    lost = files.unreadable(files.read_files(spark, root, listing)).select(F.col("error_code").alias("kind"))
    return seen.select("kind").unionByName(lost).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query
def missing_notes(spark, sf):
    marked = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")
    wanted = marked.select(F.when(F.col("quality") == 1, doc_path()).otherwise(F.concat(F.lit("gone/"), doc_path())).alias("path"))
    return notes.missing(vault_listing(spark, sf), wanted)


@query
def safe_paths(spark, sf):
    raw = F.expr(
        r"""CASE doc_id % 5 WHEN 0 THEN concat('/', source, '/', lang, '/doc-', doc_id)
            WHEN 1 THEN concat(source, '\\', lang, '\\doc-', doc_id, '.md')
            WHEN 2 THEN concat(source, '/%2e%2e/', doc_id)
            WHEN 3 THEN concat(source, '%252F', lang, '%20', doc_id)
            ELSE concat('100% ', doc_id) END"""
    )
    rows = table(spark, sf, "documents").select("doc_id", safe_note_path(raw).alias("p"))
    return rows.select("doc_id", "p.path", "p.error_code")


@query
def bulk_read_items(spark, sf):
    items = table(spark, sf, "documents").select(
        F.col("doc_id").alias("pos"),
        F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("missing/doc-"), "doc_id", F.lit(".md"))).otherwise(doc_path()).alias("path"),
        F.expr("CASE WHEN doc_id % 11 = 0 THEN 'Nope' WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN 'Part 1' ELSE 'part 0' END").alias("heading"),
        F.lit(None).cast("int").alias("heading_depth"),
    )
    out = notes.bulk_read(vault(spark, sf), items)
    return out.select("pos", "path", "heading", md5("content").alias("content_md5"), "found", "error")


def _label_notes(spark, sf):
    """New notes for the labelled documents: some replace a note, others are new."""
    return table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id").select(
        F.when(F.col("quality") == 1, doc_path()).otherwise(F.concat(F.lit("new/"), doc_path())).alias("path"),
        F.concat(F.lit("Label "), "toxic").alias("content"),
    )


@query
def create_conflicts(spark, sf):
    return notes.create_notes(vault_listing(spark, sf), _label_notes(spark, sf)).select("path", "error_code")


@query
def note_upsert(spark, sf):
    new = _label_notes(spark, sf)
    twice = new.withColumn("seq", F.lit(2)).union(new.withColumn("content", F.lit("Draft")).withColumn("seq", F.lit(1)))
    state = notes.upsert_notes(vault(spark, sf).select("path", "content"), twice, "seq")
    return state.select("path", md5("content").alias("content_md5"))


@query
def note_delete(spark, sf):
    return notes.delete_notes(vault_listing(spark, sf).select("path"), _label_notes(spark, sf))


@query
def create_from_template(spark, sf):
    nation = table(spark, sf, "nation").select(
        F.concat(F.lit("templates/"), "n_name", F.lit(".md")).alias("path"),
        F.concat(F.lit("# {{ name }}\n\nFrom "), "n_name", F.lit(", segment {{segment}}, {{name}} {{unknown}}\n")).alias("content"),
    )
    customer = table(spark, sf, "customer")
    existing = customer.filter(F.col("c_acctbal") < 0).select(
        F.concat(F.lit("customers/"), "c_custkey", F.lit(".md")).alias("path"), F.col("c_name").alias("content")
    )
    requests = customer.join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.concat(F.lit("customers/"), "c_custkey", F.lit(".md")).alias("path"),
        F.when(F.col("c_mktsegment") == "MACHINERY", F.lit("templates/none.md"))
        .otherwise(F.concat(F.lit("templates/"), "n_name", F.lit(".md")))
        .alias("template_path"),
        F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment")).alias("variables"),
    )
    return notes.create_from_template(nation.unionByName(existing), requests)


@query
def template_render(spark, sf):
    text = F.concat(F.lit("{{ c_name }} has {{balance}} in {{c_name}} {{ nothing }} {{ bad key }} #"), F.col("c_custkey").cast("string"))
    values = F.create_map(F.lit("c_name"), F.col("c_name"), F.lit("balance"), F.lit("$1 {{c_name}}"))
    return table(spark, sf, "customer").select("c_custkey", render_template(text, values).alias("text"))


# ---- structure ----


@query
def chunk_vault(spark, sf):
    return chunk_notes(vault(spark, sf).select("path", "content")).select(
        "path", "chunk_idx", F.array_join("heading_path", " > ").alias("trail"), "word_count", "start_line", "end_line", md5("text").alias("text_md5")
    )


@query
def note_outline(spark, sf):
    return outline(vault(spark, sf).select("path", "content"))


@query
def heading_paths(spark, sf):
    """Every heading with its trail, by Spark expressions alone."""
    rows = heading_trails(vault(spark, sf).select("path", "content"))
    return rows.select("path", "line", "depth", "title", F.array_join("heading_path", " > ").alias("trail"))


@query
def read_section(spark, sf):
    rows = read_sections(vault(spark, sf), F.lit("pArT 3"))
    return rows.select("path", "found", md5("content").alias("content_md5"))


@query
def frontmatter_get(spark, sf):
    fields = frontmatter_json("content")
    rows = vault(spark, sf).select("path", F.from_json(fields, "title string, lang string").alias("f"))
    return rows.select("path", "f.title", "f.lang")


@query
def frontmatter_set(spark, sf):
    payload = F.concat(F.lit('{"status": "done", "lang": "x-'), "lang", F.lit('"}'))
    rows = vault(spark, sf).select("path", set_frontmatter("content", payload).alias("r"))
    return rows.select("path", md5("r.content").alias("content_md5"), "r.error_code")


# ---- text ----


@query
def tokenize_counts(spark, sf):
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    listed = docs.select("doc_id", tokens(F.col("text")).alias("t"))
    return listed.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"))


@query
def word_counts(spark, sf):
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return docs.select("doc_id", word_count(F.col("text")).alias("word_count"))


@query
def term_frequencies(spark, sf):
    rows = document_lines(spark, sf).select("doc_id", "line", term_frequency(term_count(F.col("text"), "the"), token_count(F.col("text"))).alias("tf"))
    return rows.select("doc_id", "line", r6("tf").alias("tf"))


@query
def document_frequency(spark, sf):
    lines = document_lines(spark, sf)
    hit = [F.count_if(mentions_any(F.col("text"), [t]) & (term_count(F.col("text"), t) > 0)) for t in TRIPLE.split()]
    per_doc = lines.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.struct(F.lit(t).alias("term"), h.alias("df")) for t, h in zip(TRIPLE.split(), hit)]).alias("d"),
    )
    return per_doc.select("doc_id", "n", F.explode("d").alias("e")).select("doc_id", "n", "e.term", "e.df")


def _scored(spark, sf, what):
    rows = score_rows(document_lines(spark, sf), "doc_id", "text", ["doc_id", "line"], PAIR)
    return rows.select("doc_id", "line", r6(what).alias("score"))


@query
def tfidf_note_scope(spark, sf):
    return _scored(spark, sf, "tfidf")


@query
def tfidf_corpus_scope(spark, sf):
    return score_rows(document_lines(spark, sf), None, "text", ["doc_id", "line"], PAIR).select("doc_id", "line", r6("tfidf").alias("score"))


@query
def proximity_scores(spark, sf):
    text = F.col("text")
    lines = document_lines(spark, sf).filter(mentions_any(text, ["the"]) & mentions_any(text, ["of"]))
    return lines.select("doc_id", "line", proximity(term_hits(tokens(text), ["the", "of"]), ["the", "of"]).alias("p")).filter("p > 0").select("doc_id", "line", r6("p").alias("score"))


@query
def blended_line_scores(spark, sf):
    return _scored(spark, sf, "score").filter(F.col("score") >= 0.01)


@query
def rounded_scores(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", round3(F.col("l_extendedprice") * F.col("l_discount") / F.lit(7.0) - F.lit(100.0)).alias("score"))
    return rows


# ---- search ----


def _result(found: DataFrame) -> DataFrame:
    return found.select("path", "chunk_idx", r6("score").alias("score"), "word_count", md5("text").alias("text_md5"))


@query
def fragments_per_note(spark, sf):
    return _result(fragment_search(vault(spark, sf), PAIR))


@query
def fragments_one_term(spark, sf):
    return _result(fragment_search(vault(spark, sf), "the"))


@query
def vault_search(spark, sf):
    return _result(global_search(vault(spark, sf), TRIPLE))


@query
def vault_search_dir(spark, sf):
    return _result(global_search(vault(spark, sf), PAIR, directory="src1"))


@query
def vault_search_all(spark, sf):
    """Every qualifying chunk: the ranking without its cut."""
    return _result(fragment_search(vault(spark, sf), TRIPLE, max_chunks=2**31 - 1))


@query
def conversation_search(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    rows = score_rows(turns, "conv_id", "text", ["conv_id", "turn"], TRIPLE).filter(F.col("score") >= F.lit(0.01))
    best = rows.orderBy(F.desc("score"), "conv_id", "turn").limit(20)
    return best.select("conv_id", "turn", r6("score").alias("score"))


# ---- vectors ----


def _query_vector(spark, sf) -> list[float]:
    return list(table(spark, sf, "embeddings").filter("vec_id = 0").select("embedding").first()[0])


def _doc_vectors(spark, sf):
    """Vectors of documents with their note path; the text stays behind."""
    listing = vault_listing(spark, sf).withColumnRenamed("path", "doc_path")
    return table(spark, sf, "embeddings").withColumnRenamed("vec_id", "doc_id").join(listing, "doc_id").select("doc_id", "doc_path", "embedding")


def _texts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


def _hybrid(spark, sf, **options):
    found = vectors.hybrid_search(
        _doc_vectors(spark, sf), PAIR, _query_vector(spark, sf), ties=("doc_id",), texts=_texts(spark, sf), **options
    )
    return found.select("doc_id", r6("score").alias("score"), r6("vector_score").alias("vector_score"), r6("lexical_score").alias("lexical_score"))


@query
def cosine_all(spark, sf):
    rows = vectors.similarities(table(spark, sf, "embeddings").select("vec_id", "embedding"), _query_vector(spark, sf))
    return rows.select("vec_id", r6("similarity").alias("sim"))


@query
def vector_topk(spark, sf):
    found = vectors.top_k(table(spark, sf, "embeddings"), _query_vector(spark, sf), 20, ("vec_id",))
    return found.select("vec_id", "label", r6("similarity").alias("sim"))


@query
def vector_topk_per_label(spark, sf):
    rows = vectors.similarities(table(spark, sf, "embeddings"), _query_vector(spark, sf)).drop("embedding")
    best = rows.withColumn("rank", F.row_number().over(W.partitionBy("label").orderBy(F.desc("similarity"), "vec_id")))
    return best.filter("rank <= 3").select("label", "rank", "vec_id", r6("similarity").alias("sim"))


@query
def hybrid_search(spark, sf):
    return _hybrid(spark, sf)


@query
def hybrid_search_dir(spark, sf):
    return _hybrid(spark, sf, directory="src1", k=20)


@query
def hybrid_search_prefilter(spark, sf):
    return _hybrid(spark, sf, directory="src1/", prefilter=True)


def _store(spark, sf):
    return table(spark, sf, "embeddings").select(F.concat(F.lit("v"), "vec_id").alias("doc_path"), F.lit(0).alias("chunk_idx"), "embedding")


@query
def vector_upsert(spark, sf):
    new = table(spark, sf, "embeddings").select(
        F.concat(F.lit("v"), F.col("vec_id") * 2).alias("doc_path"),
        F.explode(F.sequence(F.lit(0), F.lit(1))).alias("chunk_idx"),
        F.transform("embedding", lambda x: -x).alias("embedding"),
    )
    state = vectors.upsert(_store(spark, sf), new, 64)
    whole = F.array_join(F.transform("embedding", lambda x: F.floor(x.cast("double") * 1e6).cast("string")), ",")
    return state.select("doc_path", "chunk_idx", F.md5(whole).alias("vector_md5"), F.size("embedding").alias("n"))


@query
def vector_delete(spark, sf):
    gone = table(spark, sf, "labels").select(F.concat(F.lit("v"), "doc_id").alias("doc_path"))
    return vectors.delete(_store(spark, sf), gone).select("doc_path", "chunk_idx")


@query
def vector_pad_truncate(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", F.explode(F.array(F.lit(48), F.lit(80))).alias("dims"), "embedding")
    fitted = F.when(F.col("dims") == 48, vectors.fit(F.col("embedding"), 48)).otherwise(vectors.fit(F.col("embedding"), 80))
    total = F.aggregate("f", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return rows.select("vec_id", "dims", fitted.alias("f")).select("vec_id", "dims", F.size("f").alias("n"), r6(total).alias("total"))


@query
def index_size(spark, sf):
    return vectors.index_size(chunk_notes(vault(spark, sf).select("path", "content")).withColumnRenamed("path", "doc_path"))


@query
def point_ids(spark, sf):
    rows = chunk_notes(vault(spark, sf).select("path", "content"))
    return rows.select("path", "chunk_idx", vectors.point_id(F.col("path"), F.col("chunk_idx")).alias("point_id"))


@query
def embedded_index(spark, sf):
    rows = build_index(vault(spark, sf), HashingEmbedder(64))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return rows.select("doc_path", "chunk_idx", "chunk_id", F.size("embedding").alias("n"), F.round(norm, 4).alias("norm"))


@query
def index_incremental(spark, sf):
    """A stored index after one batch of changes: labelled notes replaced, or removed if toxic."""
    embedder = HashingEmbedder(16)
    store = IndexStore(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", embedder.model, embedder.dimensions)
    store.save(build_index(vault(spark, sf), embedder))
    new = _label_notes(spark, sf)
    store.write_changes(0, build_changes(new.select("path"), new.filter(~F.col("content").endswith("1")), embedder))
    return store.load().select("doc_path", "chunk_idx", "chunk_id", md5("text").alias("text_md5"), F.size("embedding").alias("n"))


@query
def index_reindexed(spark, sf):
    """Saved, changed, saved again, changed by a second writer: only what came after the last snapshot counts on top."""
    embedder = HashingEmbedder(16)
    store = IndexStore(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", embedder.model, embedder.dimensions)
    new = _label_notes(spark, sf)
    store.save(build_index(new, embedder))
    store.write_changes(7, build_changes(new.select("path"), new.limit(0), embedder), "first")
    store.save(build_index(vault(spark, sf), embedder))
    store.write_changes(0, build_changes(new.select("path"), new.filter(~F.col("content").endswith("1")), embedder), "second")
    return store.load().select("doc_path", "chunk_idx", "chunk_id", md5("text").alias("text_md5"), F.size("embedding").alias("n"))


@query
def semantic_search(spark, sf):
    embedder = HashingEmbedder(64)
    index = build_index(vault(spark, sf), embedder)
    found = vectors.hybrid_search(index, TRIPLE, embed_query(embedder, TRIPLE))
    return found.select("doc_path", "chunk_idx", r6("score").alias("score"), r6("vector_score").alias("vector_score"), r6("lexical_score").alias("lexical_score"))


# ---- links ----


def _edges(spark, sf):
    return links.backlinks(vault(spark, sf).select("path", "content"), vault_listing(spark, sf))


@query
def wikilinks(spark, sf):
    return links.wikilinks(vault(spark, sf)).select("path", "target", "line", "context")


@query
def wikilink_names(spark, sf):
    aliased = F.replace("content", F.lit("]]"), F.lit("|shown]]"))
    return vault(spark, sf).select("path", F.array_join(links.wikilink_names(aliased), " ").alias("names"))


@query
def wikilink_resolve(spark, sf):
    # Resolving needs the links several times; the notes should be read and searched once.
    found = links.resolve(materialise(links.wikilinks(vault(spark, sf)), "links"), vault_listing(spark, sf), ["path", "off"])
    return found.groupBy("target", "resolved").agg(F.count(F.lit(1)).alias("n"))


@query
def partial_resolve(spark, sf):
    """Links by the end of a path, with and without a segment boundary."""
    docs = table(spark, sf, "documents")
    rows = docs.select(
        "doc_id",
        F.expr("CASE WHEN doc_id % 2 = 0 THEN concat(substr(lang, 2), '/doc-', doc_id, '#top') ELSE concat(source, '/', upper(lang), '/doc-', doc_id + 1, '.md') END").alias("target"),
    )
    found = links.resolve(rows, vault_listing(spark, sf), ["doc_id"])
    return found.select("doc_id", "target", "resolved")


@query
def backlinks(spark, sf):
    return _edges(spark, sf)


@query
def backlinks_of_labelled(spark, sf):
    wanted = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id").select(doc_path().alias("path"))
    return links.backlinks_of_all(_edges(spark, sf), wanted).select("target_key", "source_path", "line_number")


@query
def backlink_counts(spark, sf):
    return links.backlink_counts(_edges(spark, sf))


@query
def backlink_index_size(spark, sf):
    return links.backlink_counts(_edges(spark, sf)).agg(F.count(F.lit(1)).alias("targets"))


@query
def backlinks_updated(spark, sf):
    """Edges of a kept link table after labelled notes went (toxic), were rewritten, or got a namesake that takes their links."""
    marked = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")
    to = F.concat(F.lit("doc-"), F.col("doc_id") % 10)
    gone, good = F.col("toxic") == 1, F.col("quality") == 1
    changed = marked.select(
        F.when(~gone & good, F.concat(F.lit("aaa/doc-"), "doc_id", F.lit(".md"))).otherwise(doc_path()).alias("path"),
        F.when(~gone & good, F.concat(F.lit("New [["), to, F.lit("]]\n"))).when(~gone, F.concat(F.lit("See [["), to, F.lit("|this]].\n"))).alias("content"),
        gone.alias("gone"),
        (~gone & good).alias("new"),
    )
    vanished, appeared = changed.filter("gone").select("path"), changed.filter("new").select("path")
    before = vault_listing(spark, sf).select("path")
    kept = links.resolved_links(materialise(links.all_links(vault(spark, sf)), "links"), before)
    now = before.join(vanished, "path", "left_anti").union(appeared)
    edges = links.edges_from(links.follow_changes(kept, changed.select("path", "content"), appeared, vanished, now))
    return edges.select("target_key", "source_path", "line_number", "link_type")


@query
def orphan_notes(spark, sf):
    return links.orphans(vault_listing(spark, sf).select("path"), _edges(spark, sf))


@query
def html_links(spark, sf):
    pages = spread(table(spark, sf, "pages").select("page_id", "html"), "page_id")
    hrefs = F.explode_outer(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("url")
    rows = pages.select("page_id", hrefs).filter(F.col("url").isNotNull() & ~F.col("url").rlike(links.EXTERNAL))
    source = F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".md"))
    return rows.select("page_id", links.relative_target(source, "url").alias("target")).filter("target IS NOT NULL")


@query
def markdown_links(spark, sf):
    pages = spread(table(spark, sf, "pages").select("page_id", "html"), "page_id")
    items = F.transform(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1)), lambda u: F.concat(F.lit("* item [link]("), u, F.lit(")")))
    site = pages.select(
        F.concat(F.lit("site/"), F.col("page_id").cast("string"), F.lit(".md")).alias("path"),
        F.concat(F.lit("# Page\n\n"), F.array_join(items, "\n"), F.lit("\n")).alias("content"),
    )
    return links.markdown_links(site).select("path", "url", "target", "line", "off")


# ---- overview and fuzzy ----


@query
def overview_folders(spark, sf):
    return overview.folders(vault_listing(spark, sf)).select("path", "parent_path", "depth", "file_count")


@query
def overview_depth_one(spark, sf):
    listing = table(spark, sf, "events").select(
        F.concat(F.expr("CASE WHEN user_id % 9 = 0 THEN '' WHEN user_id % 9 = 1 THEN '.hidden/' ELSE concat(event_type, '/') END"), F.lit("n-"), "event_id", F.lit(".md")).alias("path"),
        F.col("ts").cast("timestamp").alias("modified_at"),
    )
    rows = overview.folders(listing, 1)
    return rows.select("path", "parent_path", "depth", "file_count", F.date_format("last_modified", "yyyy-MM-dd HH:mm:ss").alias("last_modified"))


@query
def overview_tree(spark, sf):
    """Three levels of folders below the root folders, nested as JSON."""
    path = F.concat("source", F.lit("/"), "lang", F.lit("/g"), F.col("doc_id") % 11, F.lit("/n-"), "doc_id", F.lit(".md"))
    listing = table(spark, sf, "documents").select(path.alias("path"))
    return overview.folder_tree(overview.folders(listing).drop("last_modified"))


@query
def overview_total(spark, sf):
    return overview.total_files(vault_listing(spark, sf))


def _part_names(spark, sf):
    return table(spark, sf, "part").groupBy("p_name").agg(F.min("p_partkey").alias("first_key"))


@query
def fuzzy_best(spark, sf):
    found = fuzzy.best_matches(_part_names(spark, sf), "p_name", FUZZY_QUERIES, "first_key")
    return found.select("query", "match", "distance", r6("similarity").alias("similarity"))


@query
def fuzzy_join(spark, sf):
    """Words of the benchmark beside the similar words of all documents."""
    words = lambda name: table(spark, sf, name).select(F.explode_outer(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).filter("word IS NOT NULL").distinct()
    asked, known = words("benchmark").withColumnRenamed("word", "query"), words("documents").withColumnRenamed("word", "match")
    return fuzzy.join_similar(asked, "query", known, "match", 0.8).select("query", "match", "distance", r6("similarity").alias("similarity"))


@query
def fuzzy_all(spark, sf):
    found = fuzzy.all_matches(_part_names(spark, sf), "p_name", FUZZY_QUERIES, 0.5)
    return found.select("query", F.col("p_name").alias("match"), "distance", r6("similarity").alias("similarity"))


# ---- edits ----


def _docs(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")


def _replaced(spark, sf, every):
    rows = _docs(spark, sf).select("doc_id", edits.string_replace(F.col("text"), F.lit("the"), F.lit("<$1>"), F.lit(every)).alias("r"))
    return rows.select("doc_id", md5("r.content").alias("content_md5"), "r.error")


@query
def string_replace_first(spark, sf):
    return _replaced(spark, sf, False)


@query
def string_replace_all(spark, sf):
    return _replaced(spark, sf, True)


@query
def line_replace(spark, sf):
    rows = _docs(spark, sf).select(
        "doc_id", edits.line_replace(F.col("text"), F.lit(2), (F.col("doc_id") % 9).cast("int"), F.lit("new\nlines")).alias("r")
    )
    return rows.select("doc_id", md5("r.content").alias("content_md5"), "r.error")


def _patched(spark, sf, operation):
    done = edits.patch(vault(spark, sf), operation, F.lit("Added *text*.\n"), heading=F.lit("Prt 0"))
    return done.select("path", md5("content").alias("content_md5"), "error_code")


@query
def patch_append(spark, sf):
    return _patched(spark, sf, "append")


@query
def patch_prepend(spark, sf):
    return _patched(spark, sf, "prepend")


@query
def patch_replace(spark, sf):
    return _patched(spark, sf, "replace")


@query
def patch_document(spark, sf):
    done = edits.patch(vault(spark, sf), "prepend", F.lit("First words."))
    return done.select("path", md5("content").alias("content_md5"), "error_code")


@query
def patch_document_append(spark, sf):
    done = edits.patch(vault(spark, sf), "append", F.lit("Last words."))
    return done.select("path", md5("content").alias("content_md5"), "error_code")


@query
def patch_document_replace(spark, sf):
    done = edits.patch(vault(spark, sf), "replace", F.concat(F.lit("Only "), "path"))
    return done.select("path", md5("content").alias("content_md5"), "error_code")


@query
def patch_found_block(spark, sf):
    """Append, prepend and replace at a paragraph with an id, beside notes without it."""
    marked = F.when(F.col("doc_id") % 5 == 0, F.col("content")).otherwise(F.concat("content", F.lit("\nMarked *text* ^b-1\n\nTail words\n")))
    rows = vault(spark, sf).select("path", marked.alias("content"))
    done = [edits.patch(rows, how, F.lit("Added."), block_id=F.lit("b-1")).withColumn("operation", F.lit(how)) for how in ("append", "prepend", "replace")]
    both = done[0].unionByName(done[1]).unionByName(done[2])
    return both.select("path", "operation", md5("content").alias("content_md5"), "error_code")


@query
def patch_missing_block(spark, sf):
    done = edits.patch(vault(spark, sf), "append", F.lit("x"), block_id=F.lit("nope"))
    return done.select("path", "content", "error_code")


@query
def diff_preview(spark, sf):
    done = edits.patch(vault(spark, sf), "append", F.lit("Added."), heading=F.lit("Part 0"))
    rows = done.select("path", edits.unified_diff("path", "old_content", "content").alias("d"))
    added, removed = F.regexp_count("d", F.lit(r"(?m)^\+(?!\+\+)")), F.regexp_count("d", F.lit(r"(?m)^-(?!--)"))
    return rows.select("path", added.alias("added"), removed.alias("removed"))


@query
def diff_lines(spark, sf):
    """Removed and added lines of whole texts whose second line was rewritten."""
    lines = F.split("text", "\n", -1)
    edited = F.array_join(F.transform(lines, lambda x, i: F.when(i == 1, F.concat(F.lit("Edited "), F.reverse(x))).otherwise(x)), "\n")
    rows = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("old_content"), edited.alias("content"))
    return line_changes(rows).select("path", "kind", "line_number", md5("text").alias("text_md5"))


def _batch_ops(spark, sf):
    return table(spark, sf, "documents").select(
        F.expr("doc_id div 10").alias("batch_id"),
        (F.col("doc_id") % 10).cast("int").alias("seq"),
        F.when(F.col("doc_id") % 41 == 5, F.lit("gone.md")).otherwise(doc_path()).alias("path"),
        F.expr("CASE doc_id % 4 WHEN 0 THEN 'line_replace' WHEN 1 THEN 'string_replace' WHEN 2 THEN 'append' ELSE 'frontmatter_set' END").alias("operation"),
        F.expr("""CASE doc_id % 4 WHEN 3 THEN '{"status": "ok"}' ELSE 'Edited' END""").alias("content"),
        F.lit("Part 0").alias("heading"),
        F.lit(6).alias("start_line"),
        F.expr("CASE WHEN doc_id % 20 = 16 THEN 1000000 ELSE 6 END").alias("end_line"),
        F.expr("CASE WHEN doc_id % 23 = 7 THEN 'no such text' ELSE 'Doc' END").alias("search_text"),
        (F.col("doc_id") % 3 == 0).alias("replace_all"),
    )


@query
def batch_edit(spark, sf):
    done = edits.batch_edit(vault(spark, sf).select("path", "content"), _batch_ops(spark, sf))
    return done.select("batch_id", "seq", "path", "action", "status", "error", md5("content").alias("content_md5"))


@query
def batch_summary(spark, sf):
    ops = _batch_ops(spark, sf)
    return edits.batch_summary(edits.batch_edit(vault(spark, sf).select("path", "content"), ops), ops)


# ---- changes and workflow ----


def _events(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "user_id", "event_type", debounce.micros_of(F.col("ts")).alias("at"))
    return rows


@query
def debounce_events(spark, sf):
    return debounce.firings(_events(spark, sf), "user_id", "at", HOUR_MS)


@query
def queue_dedup(spark, sf):
    return debounce.queue(_events(spark, sf), "user_id", "at")


@query
def queue_entries(spark, sf):
    return debounce.queue_entries(_events(spark, sf), "user_id", "at", F.col("event_type") == "error", HOUR_MS)


def _moves(spark, sf):
    name = F.create_map(*[F.lit(x) for kv in EVENT_MOVES.items() for x in kv])
    return _events(spark, sf).select("user_id", "at", "event_id", F.try_element_at(name, F.col("event_type")).alias("name"))


@query
def workflow_fold(spark, sf):
    return workflow.final_state(_moves(spark, sf), "user_id", ["at", "event_id"], "name")


@query
def workflow_history(spark, sf):
    rows = workflow.history(_moves(spark, sf), "user_id", ["at", "event_id"], "name")
    return rows.select("user_id", "event_id", "name", "from_place", "to_place", "accepted")


@query
def workflow_hints(spark, sf):
    states = workflow.final_state(_moves(spark, sf), "user_id", ["at", "event_id"], "name")
    rows = with_hints(states, "final_place", "edit")
    return rows.select("user_id", "final_place", F.array_join("available_transitions", ",").alias("transitions"), F.size("next_actions").alias("n_actions"), F.size("tool_hints").alias("n_tool_hints"))


def _event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


@query
def debounce_stream(spark, sf):
    """All bursts, by a streaming query with a timer for each user."""
    base = f"{shared_dir(spark)}/debounce-{uuid.uuid4().hex}"
    found = debounce.drained(_event_stream(spark, sf), "user_id", "ts", base, HOUR_MS)
    return found.select("user_id", "last_micros", "n_events")


@query
def queue_stream(spark, sf):
    """What enters the queue, by a streaming query: bursts of changes, and deletes (errors) at once."""
    base = f"{shared_dir(spark)}/queue-{uuid.uuid4().hex}"
    found = debounce.drained(_event_stream(spark, sf), "user_id", "ts", base, HOUR_MS, is_delete=F.col("event_type") == "error")
    return found.select("user_id", "at_micros", "kind")


def _workflow_stream(spark, sf, name):
    """The workflow state kept by a streaming query; the last batch per key wins."""
    base = f"{shared_dir(spark)}/workflow-{uuid.uuid4().hex}"
    rows = _event_stream(spark, sf).select("user_id", debounce.micros_of(F.col("ts")).alias("at"), "event_id", name.alias("name"))
    states = workflow_states(rows, "user_id", ["at", "event_id"], "name")

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/epoch={epoch}")

    out = states.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{base}/cp")
    out.trigger(availableNow=True).start().awaitTermination()
    log = spark.read.schema("user_id long, final_place string, n_ok long, n_rejected long, available string, epoch long").parquet(f"{base}/out")
    last = log.groupBy("user_id").agg(F.max_by(F.struct("final_place", "n_ok", "n_rejected", "available"), "epoch").alias("s"))
    return last.select("user_id", "s.*")


@query
def workflow_stream(spark, sf):
    name = F.create_map(*[F.lit(x) for kv in EVENT_MOVES.items() for x in kv])
    return _workflow_stream(spark, sf, F.try_element_at(name, F.col("event_type"))).drop("available")


@query
def workflow_stream_all(spark, sf):
    """Every transition and the hard reset, with what the last place allows."""
    name = F.create_map(*[F.lit(x) for kv in EVENT_MOVES.items() for x in kv])
    more = F.expr("CASE WHEN event_type = 'view' AND event_id % 3 = 0 THEN 'refine' WHEN event_type = 'purchase' AND event_id % 2 = 0 THEN 'back' WHEN event_type = 'error' AND event_id % 4 = 0 THEN 'hard_reset' END")
    return _workflow_stream(spark, sf, F.coalesce(more, F.try_element_at(name, F.col("event_type"))))


@query
def vault_changes(spark, sf):
    """What a watch reports when labelled notes come, change and go: the first listing is silent."""
    watch = Watch(spark, f"{shared_dir(spark)}/watch-{uuid.uuid4().hex}")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    notes_now = vault_listing(spark, sf).join(table(spark, sf, "documents").select("doc_id", F.col("n_chars").alias("size_bytes")), "doc_id")
    watch.advance(notes_now.select("path", "size_bytes", start.alias("modified_at")))
    marked = notes_now.join(table(spark, sf, "labels"), "doc_id", "left")
    later = marked.filter("toxic IS NULL OR toxic = 0").select("path", (F.col("size_bytes") + F.coalesce("quality", F.lit(0))).alias("size_bytes"), start.alias("modified_at"))
    added = marked.filter("toxic = 1").select(F.concat(F.lit("moved/"), "path").alias("path"), "size_bytes", start.alias("modified_at"))
    watch.advance(later.union(added))
    return watch.changes().select("path", "kind", "step")
