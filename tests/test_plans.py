"""Plans of the registered queries: nothing that grows quadratically or reads too much."""

import re

import pytest

import __spark_entry__ as entry
from marginalia.plans.catalog import QUERIES
from marginalia.plans.oracle import ORACLE

SF = "/root/testdata/sf0.001"
STREAMING = {"debounce_stream", "workflow_stream", "workflow_history", "vault_files", "index_incremental", "index_reindexed"}


def plan(df) -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMING))
def test_no_cross_joins(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text, "row-at-a-time Python"


def test_every_query_but_few_has_sql():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) - set(ORACLE) == {"semantic_search"}


@pytest.mark.parametrize("name", ["list_notes", "overview_folders", "overview_total", "note_delete", "create_conflicts"])
def test_listing_does_not_read_texts(spark, name):
    schemas = re.findall(r"ReadSchema: (\S+)", plan(entry.queries()[name](spark, SF)))
    assert schemas and not any("text" in s for s in schemas)


def test_vector_scan_is_narrow_and_top_k_is_partial(spark):
    text = plan(entry.queries()["vector_topk"](spark, SF))
    assert "TakeOrderedAndProject" in text and "ArrowEvalPython" in text
    ranked = plan(entry.queries()["vector_topk_per_label"](spark, SF))
    assert "WindowGroupLimit" in ranked


def test_notes_without_the_terms_are_not_parsed(spark):
    text = plan(entry.queries()["vault_search"](spark, SF))
    lines = text.splitlines()
    filters = next(i for i, x in enumerate(lines) if re.search(r"\) Filter$|Filter \(", x))
    assert filters >= 0 and "Contains(lower(content" in text.replace("contains(lower(content", "Contains(lower(content")


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["path", "chunk_idx", "score", "word_count", "text_md5"] and df.count() == 20


def test_links_are_found_once(spark):
    # Resolving reads the links several times; none of these reads searches the notes again.
    assert "regexp_extract_all" not in plan(entry.queries()["wikilink_resolve"](spark, SF))
