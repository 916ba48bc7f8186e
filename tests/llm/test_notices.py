"""Labels of near notices, and host verdicts on hosts below one half."""

import pytest

from marginalia.llm import licenses
from marginalia.llm.hostquality import judge

NOTICES = {
    "Licensed under CC BY 4.0": "cc-by",
    "Licensed under CC BY-NC 4.0": "cc-by-nc",
    "Licensed under CC BY-SA 4.0": "cc-by-sa",
    "Licensed under the GNU General Public License version 2": "gpl-2",
    "licensed under the GNU General Public License, version 3": "gpl-3",
    "Licensed under the GNU Lesser General Public License version 3": "lgpl-3",
    "Licensed under the GNU Affero General Public License version 3": "agpl-3",
    "Licensed under the Apache License, Version 2.0": "apache-2",
    "It is licensed under a Creative Commons Attribution 4.0 International License": "cc-by",
    "licensed under a Creative Commons Attribution NonCommercial 4.0 International License": "cc-by-nc",
    "licensed under a Creative Commons Attribution ShareAlike 4.0 International License": "cc-by-sa",
    "Released under the MIT License": "mit",
}


def test_near_notices_are_told_apart(spark):
    filler = " ".join(f"word{chr(97 + i % 26)}" for i in range(80))
    texts = list(NOTICES) + [f"{a}. {filler} {b}." for a in NOTICES for b in NOTICES if a < b]
    want = list(NOTICES.values()) + [",".join(sorted({NOTICES[a], NOTICES[b]})) for a in NOTICES for b in NOTICES if a < b]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["doc_id"]: r["labels"] for r in licenses.digest(docs).collect()}
    assert {i: (texts[i][:60], got[i], w) for i, w in enumerate(want) if got[i] != w} == {}


@pytest.mark.parametrize("kind", ["symbols", "lines"])
def test_hosts_below_one_half_differ(spark, kind):
    """The same borderline text stays on a host that rarely fails and goes on one that fails more often."""
    clean = " ".join(f"word{i}" for i in range(80))
    junk = clean + " " + "### " * 60
    border = " ".join(f"word{i}" + ("#" if i % 10 < 7 else "") for i in range(100)) if kind == "symbols" else "\n".join([f"a{i} b{i} c{i}" for i in range(24)] + ["one two three"] * 12)
    rows = [("good", clean)] * 200 + [("good", border)] + [("bad", clean)] * 60 + [("bad", junk)] * 40 + [("bad", border)]
    docs = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(rows)], "doc_id int, source string, text string")
    got = {r["doc_id"]: r for r in judge(docs).collect()}
    assert got[200]["kept"] and not got[301]["kept"] and not got[301]["base_failed"]
    assert got[301]["host_rate"] < 0.5 and all(got[i]["kept"] for i in range(200)) and not any(got[i]["kept"] for i in range(261, 301))
