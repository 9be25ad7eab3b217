"""Whole documents that are a full licence text."""

from pathlib import Path

import pytest

from posequarry.llm import licences
from posequarry.llm.licence_texts import FILES

INSTALLED = Path("/usr/share/common-licenses")


@pytest.mark.skipif(not INSTALLED.is_dir(), reason="no licence texts on this machine")
def test_full_texts(spark):
    texts = [(name, (INSTALLED / file).read_text()) for name, file in FILES]
    rows = [(2 * i, "\n  " + t.upper().replace("\n", "\n * ")) for i, (_, t) in enumerate(texts)]
    rows += [(2 * i + 1, t + " more") for i, (_, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    got = {r["doc_id"]: r["licence"] for r in licences.scan(docs, licences.known_licences(spark)).collect()}
    assert got == {2 * i + k: (None if k else name) for i, (name, _) in enumerate(texts) for k in (0, 1)}
