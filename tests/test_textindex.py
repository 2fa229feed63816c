"""Full-text indexes as tables: how they are built, and that they find what scans find."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from weftgraph.operators import textindex
from weftgraph.operators.search import Searcher
from weftgraph.operators.textindex import IndexSearcher, TextIndex

TEXTS = [
    ("a", "of the sea of the sky", "of"), ("b", None, "the END"), ("c", "", None), ("d", "Erin, erin! ERINN 42 été", "  "),
    ("e", "the of the", "e"), ("f", "shorth short s1or2th", "of the"), ("g", "--- ... ---", "erin"),
]


def test_no_token_is_exchanged(spark, monkeypatch):
    """Postings are made where texts are read: an exchange would write each token again, often spilled."""
    plans = []

    def settle(df, *rest):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, *rest)

    real = textindex.settle
    monkeypatch.setattr(textindex, "settle", settle)
    index = TextIndex(spark.createDataFrame(TEXTS, "vid string, t string, u string"), ["t", "u"])
    assert len(plans) == 1 and "Exchange" not in plans[0]
    assert index.n == 7 and index.mean == {"t": pytest.approx(17 / 7), "u": pytest.approx(1.0)}


@pytest.mark.parametrize("size", [1, 6, 1 << 20])
def test_index_and_scans_agree(spark, monkeypatch, size):
    """On null, empty and wordless texts, over one block or many, with patterns that an empty term would fit."""
    monkeypatch.setattr(textindex, "BLOCK_TOKENS", size)
    df = spark.createDataFrame(TEXTS, "vid string, t string, u string").coalesce(1)
    index = TextIndex(df, ["t", "u"])
    for text in ("the", "of AND the", '"of the"', "NOT erin", "*", "e~1", "sh*", "s?or*th", "u:erin", "t:erin OR u:e", "absent"):
        found = [rows(s.run().select("vid", F.round("__score", 9), "__fields")) for s in (Searcher(df, ["t", "u"], text), IndexSearcher(df, index, text))]
        assert found[0] == found[1], text
