"""Single cases that once went wrong."""

import unicodedata

import pytest

from panelspan.llm import decontaminate, langid, vector_links


def test_every_letter_is_known():
    assert max(i for i in range(0x110000) if chr(i).isalpha()) < langid._LIMIT < 1 << 18


def test_text_of_rare_letters_has_a_language(spark):
    rows = [(1, "the house and the garden", "en"), (2, chr(0x32100) * 5, None), (3, "12 !", None)]
    got = {r.doc_id: r.lang_pred for r in langid.predict(spark.createDataFrame(rows * 1, "doc_id long, text string, lang string")).collect()}
    assert got[3] == "und" and (got[2] == "en" or unicodedata.category(chr(0x32100)) == "Cn")


def test_direction_counts_at_any_length(spark):
    rows = [(1, [1e-200, 2e-200]), (2, [1.0, 2.0]), (3, [1e200, 2e200]), (4, [2.0, -1.0]), (5, [5e-324, 5e-324])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_links.links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got[1] == got[2] == got[3] and got[1][1] == 1 and got[4] == (0, 4) and got[5][1] == 1


@pytest.mark.parametrize("block", [200_000, 2])
def test_columns_may_be_named_like_the_operators_own(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate.window_blocks, "__defaults__", (decontaminate.WORDS, block))
    words = " ".join(f"w{i}" for i in range(14))
    docs = spark.createDataFrame([(1, f"before {words} after", 5, "x", 1), (2, None, 6, "y", 2)], "doc_id long, text string, _hits int, _items string, __hits int")
    out = decontaminate.removed(docs, spark.createDataFrame([(1, words)], "item_id long, text string"))
    assert out.columns == docs.columns
    got = {r.doc_id: r for r in out.collect()}
    assert "w5" not in got[1].text and got[1].text.startswith("before") and got[1]["_hits"] == 5 and got[2].text is None
