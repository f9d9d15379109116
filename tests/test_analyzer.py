from __future__ import annotations

import pytest

from pagewright.functions.analyzer import english_terms, postings, stem
from pagewright.operators.retrieval import indexed_keyword_lane, inverted_index, keyword_lane


@pytest.mark.parametrize(
    ("word", "root"),
    [
        ("caresses", "caress"), ("ponies", "poni"), ("ties", "ti"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("bled", "bled"), ("motoring", "motor"), ("sing", "sing"),
        ("conflated", "conflat"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("conditional", "condit"), ("digitizer", "digit"),
        ("operator", "oper"), ("triplicate", "triplic"), ("electrical", "electr"), ("hopefulness", "hope"), ("adjustment", "adjust"), ("adoption", "adopt"), ("probate", "probat"), ("controll", "control"), ("roll", "roll"),
        ("generalizations", "gener"), ("oscillators", "oscil"), ("is", "is"), ("x1", "x1"),
    ],
)
def test_stem(word, root):
    assert stem(word) == root


def test_english_lane(spark):
    c = spark.createDataFrame([("a", "The magnets were attracting iron"), ("b", "an iron door")], "id string, search_text string")
    assert [r["id"] for r in keyword_lane(c, "what attracts a magnet", 5, english_terms).collect()] == ["a"]
    assert keyword_lane(c, "the of and", 5, english_terms).collect() == []
    postings_, lengths = inverted_index(c, english_terms)
    assert [(r["id"], round(r["score"], 9)) for r in indexed_keyword_lane(postings_, lengths, "what attracts a magnet", 5, english_terms).collect()] == [(r["id"], round(r["score"], 9)) for r in keyword_lane(c, "what attracts a magnet", 5, english_terms).collect()]
    assert indexed_keyword_lane(postings_, lengths, "of the", 5, english_terms).collect() == [] == indexed_keyword_lane(postings_, lengths, "absent iron", 5, english_terms).collect()
    assert {(r["term"], r["id"]): r["tf"] for r in postings(c).collect()}["iron", "b"] == 1


def test_stems_of_slices(monkeypatch):
    """A batch gives the same stems however it is sliced."""
    import pyarrow as pa

    from pagewright.functions import analyzer

    batch = pa.array([["things", "the"], None, [], ["the"], ["running", "thing"]], pa.list_(pa.string()))
    whole = analyzer._analyze(batch).to_pylist()
    monkeypatch.setattr(analyzer, "ROWS", 2)
    assert analyzer._analyze(batch).to_pylist() == whole == [["thing"], [], [], [], ["run", "thing"]]
    assert analyzer._analyze(batch.slice(0, 0)).to_pylist() == []
