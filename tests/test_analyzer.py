"""The analyzer over all formats."""

import json

import pytest

from tsumugi.analyzer import FORMATS, Analyzer, version
from tsumugi.operators.lexicon import ENTRY, Lexicon


def test_analyzer(spark):
    feature = "名詞,一般,*,*,*,*,{0},{1},{1}"
    entries = [("東京", 7, 0, 0, 1, 10, feature.format("東京", "トウキョウ"), 1), ("都", 8, 0, 0, 1, 20, feature.format("都", "ト"), 1), ("は", 9, 0, 0, 2, 5, "助詞,係助詞,*,*,*,*,は,ハ,ワ", 1)]
    cells = spark.createDataFrame([(0, 0, 0), (1285, 0, 0), (0, 1285, 0)], "right_id int, left_id int, cost int")
    a = Analyzer(Lexicon.of(spark.createDataFrame(entries, ENTRY), cells))
    texts = spark.createDataFrame([(1, "東京都は"), (2, "X"), (3, None)], "text_id long, text string")
    assert {r.text_id: r.wakati for r in a.wakati(texts).collect()} == {1: "東京 都 は", 2: "X"}
    assert a.add_word("東京都", "トウキョウト", "トーキョート", -99).wakati(texts).where("text_id = 1").first().wakati == "東京都 は"
    assert a.add_word("東京都", "x", "x", -99).remove_word("東京都").overlay_size() == 0
    assert {r.text_id: r.ipa for r in a.to_ipa(texts, "|").collect()} == {1: "toɯkʲoɯ|to|wa"}
    assert a.to_dicts(texts).where("text_id = 1 and token_ix = 0").first().token.reading == "トウキョウ"
    rich = a.with_ipa().with_entities(spark.createDataFrame([("東京", "http://www.wikidata.org/entity/Q1490", 0.9), ("東京", "x:y", 0.5)], "surface string, uri string, confidence float"))
    rich = rich.with_vectors(spark.createDataFrame([(7, [1.0, 0.0]), (8, [1.0, 1.0])], "word_id long, embedding array<float>"))
    for f in FORMATS:
        assert rich.parse(texts, f).count() >= 2
    doc = json.loads(rich.parse(texts, "jsonld").where("text_id = 1").first().jsonld)
    assert [e["@id"] for e in doc["tokens"][0]["entities"]] == ["wd:Q1490", "x:y"] and doc["tokens"][2]["pronunciation"] == "/wa/"
    s = rich.similarity(spark.createDataFrame([(1, "東京", "都は"), (2, "X", "都")], "text_id long, word_a string, word_b string"))
    assert {r.text_id: r.similarity and round(r.similarity, 3) for r in s.collect()} == {1: 0.707, 2: None}
    assert rich.n_best(texts, 2).count() == 2 and version()
    with pytest.raises(ValueError):
        a.parse(texts, "nothing")
    with pytest.raises(ValueError):
        a.similarity(texts)
