"""Text functions, phonetics and features on literals with known results."""

from pyspark.sql import functions as F

from tsumugi.functions import features as fe
from tsumugi.functions import phonetic as ph
from tsumugi.functions import text as tx


def values(spark, expression, *inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r.y for r in df.select("i", expression("x").alias("y")).orderBy("i").collect()]


def test_normalizer(spark):
    assert values(spark, tx.Normalizer(), "　ＡＢＣＤ　１２３　", "ｱｲｳ​x", None, "") == ["ABCD 123", "アイウx", None, ""]
    assert values(spark, tx.Normalizer.minimal(), "　ＡＢ ") == ["　ＡＢ "]
    assert values(spark, tx.Normalizer().with_lowercase(), "ＡbC") == ["abc"]
    assert values(spark, tx.normalize_quotes, "『a』(b)〔c〕") == ["「a」（b）【c】"]
    assert values(spark, tx.normalize_punctuation, "a｡b．c､d!?:;") == ["a。b。c、d！？：；"]


def test_scripts(spark):
    assert values(spark, tx.is_hiragana_only, "ひらがな", "カナ", "", "ひ ら") == [True, False, True, True]
    assert values(spark, tx.is_katakana_only, "カタカナｱ", "漢") == [True, False]
    assert values(spark, tx.contains_kanji, "東京", "とう") == [True, False]
    df = spark.createDataFrame([("あア漢a1。 é",), ("",)], "x string")
    rows = df.select(*[c.alias(n) for n, c in tx.char_type_counts("x").items()]).collect()
    assert [rows[0][n] for n in ("hiragana", "katakana", "kanji", "ascii_letter", "digit", "punctuation", "whitespace", "other", "total")] == [1] * 8 + [8]
    assert rows[0]["japanese_ratio"] == 3 / 8 and rows[1]["japanese_ratio"] == 0.0


def test_phonetics(spark):
    assert values(spark, ph.to_romaji, "とうきょう", "にほん", "しんぶん", "がっこう", "きって", "っ", "ラー", "っっか") == ["toukyou", "nihon", "shinbun", "gakkou", "kitte", "tsu", "raー", "tsukka"]
    assert values(spark, ph.to_ipa, "あいうえお", "かきくけこ", "きゃ", "しゃ", "ちゃ", "がっこう", "っあ", "ぴっゅ") == ["aiɯeo", "kakikɯkeko", "kʲa", "ɕa", "tɕa", "ɡakkoɯ", "a", "piゅ"]
    assert values(spark, ph.to_xsampa, "きっと", "ふー") == ["ki:to", "p\\M:"]
    assert values(spark, ph.to_hiragana, "トウキョウヴ") == ["とうきょうゔ"] and values(spark, ph.to_katakana, "とう") == ["トウ"]
    feature = "助詞,係助詞,*,*,*,*,は,{},{}"
    assert values(spark, ph.token_ipa, feature.format("ハ", "ワ"), feature.format("ハ", "*"), feature.format("モ", "*"), "助詞", None) == ["wa", "wa", "mo", None, None]


def brute_romaji(text):
    text = "".join(chr(ord(c) - 0x60) if "ァ" <= c <= "ヶ" else c for c in text)
    out, i = "", 0
    while i < len(text):
        if text[i] == "っ":
            out += ph.ROMAJI[text[i + 1]][0] if text[i + 1 : i + 2] in ph.ROMAJI and i + 1 < len(text) else "tsu"
            i += 1
        elif text[i : i + 2] in ph.ROMAJI and len(text[i : i + 2]) == 2:
            out += ph.ROMAJI[text[i : i + 2]]
            i += 2
        else:
            out += ph.ROMAJI.get(text[i], text[i])
            i += 1
    return out


def test_romaji_against_a_loop(spark):
    import random

    rng = random.Random(5)
    words = ["".join(rng.choice("あかきっゃょんーシツッャxち") for _ in range(rng.randrange(1, 9))) for _ in range(300)]
    assert values(spark, ph.to_romaji, *words) == [brute_romaji(w) for w in words]


def test_features(spark):
    f = "動詞,自立,*,*,五段・カ行イ音便,連用タ接続,書く,カイ,カイ"
    assert values(spark, fe.full_pos, f, "名詞") == ["動詞-自立", "名詞"]
    assert values(spark, fe.pos_class, f, "助詞,x", "補助記号", "未知語") == ["verb", "particle", "symbol", "other"]
    parsed = values(spark, fe.parse_feature, f, "名詞,一般")
    assert parsed[0]["base"] == "書く" and parsed[1]["pos2"] == "一般" and parsed[1]["base"] is None
    wd = "http://www.wikidata.org/entity/Q1490"
    assert values(spark, fe.compact_uri, wd, "http://dbpedia.org/resource/Tokyo", "x") == ["wd:Q1490", "dbr:Tokyo", "x"]
    assert values(spark, fe.expand_uri, "wd:Q1490", "https://a", "zz:1") == [wd, "https://a", None]
    assert values(spark, fe.expand_any, "rdfs:label", "zz:1") == ["http://www.w3.org/2000/01/rdf-schema#label", "zz:1"]
    assert values(spark, fe.detect_source, wd, "http://schema.org/x", "y") == ["Wikidata", "SchemaOrg", "Custom"]
    assert values(spark, fe.schema_org_type, "Work", "nothing") == ["http://schema.org/CreativeWork", "http://schema.org/Thing"]
    assert values(spark, fe.escape_json, 'a"b\\c\n\x01') == ['a\\"b\\\\c\\n\\u0001']
    assert values(spark, fe.is_wikidata_dump, "a/wikidata_1.json.gz", "wikidata.xml") == [True, False]
    assert values(spark, lambda x: tx.byte_offset(x, F.lit(1)), "東京") == [3]
