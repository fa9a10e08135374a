"""Readers, binary formats and streams."""

import gzip
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tsumugi.operators.lexicon import Lexicon
from tsumugi.operators.nested import flatten_entities
from tsumugi.operators.viterbi import tokenize
from tsumugi.plans.streams import drain
from tsumugi.sources import binary as bi
from tsumugi.sources.build import build
from tsumugi.sources import files as fi
from tsumugi.streaming.sentences import SentenceBuffer, cut, event_rates, stream_sentences

WORDS = [("東京", 1, 2, 3, 100, "名詞,a"), ("東京", 1, 2, 3, 50, "名詞,b"), ("東", 4, 5, 6, -7, "名詞,c"), ("a", 0, 0, 0, 1, "記号")]


def test_compiled_dictionary(spark, tmp_path):
    data = bi.encode_dictionary(WORDS)
    (tmp_path / "sys.dic").write_bytes(data)
    rows = bi.read_dictionary(spark, str(tmp_path / "sys.dic"), 0).collect()
    assert sorted((r.surface, r.left_id, r.right_id, r.pos_id, r.wcost, r.feature) for r in rows) == sorted(WORDS)
    for broken in (data[:-1], data[:20], struct.pack("<I", 1) + data[4:]):
        with pytest.raises(ValueError):
            bi.decode_dictionary(broken)
    with pytest.raises(ValueError):
        bi.decode_dictionary(data, kind=2)


def test_matrix_and_characters(spark, tmp_path):
    (tmp_path / "matrix.bin").write_bytes(struct.pack("<HH6h", 2, 3, *[0, 10, -5, 20, 0, 15]))
    cells = {(r.right_id, r.left_id): r.cost for r in bi.read_matrix(spark, str(tmp_path / "matrix.bin")).collect()}
    assert cells[1, 0] == 10 and cells[0, 1] == -5 and len(cells) == 6
    with pytest.raises(ValueError):
        bi.matrix_rows(struct.pack("<HHh", 2, 3, 0))
    table = np.zeros(bi.TABLE_SIZE, "<u4")
    table[ord("あ")] = 1 | 1 << 18 | 2 << 26 | 1 << 30 | 1 << 31
    (tmp_path / "char.bin").write_bytes(struct.pack("<I", 2) + b"DEFAULT".ljust(32, b"\0") + b"HIRAGANA".ljust(32, b"\0") + table.tobytes())
    r = bi.read_characters(spark, str(tmp_path / "char.bin")).where(F.col("codepoint") == ord("あ")).first()
    assert (r.category, r.length, r.group, r.invoke) == ("HIRAGANA", 2, True, True)


def test_a_dictionary_folder(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        Lexicon.load(spark, str(tmp_path))
    (tmp_path / "sys.dic").write_bytes(bi.encode_dictionary(WORDS))
    (tmp_path / "unk.dic").write_bytes(bi.encode_dictionary([("HIRAGANA", 1, 1, 9, 5, "名詞,未知"), ("HIRAGANA", 2, 2, 9, 9, "名詞,未知二"), ("KANJI", 1, 1, 9, 7, "名詞,漢")], 2))
    (tmp_path / "matrix.bin").write_bytes(struct.pack("<HH36h", 6, 6, *range(36)))
    table = np.zeros(bi.TABLE_SIZE, "<u4")
    for c in "あいー":
        table[ord(c)] = 1 << 18 | 1 << 30
    table[ord("漢")] = 2 << 18
    (tmp_path / "char.bin").write_bytes(struct.pack("<I", 3) + b"".join(n.ljust(32, b"\0") for n in (b"DEFAULT", b"HIRAGANA", b"KANJI")) + table.tobytes())
    lexicon = Lexicon.load(spark, str(tmp_path))
    assert lexicon.entities is None and lexicon.categories().grouping == {"HIRAGANA"} and lexicon.categories()("ー") == "HIRAGANA"
    df = spark.createDataFrame([(1, "東京あいー漢")], "text_id long, text string")
    tokens = [(r.surface, r.feature, r.is_unknown) for r in tokenize(df, lexicon).orderBy("token_ix").collect()]
    assert tokens == [("東京", "名詞,b", False), ("あいー", "名詞,未知", True), ("漢", "名詞,漢", True)]
    (tmp_path / "semantic.bin").write_bytes(bi.encode_pool([("http://www.wikidata.org/entity/Q1490", 1.0)]))
    assert Lexicon.load(spark, str(tmp_path)).entities.count() == 0
    (tmp_path / "surface_map.json").write_text('{"東京": [["http://www.wikidata.org/entity/Q1490", 1.5], ["x:y", 0.25]]}')
    entities = Lexicon.load(spark, str(tmp_path)).entities.orderBy("ord").collect()
    assert [(r.surface, r.uri, r.confidence) for r in entities] == [("東京", "http://www.wikidata.org/entity/Q1490", 1.0), ("東京", "x:y", 0.25)]


def test_vectors_of_other_types(spark, tmp_path):
    m = np.array([[1.5, -2.0], [0.25, 3.0]], np.float32)
    for kind in (0, 1):
        assert (bi.decode_vectors(bi.encode_vectors(m, kind)) == m).all()
    assert bi.decode_vectors(bi.encode_vectors(np.array([[-3, 7]]), 2)).tolist() == [[-3.0, 7.0]]
    (tmp_path / "h.bin").write_bytes(bi.encode_vectors(m, 1))
    assert bi.read_vectors(spark, str(tmp_path / "h.bin")).orderBy("word_id").first().embedding == [1.5, -2.0]
    with pytest.raises(ValueError):
        bi.decode_vectors(bi.encode_vectors(m)[:12] + struct.pack("<I", 3) + bi.encode_vectors(m)[16:])


def test_vectors_and_pool(spark, tmp_path):
    m = np.arange(6, dtype=np.float32).reshape(3, 2)
    (tmp_path / "v.bin").write_bytes(bi.encode_vectors(m))
    assert {r.word_id: r.embedding for r in bi.read_vectors(spark, str(tmp_path / "v.bin")).collect()}[2] == [4.0, 5.0]
    with pytest.raises(ValueError):
        bi.decode_vectors(bi.encode_vectors(m)[:-1])
    (tmp_path / "p.bin").write_bytes(bi.encode_pool([("http://www.wikidata.org/entity/Q1", 0.75), ("x:y", 1.0), ("http://dbpedia.org/resource/Q1", 0.1)]))
    rows = bi.read_pool(spark, str(tmp_path / "p.bin")).orderBy("pool_id").collect()
    assert [r.uri for r in rows] == ["http://www.wikidata.org/entity/Q1", "x:y", "http://dbpedia.org/resource/Q1"] and rows[0].confidence == 191 / 255


def test_text_files(spark, tmp_path):
    write = lambda name, text: (tmp_path / name).write_text(text) and str(tmp_path / name)
    assert fi.lines(spark, write("a.txt", "x\n\ny\n")).count() == 2
    assert fi.user_dictionary(spark, write("u.csv", "# c\n東,ア,ア,5\nbad\n")).first().surface == "東"
    lex = fi.source_lexicon(spark, write("l.csv", "東,1,2,-3,名詞,一般\nx,y,z\n")).collect()
    assert [(r.surface, r.left_id, r.right_id, r.wcost, r.feature) for r in lex] == [("東", 1, 2, -3, "名詞,一般")]
    path = write("q.csv", '",",5,6,7,記号,読点\n"a""b",1,1,1,x\n東,1,2,3\n"x,1,2,3,y\n,1,2,3,y\nz,1,2,99999,y\n')
    assert [(r.surface, r.word_id, r.feature) for r in fi.source_lexicon(spark, path).orderBy("word_id").collect()] == [(",", 0, "記号,読点"), ('a"b', 1, "x")]
    assert {r.line[:2]: r.reason for r in fi.source_lexicon_errors(spark, path).collect()} == {"東,": "columns", '"x': "quoting", ",1": "surface", "z,": "number"}
    last = fi.vocabulary(spark, write("last.tsv", "9\t名詞,一般,*,*,*,*,東京\n7\t名詞,一般,*,*,*,*,東京\n"))
    assert [r.word_id for r in fi.vectors_text(spark, write("w2.txt", "1 2\n東京 0.5 1\n"), last).collect()] == [7]
    assert [tuple(r) for r in fi.matrix_text(spark, write("m.def", "1 2\n0 0 5\n0 1 -6\n")).collect()] == [(0, 0, 5), (0, 1, -6)]
    assert [r.word_ids for r in fi.corpus(spark, write("c.txt", "1 x 2\n\nfoo\n3\n")).collect()] == [[1, 2], [3]]
    vocab = fi.vocabulary(spark, write("v.tsv", "# id\n7\t名詞,一般,*,*,*,*,東京\n9\t名詞,一般,*,*,*,*,*\n"))
    vectors = fi.vectors_text(spark, write("w.txt", "2 2\n東京 0.5 1\n京都 1 1\nbad 1\n"), vocab).collect()
    assert [(r.word_id, r.embedding) for r in vectors] == [(7, [0.5, 1.0])]
    m = fi.surface_map(spark, write("s.json", '{"東京": [["u", 0.5], ["v", 0.25]]}')).orderBy("ord").collect()
    assert [(r.surface, r.uri, r.confidence) for r in m] == [("東京", "u", 0.5), ("東京", "v", 0.25)]
    with gzip.open(tmp_path / "d.json.gz", "wt") as f:
        f.write('[\n{"id":"Q1","labels":{"ja":{"value":"東"}}},\n]\n')
    assert flatten_entities(fi.entity_dump(spark, str(tmp_path / "d.json.gz"))).first().leaf_value == "東"
    with pytest.raises(FileNotFoundError):
        fi.default_dictionary((str(tmp_path),))
    fi.write_vectors_text(spark.createDataFrame([(1, [0.5])], "word_id long, embedding array<float>"), str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["1 1", "1 0.500000"]


def test_writers(spark, tmp_path):
    v = spark.createDataFrame([(3, [1.0, 2.0]), (0, [0.5, 0.5]), (9, [9.0, 9.0])], "word_id long, embedding array<float>")
    bi.write_vectors(v, str(tmp_path / "v.bin"), 4, 2)
    back = {r.word_id: r.embedding for r in bi.read_vectors(spark, str(tmp_path / "v.bin")).collect()}
    assert back == {0: [0.5, 0.5], 1: [0.0, 0.0], 2: [0.0, 0.0], 3: [1.0, 2.0], 4: [0.0, 0.0]}
    bi.write_pool(spark.createDataFrame([(2, "b:y", 1.0), (1, "a:x", 0.0)], "pool_id long, uri string, confidence double"), str(tmp_path / "p.bin"))
    assert [r.uri for r in bi.read_pool(spark, str(tmp_path / "p.bin")).orderBy("pool_id").collect()] == ["a:x", "b:y"]
    fi.write_vocabulary(spark.createDataFrame([(2, "f,2"), (1, "f,1"), (None, "x")], "word_id long, feature string"), str(tmp_path / "vocab"))
    assert [(r.word_id, r.feature) for r in fi.vocabulary(spark, str(tmp_path / "vocab")).orderBy("word_id").collect()] == [(1, "f,1"), (2, "f,2")]
    fi.write_user_dictionary(spark.createDataFrame([("東", "ア", "ア", 5, "名詞")], "surface string, reading string, pronunciation string, cost int, pos string"), str(tmp_path / "u"))
    assert fi.user_dictionary(spark, str(tmp_path / "u")).first().cost == 5


def test_cut():
    assert cut("これは", "テスト。次", "。") == (["これはテスト。"], "次")
    assert cut("", " 。", "。") == ([" 。"], "") and cut("", "\n\n", "\n") == ([], "")
    assert cut("a", "", "。") == ([], "a")


def test_buffer():
    buffer = SentenceBuffer()
    assert buffer.push("これは") == [] and buffer.has_pending and buffer.pending_len == 9
    assert buffer.push("テストです。も") == ["これはテストです。"] and buffer.flush() == "も" and not buffer.has_pending
    buffer.push("残り")
    buffer.clear()
    assert buffer.flush() is None and SentenceBuffer("|").push("a|b|") == ["a|", "b|"]


def test_pieces_out_of_order(spark, tmp_path):
    schema = "stream_id long, read_no int, text string, read_at timestamp"
    triggers = [[(1, 2, "の文。終", 1), (2, 0, "あ", 1)], [(1, 0, "これは", 2), (1, None, "り", 2)], [(1, 1, "文。次", 3), (1, 0, "重複。", 3), (2, 2, "う。え", 3)], [(3, 0, "x", 9999)], [(3, 1, "y", 19999)]]
    for rows in triggers:
        df = spark.createDataFrame(rows, "stream_id long, read_no int, text string, s long").withColumn("read_at", F.timestamp_seconds("s")).drop("s")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    reads = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    done = drain(stream_sentences(reads), str(tmp_path)).where("stream_id < 3")
    assert sorted((r.stream_id, r.sentence, r.finished) for r in done.collect()) == [(1, "これは文。", True), (1, "次の文。", True), (1, "終り", False), (2, "あう。", True), (2, "え", False)]


def test_streams(spark, tmp_path):
    schema = "stream_id long, read_no int, text string, read_at timestamp"
    first = spark.createDataFrame([(1, 0, "これは", "2030-01-01 00:00:00"), (1, 1, "文。次", "2030-01-01 00:00:01"), (2, 0, "x", "2030-01-01 00:00:00")], "stream_id long, read_no int, text string, at string").withColumn("read_at", F.to_timestamp("at")).drop("at")
    first.coalesce(1).write.parquet(str(tmp_path / "in"))
    second = spark.createDataFrame([(1, 2, "の文。", "2030-01-01 00:00:02")], "stream_id long, read_no int, text string, at string").withColumn("read_at", F.to_timestamp("at")).drop("at")
    second.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    reads = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    done = drain(stream_sentences(reads), str(tmp_path))
    assert sorted(r.sentence for r in done.where("finished").collect()) == ["これは文。", "次の文。"]
    events = spark.createDataFrame([("2030-01-01 00:01:00", "a", 1.0), ("2030-01-01 00:02:00", "a", 2.0), ("2030-01-01 01:00:00", "a", 5.0)], "at string, event_type string, value double").withColumn("ts", F.to_timestamp("at")).drop("at")
    events.coalesce(1).write.parquet(str(tmp_path / "events"))
    rates = drain(event_rates(spark.readStream.schema("event_type string, value double, ts timestamp").parquet(str(tmp_path / "events"))), str(tmp_path))
    assert [(r.n, r.total) for r in rates.collect()] == [(2, 3.0)]


def test_build_job(spark, tmp_path):
    (tmp_path / "out").mkdir()
    (tmp_path / "source.csv").write_text('東京,1,1,5,名詞,"a,b"\n京都,1,1,5,名詞\n"bad,1\n')
    (tmp_path / "dump.json").write_text('[\n{"id":"Q1490","labels":{"ja":{"value":"東京"}},"aliases":{"ja":[{"value":"東京都"}]},"sitelinks":{"a":{"title":"x"}}},\n{"id":"Q7","labels":{"ja":{"value":"東京"}}}\n]\n')
    counts = build(spark, str(tmp_path / "source.csv"), str(tmp_path / "dump.json"), str(tmp_path / "out"))
    assert counts == {"n_entries": 3, "n_with_entities": 1, "n_candidates": 2}
    lines = [r.value for r in spark.read.text(str(tmp_path / "out/extended.csv")).collect()]
    base = "http://www.wikidata.org/entity/"
    assert sorted(lines)[-1] == f'東京,1,1,5,名詞,"a,b",2,"{base}Q1490|{base}Q7"' and "京都,1,1,5,名詞,0,0" in lines
    entities = fi.surface_map(spark, str(tmp_path / "out/surface_map.json")).collect()
    assert {(r.surface, r.uri) for r in entities} == {("東京", base + "Q1490"), ("東京", base + "Q7"), ("東京都", base + "Q1490")}
    assert {r.uri for r in bi.read_pool(spark, str(tmp_path / "out/semantic.bin")).collect()} == {base + "Q1490", base + "Q7"}
