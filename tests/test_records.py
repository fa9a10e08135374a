"""Rejected lines, packed values and nested entities."""

import csv
import io
import json
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tsumugi.operators import delimited as de
from tsumugi.operators import nested as ne
from tsumugi.operators import packed_values as pv


def test_tokenizer_agrees_with_a_loop_over_characters():
    def slow(line):
        state, fields, now, i = de.START, [], "", 0
        for i, c in enumerate(line):
            kind = de.DELIMITER if c == "," else de.QUOTE if c == '"' else de.OTHER
            new = int(de.NEXT[kind, state])
            if new == de.BROKEN:
                return None, i
            if kind == de.DELIMITER and new == de.START:
                fields.append(now)
                now = ""
            else:
                now += c
            state = new
        return (fields + [now], -1) if state != de.QUOTED else (None, len(line))

    rng = random.Random(3)
    lines = ["".join(rng.choice(',"a\n。') for _ in range(rng.randrange(12))) for _ in range(400)] + ["x" * 5000 + '"', '"' + "y," * 3000 + '"']
    fields, broken = de.tokenize(lines)
    for line, f, b in zip(lines, fields, broken):
        want, at = slow(line)
        assert b == at
        if at < 0:
            assert f == [w[1:-1].replace('""', '"') if w[:1] == '"' else w for w in want]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(blacklist_characters="\r\x00", blacklist_categories=("Cs",)), max_size=8), min_size=1, max_size=6))
def test_written_rows_read_back(row):
    out = io.StringIO()
    csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator="").writerow(row)
    fields, broken = de.tokenize([out.getvalue()])
    assert fields == [row] and broken == [-1]


def test_states_do_not_depend_on_how_a_text_is_cut():
    rng = np.random.default_rng(1)
    classes = rng.integers(0, 3, 5000).astype(np.uint8)
    whole, _ = de.compose(classes, chunk=256)
    state, parts = de.START, []
    for i in range(0, 5000, 777):
        s, state = de.compose(classes[i : i + 777], state, chunk=32)
        parts.append(s)
    assert (np.concatenate(parts) == whole).all()


def test_rejected_and_loaded_lines(spark):
    pos = "名詞,一般,*,*,*,*"
    lines = [
        (1, "user", "東京,トウキョウ,トーキョー,100"), (2, "user", f"東京,a,b,-5,{pos}"), (3, "user", "incomplete,data"), (4, "user", "x,a,b,4.5"), (5, "user", "x,a,b,32768"), (6, "user", 'x"y,a,b,1'),
        (7, "user", '"x"y,a,b,1'), (8, "user", '"x,a,b,1'), (9, "user", "　,a,b,1"), (10, "user", ",a,b,1"), (11, "user", "x,a,b,1,名詞,,*,*,*,*"), (12, "user", "x,a,b,1,犬,一般,*,*,*,*"),
        (13, "user", "# note"), (14, "user", "  "), (15, "user", None), (16, "source", ""), (17, "source", f"x,1,2,3,{pos},x,y,z"), (18, "source", f"x,1,2,４,{pos},x,y,z"), (19, "user", '"a\nb",a,b,+7'), (19, "user", '"a\nb",a,b,+7'),
        (20, None, "x,a,b,1"), (21, "user", "x,a,b,"),
    ]
    df = spark.createDataFrame([(*x, "clash") for x in lines], "row_id long, kind string, line string, reason string")
    rows = {r.row_id: r for r in de.parse_dictionary_lines(df).collect()}
    reasons = {i: r.reason for i, r in rows.items()}
    want = {1: None, 2: None, 3: "columns", 4: "cost", 5: "cost", 6: "quoting", 7: "quoting", 8: "quoting", 9: "surface", 10: "surface", 11: "pos", 12: "pos", 16: "columns", 17: None, 18: "cost", 19: None, 20: None, 21: "cost"}
    assert reasons == want
    assert rows[6].error_at == 1 and rows[8].error_at == 8
    assert rows[19].surface == "a\nb" and rows[19].cost == 7 and rows[17].left_id == 1 and rows[17].base == "x" and rows[2].pos == pos.split(",")
    assert de.parse_dictionary_lines(df.limit(0)).count() == 0


def test_records_of_files(spark, tmp_path):
    rows = [["a", "b\nc", "d", "1"], ['q"u,x', "", "", "2"], ["x" * 700 + "\n" + "y" * 300, "b", "c", "3"], ["plain", "r", "p", "4"]]
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows(rows)
    text = out.getvalue() + 'bad"quote,b,c,5\nafter,b,c,6\r\n"open,b\nrest'
    found = de.records(text)
    fields, broken = de.tokenize([x for _, x in found])
    assert fields[:4] == rows and [b >= 0 for b in broken] == [False] * 4 + [True, False, True]
    assert all(text.startswith(x, a) for a, x in found) and de.records("") == [] and [x for _, x in de.records("a\n\nb\n")] == ["a", "", "b"]
    (tmp_path / "user.csv").write_text(text)
    parsed = {r.line[:5]: r.reason for r in de.parse_dictionary_lines(de.read_records(spark, str(tmp_path / "user.csv"), "user")).join(de.read_records(spark, str(tmp_path / "user.csv"), "user").select("row_id", "line"), "row_id").collect()}
    assert parsed['a,"b\n'] is None and parsed["bad\"q"] == "quoting" and parsed["after"] is None and parsed['"open'] == "quoting"


CASES = {
    "名詞,一般,*,*,*,*,東京,トウキョウ,トーキョー": ["名詞", "一般", "*", "*", "*", "*", "東京", "トウキョウ", "トーキョー"],
    "名詞、一般、*、*、*、*、東京、トウキョウ、トーキョー、": ["名詞", "一般", "*", "*", "*", "*", "東京", "トウキョウ", "トーキョー", ""],
    "名詞\t一般\t*|*|*|*|京都|キョウト|キョート": ["名詞", "一般", "*", "*", "*", "*", "京都", "キョウト", "キョート"],
    " 名詞 ; 一般 ;*;*;*;*;\"京,都\";'キョウト';\"a\"\"b\"": ["名詞", "一般", "*", "*", "*", "*", "京,都", "キョウト", 'a"b'],
    "名詞,一般,*,*,*,*,Rika's,東・京/都,x": ["名詞", "一般", "*", "*", "*", "*", "Rika's", "東・京/都", "x"],
}


def test_dialects(spark):
    base = [f"名詞,一般,*,*,*,*,語{i},ゴ{i},ゴ{i}" for i in range(40)]
    df = spark.createDataFrame([(i, f, "x") for i, f in enumerate([*base, *CASES, None, "", "  ", next(iter(CASES))])], "rec_id long, feature string, pos_no string")
    codes = pv.learn_codes(df)
    for feature, want in CASES.items():
        assert codes.best(feature) == want
    rows = pv.split_packed(df, codes, ["rec_id"]).collect()
    got = {}
    for r in rows:
        got.setdefault(r.rec_id, {})[r.pos_no] = r.item_value
    for i, (feature, want) in enumerate(CASES.items(), len(base)):
        assert got[i] == {p: v for p, v in enumerate(want) if v and v != "*"}
    assert not {len(base) + len(CASES) + k for k in range(3)} & set(got)
    assert pv.split_packed(df.limit(0), pv.learn_codes(df.limit(0)), ["rec_id"]).count() == 0


def test_choices_by_joined_counts_agree_with_counts_in_memory(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("あいうえおab") for _ in range(rng.randrange(1, 4)))
    fields = [d.join(word() for _ in range(rng.randrange(1, 6))) for d in rng.choices(",;|、", k=300)]
    fields += [f"{word()},{word()};{word()}|'{word()}" for _ in range(40)] + [f'{word()};"{word()},{word()}";{word()}、{word()}' for _ in range(40)]
    fields += fields[:50]
    df = spark.createDataFrame([(i, f) for i, f in enumerate(fields)], "rec_id long, feature string")
    book = pv.learn_codes(df)
    counts = Counter()
    for f in fields:
        counts.update(pv.shares(f))
        for option in pv.candidates(f):
            for v in pv.split(f, *option):
                counts.update({("c", x): pv.SHARE // len(pv.candidates(f)) * v.count(x) for x in set(v)})
    assert {(r.kind, r.key): r.weight for r in book.counts.collect()} == counts
    got = {}
    for r in pv.split_packed(df, book, ["rec_id"]).collect():
        got.setdefault(r.rec_id, {})[r.pos_no] = r.item_value
    of = Counter(fields)
    totals = Counter()
    for (k, _), w in counts.items():
        totals[k] += w
    rare = sum(w for (k, _), w in counts.items() if k == "v" and w <= 2 * pv.SHARE)
    for i, f in enumerate(fields):
        own = pv.shares(f)
        others = [(k, s, w - of[f] * own[k, s]) for (k, s), w in counts.items()]
        codes = pv.Codes([x for x in others if x[2] > 0], totals, rare)
        assert got.get(i, {}) == {p: v for p, v in enumerate(codes.best(f)) if v and v != "*"}, f


def test_fields_with_one_delimiter_are_split_alike(spark):
    fields = [" a , b\x1c,　c　,,* ", ",", "a\t b\t\tc ", "　", "x", "、a、", "a · b/c", "\x85a\x85;b\u2003"]
    df = spark.createDataFrame([(i, f) for i, f in enumerate(fields)], "rec_id long, feature string")
    got = {(r.rec_id, r.pos_no): r.item_value for r in pv.split_packed(df, pv.learn_codes(df), ["rec_id"]).collect()}
    assert got == {(i, p): v for i, f in enumerate(fields) for p, v in enumerate(pv.split(f, *pv.candidates(f)[0])) if v and v != "*"}


@pytest.mark.parametrize("delimiters", [",;|\t", pv.DELIMITERS])
def test_fields_may_mix_any_number_of_delimiters(delimiters):
    values = [chr(97 + i) for i in range(len(delimiters) + 1)]
    counts = [("v", v, 100 * pv.SHARE) for v in values] + [("c", v, 100 * pv.SHARE) for v in values] + [("n", str(len(values)), 100 * pv.SHARE)]
    feature = "".join(v + d for v, d in zip(values, delimiters)) + values[-1]
    assert pv.Codes(counts).best(feature) == values
    assert len(pv.candidates(feature)) == 2 ** len(delimiters) - 1


def brute(line):
    try:
        entity = json.loads(line.strip().lstrip("[").rstrip("],").strip().rstrip(",").strip())
    except (ValueError, AttributeError):
        return []
    if not isinstance(entity, dict):
        return []
    rows = []
    text = lambda x: x if x is None or isinstance(x, str) else json.dumps(x, separators=(",", ":"))
    leaf = lambda x, m: text(x.get(m)) if isinstance(x, dict) else None if isinstance(x, list) else text(x)
    many = lambda x: x if isinstance(x, list) else [] if x is None else [x]
    for k, v in (entity.get("labels") or {}).items() if isinstance(entity.get("labels"), dict) else ():
        rows.append(("label", k, 0, leaf(v, "value")))
    for k, v in (entity.get("aliases") or {}).items() if isinstance(entity.get("aliases"), dict) else ():
        rows += [("alias", k, i, leaf(x, "value")) for i, x in enumerate(many(v))]
    for k, v in (entity.get("sitelinks") or {}).items() if isinstance(entity.get("sitelinks"), dict) else ():
        rows.append(("sitelink", k, 0, leaf(v, "title")))
        rows += [("badge", k, i, leaf(x, "value")) for i, x in enumerate(many(v.get("badges")))] if isinstance(v, dict) else []
    return [r for r in rows if r[3] is not None]


def test_entities_against_a_plain_parser(spark):
    lines = [
        '{"id":"Q1","labels":{"ja":{"language":"ja","value":"東京"},"en":"Tokyo","de":null},"aliases":{"ja":[{"value":"a"},{"value":null},"b",{}],"en":{"value":"one"},"fr":"bare","es":null,"ko":[]}},',
        '[{"id":"Q2","sitelinks":{"jawiki":{"title":"東","badges":["Q5",null,"Q6"]},"enwiki":"plain","dewiki":{"title":null,"badges":"Q7"},"frwiki":{"badges":null}}}',
        '{"labels":{"ja":{"value":"a"},"en":{"value":{"x":1}},"de":7,"fr":{"value":3}},"sitelinks":{"a":{"title":"t","badges":[{"value":"Q1"},["Q2"],"Q3",null,4]},"b":{"badges":["{x","[y"]},"c":null,"d":{}}}',
        '{"labels":{"ja":{"value":"b"},"en":null},"aliases":{"ja":[{"value":"c"},null,{"x":1}],"en":null},"sitelinks":{"w":{"title":"t","badges":["Q1",null,"Q2"]},"x":{"title":null,"badges":null},"y":{}}}',
        "[", "]", "", None, '{"id":"Q3","labels":{"ja":', '"Q4"', "[]", '{"labels":[],"aliases":null,"sitelinks":{}}', ' {"labels":{"ja":{"value":""}}} ]',
    ]
    df = spark.createDataFrame([(i, x, "k") for i, x in enumerate(lines)] + [(0, lines[0], "k")], "line_id long, line string, kind string")
    got = sorted((r.line_id, r.kind, r.map_key, r.ord_no, r.leaf_value) for r in ne.flatten_entities(df).collect())
    assert got == sorted((i, *r) for i, x in enumerate(lines) for r in brute(x))
    assert ne.flatten_entities(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, '{"labels":{"ja":{"value":"a","value":"b"},"ja":{"value":"c"}},"aliases":{"ja":["x"]}}')], "line_id long, line string")
    assert sorted((r.kind, r.leaf_value) for r in ne.flatten_entities(twice).collect()) == [("alias", "x"), ("label", "c")]


@pytest.mark.parametrize("size", [1, 255, 256, 257])
def test_chunk_edges(size):
    fields, broken = de.tokenize(['"' + "a" * size + '",b'])
    assert fields == [["a" * size, "b"]] and broken == [-1]
