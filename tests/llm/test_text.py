"""Sentences, look-alikes, leaks, languages and packing."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tsumugi.llm import languages as la
from tsumugi.llm import leaks as le
from tsumugi.llm import lookalikes as lo
from tsumugi.llm import packing as pk
from tsumugi.llm import sentences as se
from tsumugi.llm.boundary_seed import JOINED, SPACED


@pytest.fixture(scope="module")
def model():
    return se.fit(se.seed_examples())


def cut(text, model):
    return [text[a:b] for a, b in se.split(text, model)]


HELD_OUT = {
    "en": ["Dr. Evans saw Mrs. Cole at 7 p.m. sharp.", "The meeting ended at 9 a.m.", '"Where is it? I lost it!" asked Tom.', "She wrote it (see p. 3) and left.", "Version 3.11.2 reads data.v2.json twice.", "Well... Mary never came.", "It weighs 9 oz. and fits Ben (a box!).", "They sold pens, paper, etc.", '"The book belongs to Sue."', "Is it done?!", "The T.L.A. group left, i.e. nobody stayed.", "Pi is 3.14."],
    "de": ["Am 5. April kam Prof. Huber an.", "Siehe Nr. 3 bzw. Abs. 7 bei Lang!", "„Wo ist es? Ich sehe nichts!“, fragte Eva.", "Er hat z. B. ein Heft, d. h. Papier."],
    "fr": ["« Où est-il ? Je ne sais pas ! » demanda Luc.", "M. Roux lit la p. 4 du livre.", "Tu viens ?", "Cf. le texte de Mme Noir, vol. 2 !"],
    "es": ["«¿Dónde está? No lo veo.», dijo Ana.", "El Sr. Gil pagó 3,5 por el n.º 9.", "¡Hola!", "Compró pan, pág. 3, etc. en casa."],
    "ko": ["비율은 90.1이고 좋다.", '"와! 찾았다!" 하고 그가 외쳤다.', "벌써 읽었나요?"],
    "hi": ["डॉ. Rao ने कहा।", "क्या 3.5 अंक मिले?"],
}
HELD_OUT_JOINED = {"ja": ["「はい！」「いいえ！」と答えた。", "彼（初版は3年。改訂あり。）を見よ。", "えっ、本当！？", "第1.2節に載せた。", "本から届いた．", "まあ…彼なら仕方がない。"], "zh": ["他问：“看见了吗？没有。”然后走了。", "《书！》是第1.2版。", "唉……没有。", "真的吗？！"]}


def test_sentences_in_every_language(model):
    rng = random.Random(1)
    for joined, book in ((" ", HELD_OUT), ("", HELD_OUT_JOINED)):
        for lang, sentences in book.items():
            for _ in range(20):
                order = rng.sample(sentences, len(sentences))
                assert cut(joined.join(order), model) == order, lang


def test_line_breaks_by_language(model):
    assert cut("今日は晴れ\n明日は雨", model) == ["今日は晴れ", "明日は雨"]
    assert cut("one\ntwo\n\nthree", model) == ["one\ntwo", "three"]
    assert cut("ไปตลาด กินข้าว", model) == ["ไปตลาด", "กินข้าว"]
    assert cut("URL は example.org/docs/index.html\n最後の行", model) == ["URL は example.org/docs/index.html", "最後の行"]
    assert cut("see the word 辞書\nfor more", model) == ["see the word 辞書\nfor more"]
    long = "ก" * 200
    assert cut(f"{long} x{long} yes", model) == [long, "x" + long, "yes"]
    assert cut("「" + "長い引用です。" * 60, model) == ["「" + "長い引用です。" * 60]
    assert cut("「開いた引用\n\n" + "次の文です。" * 3, model) == ["「開いた引用", *["次の文です。"] * 3]
    assert cut("", model) == [] and cut(" \n　", model) == [] and cut("終わり", model) == ["終わり"]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB1.!?。「」“”\"()（） \n　…あ漢가ไ,", max_size=60))
def test_spans_cover_every_visible_character(model, text):
    spans = se.split(text, model)
    inside = "".join(text[a:b] for a, b in spans)
    assert "".join(text.split()) == "".join(inside.split())
    assert all(a < b and text[a:b] == text[a:b].strip() for a, b in spans) and spans == sorted(spans)


def test_streams_in_pieces(spark, model):
    rng = random.Random(3)
    texts = {i: "\n\n".join(" ".join(rng.sample(SPACED["en"], 3)) for _ in range(4)) + "".join(JOINED["ja"]) for i in range(6)} | {9: ""}
    rows = []
    for i, t in texts.items():
        at = n = 0
        while at < len(t) or n == 0:
            k = rng.randrange(0, 15)
            rows.append((i, n, t[at : at + k] or None, f"2030-01-01 00:00:{n % 60:02d}"))
            at, n = at + k, n + 1
    rng.shuffle(rows)
    reads = spark.createDataFrame(rows + rows[:20], "stream_id long, read_no int, text string, received_at string")
    parts = se.stream_paragraphs(reads).select(F.lit("s").alias("src"), "rec_id", "shift", "text")
    got = {}
    for r in se.split_texts(parts, model).orderBy("start_pos").collect():
        got.setdefault(r.rec_id, []).append((r.start_pos, r.end_pos))
    assert got == {i: se.split(t, model) for i, t in texts.items() if t}


def test_a_stream_of_many_blocks_is_numbered_through(spark, model, monkeypatch):
    monkeypatch.setattr(se, "BLOCK", 4)
    rng = random.Random(4)
    text = "\n\n".join(" ".join(rng.sample(SPACED["en"], 3)) for _ in range(12))
    pieces = [text[i : i + 37] for i in range(0, len(text), 37)]
    reads = spark.createDataFrame([(1, n, p, f"2030-01-01 00:00:{n % 60:02d}") for n, p in enumerate(pieces)], "stream_id long, read_no int, text string, received_at string")
    parts = se.stream_paragraphs(reads).select(F.lit("s").alias("src"), "rec_id", "shift", "text")
    spans = se.number_sentences(se.split_texts(parts, model).drop("shift"), width=50)
    got = sorted((r.sent_no, r.start_pos, r.end_pos) for r in spans.collect())
    assert got == [(n, a, b) for n, (a, b) in enumerate(se.split(text, model), 1)]


def test_one_form_for_the_same_look(spark):
    same = ["パネル", "ﾊﾟﾈﾙ", "パネル", "パ​ネル", "パネル﻿", "­パネル "]
    same2 = ["Corpus No-5", "Ｃｏｒｐｕｓ　Ｎｏ－５", "Cоrpus No‑5", "Сorpus Nο‐5"]
    other = ["ハネル", "バネル", "corpus No-5", "Corpus No-50", "Córpus No-5", "ギ夛ー", "ギター", "ギ夕ー", "²", "2", "", "  ", None]
    rows = [("f", i, t) for i, t in enumerate([*same, *same2, *other])]
    df = spark.createDataFrame([*rows, rows[0]], "field string, id long, text string")
    scores = lo.learn_scores(df, "text")
    forms = {r.id: r.form for r in lo.with_forms(df, "text", scores).collect()}
    n, m = len(same), len(same2)
    assert len({forms[i] for i in range(n)}) == 1 and len({forms[n + i] for i in range(m)}) == 1
    rest = [forms[n + m + i] for i in range(len(other))]
    assert rest[6] == rest[7] == "ギター" and rest[-3:] == [None] * 3 and len(set(rest[:-3])) == len(rest) - 3 - 1
    pairs = {(r.id_a, r.id_b) for r in lo.same_look_pairs(df, scores).collect()}
    want = {(a, b) for k, size in ((0, n), (n, m)) for a in range(k, k + size) for b in range(a + 1, k + size)} | {(n + m + 6, n + m + 7)}
    assert pairs == want
    assert lo.same_look_pairs(df.limit(0), scores).count() == 0
    clash = lo.with_forms(df.withColumn("form", F.lit(1)), "text", scores)
    assert clash.columns.count("form") == 1


def test_accents_over_look_alikes():
    canonical = lo.Canonical(lo.Scores([("ca", 3)]))
    for texts in (["café", "caf\u0435\u0301", "cafe\u0301", "с\u0430fé"], ["ópera", "\u03bf\u0301pera", "όpera", "о\u0301pera"], ["è", "ѐ", "е\u0300"], ["Á", "А\u0301"], ["Ї", "Ï", "I\u0308"], ["ベ", "べ", "へ\u3099", "ヘ\u3099"], ["한", "\u1112\u1161\u11ab"]):
        assert len({canonical(t) for t in texts}) == 1, texts
    assert len({canonical(t) for t in ("cafe", "café", "cafè", "cafê", "ヘ", "ベ", "ペ")}) == 7


def test_copies_of_a_spelling_are_not_paired(spark):
    df = spark.range(0, 3000).select(F.lit("f").alias("field"), "id", F.when(F.col("id") == 7, "А").otherwise("A").alias("text"))
    members, pairs = lo.same_look_spellings(df, lo.Scores([("ab", 1)]))
    assert pairs.count() == 1 and members.count() == 3000
    got = lo.same_look_pairs(df, lo.Scores([("ab", 1)]))
    assert got.count() == 2999 and got.where("id_a >= id_b or (id_a <> 7 and id_b <> 7)").count() == 0


def test_forms_do_not_depend_on_the_spelling():
    canonical = lo.Canonical(lo.Scores([("ab", 3), ("カー", 9)]))
    rng = random.Random(6)
    for _ in range(300):
        classes = [rng.randrange(len(lo.CLASSES)) for _ in range(rng.randrange(1, 9))]
        spell = lambda: "".join(rng.choice(lo.CLASSES[k]) for k in classes)
        assert canonical(spell()) == canonical(spell())
        marks = [rng.choice(["", "", "\u3099", "\u0301\u0308"]) for _ in classes]
        marked = lambda: "".join(rng.choice(lo.CLASSES[k]) + m for k, m in zip(classes, marks))
        assert canonical(marked()) == canonical(marked())


def brute_leaks(documents, items):
    out = set()
    for d, text in documents:
        body = le.letters(text or "")
        for i, lang, item in items:
            t, run = le.letters(item or ""), le.run_length(lang, item or "")
            if any(t[k : k + run] in body for k in range(len(t) - run + 1)):
                out.add((d, i))
    return out


def test_leaks_against_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda n, a: "".join(rng.choice(a) for _ in range(n))
    items = [(i, rng.choice(["ja", None]), word(rng.randrange(20, 90), "あいうえおかきく漢字")) for i in range(8)] + [(i, rng.choice(["en", None]), word(rng.randrange(50, 160), "abcdef ")) for i in range(8, 14)] + [(20, "ja", None), (21, None, "")]
    documents = [(900, None), (901, "")]
    for d in range(150):
        _, _, t = rng.choice(items[:14])
        a = rng.randrange(len(t))
        passage = t[a : a + rng.randrange(10, 90)]
        documents.append((d, word(rng.randrange(40), "あうxyz") + "、".join(passage[k : k + 7].upper() for k in range(0, len(passage), 7)) + word(5, "さしz")))
    ds = spark.createDataFrame([(*d, "c") for d in documents + documents[:5]], "doc_id long, text string, item_id string")
    its = spark.createDataFrame(items + items[:2], "item_id long, lang string, text string")
    for block in (4_000_000, 100):
        monkeypatch.setattr(le, "BLOCK", block)
        blocks = le.item_blocks(its, block)
        assert (len(blocks) > 1) == (block == 100)
        got = {(r.doc_id, r.item_id) for r in le.find_leaks(ds, its).select("doc_id", "item_id").collect()}
        assert got == brute_leaks(documents, items)
    assert le.find_leaks(ds, its.limit(0)).count() == 0 and le.find_leaks(ds.limit(0), its).count() == 0


def test_one_error_is_found_as_a_passage():
    text = "".join(random.Random(1).choice("abcdefgh") for _ in range(100))
    found = le.Matcher([(1, text, 60)]).find("zz" + text[:40] + "X" + text[41:75] + "zz", fuzzy=True)
    assert found and found[0][0] == 1 and found[0][2] == 1
    assert le.Matcher([(1, text, 60)]).find("zz" + text[:40] + "X" + text[41:75] + "zz") == []


def brute_passages(document, text, run):
    """Longest shared run and least distance of a passage, None if that is more than ERRORS."""
    least = min((le.myers(text[k : k + run], document) for k in range(len(text) - run + 1)), default=run)
    shared = max((n for k in range(len(text)) for n in range(len(text) - k + 1) if text[k : k + n] in document), default=0)
    return (shared, least) if least <= le.ERRORS else None


@pytest.mark.parametrize("run", [24, 60])
def test_passages_against_brute_force_at_all_offsets_and_error_places(run):
    rng = random.Random(run)
    text = "".join(rng.choice("あいうえおかきくけこabcdefgh") for _ in range(run + 31))
    matcher = le.Matcher([(1, text, run)])
    for first in range(32):
        passage = text[first : first + run]
        for at in range(run):
            for changed in (passage[:at] + "X" + passage[at + 1 :], passage[:at] + passage[at + 1 :], passage[:at] + "X" + passage[at:]):
                ((_, _, distance),) = matcher.find("yz" + changed + "zy", fuzzy=True)
                assert distance == int(changed != passage and passage not in changed), (first, at, changed)


def test_passages_against_brute_force_on_repetitive_texts():
    rng = random.Random(5)
    hits = 0
    for _ in range(250):
        text = "".join(rng.choice("abc") for _ in range(rng.randrange(22, 40)))
        a = rng.randrange(max(1, len(text) - 23))
        changed = list(text[a : a + rng.randrange(22, 34)])
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(changed) + 1)
            changed[k : k + rng.randrange(2)] = rng.choice(["", "X", "a"])
        document = "".join(rng.choice("abc") for _ in range(rng.randrange(6))) + "".join(changed) + "".join(rng.choice("abc") for _ in range(rng.randrange(6)))
        want = brute_passages(document, text, 24)
        assert le.Matcher([(1, text, 24)]).find(document, fuzzy=True) == ([(1, *want)] if want else []), (text, document)
        hits += bool(want) and want[1] == 1
    assert hits > 30


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="abc", min_size=1, max_size=12), st.text(alphabet="abcd", max_size=20))
def test_myers_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != t)))
        row = new
    assert le.myers(pattern, text) == min(row)


SAMPLES = {
    "ja": "この本はとても面白いです。彼は毎日学校へ行きます。なぜそれを知らないのだろうか。私の家は駅の近くにあります。", "en": "The weather was very nice yesterday. We walked along the river and talked about books. Nobody knows where she went.",
    "zh": "今天的天气非常好。我们沿着河边散步。没有人知道她去了哪里。这本书很有意思。", "ko": "오늘은 날씨가 아주 좋습니다. 우리는 강을 따라 걸었습니다. 아무도 그녀가 어디로 갔는지 모릅니다.",
    "de": "Gestern war das Wetter sehr schön. Wir gingen am Fluss entlang und sprachen über Bücher. Niemand weiß, wohin sie ging.", "fr": "Hier, il faisait très beau. Nous avons marché le long de la rivière et parlé de livres. Personne ne sait où elle est allée.",
    "es": "Ayer hizo muy buen tiempo. Caminamos junto al río y hablamos de libros. Nadie sabe adónde fue ella.",
}


def test_languages(spark):
    documents = [(100 * n + k, t, lang) for n, (lang, t) in enumerate(SAMPLES.items()) for k in range(6)]
    documents += [(7, SAMPLES["en"], "fr"), (8, SAMPLES["de"], None), (9, SAMPLES["ja"] + "\n" + SAMPLES["en"], "ja"), (10, "Kono hon wa totemo omoshiroi desu. Kare wa mainichi gakkou e ikimasu.", "ja")]
    documents += [(11, SAMPLES["ja"], "Japanese"), (12, SAMPLES["en"], "und"), (13, None, "en"), (14, "123 ...", "en"), (15, "", None), (16, SAMPLES["fr"].replace("livres", "books"), "fra"), (17, SAMPLES["es"], "en-GB")]
    df = spark.createDataFrame([(*d, "c") for d in documents], "doc_id long, text string, lang string, label string")
    models = la.train(df)
    found = {}
    for r in la.doubtful(la.document_languages(df, models)).collect():
        found.setdefault(r.doc_id, set()).add(r.lang)
    assert found == {7: {"en"}, 8: {"de"}, 9: {"ja", "en"}, 12: {"en"}, 17: {"es"}}
    segments = la.language_segments(df, models).where("doc_id = 9").orderBy("seg_no").collect()
    assert [s.lang for s in segments] == ["ja", "en"] and segments[0].start_pos == 0 and segments[-1].end_pos == len(SAMPLES["ja"] + "\n" + SAMPLES["en"])
    assert all(0 <= s.confidence <= 1 for s in segments)
    assert la.document_languages(df.limit(0), models).count() == 0


def test_short_sentences_long_texts_and_other_languages(spark):
    documents = [(100 * n + k, t * 60, lang) for n, (lang, t) in enumerate(SAMPLES.items()) for k in range(4)]  # all longer than a sample document
    models = la.train(spark.createDataFrame(documents, "doc_id long, text string, lang string"))
    langs = lambda t: {x[0] for x in la.detect([t], models)[0][0]}
    assert all(langs(t) == {lang} for lang, t in SAMPLES.items())
    assert langs(SAMPLES["en"] + " Hier, il pleut. Nous avons parlé. C'est très beau.") == {"en", "fr"}
    assert langs(SAMPLES["en"] + " Nobody. Yes. Tokyo.") == {"en"} and langs(SAMPLES["ja"] + "Tokenizer。") == {"ja"}
    assert langs("Вчера была очень хорошая погода. Мы гуляли вдоль реки.") == {la.UNDETERMINED} and langs("123 !") == set()
    frame = spark.createDataFrame([(1, "Вчера была очень хорошая погода. Мы гуляли вдоль реки.", None)], "doc_id long, text string, lang string")
    assert la.document_languages(frame, models).first().lang == la.UNDETERMINED and la.doubtful(la.document_languages(frame, models)).count() == 0


def test_texts_judged_together_or_alone():
    models = la.fit([(c, t) for c, t in SAMPLES.items() for _ in range(3)])
    texts = [*SAMPLES.values(), "", "1 2", SAMPLES["ja"] + "\n" + SAMPLES["en"], "OK", SAMPLES["fr"] + " " + SAMPLES["de"]]
    together = la.detect(texts, models)
    for text, (languages, segments) in zip(texts, together):
        ((alone, parts),) = la.detect([text], models)
        assert [x[0] for x in alone] == [x[0] for x in languages] and [p[:3] for p in parts] == [p[:3] for p in segments]
        assert [x[1:] for x in alone] == [pytest.approx(x[1:], abs=1e-4) for x in languages]


def test_labels(spark):
    names = ["ja", "ja-JP", "JA", "Japanese", "日本語", "jpn", "zh-Hans", "en_US", "it", "und", "N/A", "", " ", None]
    df = spark.createDataFrame([(n,) for n in names], "l string").select(la.canonical_label(F.col("l")).alias("c"))
    assert [r.c for r in df.collect()] == ["ja"] * 6 + ["zh", "en", "it"] + [None] * 5


def test_fill_is_optimal_on_small_cases():
    rng = random.Random(9)
    for _ in range(300):
        counts = {rng.randrange(1, 12): rng.randrange(1, 4) for _ in range(4)}
        room = rng.randrange(1, 40)
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * i for s in sums for i in range(n + 1)}
        chosen = pk.fill(counts, room, sorted(counts, reverse=True))
        assert sum(k * n for k, n in chosen.items()) == max(s for s in sums if s <= room)
        assert all(0 < n <= counts[k] for k, n in chosen.items())


def test_packing(spark):
    rng = random.Random(10)
    texts = ["word " * rng.choice([1, 3, 7, 7, 7, 20, 33]) for _ in range(200)] + ["long text " * 90, "", None]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, pack_id int")
    settings_ = [(1, 32), (2, 64), (3, None)]
    rows = pk.pack(df, settings_, salts=4).collect()
    encode = pk.encoding().encode_ordinary
    sizes = {i: len(encode(t)) for i, t in enumerate(texts) if t}
    for pack, capacity in settings_[:2]:
        mine = [r for r in rows if r.pack_id == pack]
        used, pieces = {}, {}
        for r in mine:
            used[r.container_no] = used.get(r.container_no, 0) + r.n_tokens
            pieces.setdefault(r.doc_id, []).append((r.start_token, r.n_tokens))
        assert set(pieces) == set(sizes) and max(used.values()) <= capacity and sorted(used) == list(range(1, len(used) + 1))
        for d, parts in pieces.items():
            parts.sort()
            assert sum(n for _, n in parts) == sizes[d] and (len(parts) == 1 or sizes[d] > capacity)
            assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:]))
        assert len(used) <= -(-sum(sizes.values()) // capacity) * 1.05 + 1
    assert sorted(map(tuple, pk.pack(df, settings_, salts=4).collect())) == sorted(map(tuple, rows))
    assert pk.pack(df.limit(0), settings_).count() == 0 and pk.pack(df, [(None, 5), (1, None), (2, 0)]).count() == 0


def test_runs_of_items_without_a_language():
    assert le.run_length(None, "Fagevafu의 항아리에 조약돌 377개. Posolabe가 울리면 Votiroma는 503분 기다린다.") == le.RUN_CJK
    assert le.run_length(None, "The word 辞書 and the word 形態素 stand in this English item of many words.") == le.RUN_OTHER
    assert le.run_length("und", "日本語の文です。") == le.RUN_CJK and le.run_length("en-GB", "日本語") == le.RUN_OTHER and le.run_length(None, "") == le.RUN_OTHER


@pytest.mark.parametrize("errors", [0, 2, 3])
def test_any_error_budget_against_brute_force(errors):
    rng = random.Random(20 + errors)
    hits = 0
    for _ in range(60):
        text = "".join(rng.choice("abcdあい") for _ in range(rng.randrange(24, 50)))
        changed = list(text)
        for _ in range(rng.randrange(errors + 2)):
            k = rng.randrange(len(changed) + 1)
            changed[k : k + rng.randrange(2)] = rng.choice(["", "X", "a"])
        document = "zz" + "".join(changed)[: rng.randrange(20, 60)] + "zy"
        least = min((le.myers(text[k : k + 24], document) for k in range(len(text) - 23)), default=99)
        found = le.Matcher([(1, text, 24)], errors).find(document, fuzzy=True)
        assert [d for _, _, d in found] == ([least] if least <= errors else []), (text, document)
        hits += bool(found)
    assert hits > 10
