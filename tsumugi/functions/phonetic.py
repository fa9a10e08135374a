"""Kana to hiragana, katakana, romaji, IPA and X-SAMPA.

The tables follow from rows of kana with one onset each; only what a row's onset does not
explain is listed. A text is cut into digraphs and single characters by one pattern and
each piece is looked up, so a conversion is one pass.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tsumugi.functions.text import HIRAGANA, KATAKANA, _text

# Rows of kana with one onset each, onsets of the rows, sounds that deviate, kana before small ya, yu, yo and their onsets.
ROWS = ("あいうえお", "かきくけこ", "さしすせそ", "たちつてと", "なにぬねの", "はひふへほ", "まみむめも", "らりるれろ", "がぎぐげご", "ざじずぜぞ", "だぢづでど", "ばびぶべぼ", "ぱぴぷぺぽ")
SMALL = ("ゃ", "ゅ", "ょ")
ROMAJI_ONSETS = ("", "k", "s", "t", "n", "h", "m", "r", "g", "z", "d", "b", "p")
ROMAJI_OTHERS = {"し": "shi", "ち": "chi", "つ": "tsu", "ふ": "fu", "じ": "ji", "ぢ": "ji", "づ": "zu", "や": "ya", "ゆ": "yu", "よ": "yo", "わ": "wa", "を": "wo", "ん": "n"}
ROMAJI_GLIDES = {"き": "ky", "し": "sh", "ち": "ch", "に": "ny", "ひ": "hy", "み": "my", "り": "ry", "ぎ": "gy", "じ": "j", "び": "by", "ぴ": "py"}
IPA_ONSETS = ("", "k", "s", "t", "n", "h", "m", "ɾ", "ɡ", "dz", "d", "b", "p")
IPA_OTHERS = {"し": "ɕi", "ち": "tɕi", "つ": "tsɯ", "に": "ɲi", "ひ": "çi", "ふ": "ɸɯ", "じ": "dʑi", "ぢ": "dʑi", "づ": "dzɯ", "や": "ja", "ゆ": "jɯ", "よ": "jo", "わ": "wa", "を": "o", "ん": "ɴ"}
IPA_GLIDES = {"き": "kʲ", "し": "ɕ", "ち": "tɕ", "に": "ɲ", "ひ": "ç", "み": "mʲ", "り": "ɾʲ", "ぎ": "ɡʲ", "じ": "dʑ", "び": "bʲ", "ぴ": "pʲ"}
XSAMPA_ONSETS = ("", "k", "s", "t", "n", "h", "m", "4", "g", "z", "d", "b", "p")
XSAMPA_OTHERS = {"し": "Ci", "ち": "tCi", "つ": "tsM", "に": "Ji", "ひ": "Ci", "ふ": "p\\M", "じ": "dZi", "ぢ": "dZi", "づ": "zM", "や": "ja", "ゆ": "jM", "よ": "jo", "わ": "wa", "を": "o", "ん": "N"}


def _table(vowels: str, onsets: tuple[str, ...], others: dict[str, str], glides: dict[str, str]) -> dict[str, str]:
    """Sounds by kana: onset and vowel of each row, then what deviates, then kana with small ya, yu, yo."""
    table = {kana: onset + vowel for row, onset in zip(ROWS, onsets) for kana, vowel in zip(row, vowels)}
    table |= others
    a, u, o = vowels[0], vowels[2], vowels[4]
    table |= {kana + small: onset + vowel for kana, onset in glides.items() for small, vowel in zip(SMALL, (a, u, o))}
    return table


ROMAJI = _table("aiueo", ROMAJI_ONSETS, ROMAJI_OTHERS, ROMAJI_GLIDES)
IPA = _table("aiɯeo", IPA_ONSETS, IPA_OTHERS, IPA_GLIDES)
XSAMPA = _table("aiMeo", XSAMPA_ONSETS, XSAMPA_OTHERS, {})
IPA_VOWELS = "aeioɯ"
PARTICLES = {"ハ": "wa", "ヘ": "e", "ヲ": "o"}


def to_hiragana(x: Column | str) -> Column:
    return F.translate(_text(x), KATAKANA, HIRAGANA)


def to_katakana(x: Column | str) -> Column:
    return F.translate(_text(x), HIRAGANA, KATAKANA)


def geminations(table: dict[str, str], silent: str = "") -> dict[str, str]:
    """First letter of the following sound -> the kana that begin with it; ``silent`` letters double nothing."""
    groups: dict[str, str] = {}
    for kana, sound in table.items():
        if len(kana) == 1 and sound[0] not in silent:
            groups[sound[0]] = groups.get(sound[0], "") + kana
    return groups


def _spell(x: Column, table: dict[str, str]) -> Column:
    pairs = [k for k in table if len(k) == 2]
    pattern = "(?s)" + (f"[{''.join(sorted({p[0] for p in pairs}))}][{''.join(SMALL)}]|" if pairs else "") + "."
    lookup = F.create_map(*[F.lit(v) for item in table.items() for v in item])
    pieces = F.regexp_extract_all(x, F.lit(pattern), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.coalesce(F.element_at(lookup, p), p)), "")


def to_romaji(x: Column | str) -> Column:
    x = to_hiragana(x)
    for letter, kana in geminations(ROMAJI).items():
        x = F.regexp_replace(x, f"っ(?=[{kana}])", letter)
    return _spell(F.replace(x, F.lit("っ"), F.lit("tsu")), ROMAJI)


def to_ipa(x: Column | str) -> Column:
    x = to_hiragana(x)
    for letter, kana in geminations(IPA, IPA_VOWELS).items():
        x = F.regexp_replace(x, f"っ(?=[{kana}])", letter)
    return F.translate(_spell(F.translate(x, "ー", "ː"), IPA), "っ", "")


def to_xsampa(x: Column | str) -> Column:
    return _spell(F.translate(to_hiragana(x), "っー", "::"), XSAMPA)


def token_ipa(feature: Column | str) -> Column:
    """IPA of a token from its feature fields: pronunciation first, then reading; NULL without either."""
    fields = F.split(_text(feature), ",")
    pronunciation, reading, pos = F.get(fields, 8), F.get(fields, 7), F.get(fields, 0)
    particle = F.create_map(*[F.lit(v) for item in PARTICLES.items() for v in item])
    spoken = lambda f: f.isNotNull() & ~f.isin("*", "")
    return F.when(spoken(pronunciation), to_ipa(pronunciation)).when(
        spoken(reading), F.coalesce(F.when(pos == "助詞", F.element_at(particle, reading)), to_ipa(reading))
    )
