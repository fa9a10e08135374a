"""Text normalization and character classes as Column expressions (one code-generated pass each)."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F


def span(first: int, last: int) -> str:
    return "".join(map(chr, range(first, last + 1)))


# The character pairs of each step, by rule where they form a range.
FULL_ASCII, HALF_ASCII = span(0xFF01, 0xFF5E), span(0x21, 0x7E)
FULL_DIGITS, HALF_DIGITS = span(0xFF10, 0xFF19), span(0x30, 0x39)
FULL_LETTERS, HALF_LETTERS = span(0xFF21, 0xFF3A) + span(0xFF41, 0xFF5A), span(0x41, 0x5A) + span(0x61, 0x7A)
HALF_KANA = span(0xFF66, 0xFF9F)
FULL_KANA = "ヲァィゥェォャュョッーアイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワン゛゜"
ZERO_WIDTH = "​‌‍﻿⁠"
QUOTES = ("『｢』｣()〔〕", "「「」」（）【】")
PUNCTUATION = ("｡．､，!?:;", "。。、、！？：；")
HIRAGANA, KATAKANA = span(0x3041, 0x3096), span(0x30A1, 0x30F6)
CJK_PUNCTUATION = "。、！？「」『』（）【】・：；〜…‥゛゜"
KANJI = "一-鿿㐀-䶿豈-﫿"


def _text(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def compatibility(x: Column | str) -> Column:
    """Full-width ASCII to ASCII, ideographic space to space, wave dash to full-width tilde."""
    return F.translate(_text(x), FULL_ASCII + "　〜", HALF_ASCII + " ～")


def halfwidth_digits(x: Column | str) -> Column:
    return F.translate(_text(x), FULL_DIGITS, HALF_DIGITS)


def halfwidth_letters(x: Column | str) -> Column:
    return F.translate(_text(x), FULL_LETTERS, HALF_LETTERS)


def fullwidth_katakana(x: Column | str) -> Column:
    return F.translate(_text(x), HALF_KANA, FULL_KANA)


def remove_zero_width(x: Column | str) -> Column:
    return F.translate(_text(x), ZERO_WIDTH, "")


def collapse_whitespace(x: Column | str) -> Column:
    return F.regexp_replace(_text(x), r"(?U)\s+", " ")


def trim_whitespace(x: Column | str) -> Column:
    return F.regexp_replace(_text(x), r"(?U)^\s+|\s+$", "")


def remove_whitespace(x: Column | str) -> Column:
    return F.regexp_replace(_text(x), r"(?U)\s+", "")


@dataclass(frozen=True)
class Normalizer:
    """Normalization steps in their fixed order: form, widths, zero width, white space, trim, case."""

    form: bool = True
    digits: bool = True
    letters: bool = True
    katakana: bool = True
    zero_width: bool = True
    collapse: bool = True
    trim: bool = True
    lowercase: bool = False

    @classmethod
    def minimal(cls) -> Normalizer:
        return cls(*[False] * 8)

    def with_lowercase(self, on: bool = True) -> Normalizer:
        return replace(self, lowercase=on)

    def with_form(self, on: bool = True) -> Normalizer:
        return replace(self, form=on)

    def __call__(self, x: Column | str) -> Column:
        x = _text(x)
        pairs: list[tuple[str, str]] = []  # one translate for all one-to-one steps
        if self.form:
            pairs.append((FULL_ASCII + "　〜", HALF_ASCII + " ～"))
        if self.digits:
            pairs.append((FULL_DIGITS, HALF_DIGITS))
        if self.letters:
            pairs.append((FULL_LETTERS, HALF_LETTERS))
        if self.katakana:
            pairs.append((HALF_KANA, FULL_KANA))
        mapping: dict[str, str] = {}
        for old, new in pairs:
            for a, b in zip(old, new):
                mapping.setdefault(a, b)
        if mapping or self.zero_width:
            x = F.translate(x, "".join(mapping) + (ZERO_WIDTH if self.zero_width else ""), "".join(mapping.values()))
        if self.collapse:
            x = collapse_whitespace(x)
        if self.trim:
            x = trim_whitespace(x)
        return F.lower(x) if self.lowercase else x


def normalize_quotes(x: Column | str) -> Column:
    return F.translate(_text(x), *QUOTES)


def normalize_punctuation(x: Column | str) -> Column:
    return F.translate(_text(x), *PUNCTUATION)


def is_hiragana_only(x: Column | str) -> Column:
    return _text(x).rlike("(?U)^[぀-ゟ\\s]*$")


def is_katakana_only(x: Column | str) -> Column:
    return _text(x).rlike("(?U)^[゠-ヿ･-ﾟ\\s]*$")


def contains_kanji(x: Column | str) -> Column:
    return _text(x).rlike(f"[{KANJI}]")


# Disjoint classes in order of precedence; "other" is the rest.
CHAR_CLASSES = {
    "hiragana": "぀-ゟ",
    "katakana": "゠-ヿ･-ﾟ",
    "kanji": "一-鿿",
    "ascii_letter": "A-Za-z",
    "digit": "0-9",
    "punctuation": r"!-/:-@\[-`{-~" + "".join(c for c in CJK_PUNCTUATION if not "぀" <= c <= "ヿ"),
    "whitespace": "\\t-\\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000",
}


def char_type_counts(x: Column | str) -> dict[str, Column]:
    """Counts by class, ``other``, ``total`` and ``japanese_ratio``."""
    x = _text(x)
    counts = {name: F.length(x) - F.length(F.regexp_replace(x, f"[{members}]", "")) for name, members in CHAR_CLASSES.items()}
    total = F.length(x)
    counts["other"] = total - sum(counts.values(), F.lit(0))
    japanese = counts["hiragana"] + counts["katakana"] + counts["kanji"]
    return counts | {"total": total, "japanese_ratio": F.when(total == 0, 0.0).otherwise(japanese / total)}


def byte_offset(x: Column | str, characters: Column) -> Column:
    """UTF-8 offset of a character offset."""
    return F.octet_length(F.substring(_text(x), F.lit(1), characters))
