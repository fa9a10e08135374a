"""Visually identical text in one form.

1. Ignorable characters are deleted and compatibility forms of the same look (width,
   kind of space or hyphen, radicals, composed or combining marks) are folded.
2. Every remaining character that has look-alikes in other scripts stands for its whole
   class. The characters of a text thus form a lattice, and Viterbi search picks the path
   with the best sum of character-bigram scores and script consistency.

Strings that look the same have the same lattice, hence the same best path: which strings are
equal is settled by the lattice, and the search only picks the spelling that is shown. Strings
that differ visibly differ in a class or in a character without a class. Accents and voicing
marks stand apart from their letters in the lattice and are composed again afterwards. The lattice is cut at
characters without look-alikes, so its pieces are short and repeat.

Bigram scores are counted over all texts; the TABLE most frequent are used.

Defined results: NULL and blank text has a NULL form; white space at both ends of a text is
invisible and dropped; line breaks are visible and kept.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsumugi.runtime import durable, spread

# Characters of the same shape; the members of a class are separated by nothing.
CLASSES = (
    "AΑА BΒВ CϹС EΕЕ HΗН IΙІ JЈ KΚК MΜМ NΝ OΟО PΡР SЅ TΤТ XΧХ YΥҮ ZΖ "
    "aа cϲс eе hһ iі jј oοо pρр qԛ sѕ vν wԝ xх yу dԁ "
    "QԚ WԜ gɡ lӏ "
    "タ夕 カ力 ロ口囗 ニ二 ハ八 エ工 ト卜 ヘへ ノ丿 ム厶 ー一—―─ "
    "·‧⋅∙ :∶ /∕⁄ |∣ǀ ~〜∼"
).split()
HYPHENS = "‐‑‒–−⁃﹣－"
IGNORABLE = "­͏ᅟᅠ឴឵ㅤﾠ"
TABLE = 20_000
REMEMBERED = 200_000

CLASS_OF = {c: i for i, members in enumerate(CLASSES) for c in members}
MEMBERS = [tuple(members) for members in CLASSES]
_FIRSTS = {ord(c): members[0] for members in CLASSES for c in members}
_RUNS = re.compile("[" + re.escape("".join(members[0] for members in CLASSES)) + "]+")


_MARKS = re.compile("[" + "".join(c for c in map(chr, range(0x10000)) if unicodedata.combining(c)) + "]+")


class _Folding(dict):
    """str.translate table filled as characters occur."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        category = unicodedata.category(c)
        if category == "Cf" or c in IGNORABLE or 0xFE00 <= point <= 0xFE0F or 0xE0100 <= point <= 0xE01EF:
            folded = ""
        elif c in HYPHENS:
            folded = "-"
        elif c in CLASS_OF:
            folded = c
        elif category == "Zs" or c == "\t":
            folded = " "
        elif c in "゛゜":
            folded = {"゛": "゙", "゜": "゚"}[c]
        else:
            tag, _, points = unicodedata.decomposition(c).rpartition(">")
            same_look = tag.lstrip("<") in ("", "wide", "narrow", "noBreak") or tag == "<compat" and " " not in points.strip()
            folded = unicodedata.normalize("NFKC", c) if same_look and not (tag and "゙" <= c <= "゚") else c
        self[point] = folded
        return folded


_folding = _Folding()


def fold(text: str) -> str:
    """Compatibility folding of same-look forms, decomposed and without ignorable characters."""
    return unicodedata.normalize("NFD", text.translate(_folding)).strip()


def fold_all(texts: list[str]) -> list[str]:
    """``fold`` of many texts in one pass."""
    parts = unicodedata.normalize("NFD", "\0".join(texts).translate(_folding)).split("\0")
    return [p.strip() for p in parts] if len(parts) == len(texts) else [fold(t) for t in texts]


def script(c: str) -> str:
    o = ord(c)
    if o < 0x80:
        return "latin" if c.isalpha() else "common"
    if 0x3041 <= o <= 0x309F:
        return "hiragana"
    if 0x30A0 <= o <= 0x30FF or 0x31F0 <= o <= 0x31FF:
        return "katakana"
    if 0x3400 <= o <= 0x9FFF or 0xF900 <= o <= 0xFAFF or 0x20000 <= o <= 0x3FFFF or c == "々":
        return "han"
    if 0x370 <= o <= 0x3FF or 0x1F00 <= o <= 0x1FFF:
        return "greek"
    if 0x400 <= o <= 0x52F:
        return "cyrillic"
    if o < 0x250:
        return "latin" if c.isalpha() else "common"
    return "other" if c.isalpha() else "common"


class Scores:
    """Character-bigram scores with a bonus for staying in one script."""

    def __init__(self, bigrams: list[tuple[str, int]]):
        total = sum(n for _, n in bigrams) + 1
        self.bits = {b: math.log2(n * len(bigrams) / total + 1) for b, n in bigrams}

    def pair(self, a: str, b: str) -> float:
        same = script(a) == script(b) if a and b else False
        return (6.0 if same else 0.0) + 0.5 * min(self.bits.get(a + b, 0.0), 8.0)

    def best(self, left: str, classes: tuple[int, ...], right: str) -> str:
        """Members of the classes along the best path between two fixed characters; ties to the first member."""
        paths = [(0.0, "", left)]
        for k in classes:
            paths = [max(((s + self.pair(last, c) + (0.25 if c < "ɐ" else 0.0), p + c, c) for s, p, last in paths), key=lambda x: x[0]) for c in MEMBERS[k]]
        return max(paths, key=lambda x: x[0] + self.pair(x[2], right))[1]


class Canonical:
    """The one form of texts that look the same."""

    def __init__(self, scores: Scores):
        self.scores = scores
        self.known: dict[tuple, str] = {}

    def __call__(self, text: str | None) -> str | None:
        return None if text is None else self.of_folded(fold(text))

    def of_folded(self, folded: str) -> str | None:
        if not folded:
            return None
        if not _MARKS.search(folded):
            return unicodedata.normalize("NFC", self._best(folded))
        # Marks stand between the characters of a lattice without cutting it.
        letters = self._best(_MARKS.sub("", folded))
        out, at, before = [], 0, 0
        for m in _MARKS.finditer(folded):
            out += [letters[at : m.start() - before], m[0]]
            at = m.start() - before
            before += len(m[0])
        return unicodedata.normalize("NFC", "".join(out) + letters[at:])

    def _best(self, folded: str) -> str:
        """The best path through a text without marks."""
        firsts = folded.translate(_FIRSTS)
        known = self.known

        def form(m: re.Match) -> str:
            piece = (firsts[m.start() - 1 : m.start()], m[0], firsts[m.end() : m.end() + 1])
            if (found := known.get(piece)) is None:
                found = self.scores.best(piece[0], tuple(CLASS_OF[x] for x in piece[1]), piece[2])
                if len(known) < REMEMBERED:
                    known[piece] = found
            return found

        return _RUNS.sub(form, firsts)


def _bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in batches:
        texts = unicodedata.normalize("NFC", fold("\n\0\n".join(batch.column(0).to_pylist())))
        points = np.frombuffer(texts.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        pairs, n = np.unique(points[:-1] << np.uint64(21) | points[1:], return_counts=True)
        counts.update(dict(zip(pairs.tolist(), n.tolist())))
    split = {chr(p >> 21) + chr(p & 0x1FFFFF): n for p, n in counts.items() if p >> 21 and p & 0x1FFFFF}
    yield pa.RecordBatch.from_arrays([pa.array(list(split), pa.string()), pa.array(list(split.values()), pa.int64())], names=["bigram", "n"])


def learn_scores(texts: DataFrame, column: str) -> Scores:
    """Scores from the bigrams of all texts; at most TABLE of them reach the driver."""
    counted = spread(texts.select(column).where(F.col(column).isNotNull())).mapInArrow(_bigrams, "bigram string, n long")
    top = counted.groupBy("bigram").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "bigram").limit(TABLE)
    return Scores([(r.bigram, r.n) for r in top.collect()])


def with_forms(texts: DataFrame, column: str, scores: Scores, form: str = "form") -> DataFrame:
    """``texts`` with the canonical form of ``column`` added; an older column ``form`` is replaced."""
    texts = texts.drop(form)
    shared = texts.sparkSession.sparkContext.broadcast(scores)
    at = texts.columns.index(column)
    names = [*texts.columns, form]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canonical = Canonical(shared.value)
        for batch in batches:
            encoded = batch.column(at).dictionary_encode()
            forms = pa.array([canonical.of_folded(t) for t in fold_all(encoded.dictionary.to_pylist())], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, forms.take(encoded.indices)], names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields) + f", `{form}` string"
    return spread(texts).mapInArrow(run, schema)


def same_look_spellings(records: DataFrame, scores: Scores) -> tuple[DataFrame, DataFrame]:
    """The records (field, id, text, form) whose form occurs in several spellings, and the
    distinct pairs (field, text_a, text_b) of such spellings.

    Rows are those of the records plus the pairs of different spellings of one form: copies of
    a spelling are never paired. With it, classes can be had without listing pairs of records.
    """
    forms = with_forms(records.select("field", "id", "text").where(F.col("text").isNotNull()).dropDuplicates(), "text", scores)
    forms = durable(forms.where(F.col("form").isNotNull()))
    several = forms.groupBy("field", "form").agg(F.min("text").alias("_lo"), F.max("text").alias("_hi")).where(F.col("_lo") != F.col("_hi")).select("field", "form")
    members = durable(forms.join(several, ["field", "form"]))
    spellings = members.select("field", "form", "text").distinct()
    a = spellings.select("field", "form", F.col("text").alias("text_a"))
    b = spellings.select("field", "form", F.col("text").alias("text_b"))
    pairs = a.join(b, ["field", "form"]).where(F.col("text_a") < F.col("text_b")).select("field", "text_a", "text_b")
    return members, pairs


def same_look_pairs(records: DataFrame, scores: Scores) -> DataFrame:
    """Pairs (field, id_a, id_b) of records (field, id, text) that differ in characters but look the same.

    Spellings are paired first and then spread to their records, so copies of one spelling
    never meet each other; the adaptive planner splits the records of a hot spelling.
    """
    members, pairs = same_look_spellings(records, scores)
    a = members.select("field", F.col("id").alias("_a"), F.col("text").alias("text_a"))
    b = members.select("field", F.col("id").alias("_b"), F.col("text").alias("text_b"))
    both = pairs.join(a, ["field", "text_a"]).join(b, ["field", "text_b"]).where(F.col("_a") != F.col("_b"))
    return both.select("field", F.least("_a", "_b").alias("id_a"), F.greatest("_a", "_b").alias("id_b"))
