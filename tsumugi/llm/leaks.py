"""Evaluation texts leaking into documents, by pigeonhole edit matching.

Texts are compared in Unicode NFKC and lower case, letters and digits only. A passage of
``run`` characters that may differ in ERRORS places holds one of any ERRORS + 1 separate
pieces unchanged. An item is cut into pieces of (run + 1) // (ERRORS + 2), so every passage,
wherever it begins, contains ERRORS + 1 whole ones (for exact runs, one of half a passage):

1. all pieces of all items form one Aho-Corasick automaton that reads each document once;
2. at every piece hit the run of equal characters through it is measured;
3. the farthest reach with 0, 1, ... errors to either side of the hit (by diagonals) picks
   the passage through the hit that may have the least distance;
4. Myers' bit-parallel distance of that passage to the text around the hit verifies it: no
   pair gets a row without.

The run length of a pair is the longest run of characters that both texts share; a pair at
distance 0 shares a whole passage.

Items are the stated query set: they are handed to the tasks in blocks of at most BLOCK
characters, of which the driver holds one at a time; all documents are read against every
block, and nothing of the documents is gathered anywhere.

Defined results: NULL or empty texts on either side match nothing; an item shorter than
its run length cannot match; repeated items or documents give one row per pair.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsumugi.llm.languages import NAMES
from tsumugi.runtime import spread

ERRORS = 1
RUN_CJK, RUN_OTHER = 24, 60
BLOCK = 4_000_000  # characters of items that one automaton holds (about 100 MB in a task)

_NOT_ALNUM = re.compile(r"[\W_]+")
_WORD = re.compile(r"[^\W\d_]+")
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯豈-﫿]")

LEAKS = "doc_id long, item_id long, run_length int, distance int"


def letters(text: str) -> str:
    """NFKC, lower case, letters and digits only."""
    return _NOT_ALNUM.sub("", unicodedata.normalize("NFKC", text).lower())


def run_length(lang: str | None, text: str) -> int:
    """The run that counts as a leak: by the item's language, by its letters if that is not given."""
    named = (lang or "").strip().lower()
    for code, names in NAMES.items():
        if named in names.split() or re.split(r"[-_]", named)[0] in names.split():
            return RUN_CJK if code in ("ja", "zh", "ko") else RUN_OTHER
    words = len(_WORD.findall(_CJK.sub(" ", text)))  # names and terms in other letters: a word weighs as much as a syllable
    return RUN_CJK if len(_CJK.findall(text)) > words else RUN_OTHER


def myers(pattern: str, text: str) -> int:
    """Least edit distance of ``pattern`` to any substring of ``text``, bit-parallel."""
    m = len(pattern)
    if not m:
        return 0
    ones, high = (1 << m) - 1, 1 << (m - 1)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    vp, vn, score, best = ones, 0, m, m
    for c in text:
        eq = peq.get(c, 0)
        x = eq | vn
        d = ((((x & vp) + vp) ^ vp) | x) & ones
        hp, hn = vn | ~(d | vp) & ones, vp & d
        score += 1 if hp & high else -1 if hn & high else 0
        best = min(best, score)
        hp = hp << 1 & ones  # a match may begin anywhere in the text
        hn = hn << 1 & ones
        vp, vn = hn | ~(d | hp) & ones, hp & d
    return best


def _common_suffix(a: str, i: int, b: str, j: int) -> int:
    """Equal characters before positions i and j, found by doubling slices."""
    n = min(i, j)
    if a[i - n : i] == b[j - n : j]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[i - mid : i] == b[j - mid : j]:
            lo = mid
        else:
            hi = mid
    return lo


def _common_prefix(a: str, i: int, b: str, j: int) -> int:
    n = min(len(a) - i, len(b) - j)
    if a[i : i + n] == b[j : j + n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[i : i + mid] == b[j : j + mid]:
            lo = mid
        else:
            hi = mid
    return lo


def _reaches(a: str, i: int, b: str, j: int, errors: int, back: bool) -> list[int]:
    """Most characters of ``a`` after (or before) i that agree with ``b`` at j within 0, 1, ... ``errors`` edits."""
    sign, common = (-1, _common_suffix) if back else (1, _common_prefix)
    most_a, most_b = (i, j) if back else (len(a) - i, len(b) - j)
    far = {0: common(a, i, b, j)}  # characters of a by diagonal (characters of b less those of a)
    reaches = [far[0]]
    for _ in range(errors):
        new = dict(far)
        for diagonal, n in far.items():
            for da, db in ((1, 1), (1, 0), (0, 1)):
                x, y = n + da, n + diagonal + db
                if x <= most_a and y <= most_b:
                    x += common(a, i + sign * x, b, j + sign * y)
                    new[y - n - da] = max(new.get(y - n - da, 0), x)
        far = new
        reaches.append(max(far.values()))
    return reaches


class Matcher:
    """Pieces of a block of items; ``items`` are (item_id, letters, run)."""

    def __init__(self, items: list[tuple[int, str, int]], errors: int = ERRORS):
        self.items, self.errors = items, errors
        self._automata: dict[int, ahocorasick.Automaton | None] = {}

    def _automaton(self, errors: int) -> ahocorasick.Automaton | None:
        """Pieces such that every passage contains ``errors`` + 1 whole ones; None if there are none."""
        if errors not in self._automata:
            pieces: dict[str, list[tuple[int, int]]] = {}
            for n, (_, text, run) in enumerate(self.items):
                size = (run + 1) // (errors + 2)
                for at in range(0, len(text) - size + 1 if len(text) >= run else 0, size):
                    pieces.setdefault(text[at : at + size], []).append((n, at))
            automaton = ahocorasick.Automaton()
            for piece, places in pieces.items():
                automaton.add_word(piece, (len(piece), places))
            if pieces:
                automaton.make_automaton()
            self._automata[errors] = automaton if pieces else None
        return self._automata[errors]

    def find(self, document: str, fuzzy: bool = False) -> list[tuple[int, int, int]]:
        """(item_id, longest exact run, least distance of a passage) of every item that leaks.

        Exact runs only, unless ``fuzzy``: then passages within the error budget count too.
        """
        errors = self.errors if fuzzy else 0
        automaton = self._automaton(errors)
        if automaton is None:
            return []
        longest: dict[int, int] = {}
        least: dict[int, int] = {}
        for end, (size, places) in automaton.iter(document):
            start = end + 1 - size
            for n, at in places:
                _, text, run = self.items[n]
                before = _common_suffix(text, at, document, start)
                after = _common_prefix(text, at + size, document, start + size)
                longest[n] = max(longest.get(n, 0), before + size + after)
                if before + size + after >= run:
                    distance, left = 0, before
                elif errors and least.get(n, errors + 1) > 1:
                    lefts = _reaches(text, at, document, start, errors, True)
                    rights = _reaches(text, at + size, document, start + size, errors, False)
                    distance, left = min(((i + j, lefts[i]) for i in range(errors + 1) for j in range(errors + 1 - i) if lefts[i] + size + rights[j] >= run), default=(errors + 1, 0))
                else:
                    continue
                if distance < least.get(n, errors + 1):
                    begin = min(left, run - size)
                    around = document[max(0, start - begin - errors) : start - begin + run + errors]
                    verified = myers(text[at - begin : at - begin + run], around)
                    if verified <= errors:
                        least[n] = min(verified, least.get(n, verified))
        return [(self.items[n][0], self._longest(n, longest[n], document, errors), d) for n, d in least.items()]

    def _longest(self, n: int, known: int, document: str, errors: int) -> int:
        """The longest shared run, if the longest through a piece is ``known``: runs without a whole piece are shorter than two pieces."""
        _, text, run = self.items[n]
        most = 2 * ((run + 1) // (errors + 2)) - 2
        while known < most and any(text[i : i + known + 1] in document for i in range(len(text) - known)):
            known += 1
        return known


def item_blocks(items: DataFrame, size: int = BLOCK) -> list[list[tuple[int, str, int]]]:
    """The query set (item_id, lang, text) as blocks of prepared items, each of bounded size."""
    return list(_blocks(items, size))


def _blocks(items: DataFrame, size: int) -> Iterator[list[tuple[int, str, int]]]:
    """The blocks one after the other; at least one, which may be empty."""
    block: list[tuple[int, str, int]] = []
    held = 0
    for row in items.select("item_id", "lang", "text").where(F.col("text").isNotNull()).dropDuplicates().toLocalIterator():
        text = letters(row.text)
        if held + len(text) > size and block:
            yield block
            block, held = [], 0
        block.append((row.item_id, text, run_length(row.lang, row.text)))
        held += len(text)
    yield block


def find_leaks(documents: DataFrame, items: DataFrame, fuzzy: bool = False, errors: int = ERRORS) -> DataFrame:
    """doc_id, item_id, run_length and distance for every document that holds a passage of an item.

    Passages must be equal, unless ``fuzzy``: then up to ``errors`` characters of a passage may
    be changed, missing or added; equal passages have distance 0.
    """
    texts = spread(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull()))
    result = None
    for block in _blocks(items, BLOCK):
        shared = documents.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, errors)
            for batch in batches:
                rows = [(i, *hit) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for hit in matcher.find(letters(t), fuzzy)]
                columns = list(zip(*rows)) if rows else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["doc_id", "item_id", "run_length", "distance"])

        part = texts.mapInArrow(run, LEAKS)
        result = part if result is None else result.unionByName(part)
    return result.groupBy("doc_id", "item_id").agg(F.max("run_length").alias("run_length"), F.min("distance").alias("distance"))
