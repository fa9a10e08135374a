"""Sentence boundaries across languages and scripts, by a maximum-entropy classifier.

Candidates are generated from structure: every run of closing punctuation, with closing
quotes and brackets, that lies outside a quotation or bracket after which its sentence goes
on. Empty lines always end a sentence, line breaks do where the line is Japanese or Chinese,
and spaces do in Thai. Candidates that begin with a mark of ALWAYS end a sentence by rule,
which decides nearly all of Japanese, Chinese and Hindi. Every other candidate is classified by a maximum-entropy model over
the neighbouring tokens, their case, length, digits and script. The model is trained on
reliable boundaries: seed sentences with known ends, and a sample of the texts' own
candidates that an empty line or the text's end proves (boundary) or a following
lower-case word disproves.

Positions are code points, end exclusive, without surrounding white space.

Defined results: NULL and blank texts have no sentence; a rest without closing punctuation
is a sentence; repeated identical rows count once; a piece of a stream that came in
differing versions counts in the last one received.
"""

from __future__ import annotations

import random
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsumugi.llm.boundary_seed import JOINED, SPACED
from tsumugi.runtime import durable, spread

SAMPLE = 4_000  # texts whose own reliable boundaries join the training set
FEATURES = 1 << 15
LONGEST = 20_000  # characters of a sampled text; of a longer one a stretch chosen by hash
NEAR = 40  # characters to the left in which the neighbouring tokens are looked for
EPOCHS = 40
REMEMBERED = 100_000  # feature slots and contexts that a task keeps

# Closing punctuation, quotes and brackets by role.
STOPS = ".!?。！？．।॥…‥؟۔｡"
OPENERS = {"「": "」", "『": "』", "（": "）", "(": ")", "[": "]", "【": "】", "〔": "〕", "《": "》", "〈": "〉", "«": "»", "“": "”", "„": "“", "｢": "｣", "［": "］"}
CLOSERS = set(OPENERS.values()) | {'"', "”", "’", "'"}
VOWELS = frozenset("aeiouyäöüáéíóúàèìòùâêîôû")
MONTHS = frozenset(
    "januar jänner februar märz april mai juni juli august september oktober november dezember "
    "january february march may june july october december janvier février mars avril juin juillet août septembre octobre novembre décembre "
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split()
)
KOREAN_AFTER_QUOTE = re.compile(r"(이?라고|하고|하며|이?라며|이?라는|하는|고|며|는|은|이|가|을|를|와|과|도|에|의|로|으로)(?![가-힣])|이?라고|하고")
CJK = re.compile(r"[぀-ヿ㐀-鿿豈-﫿ｦ-ﾟ々〆〇]")
THAI = re.compile(r"[฀-๿]")
BREAK = re.compile(r"\n[^\S\n]*(?:\n\s*)+|\r\n[^\S\n]*(?:\r?\n\s*)+")
STOP_RUN = re.compile(f"[{re.escape(STOPS)}](?:[^\\S\\n]?[!?！？][^\\S\\n]?|[{re.escape(STOPS)}])*")
LAST_STOP = re.compile(r"[。！？．｡]|[.!?](?=\s)")
WORD = re.compile(r"[\w'’\-]+(?:\.[\w'’\-]+)*")  # matched backwards
TOKEN = re.compile(r"[^\W_]+")


def _kind(c: str) -> str:
    """Class of a character: case, digit or script."""
    if c.isdigit():
        return "d"
    o = ord(c)
    if o < 0x590 or 0x1E00 <= o < 0x2000:
        return "U" if c.isupper() else "l" if c.isalpha() else "p"
    if 0x900 <= o < 0x980:
        return "D"
    if 0xE00 <= o < 0xE80:
        return "T"
    if 0xAC00 <= o < 0xD7B0:
        return "K"
    if CJK.match(c):
        return "J"
    return "U" if c.isupper() else "a" if c.isalpha() else "p"


def _enclosures(text: str) -> list[tuple[int, int]]:
    """Quotations and brackets as (position of the opening, position of the closing or len(text))."""
    stack: list[tuple[str, int]] = []
    pairs: list[tuple[int, int]] = []
    for m in re.finditer(r"[「『（(\[【〔《〈«“„｢［」』）)\]】〕》〉»”｣］\"]", text):
        c, i = m[0], m.start()
        close_of = {x for x, _ in stack}
        if c == '"':
            if '"' in close_of:
                while stack[-1][0] != '"':
                    stack.pop()
                pairs.append((stack.pop()[1], i))
            else:
                stack.append(('"', i))
        elif c in close_of and not (c == "“" and "“" not in close_of):
            while stack[-1][0] != c:
                stack.pop()
            pairs.append((stack.pop()[1], i))
        elif c in OPENERS:
            stack.append((OPENERS[c], i))
    # An opening that is never closed holds the rest only in the last paragraph, where the text was cut off.
    last = max((m.end() for m in BREAK.finditer(text)), default=0) if stack else 0
    pairs.extend((i, len(text)) for _, i in stack if i >= last)
    return sorted(pairs)


def _breaks_lines(line: str, text_is_cjk: bool) -> bool:
    """Whether a line break behind ``line`` ends a sentence: if the line's last sentence is
    Japanese or Chinese, by its letters against words in other scripts."""
    rest = LAST_STOP.split(line)[-1]
    letters = len(CJK.findall(rest))
    return letters > 0 and (text_is_cjk or letters > len(CJK.sub(" ", rest).split()))


def _goes_on(text: str, at: int, opened: dict[int, int]) -> bool:
    """Whether the sentence goes on at position ``at``, right behind a closing quote or bracket."""
    n = len(text)
    while True:
        j = at
        while j < n and text[j] in " 　   ":
            j += 1
        if j >= n or text[j] == "\n":
            if j < n and (rest := text[j:].lstrip()) and not re.match(r"\n\s*\n", text[j:]) and rest[0].islower():
                return True
            return False
        c = text[j]
        if j == at and j in opened and opened[j] < n and c in "「『“《（(":
            at = opened[j] + 1  # a further quotation right behind: what follows it decides
            continue
        break
    if c in STOPS or c in ",，、;；:：–—-~〜/" or c in CLOSERS and c != '"':
        return True
    kind = _kind(c)
    if kind == "l":
        return True
    if kind == "K":
        return j == at or bool(KOREAN_AFTER_QUOTE.match(text, j))
    if kind in "JTaD":
        return j == at
    if j == at and kind in "Ud" and CJK.search(text[max(0, at - 12) : at]):
        return True
    return False


def candidates(text: str) -> tuple[list[int], list[tuple[int, int]]]:
    """Ends of hard segments, and soft candidates (start of the punctuation, end with closers)."""
    hard = {len(text)}
    for m in BREAK.finditer(text):
        hard.add(m.start())
    if "\n" in text and CJK.search(text):
        cjk = len(CJK.findall(text)) > len(CJK.sub(" ", text).split())
        at = 0
        for m in re.finditer("\n", text):
            if _breaks_lines(text[at : m.start()], cjk):
                hard.add(m.start())
            at = m.end()
    if THAI.search(text):
        words = [(m.start(), m.end(), bool(THAI.search(m[0]))) for m in re.finditer(r"\S+", text)]
        hard.update(end for (_, end, thai), (_, _, follows) in zip(words, words[1:]) if thai or follows)
    pairs = _enclosures(text)
    opened = dict(pairs)
    closed = {j for _, j in pairs}
    shut = []  # enclosures that end nothing
    for i, j in pairs:
        if j == len(text) or _goes_on(text, j + 1, opened):
            shut.append((i, j))
    soft = []
    k, reach, last_end = 0, -1, -1
    for m in STOP_RUN.finditer(text):
        start, end = m.start(), m.end()
        while text[end - 1] in "    　\t":
            end -= 1
        while k < len(shut) and shut[k][0] < start:
            reach = max(reach, shut[k][1])
            k += 1
        if start < last_end:
            continue
        if reach > start:
            continue
        while end < len(text):
            if text[end] in CLOSERS and (end in closed or text[end] in "’'"):
                end += 1
            elif text[end] in "   " and end + 1 < len(text) and text[end + 1] == "»" and end + 1 in closed:
                end += 2
            else:
                break
        last_end = end
        soft.append((start, end))
    return sorted(hard), soft


def context(text: str, start: int, end: int, begun: int, follow: int | None = None) -> tuple:
    """What the features of a candidate depend on; ``begun`` is where its sentence began, ``follow`` where the next text begins."""
    mark = text[start:end]
    stop = "..." if "..." in mark or "…" in mark or "‥" in mark else "!?" if any(c in "!?！？" for c in mark) else mark[0]
    left = text[max(begun, start - NEAR) : start]
    if stop == "!?":
        left = left.rstrip()
    m = WORD.match(left[::-1])
    word = m[0][::-1] if m else ""
    shape = "none" if not word else "num" if word[0].isdigit() else "initial" if len(word) == 1 and word.isupper() else "dotted" if "." in word else "cap" if word[0].isupper() else "low"
    script = _kind(word[-1]) if word else "-"
    j = end if follow is None else follow
    gap = "0" if j < len(text) and not text[j].isspace() and follow is None else "1"
    while j < len(text) and text[j].isspace():
        j += 1
    quoted = ""
    while j < len(text) and (text[j] in OPENERS or text[j] in "\"'¿¡"):
        quoted = "o"
        j += 1
    after = _kind(text[j]) if j < len(text) else "E"
    basic = (stop, "q" if mark[-1] in CLOSERS else "", shape, script, gap, quoted, after)
    if stop == ".":
        before = month = ""
        if shape == "num":
            earlier = TOKEN.findall(left[: len(left) - len(word)])
            before = earlier[-1].lower() if earlier else "^"
            following = TOKEN.match(text, j)
            month = str(bool(following) and following[0].lower() in MONTHS)
        return (*basic, word.lower(), len(word), before, month, bool(start) and text[start - 1] in CLOSERS)
    if stop == "...":
        earlier = TOKEN.findall(left[: len(left) - len(word)])
        return (*basic, "few" if len(earlier) + bool(word) <= 2 and len(text[begun:start].split()) <= 2 else "many")
    return basic


def features(known: tuple) -> list[str]:
    """Names of the features of a candidate's context."""
    stop, closer, shape, script, gap, quoted, after = known[:7]
    f = [f"s={stop}{closer}", f"s={stop}{gap}", f"s={stop}|n={quoted}{after}{gap}", f"s={stop}|sh={shape}|n={after}", f"s={stop}|sc={script}|n={after}{gap}"]
    if stop == ".":
        low, length, before, month, shut = known[7:]
        short = str(min(length, 5))
        f += [f"shut={shut}|n={after}", f"w={low}", f"w={low}|n={after}", f"len={short}|{shape}|n={after}", f"sh={shape}|n={after}{gap}", f"script={script}"]
        vowels = "e" if low[-1:] in VOWELS and low else "v" if any(c in VOWELS for c in low) else "-"
        f += [f"vowel={vowels}|{shape}|n={after}", f"vowel={vowels}|len={short}|{shape}"]
        if shape == "num":
            f += [f"num{min(length, 3)}|n={after}", f"num|b={before}", f"num|month={month}"]
        if shape == "initial":
            f.append(f"initial|n={after}")
    if stop == "...":
        f += [f"dots|{known[7]}", f"dots|{known[7]}|n={after}", f"dots|gap={gap}"]
    return f


class Model:
    """Weights of hashed features."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights
        self.known: dict[str, int] = {}
        self.scores: dict[tuple, float] = {}

    def slots(self, names: list[str]) -> list[int]:
        out = []
        for name in names:
            slot = self.known.get(name)
            if slot is None:
                slot = zlib.crc32(name.encode()) % FEATURES
                if len(self.known) < REMEMBERED:
                    self.known[name] = slot
            out.append(slot)
        return out

    def score(self, known: tuple) -> float:
        """Log-odds that a candidate in this context ends a sentence; contexts recur."""
        score = self.scores.get(known)
        if score is None:
            w = self.weights
            score = float(sum(w[i] for i in self.slots(features(known))))
            if len(self.scores) < REMEMBERED:
                self.scores[known] = score
        return score

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "known": {}, "scores": {}}


def fit(examples: list[tuple[list[str], int, float]], epochs: int = EPOCHS) -> Model:
    """Maximum-entropy (logistic) fit with L2 decay by full-batch AdaGrad; deterministic."""
    model = Model(np.zeros(FEATURES))
    if not examples:
        return model
    rows = [model.slots(names) for names, _, _ in examples]
    index = np.fromiter((i for r in rows for i in r), np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    label = np.array([y for _, y, _ in examples], float)
    weight = np.array([w for _, _, w in examples], float)
    w, g2 = model.weights, np.full(FEATURES, 1e-8)
    for _ in range(epochs * 10):
        margin = np.bincount(owner, w[index], len(rows))
        error = weight * (label - 1 / (1 + np.exp(-np.clip(margin, -30, 30))))
        gradient = np.bincount(index, error[owner], FEATURES) - 0.02 * w
        g2 += gradient**2
        w += 0.5 * gradient / np.sqrt(g2)
    model.known = {}
    return model


def seed_examples() -> list[tuple[list[str], int, float]]:
    """Examples from seed sentences put after each other in every order that matters."""
    examples = []
    rng = random.Random(7)
    for joined, books in (("", JOINED), (" ", SPACED)):
        for sentences in books.values():
            for sentence in sentences:
                for other in rng.sample(sentences, min(6, len(sentences))):
                    text = sentence + joined + other
                    for start, end in candidates(text)[1]:
                        if end <= len(sentence):
                            examples.append((features(context(text, start, end, 0)), int(end == len(sentence)), 1.0))
    return examples


def own_examples(texts: list[str]) -> list[tuple[list[str], int, float]]:
    """Reliable boundaries and non-boundaries of the texts themselves."""
    examples = []
    for text in texts:
        hard, soft = candidates(text)
        begun = 0
        for start, end in soft:
            rest = re.match(r"\s*", text[end:])[0]
            nxt = end + len(rest)
            if "\n" in rest and re.search(r"\n\s*\n", rest) and nxt < len(text):
                if text[start:end] != "..." and "…" not in text[start:end]:
                    examples.append((features(context(text, start, end, begun, follow=nxt)), 1, 0.2))
                begun = nxt
            elif nxt < len(text) and text[nxt].islower() and rest and start and _kind(text[start - 1]) in "Ul":
                examples.append((features(context(text, start, end, begun)), 0, 0.2))
    return examples


def train(texts: DataFrame | None = None, key: str = "rec_id", column: str = "text", sample: int = SAMPLE) -> Model:
    """The boundary model, from the seed and from ``sample`` texts chosen by hash."""
    own: list[str] = []
    if texts is not None:
        at = F.pmod(F.xxhash64(F.col(key), F.lit("stretch")), F.greatest(F.lit(1), F.length(column) - (LONGEST - 1))).cast("int") + 1
        chosen = texts.where(F.col(column).contains("\n\n")).select(F.substring(column, at, F.lit(LONGEST)).alias(column), F.xxhash64(F.col(key)).alias("_h")).orderBy("_h", column).limit(sample)
        own = [r[0] for r in chosen.collect()]
    return fit(seed_examples() + own_examples(own))


def split(text: str, model: Model) -> list[tuple[int, int]]:
    """Spans of the sentences of a text."""
    hard, soft = candidates(text)
    ends = []
    begun, h = 0, 0
    for start, end in soft:
        while h < len(hard) and hard[h] < start:
            begun = max(begun, hard[h])
            h += 1
        if model.score(context(text, start, end, begun)) > 0:
            ends.append(end)
            begun = end
    spans = []
    at = 0
    for cut in sorted(set(hard) | set(ends)):
        piece = text[at:cut]
        left = len(piece) - len(piece.lstrip())
        body = piece.strip()
        if body:
            spans.append((at + left, at + left + len(body)))
        at = cut
    return spans


SPANS = "src string, rec_id long, shift long, sent_no int, start_pos int, end_pos int"


def split_texts(texts: DataFrame, model: Model) -> DataFrame:
    """Sentences of texts given as (src, rec_id, shift, text); positions are moved by ``shift``."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            srcs, ids, shifts, bodies = (c.to_pylist() for c in batch.columns)
            rows = [(s, i, d, n, a + d, b + d) for s, i, d, t in zip(srcs, ids, shifts, bodies) for n, (a, b) in enumerate(split(t, model), 1)]
            columns = list(zip(*rows)) if rows else [[]] * 6
            types = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["src", "rec_id", "shift", "sent_no", "start_pos", "end_pos"])

    return spread(texts).mapInArrow(run, SPANS)


BLOCK = 1024  # pieces of a stream whose running sums are formed in one task


def stream_paragraphs(reads: DataFrame) -> DataFrame:
    """Texts of streams (stream_id, read_no, text, received_at), one row per stretch between empty lines.

    An empty line ends every sentence, so a stream is put together only from one piece that
    holds an empty line to the next. Offsets of the stretches are running sums within blocks of
    BLOCK pieces plus the sums of the blocks before, so a stream of any length stays distributed.
    """
    block = (F.col("read_no") / BLOCK).cast("long")
    placed = reads.select("stream_id", "read_no", "text", "received_at", block.alias("_block")).repartition("stream_id", "_block")
    last = placed.groupBy("stream_id", "_block", "read_no").agg(F.max(F.struct("received_at", "text")).alias("r")).select("stream_id", "_block", "read_no", F.coalesce("r.text", F.lit("")).alias("text"))
    head = F.regexp_extract("text", r"(?s)^(.*\n[^\S\n]*\n\s*)(.*)$", 1)
    parts = last.select("stream_id", "_block", "read_no", F.explode(F.array(F.struct(F.lit(0).alias("part"), head.alias("text")), F.struct(F.lit(1).alias("part"), F.substring("text", F.length(head) + 1, F.length("text")).alias("text")))).alias("p"), (F.length(head) > 0).alias("cut"))
    parts = parts.select("stream_id", "_block", "read_no", "p.part", "p.text", "cut").where((F.col("part") == 1) | F.col("cut"))
    opens = F.when(F.col("cut") & (F.col("part") == 1), 1).otherwise(0)
    order = Window.partitionBy("stream_id", "_block").orderBy("read_no", "part").rowsBetween(Window.unboundedPreceding, 0)
    within = parts.select("stream_id", "_block", "read_no", "part", "text", F.sum(opens).over(order).alias("stretch"), (F.sum(F.length("text")).over(order) - F.length("text")).alias("shift"))
    blocks = parts.groupBy("stream_id", "_block").agg(F.sum(opens).alias("_opened"), F.sum(F.length("text")).alias("_length"))
    before = Window.partitionBy("stream_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    offsets = blocks.select("stream_id", "_block", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("_opened", "_length")])
    joined = within.join(offsets, ["stream_id", "_block"]).select("stream_id", "read_no", "part", "text", (F.col("stretch") + F.col("_opened")).alias("stretch"), (F.col("shift") + F.col("_length")).alias("shift"))
    pieces = joined.groupBy("stream_id", "stretch").agg(F.min("shift").alias("shift"), F.array_sort(F.collect_list(F.struct("read_no", "part", "text"))).alias("pieces"))
    return pieces.select(F.col("stream_id").alias("rec_id"), F.col("shift").cast("long").alias("shift"), F.array_join(F.col("pieces.text"), "").alias("text"))


def number_sentences(spans: DataFrame, width: int = 65_536) -> DataFrame:
    """Spans with sent_no counted through each (src, rec_id) in order of start_pos.

    Numbers are places within a stretch of ``width`` characters plus the sentences of the
    stretches before, so the sentences of one record need not meet in a task. The spans are
    written once.
    """
    spans = durable(spans.withColumn("_at", (F.col("start_pos") / width).cast("long")))
    key = ["src", "rec_id", "_at"]
    counts = spans.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("src", "rec_id").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)  # one row per stretch
    offsets = counts.select(*key, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy(*key).orderBy("start_pos"))
    return spans.withColumn("sent_no", place).join(offsets, key).withColumn("sent_no", (F.col("sent_no") + F.col("_before")).cast("int")).drop("_at", "_before")
