"""Languages of documents and of their segments, by multilingual mixture inference.

Each language has a model of hashed character n-grams (orders 2 to 4), counted on a
bounded sample of labelled documents and on seed sentences. Wrong labels in the sample are
cleaned out by re-assigning every sample document to the model that fits it best with the
document itself left out. Japanese in Latin letters has a model of its own.

A document is a mixture: every sentence has a likelihood under every language, and
expectation-maximisation estimates the languages' proportions. Its language set is grown
from the best single language, adding a language only if the mixture's log-likelihood
rises by more than PENALTY; single foreign words cannot reach that. Segments are runs of
sentences that share their most probable language of the set. Only units that are no whole
sentences (single words, numbers) are left out of a mixture, if the text has a whole one.

Defined results: texts that are NULL or hold no letters have no language and no segment; a
text most of whose letters are of blocks of characters that the labelled sample (almost) never
uses is in none of the languages: it is UNDETERMINED, with the share of such letters as
confidence; a foreign sentence of a few letters stays below PENALTY; documents repeated under
one id give one result per text.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsumugi.llm.boundary_seed import JOINED, SPACED
from tsumugi.runtime import spread

CLASSES = ("ja", "en", "zh", "ko", "de", "fr", "es", "ja-latn")
LANG = tuple(c.split("-")[0] for c in CLASSES)
SAMPLE = 300  # labelled documents per class that the models are fitted on
LONGEST = 4_000  # characters of a sample document; of a longer one a stretch chosen by hash
UNDETERMINED = "und"
RARE_BLOCK = 2e-5  # share of the sample's letters below which a block of 256 characters is foreign to all languages
ORDERS = (2, 3, 4)
BUCKETS = 1 << 18
ROUNDS = 3
SMOOTH = 0.05
PENALTY = 14.0  # nats per further language
# Letters that make a unit a whole sentence: if it ends like one and, with blanks, has two words; else.
CLOSED_JOINED, CLOSED_SPACED, LEAST_JOINED, LEAST_SPACED = 4, 5, 8, 18
CHUNK = 400_000  # characters scored at once

# Customary names of languages, and labels that say that it is not known.
NAMES = {
    "ja": "ja jpn jp japanese 日本語 japanisch japonais japonés",
    "en": "en eng english englisch anglais inglés 英語",
    "zh": "zh zho chi cmn chinese 中文 chinesisch chinois chino 中国語 汉语",
    "ko": "ko kor korean 한국어 koreanisch coréen coreano 韓国語",
    "de": "de deu ger german deutsch allemand alemán ドイツ語",
    "fr": "fr fra fre french français französisch francés フランス語",
    "es": "es spa spanish español castellano spanisch espagnol スペイン語",
}
UNKNOWN = "unk und unknown undetermined n/a na none null nil mis mul zxx xx xxx ? - other misc auto".split()
ROMAJI = (
    "Kono hon wa totemo omoshiroi desu. Kare wa mainichi gakkou e ikimasu. Naze sore o shiranai no darou ka. Watashi no ie wa eki no chikaku ni arimasu. "
    "Mazu mizu o wakashite, tsugi ni cha o ireru. Kotoba to moji no kankei o shiraberu. Nihongo o yomu no wa muzukashii to omou. Ano hito ga kaita tegami o yonda."
)

_SENTENCE = re.compile(r"[^.!?。！？．\n]*(?:[.!?。！？．]+[\"'”’“»」』）)\]]*|\n|\Z)", re.S)
_MARK = "\x1e"  # stands between units that are normalised together
_NOISE = re.compile(f"[^\\w{_MARK}]+|_+")
_CLOSED = re.compile(r"[.!?。！？．…][\"'”’“»」』）)\]\s]*\Z")


def canonical_label(label: Column) -> Column:
    """Code of the language a label names; NULL if it says nothing, itself if it names none of ours."""
    plain = F.lower(F.trim(label))
    first = F.regexp_extract(plain, r"^([^-_\s]*)", 1)
    known = F.create_map(*[F.lit(x) for code, names in NAMES.items() for name in names.split() for x in (name, code)])
    nothing = plain.isNull() | (plain == "") | plain.isin(UNKNOWN)
    return F.when(nothing, F.lit(None).cast("string")).otherwise(F.coalesce(known[plain], known[first], plain))


def normal(text: str) -> str:
    """NFKC and lower case, everything but letters, digits and unit marks as a blank."""
    return _NOISE.sub(" ", unicodedata.normalize("NFKC", text).lower())


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """Spans of sentences that cover the text; a stop inside a number or before a letter ends none."""
    spans, at = [], 0
    for m in _SENTENCE.finditer(text):
        end = m.end()
        if end == len(text):
            break
        stop = text[end - 1]
        if stop in ".．" and not text[end].isspace() and ord(text[end]) < 0x3000 and ord(stop) < 0x3000:
            continue
        if end - at >= 2:
            spans.append((at, end))
            at = end
    if at < len(text):
        spans.append((at, len(text)))
    return spans


def grams(points: np.ndarray) -> list[np.ndarray]:
    """Hashed n-grams by order; the gram at i begins at character i."""
    out = []
    p = points.astype(np.uint64)
    for n in ORDERS:
        if len(p) < n:
            out.append(np.zeros(0, np.int64))
            continue
        h = np.full(len(p) - n + 1, n * 0x9E3779B1, np.uint64)
        for k in range(n):
            h = (h ^ p[k : len(p) - n + 1 + k]) * np.uint64(0x100000001B3)
        h ^= h >> np.uint64(29)
        out.append((h % np.uint64(BUCKETS)).astype(np.int64))
    return out


def code_points(text: str) -> np.ndarray:
    """Code points of a normalised text, with one digit for all."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where((points > 48) & (points < 58), np.uint32(48), points)


LAST_LETTER = 0x323B0
_letters = np.zeros(0, bool)


def is_letter(points: np.ndarray) -> np.ndarray:
    """Which code points are letters; the table is made once per process and ends behind the last ideographs."""
    global _letters
    if not len(_letters):
        _letters = np.fromiter((chr(i).isalpha() for i in range(LAST_LETTER)), bool, LAST_LETTER)
        _letters = np.append(_letters, False)
    return _letters[np.minimum(points, LAST_LETTER)]


def block(points: np.ndarray) -> np.ndarray:
    return np.minimum(points, LAST_LETTER) >> 8


class Models:
    """log p of every hashed n-gram under every class."""

    def __init__(self, counts: np.ndarray, letters: np.ndarray):
        """From the n-grams' counts by class and the sample's letters by block of 256 characters."""
        self.table = self.logs(counts)
        self.foreign = letters < RARE_BLOCK * letters.sum()

    @staticmethod
    def logs(counts: np.ndarray) -> np.ndarray:
        total = counts.sum(axis=0, keepdims=True)
        background = (counts.sum(axis=1, keepdims=True) + 0.5) / (counts.sum() + 0.5 * len(counts))
        # Every class is smoothed towards what all classes share, by the same share of its own size.
        mass = SMOOTH * np.maximum(total, total.mean())
        return np.log((counts + mass * background) / (total + mass)).astype(np.float32)

    def units(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Log-likelihoods (units, classes), foreign letters, letters and blanks of each unit; n-grams within one unit only."""
        n = len(texts)
        scores = np.zeros((n, len(CLASSES)))
        points = code_points(normal(_MARK.join(texts)))
        marks = np.flatnonzero(points == ord(_MARK))
        begins, ends = np.concatenate(([0], marks + 1)), np.concatenate((marks, [len(points)]))
        owner = np.repeat(np.arange(n), np.diff(np.concatenate((begins, [len(points) + 1]))))[: len(points)]  # a mark belongs to the unit before
        inside = np.concatenate((points != ord(_MARK), [False]))
        for size, g in zip(ORDERS, grams(points)):
            last = np.arange(len(g)) + size - 1
            kept = np.flatnonzero(inside[: len(g)] & inside[last] & (owner[: len(g)] == owner[last])) if len(g) else last
            if not len(kept):
                continue
            who = owner[kept]
            first = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1])))
            scores[who[first]] += np.add.reduceat(self.table[g[kept]], first, axis=0)
        letter = is_letter(points)
        within = lambda what: (c := np.concatenate(([0], np.cumsum(what))))[ends] - c[begins]
        return scores / len(ORDERS), within(letter & self.foreign[block(points)]), within(letter), within(points == 32)


def fit(documents: list[tuple[str, str]], rounds: int = ROUNDS) -> Models:
    """Models from (class, text), cleaned of wrong labels with each document left out of its own class."""
    index = {c: i for i, c in enumerate(CLASSES)}
    seeds = [(c, " ".join(s)) for book in (JOINED, SPACED) for c, s in book.items() if c in index] + [("ja-latn", ROMAJI)]
    fixed = np.zeros((BUCKETS, len(CLASSES)))
    letters = np.zeros((LAST_LETTER >> 8) + 1)

    def grams_of(text: str) -> np.ndarray:
        points = code_points(normal(text))
        letters[:] += np.bincount(block(points[is_letter(points)]), minlength=len(letters))
        return np.concatenate(grams(points))

    for c, text in seeds:
        np.add.at(fixed[:, index[c]], grams_of(text), 1)
    bags = [np.unique(grams_of(text), return_counts=True) for _, text in documents]
    assigned = [index[c] for c, _ in documents]
    for _ in range(rounds):
        counts = fixed.copy()
        for (g, n), k in zip(bags, assigned):
            counts[g, k] += n
        logs = Models.logs(counts)
        total = counts.sum(axis=0)
        mass = SMOOTH * np.maximum(total, total.mean())
        everything = counts.sum()
        new = []
        for (g, n), k in zip(bags, assigned):
            score = n @ logs[g]
            background = (counts[g].sum(axis=1) + 0.5) / (everything + 0.5 * BUCKETS)
            left = np.log((counts[g, k] - n + mass[k] * background) / (total[k] - n.sum() + mass[k]))
            score[k] = n @ left
            new.append(int(np.argmax(score)))
        if new == assigned:
            break
        assigned = new
    counts = fixed.copy()
    for (g, n), k in zip(bags, assigned):
        counts[g, k] += n
    return Models(counts, letters)


def train(documents: DataFrame, sample: int = SAMPLE) -> Models:
    """Models from at most ``sample`` labelled documents of each class and LONGEST characters of each, chosen by hash."""
    latin = F.length(F.regexp_replace("text", "[^A-Za-zＡ-Ｚａ-ｚ]", ""))
    label = canonical_label(F.col("lang"))
    at = F.pmod(F.xxhash64("doc_id", F.lit("stretch")), F.greatest(F.lit(1), F.length("text") - (LONGEST - 1))).cast("int") + 1
    wanted = documents.where(F.col("text").isNotNull()).withColumn("_c", label).where(F.col("_c").isin(*LANG)).select("doc_id", "_c", F.substring("text", at, F.lit(LONGEST)).alias("text"))
    wanted = wanted.withColumn("_c", F.when((F.col("_c") == "ja") & (latin > 0.5 * F.length("text")), "ja-latn").otherwise(F.col("_c")))
    order = Window.partitionBy("_c").orderBy(F.xxhash64("doc_id"), "text")
    chosen = wanted.select("_c", "text", "doc_id").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= sample)
    return fit([(r[0], r[1]) for r in chosen.select("_c", "text").collect()])


def _mixture(likelihood: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions and log-likelihood of a mixture over the columns, by expectation-maximisation."""
    top = likelihood.max(axis=1, keepdims=True)
    p = np.exp(np.maximum(likelihood - top, -600))
    share = np.full(likelihood.shape[1], 1 / likelihood.shape[1])
    for _ in range(20):
        joint = p * share
        new = (joint / joint.sum(axis=1, keepdims=True)).mean(axis=0)
        done = np.abs(new - share).max() < 1e-4
        share = new
        if done:
            break
    return share, float((top[:, 0] + np.log((p * share).sum(axis=1))).sum())


def infer(likelihood: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Classes of the language set, their shares and confidences, for sentences x classes log-likelihoods."""
    single = likelihood.sum(axis=0)
    order = np.argsort(-single)
    chosen = [int(order[0])]
    second = next(i for i in order if LANG[i] != LANG[order[0]])
    confidence = [1 / (1 + np.exp(-min(30.0, (single[order[0]] - single[second]) / 4)))]
    value = float(single[chosen[0]])
    share = np.ones(1)
    while len(chosen) < len(CLASSES):
        upper = np.maximum(likelihood, likelihood[:, chosen].max(axis=1, keepdims=True)).sum(axis=0)
        upper[chosen] = -np.inf
        best = int(np.argmax(upper))
        if upper[best] - value <= PENALTY:
            break
        new_share, new_value = _mixture(likelihood[:, [*chosen, best]])
        if new_value - value <= PENALTY:
            break
        confidence.append(1 / (1 + np.exp(-min(30.0, (new_value - value - PENALTY) / 4))))
        chosen.append(best)
        share, value = new_share, new_value
    return chosen, share, np.array(confidence)


def detect(texts: list[str], models: Models) -> list[tuple[list[tuple[str, float, float]], list[tuple[int, int, str, float]]]]:
    """Per text: its languages (lang, share, confidence) and its segments (start, end, lang, confidence)."""
    spans = [sentence_spans(t) for t in texts]
    units = [t[a:b] for t, s in zip(texts, spans) for a, b in s]
    if not units:
        return [([], [])] * len(texts)
    scores, foreign, letters, blanks = models.units(units)
    joined = np.isin(np.array(LANG)[scores.argmax(axis=1)], ("ja", "zh", "ko"))
    closed = np.fromiter((bool(_CLOSED.search(u[-8:])) for u in units), bool, len(units)) & (joined | (blanks > 1))
    whole = letters >= np.where(closed, np.where(joined, CLOSED_JOINED, CLOSED_SPACED), np.where(joined, LEAST_JOINED, LEAST_SPACED))
    sizes = np.fromiter(map(len, spans), np.int64, len(spans))
    owner = np.repeat(np.arange(len(spans)), sizes)
    none = np.bincount(owner, whole, len(spans)) == 0
    whole |= none[owner] & (letters > 0)  # a text without any whole sentence is judged by what it has

    # All texts at once: sums under every class, and the most that a second class could add to the best one.
    used = np.flatnonzero(whole)
    by = owner[used]
    first = np.flatnonzero(np.concatenate(([True], by[1:] != by[:-1]))) if len(used) else used
    there = by[first]
    single = np.add.reduceat(scores[used], first, axis=0) if len(used) else np.zeros((0, len(CLASSES)))
    best = single.argmax(axis=1)
    row = np.repeat(np.arange(len(there)), np.diff(np.append(first, len(used))))
    gain = np.add.reduceat(np.maximum(scores[used] - scores[used, best[row]][:, None], 0), first, axis=0).max(axis=1, initial=0) if len(used) else np.zeros(0)
    others = np.where(np.array(LANG)[None, :] == np.array(LANG)[best][:, None], -np.inf, single).max(axis=1, initial=-np.inf)
    top = single.max(axis=1, initial=-np.inf)
    lead = 1 / (1 + np.exp(-np.minimum(30.0, (top - others) / 4)))
    alien = np.bincount(owner, foreign, len(spans)) / np.maximum(np.bincount(owner, letters, len(spans)), 1)
    starts = np.concatenate(([0], np.cumsum(sizes)))

    results: list = [([], [])] * len(texts)
    for k, d in enumerate(there.tolist()):
        s = spans[d]
        if alien[d] > 0.5:
            sure = float(alien[d])
            results[d] = ([(UNDETERMINED, 1.0, sure)], [(s[0][0], s[-1][1], UNDETERMINED, sure)])
        elif gain[k] <= PENALTY:
            lang = LANG[best[k]]
            results[d] = ([(lang, 1.0, float(lead[k]))], [(s[0][0], s[-1][1], lang, 1.0)])
        else:
            part = slice(starts[d], starts[d + 1])
            results[d] = _mixed(s, scores[part], whole[part])
    return results


def _mixed(s: list[tuple[int, int]], own: np.ndarray, whole: np.ndarray) -> tuple[list[tuple[str, float, float]], list[tuple[int, int, str, float]]]:
    """Languages and segments of one text with sentences ``s`` that may mix several languages."""
    chosen, share, confidence = infer(own[whole])
    languages: dict[str, list[float]] = {}
    for k, w, c in zip(chosen, share, confidence):
        old = languages.setdefault(LANG[k], [0.0, 0.0])
        languages[LANG[k]] = [old[0] + float(w), max(old[1], float(c))]
    joint = own[:, chosen] + np.log(np.maximum(share, 1e-9))
    joint -= joint.max(axis=1, keepdims=True)
    posterior = np.exp(joint)
    posterior /= posterior.sum(axis=1, keepdims=True)
    which = [LANG[chosen[k]] for k in posterior.argmax(axis=1)]
    segments: list[list] = []
    for n, (a, b) in enumerate(s):
        lang = which[n] if whole[n] else segments[-1][2] if segments else which[int(np.flatnonzero(whole)[0])]
        sure = float(posterior[n].max()) if whole[n] else None
        if segments and segments[-1][2] == lang:
            segments[-1][1] = b
            if sure is not None:
                segments[-1][3].append(sure)
        else:
            segments.append([a, b, lang, [sure] if sure is not None else []])
    return [(lang, w, c) for lang, (w, c) in languages.items()], [(a, b, lang, float(np.mean(c)) if c else 0.5) for a, b, lang, c in segments]


LANGUAGES = "doc_id long, label string, lang string, share double, confidence double, n_langs int"
SEGMENTS = "doc_id long, seg_no int, start_pos int, end_pos int, lang string, confidence double"


def _detected(documents: DataFrame, models: Models, segments: bool) -> DataFrame:
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), canonical_label(F.col("lang")).alias("label"), "text").where(F.col("text").isNotNull())
    shared = documents.sparkSession.sparkContext.broadcast(models)
    names = ["doc_id", "seg_no", "start_pos", "end_pos", "lang", "confidence"] if segments else ["doc_id", "label", "lang", "share", "confidence", "n_langs"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64()] if segments else [pa.int64(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        for batch in batches:
            ids, labels, texts = (c.to_pylist() for c in batch.columns)
            out = []
            i = 0
            while i < len(ids):
                j, size = i, 0
                while j < len(ids) and (j == i or size + len(texts[j]) <= CHUNK):
                    size += len(texts[j])
                    j += 1
                for n, (languages, parts) in enumerate(detect(texts[i:j], models), i):
                    if segments:
                        out.extend((ids[n], k, a, b, lang, c) for k, (a, b, lang, c) in enumerate(parts, 1))
                    else:
                        out.extend((ids[n], labels[n], lang, w, c, len(languages)) for lang, w, c in languages)
                i = j
            columns = list(zip(*out)) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return spread(rows).mapInArrow(run, SEGMENTS if segments else LANGUAGES)


def document_languages(documents: DataFrame, models: Models) -> DataFrame:
    """doc_id, canonical label, and one row per language in the document with share and confidence."""
    return _detected(documents, models, segments=False)


def language_segments(documents: DataFrame, models: Models) -> DataFrame:
    """doc_id, seg_no and span of every stretch in one language, with its confidence."""
    return _detected(documents, models, segments=True)


def doubtful(languages: DataFrame) -> DataFrame:
    """Languages of documents whose label is missing or wrong, or that mix several languages; UNDETERMINED is none."""
    right = Window.partitionBy("doc_id")
    named = F.coalesce(F.col("label") == F.col("lang"), F.lit(False)).cast("int")
    return languages.where(F.col("lang") != UNDETERMINED).withColumn("_named", F.max(named).over(right)).where((F.col("n_langs") > 1) | (F.col("_named") == 0)).select("doc_id", "lang")
