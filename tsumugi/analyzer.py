"""One object for the usual ways of analysing texts, all of them batched over DataFrames.

The analyzer is immutable: adding or removing words, or switching options, gives a new one.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsumugi import __version__
from tsumugi.functions.features import token_dict
from tsumugi.functions.phonetic import token_ipa
from tsumugi.operators import exports, vectors, viterbi
from tsumugi.operators.entities import disambiguate
from tsumugi.operators.lexicon import Lexicon

FORMATS = ("plain", "wakati", "dump", "json", "jsonld", "turtle", "ntriples", "nquads", "word_ids")


@dataclass(frozen=True)
class Analyzer:
    """A lexicon with optional entities (surface, uri, confidence) and vectors (word_id, embedding)."""

    lexicon: Lexicon
    ipa: bool = False
    entities: DataFrame | None = None
    vectors: DataFrame | None = None
    strategy: str = "highest"
    most_entities: int = 5

    def with_ipa(self, on: bool = True) -> Analyzer:
        return replace(self, ipa=on)

    def with_entities(self, entities: DataFrame, strategy: str = "none", most: int = 5) -> Analyzer:
        return replace(self, entities=entities, strategy=strategy, most_entities=most)

    def with_vectors(self, table: DataFrame) -> Analyzer:
        return replace(self, vectors=table)

    def add_word(self, surface: str, reading: str, pronunciation: str, cost: int) -> Analyzer:
        return replace(self, lexicon=self.lexicon.add_words([(surface, reading, pronunciation, cost)]))

    def remove_word(self, surface: str) -> Analyzer:
        return replace(self, lexicon=self.lexicon.remove_words([surface]))

    def overlay_size(self) -> int:
        return self.lexicon.overlay_size()

    def tokens(self, texts: DataFrame, k: int = 1) -> DataFrame:
        """Tokens of the k best paths of (text_id, text), enriched as the options say."""
        out = viterbi.tokenize(texts, self.lexicon, k)
        if self.ipa:
            out = out.withColumn("ipa", token_ipa("feature"))
        if self.entities is not None:
            ranked = disambiguate(self.entities, ["surface"], self.strategy, "uri")
            best = ranked.where(F.col("rank_no") <= self.most_entities).groupBy("surface").agg(F.array_sort(F.collect_list(F.struct("rank_no", "uri", "confidence"))).alias("e"))
            links = F.transform("e", lambda e: F.struct(e["uri"].alias("uri"), e["confidence"].alias("confidence")))
            out = out.join(best.select("surface", links.alias("entities")), "surface", "left")
        if self.vectors is not None:
            out = vectors.lookup(out, self.vectors)
        return out

    def parse(self, texts: DataFrame, format: str = "plain") -> DataFrame:
        """(text_id, <format>) documents; triples formats give one row (text_id, token_ix, line) each."""
        if format not in FORMATS:
            raise ValueError(f"format must be one of {', '.join(FORMATS)}")
        tokens = self.tokens(texts)
        if format in ("ntriples", "nquads"):
            return getattr(exports, format)(exports.triples(tokens))
        return getattr(exports, format)(tokens)

    def wakati(self, texts: DataFrame) -> DataFrame:
        return self.parse(texts, "wakati")

    def n_best(self, texts: DataFrame, k: int) -> DataFrame:
        return exports.n_best(self.tokens(texts, k))

    def to_dicts(self, texts: DataFrame) -> DataFrame:
        """text_id, token_ix and a struct of the token's members."""
        return self.tokens(texts).select("text_id", "token_ix", token_dict(F.col("surface"), F.col("feature")).alias("token"))

    def to_ipa(self, texts: DataFrame, separator: str = " ") -> DataFrame:
        """IPA of each text, tokens without one left out."""
        spoken = viterbi.tokenize(texts, self.lexicon).withColumn("ipa", token_ipa("feature")).where(F.col("ipa").isNotNull())
        parts = F.array_sort(F.collect_list(F.struct("token_ix", "ipa"))).getField("ipa")
        return spoken.groupBy("text_id").agg(F.array_join(parts, separator).alias("ipa"))

    def similarity(self, pairs: DataFrame) -> DataFrame:
        """Cosine of the first tokens' vectors of (text_id, word_a, word_b)."""
        if self.vectors is None:
            raise ValueError("similarity needs vectors")
        sides = [self._first(pairs.select("text_id", F.col(c).alias("text")), name) for c, name in (("word_a", "a"), ("word_b", "b"))]
        cosine: Column = vectors.cosine(F.col("a"), F.col("b"))
        return pairs.select("text_id", "word_a", "word_b").join(sides[0], "text_id", "left").join(sides[1], "text_id", "left").select("text_id", "word_a", "word_b", cosine.alias("similarity"))

    def _first(self, texts: DataFrame, name: str) -> DataFrame:
        first = viterbi.tokenize(texts, self.lexicon).where(F.col("token_ix") == 0)
        return vectors.lookup(first, self.vectors).select("text_id", F.col("embedding").alias(name))


def version() -> str:
    return __version__
