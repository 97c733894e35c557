"""L1: part-of-speech tagging as a pluggable Arrow table function, and aspects from its tags.

A tagger is a factory; called once per Python worker it gives a function from
a text to its tokens ``(token, lemma, pos, is_stop)``. ``SuffixTagger`` judges
each token by fixed rules. ``HmmTagger`` is learned from a table of tagged
sentences: counts of words, suffixes and neighbouring tags come from Spark,
the best tag sequence of a sentence from the Viterbi algorithm.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textpool.operators.aspects import ASPECT_BLACKLIST, MIN_ASPECT_CHARS
from textpool.operators.blocks import cut

NOUN_TAGS = ("NOUN", "PROPN")
TOKENS = "array<struct<token:string,lemma:string,pos:string,is_stop:boolean>>"
_FIELDS = [pa.field("token", pa.string()), pa.field("lemma", pa.string()), pa.field("pos", pa.string()), pa.field("is_stop", pa.bool_())]
#: Bytes of texts whose tokens a worker holds at a time.
SLICE_BYTES = 250_000
#: Common function words; a tagger's own list may be given instead.
STOP_WORDS = (
    "acaba ancak asla aslında ayrıca bana bazen bazı belki ben benim beri bir biraz birçok biz bize bizim bu buna bunu burada bütün "
    "böyle çünkü da daha de defa değil diğer diye dolayı en gibi göre hala hangi hep hepsi her hiç hem için ile ise kadar karşı kendi ki "
    "kim mı mi mu mü nasıl ne neden nerede niye o ona onlar onu orada oysa pek sanki sen senin siz size sizin şey şu tüm ve veya ya yani yine zaten").split()
#: Inflections that end a Turkish noun, longest first when matched.
LEMMA_SUFFIXES = (
    "larından lerinden larında lerinde larının lerinin larına lerine larını lerini lardan lerden larda lerde ların lerin lara lere ları leri "
    "larım lerim lar ler ından inden undan ünden ında inde unda ünde ının inin unun ünün ımız imiz umuz ümüz "
    "dan den tan ten nın nin nun nün da de ta te ya ye yı yi yu yü sı si su sü ım im um üm ın in un ün a e ı i u ü").split()
MIN_STEM = 3
_WORD = re.compile(r"[^\W_]+|_+|[.!?\n]")
_ENDS = frozenset(".!?\n")

Token = tuple[str, str, str, bool]
TextTagger = Callable[[str], Iterable[Token]]


def suffix_lemma(word: str, pattern: re.Pattern) -> str:
    """``word`` without its longest listed suffix, if at least ``MIN_STEM`` characters stay."""
    return pattern.sub(r"\1", word)


def lemma_pattern(suffixes: Iterable[str]) -> re.Pattern:
    ends = "|".join(map(re.escape, sorted(set(suffixes), key=lambda s: (-len(s), s))))
    return re.compile(rf"^(.{{{MIN_STEM},}}?)(?:{ends})$", re.DOTALL)


class SuffixTagger:
    """Capitalised tokens are PROPN, tokens with one of ``noun_suffixes`` are NOUN, all others X; lemmas by suffix rules."""

    def __init__(self, noun_suffixes: Iterable[str], lemma_suffixes: Iterable[str] = LEMMA_SUFFIXES, stop_words: Iterable[str] = STOP_WORDS):
        self.noun_suffixes, self.lemma_suffixes, self.stop_words = tuple(noun_suffixes), tuple(lemma_suffixes), frozenset(stop_words)

    def __call__(self) -> TextTagger:
        words, lemmas = re.compile(r"\w+"), lemma_pattern(self.lemma_suffixes)

        def tag(text: str) -> Iterator[Token]:
            for word in words.findall(text):
                low = word.lower()
                pos = "PROPN" if word[0].isupper() else "NOUN" if low.endswith(self.noun_suffixes) else "X"
                yield word, suffix_lemma(low, lemmas), pos, low in self.stop_words

        return tag


class HmmTagger:
    """First-order tagger; a word that was not seen is judged by its longest seen suffixes and its capital letter."""

    def __init__(self, tags: list[str], start: dict, moves: dict, words: dict, suffixes: dict, lemma_suffixes=LEMMA_SUFFIXES,
                 stop_words: Iterable[str] = STOP_WORDS, longest: int = 4):
        self.tags, self.start, self.moves, self.words, self.suffixes = tags, start, moves, words, suffixes
        self.lemma_suffixes, self.stop_words, self.longest = tuple(lemma_suffixes), frozenset(stop_words), longest

    def _emissions(self, word: str, first: bool) -> list[float]:
        """log P(tag | word) - log P(tag), which ranks tags as log P(word | tag) does."""
        low, n = word.lower(), len(self.tags)
        prior = self.suffixes[""]
        total = sum(prior)
        share = [(c + 1) / (total + n) for c in prior]
        guess = share
        for k in range(1, self.longest + 1):  # longer suffixes refine the shares of shorter ones
            counts = self.suffixes.get(low[-k:]) if len(low) > k else None
            if counts is None:
                break
            guess = [(c + 2 * g) / (sum(counts) + 2) for c, g in zip(counts, guess, strict=True)]
        if not first and word[:1].isupper() and "PROPN" in self.tags:
            guess = [0.9 * (t == "PROPN") + 0.1 * g for t, g in zip(self.tags, guess, strict=True)]
        seen = self.words.get(low)
        if seen is not None:
            guess = [(c + 0.5 * g) / (sum(seen) + 0.5) for c, g in zip(seen, guess, strict=True)]
        return [math.log(g / s) for g, s in zip(guess, share, strict=True)]

    def _best_path(self, sentence: list[str]) -> list[str]:
        n = len(self.tags)
        move = lambda counts: [math.log((c + 0.5) / (sum(counts) + 0.5 * n)) for c in counts]
        table = [move(self.moves.get(t, [0] * n)) for t in self.tags]
        score = [s + e for s, e in zip(move(self.start), self._emissions(sentence[0], True), strict=True)]
        back = []
        for word in sentence[1:]:
            emitted = self._emissions(word, False)
            best = [max(range(n), key=lambda i, j=j: score[i] + table[i][j]) for j in range(n)]
            score = [score[best[j]] + table[best[j]][j] + emitted[j] for j in range(n)]
            back.append(best)
        at = max(range(n), key=score.__getitem__)
        path = [at]
        for best in reversed(back):
            at = best[at]
            path.append(at)
        return [self.tags[i] for i in reversed(path)]

    def __call__(self) -> TextTagger:
        lemmas = lemma_pattern(self.lemma_suffixes)

        def tag(text: str) -> Iterator[Token]:
            sentence: list[str] = []
            for word in [*_WORD.findall(text), "."]:
                if word not in _ENDS:
                    sentence.append(word)
                elif sentence:
                    for w, pos in zip(sentence, self._best_path(sentence), strict=True):
                        low = w.lower()
                        yield w, suffix_lemma(low, lemmas), pos, low in self.stop_words
                    sentence = []

        return tag


def fit_hmm(tagged: DataFrame, longest: int = 4, **options) -> HmmTagger:
    """A tagger learned from ``tagged(sentence, position, word, tag)``, a table labelled by hand.

    Counting is distributed; the counts, bounded by that table's words, tags
    and suffixes, travel with the tagger.
    """
    low = F.lower("word")
    rows = tagged.select("sentence", "position", low.alias("word"), "tag")
    before = F.lag("tag").over(Window.partitionBy("sentence").orderBy("position"))
    moves = rows.select(before.alias("before"), "tag").groupBy("before", "tag").agg(F.count(F.lit(1)).alias("n")).collect()
    words = rows.groupBy("word", "tag").agg(F.count(F.lit(1)).alias("n")).collect()
    ends = F.transform(F.sequence(F.lit(0), F.least(F.lit(longest), F.length("word") - 1)), lambda k: F.right(F.col("word"), k))
    suffixes = rows.select(F.explode(ends).alias("suffix"), "tag").groupBy("suffix", "tag").agg(F.count(F.lit(1)).alias("n")).collect()
    tags = sorted({r.tag for r in words})
    if not tags:
        raise ValueError("no tagged words to learn from")
    at = {t: i for i, t in enumerate(tags)}

    def table(counted, key):
        out: dict = {}
        for r in counted:
            out.setdefault(r[key], [0] * len(tags))[at[r.tag]] += r.n
        return out

    follow = table(moves, "before")
    start = follow.pop(None)
    return HmmTagger(tags, start, follow, table(words, "word"), table(suffixes, "suffix"), longest=longest, **options)


def tag_tokens(text: Column, tagger: Callable[[], TextTagger]) -> Column:
    """The tokens of each text (null text: none), as ``array<struct<token, lemma, pos, is_stop>>``.

    A worker holds the tokens of a slice of a batch at a time.
    """
    @F.arrow_udf(TOKENS)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tag = tagger()
        for batch in batches:
            for texts in cut(batch, SLICE_BYTES):
                found, sizes = [], [0]
                for x in texts:
                    found.extend(tag(x.as_py()) if x.is_valid else ())
                    sizes.append(len(found))
                columns = [pa.array([t[i] for t in found], f.type) for i, f in enumerate(_FIELDS)]
                yield pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays(columns, fields=_FIELDS))

    return run(text)


def aspects_of_tokens(tokens: Column) -> Column:
    """L1: distinct noun tokens that are no stop word, whose lemma and surface form are not in the blacklist, of at least 3 characters."""
    def keep(t):
        low = F.lower(t["token"])
        return (t["pos"].isin(*NOUN_TAGS) & ~t["is_stop"] & (F.length(low) >= MIN_ASPECT_CHARS)
                & ~F.lower(t["lemma"]).isin(*ASPECT_BLACKLIST) & ~low.isin(*ASPECT_BLACKLIST))
    return F.array_distinct(F.transform(F.filter(tokens, keep), lambda t: t["token"]))
