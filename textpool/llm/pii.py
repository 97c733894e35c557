"""Personal data: fixed patterns for seeds, bootstrapped patterns for identifiers that no rule knows.

The base spans of a whole text are found by four rules. Tokens that look like
identifiers (they hold a digit or @) stand in lexical patterns; patterns and
tokens form a graph, scored round by round: a pattern is as good as the share
of known tokens in it, a token as good as its patterns. Seeds are the base
spans and tokens that look like keys (``looks_like_key``); keys of published
formats are spans of kind ``id`` wherever they stand. Tokens accepted in
a round support patterns in the next, until nothing new is accepted. Tokens in
patterns of high confidence, base spans apart, become spans of kind ``id``.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textpool.llm.common import SPACES, materialise

KINDS = ("email", "ip", "card", "phone")
FOUND = "id"
#: Added to a pattern's number of tokens, so that few tokens cannot make it sure.
PRIOR = 1.5
#: A pattern needs this score and so many distinct known tokens.
SURE, SUPPORT = 0.6, 3
#: Code points beside a token that its pattern words come from.
NEAR = 80
#: Published formats of keys (fixed values).
KEY_FORMATS = (
    r"AKIA[0-9A-Z]{16}",
    r"AIza[0-9A-Za-z_-]{35}",
    r"gh[pousr]_[0-9A-Za-z]{36}",
    r"github_pat_[0-9A-Za-z_]{22,}",
    r"glpat-[0-9A-Za-z_-]{20}",
    r"xox[abps]-[0-9A-Za-z-]{10,}",
)
#: A key of no published format has so many letters and digits, mixed.
KEY_LENGTH = 32

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Digits are taken whole and never given back, so a search stays linear in the text.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]")
_SPACE = re.compile(r"[\x20\x09-\x0D]")
#: Punctuation at the ends of a word.
_EDGES = string.punctuation + "«»“”„‘’…¿¡"
_KEY = re.compile(r"[A-Za-z0-9+/_-]+")
_PUBLISHED = re.compile("|".join(KEY_FORMATS))
_HEX = re.compile(r"[0-9A-Fa-f]+")
_ASSIGNED = re.compile(r"[A-Za-z_-]+[=:][\"'(\[<]*(?=[^/])")
_LABEL = re.compile(r"([^\W\d_](?:[\w.-]*[^\W_])?)[\"')\]]*\s*[=:#]+>?\s*[\"'(\[<]*$")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each @ outwards."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def cards(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _CARD.finditer(text) if 13 <= m.end() - m.start() <= 37 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the four kinds, in their order, each by start."""
    return [(k, *s) for k, find in zip(KINDS, (emails, ips, cards, phones), strict=True) for s in find(text)]


def identifier_tokens(text: str) -> list[tuple[int, int]]:
    """Tokens between white space that hold a digit or @, without punctuation at their ends or a name and mark (``key=``) before."""
    out, end = [], 0
    m = _MARK.search(text)
    while m:
        start = m.start()
        while start > end and not _SPACE.match(text[start - 1]):
            start -= 1
        stop = _SPACE.search(text, m.end())
        end = stop.start() if stop else len(text)
        a, b = start, end
        while a < b and not text[a].isalnum() and text[a] != "+":
            a += 1
        while b > a and not text[b - 1].isalnum():
            b -= 1
        named = _ASSIGNED.match(text, a, b)
        if named and _MARK.search(text, named.end(), b):
            a = named.end()
        if b - a >= 4:
            out.append((a, b))
        m = _MARK.search(text, end)
    return out


def looks_like_key(token: str) -> bool:
    """A key in a published format, or a long run that mixes letters and digits as random keys do."""
    if not _KEY.fullmatch(token):
        return False
    if _PUBLISHED.fullmatch(token):
        return True
    kinds = [c.isdigit() for c in token if c.isalnum()]
    return len(kinds) >= KEY_LENGTH and len(set(token.lower())) >= 10 and 8 * sum(x != y for x, y in itertools.pairwise(kinds)) >= len(kinds)


def shape(token: str) -> str:
    """The runs of character classes and their lengths; of many runs, the classes and the token's length."""
    if len(token) >= 16 and _HEX.fullmatch(token):
        return f"hex{len(token)}"
    kinds = ["0" if c.isdigit() else "a" if c.isalpha() else c for c in token]
    runs = [(k, len(list(g))) for k, g in itertools.groupby(kinds)]
    if len(runs) <= 6:
        return "".join(f"{k}{n}" if k in "0a" else k for k, n in runs)
    return "".join(sorted(set(kinds))) + str(len(token))


def _words(piece: str) -> list[str]:
    """Lower-cased words with letters and without a digit or @; other tokens between white space are passed over."""
    return [w for t in re.split(_SPACE, piece.lower()) if not _MARK.search(t) and any(c.isalpha() for c in t) and (w := t.strip(_EDGES))]


def contexts(text: str, start: int, end: int) -> list[str]:
    """Patterns of a token.

    The two words before it; the word before and the word after; the name
    before a mark (``name = _``); the word before and the token's shape.
    Words come from ``NEAR`` code points on each side; a word that this cuts
    is passed over.
    """
    low, high = max(0, start - NEAR), min(len(text), end + NEAR)
    before, after = text[low:start], text[end:high]
    if low and not _SPACE.match(text[low - 1]):
        cut = _SPACE.search(before)
        before = before[cut.end():] if cut else ""
    if high < len(text) and not _SPACE.match(text[high]):
        after = after[:max(after.rfind(c) for c in SPACES) + 1]
    left, right = _words(before), _words(after)
    out = [" ".join(left[-2:]) + " _"] if len(left) > 1 else []
    if left and right:
        out.append(left[-1] + " _ " + right[0])
    label = _LABEL.search(before)
    if label:
        out.append(label[1].lower() + " = _")
    if left:
        out.append(left[-1] + " _ " + shape(text[start:end]) + " .")
    return out


def _instance(token: str) -> str:
    return token.lower() if len(token) <= 64 else hashlib.md5(token.lower().encode()).hexdigest()


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans in order, overlapping ones as one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("k", pa.int32()), ("s", pa.int32()), ("e", pa.int32())]))
    token = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("inst", pa.string()), ("base", pa.bool_()), ("seed", pa.bool_()), ("known", pa.bool_()), ("ctx", pa.list_(pa.string()))]))
    for batch in batches:
        spans, tokens = [], []
        for text in batch.column(2).to_pylist():
            text = text or ""
            base = base_spans(text) if "@" in text or _MARK.search(text) else []
            spans.append([{"k": KINDS.index(k), "s": s, "e": e} for k, s, e in base])
            own, ranges, at = [], _merged([(s, e) for _, s, e in base]), 0
            for s, e in identifier_tokens(text):
                while at < len(ranges) and ranges[at][1] <= s:
                    at += 1
                fixed = at < len(ranges) and ranges[at][0] < e
                own.append({"s": s, "e": e, "inst": _instance(text[s:e]), "base": fixed, "seed": fixed or looks_like_key(text[s:e]),
                            "known": not fixed and _PUBLISHED.fullmatch(text, s, e) is not None, "ctx": contexts(text, s, e)})
            tokens.append(own)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, span), pa.array(tokens, token)],
                                         ["doc_id", "version", "base", "tokens"])


_SCAN_SCHEMA = ("doc_id long, version long, base array<struct<k:int,s:int,e:int>>, "
                "tokens array<struct<s:int,e:int,inst:string,base:boolean,seed:boolean,known:boolean,ctx:array<string>>>")


def sure_contexts(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(ctx, ctx_score) of the patterns of high confidence in ``edges(ctx, inst, seed)``, one row per pair.

    A seed has the score 1. A pattern's score is the sum of its known tokens'
    scores over its number of tokens plus ``PRIOR``; it is sure from ``SURE``
    on, with ``SUPPORT`` known tokens. A token of sure patterns is known from
    the next round on, its score the noisy-or of theirs. Scores only grow, so
    no pattern or token is lost again; rounds end when none is added. A round
    is two joins and aggregates on the graph, folded before they shuffle.
    """
    # a pattern with fewer tokens than SUPPORT is never sure; most patterns of prose are such
    enough = edges.groupBy("ctx").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= SUPPORT).drop("n")
    graph = materialise(spark, edges.join(enough, "ctx"), "pii-graph")
    unknown = graph.filter("NOT seed").drop("seed")
    scored, before = graph.withColumn("score", F.when(F.col("seed"), 1.0)), None
    while True:
        good = scored.groupBy("ctx").agg(
            F.round(F.sum("score") / (F.count(F.lit(1)) + F.lit(PRIOR)), 9).alias("ctx_score"), F.count("score").alias("known"))
        sure = materialise(spark, good.filter((F.col("ctx_score") >= SURE) & (F.col("known") >= SUPPORT)).drop("known"), "pii-contexts")
        told = materialise(spark, unknown.join(sure, "ctx").groupBy("inst").agg(
            F.round(1 - F.exp(F.sum(F.log(F.lit(1.0) - F.least(F.col("ctx_score"), F.lit(0.999))))), 9).alias("told")), "pii-tokens")
        now = (sure.count(), told.count())
        if now == before or not now[1]:
            return sure
        before = now
        scored = graph.join(told, "inst", "left").withColumn("score", F.when(F.col("seed"), 1.0).otherwise(F.col("told")))


def find_personal_data(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, base and found: arrays of spans ``(k, s, e)`` of every row of ``docs(doc_id, text)``.

    ``k`` indexes KINDS; spans of ``found`` are the method's, none overlaps a
    base span. A key of a published format is a seed and a span; another that
    looks like a key is a seed, but a span only where a pattern is sure of it.
    Identifiers without a digit or @ are not looked for. Offsets are code points, ends exclusive. A null text is empty.
    Repeated rows get equal spans; null ids are kept. An empty table gives an
    empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("version"), "text")
    scanned = materialise(spark, rows.mapInArrow(_scan, _SCAN_SCHEMA), "pii-scan")
    tokens = scanned.filter(F.size("tokens") > 0).select("doc_id", "version", F.explode("tokens").alias("t")).select(
        "doc_id", "version", "t.s", "t.e", "t.inst", "t.base", "t.seed", F.explode("t.ctx").alias("ctx"))
    edges = tokens.groupBy("ctx", "inst").agg(F.max("seed").alias("seed"))
    sure = sure_contexts(spark, edges)
    found = (tokens.filter("NOT base").join(sure, "ctx").groupBy("doc_id", "version")
             .agg(F.sort_array(F.collect_set(F.struct(F.lit(len(KINDS)).alias("k"), "s", "e"))).alias("found"))
             .withColumnRenamed("doc_id", "f_id").withColumnRenamed("version", "f_version"))
    same = F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("version") == F.col("f_version"))
    spans = "array<struct<k:int,s:int,e:int>>"
    keys = F.transform(F.filter("tokens", lambda t: t["known"]), lambda t: F.struct(F.lit(len(KINDS)).alias("k"), t["s"].alias("s"), t["e"].alias("e")))
    rows = scanned.select("doc_id", "version", "base", keys.cast(spans).alias("keys"))
    return rows.join(found, same, "left").select(
        "doc_id", "base", F.array_sort(F.array_union("keys", F.coalesce(F.col("found").cast(spans), F.array().cast(spans)))).alias("found"))


def pii_digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans: what the registered query returns."""
    found = find_personal_data(spark, docs.select("doc_id", "text"))
    names = F.array(*[F.lit(k) for k in (*KINDS, FOUND)])

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["k"]), s["s"].cast("string"), s["e"].cast("string"))), ",")

    def count(kind: int):
        return F.size(F.filter("base", lambda s: s["k"] == kind)).cast("long")

    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
                        joined(F.concat("base", "found")).alias("spans"))
