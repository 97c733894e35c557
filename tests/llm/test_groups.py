"""Hot groups of operator 7, and the models of operator 8 against an independent definition."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textpool.llm import langid, ngram_join


# hot groups of the Jaccard join

def _counted(texts, n_buckets):
    """(f, shared) as step 1 counts them, and by brute force, with each text a batch of its own or all in one."""
    out = []
    for batches in ([texts], [[t] for t in texts]):
        rows = [r for b in ngram_join._postings(n_buckets)(iter([pa.RecordBatch.from_arrays([pa.array(x)], ["text"]) for x in batches]))
                for r in b.to_pylist()]
        found = Counter()
        for bucket in {r["bucket"] for r in rows}:
            group = pa.table({"bucket": pa.array([r["bucket"] for r in rows if r["bucket"] == bucket], pa.int32()),
                              "payload": pa.array([r["payload"] for r in rows if r["bucket"] == bucket], pa.binary())})
            for r in ngram_join._count_shared(group).to_pylist():
                found[r["f"] % 2**64] += r["shared"]
        out.append((rows, found))
    sets = {}
    for first, last, h, rows in ngram_join.shingle_sets(pa.array(texts)):
        start, _, f = ngram_join._fingerprints(h, rows, first, last)
        sets.update({int(f[i]): {int(x) for x in h[start[i]:start[i + 1]] if x < ngram_join._REGION_END} for i in range(last - first)})
    held = Counter(x for s in sets.values() for x in s)
    return out, {f: sum(held[x] > 1 for x in s) for f, s in sets.items()}


def test_shared_tokens_of_one_slab_are_dealt_by_class():
    rng = random.Random(11)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [f"{passage} " + " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(20)) for _ in range(400)]
    ((one, together), (_, apart)), want = _counted(texts, 12)
    want = {f: n for f, n in want.items() if n}
    assert dict(together) == dict(apart) == want
    sizes = Counter()
    for r in one:
        sizes[r["bucket"]] += len(ngram_join._unpack(r["payload"])[0])
    known = [n for b, n in sizes.items() if b < 0]
    assert len(known) == 12 and max(known) < 2 * sum(known) / 12  # the passage's tokens are spread over all


def test_a_class_with_many_pairs_is_verified_in_many_parts(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "PART", 5)
    base = np.arange(100, dtype=np.uint64)
    sets = [(0, 100, base.tobytes())] + [(i, 100, np.r_[base[: 90 if i % 2 else 60], base[: 10 if i % 2 else 40] + np.uint64(1000 * i)].tobytes()) for i in range(1, 60)]
    sets = spark.createDataFrame([(f, n, bytearray(t)) for f, n, t in sets], "f long, n int, tokens binary")
    pairs = spark.createDataFrame([(0, i) for i in range(1, 60)] + [(1, 2), (1, 3)], "a long, b long")
    got = {tuple(r) for r in ngram_join.verified(pairs, sets, 61).collect()}
    assert got == {(0, i) for i in range(1, 60, 2)} | {(1, 3)}


def test_one_text_copied_very_often_is_one_set(spark):
    text = " ".join(f"w{i}" for i in range(30))
    near = text.replace("w29", "other")
    docs = spark.range(100_000).select(F.col("id").alias("doc_id"), F.lit(text).alias("text")).union(
        spark.createDataFrame([(-1, near), (-2, "something else than this text altogether")], "doc_id long, text string")).union(
        spark.range(500).select(F.lit(None).cast("long"), F.lit(near)))
    got = ngram_join.near_copies(spark, docs).groupBy("component_id", "n_shingles").count().collect()
    assert {(r.component_id, r.n_shingles, r["count"]) for r in got} == {(-1, 26, 100_501), (-2, 2, 1)}


# language models against an independent Kneser-Ney, and with many languages

def _brute_log_p(texts, letters, gram):
    """log p of the last symbol of ``gram`` by the recursive definition; symbols are code points, 0 the boundary."""
    grams = Counter()
    for t in texts:
        s = [0] * 3 + [ord(c) % 65521 + 1 if c.isalpha() else 0 for c in re.sub(r"[\W\d_]+", " ", t.lower())] + [0]
        s = s[:3] + [x for i, x in enumerate(s[3:], 3) if x or s[i - 1] or i == 3]
        grams.update(tuple(s[i - 3:i + 1]) for i in range(3, len(s)))
    orders = {4: grams}
    for n in (3, 2, 1):
        orders[n] = Counter(g[1:] for g in orders[n + 1])

    def p(g):
        if not g:
            return 1 / (letters + 1)
        c = orders[len(g)]
        own = {x: k for x, k in c.items() if x[:-1] == g[:-1]}
        if not own:
            return p(g[1:])
        n1, n2 = (sum(v == k for v in c.values()) for k in (1, 2))
        d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        total = sum(own.values())
        return max(own.get(g, 0) - d, 0) / total + d * len(own) / total * p(g[1:])

    return math.log(p(gram))


def test_models_equal_an_independent_kneser_ney():
    texts = {"a": ["the rain in the plain", "rain again"], "b": ["der regen in der ebene", "regen regen"], "c": ["xyz"]}
    counts = {lang: np.unique(langid.symbols(t)[0], return_counts=True) for lang, t in texts.items()}
    model = langid.estimate(list(texts), counts)
    letters = len({int(k) & 0xFFFF for keys, _ in counts.values() for k in keys})
    keys = np.unique(langid.symbols(["the regen xyz plain ö", "zzz"])[0])
    got = model.log_p(keys)
    for row, key in zip(got, keys.tolist(), strict=True):
        gram = tuple(key >> 16 * j & 0xFFFF for j in (3, 2, 1, 0))
        assert np.allclose(row, [_brute_log_p(t, letters, gram) for t in texts.values()], atol=1e-4), gram


def test_a_hundred_languages_hold_their_own_entries_only(spark):
    rng = random.Random(12)
    words = {f"l{i:03}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 8))) for _ in range(25)] for i in range(100)}
    rows = [(1000 * i + j, " ".join(rng.choice(w) for _ in range(30)), lang) for i, (lang, w) in enumerate(words.items()) for j in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(spark, docs)
    assert len(model.langs) == 100
    keys, _, lang, value = model.grams[langid.ORDER]
    assert len(lang) == len(value) < 5 * len(keys)
    got = langid.langid_digest(spark, docs).filter("held_out").join(docs, "doc_id").collect()
    assert len(got) > 300 and sum(r.lang == r.lang_pred for r in got) >= 0.99 * len(got)


def test_too_many_counts_are_refused(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_COUNTS", 10)
    docs = spark.createDataFrame([(i, "a text of some letters", "en") for i in range(8)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        langid.fit(spark, docs)
