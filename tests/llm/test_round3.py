"""Operators 11 to 13 against brute force, and on odd rows."""

import base64
import collections
import gzip
import hashlib
import itertools
import json
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from textpool.llm import embed_dedup, filter_audit, html_extract, spelling, tool_chat, url_filter, warc
from textpool.session import scratch_path

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LABEL = "doc_id long, quality int, toxic int"
PAGE = "page_id long, url string, html string"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# 11

def brute_words(docs):
    counts = collections.Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(docs):
    n = brute_words(docs)
    near = {w: [o for o in n if o != w and abs(len(o) - len(w)) < 2 and one_edit(w, o)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def spelling_docs():
    rng = random.Random(5)
    base = ["colour", "balloon", "aaaaa", "aaaaaa", "bookkeeper", "naïvetés", "straße"]
    texts = []
    for i in range(120):
        words = []
        for _ in range(60):
            w = rng.choice(base[: 1 + rng.randrange(len(base))])
            if rng.random() < 0.4:
                at, kind = rng.randrange(len(w)), rng.randrange(3)
                c = rng.choice("aeloûß")
                w = w[:at] + (c + w[at:] if kind == 0 else w[at + 1:] if kind == 1 else c + w[at + 1:])
            words.append(w.upper() if rng.random() < 0.1 else w)
        texts.append((i, rng.choice(" .,1×") .join(words)))
    texts.append((300, "gardensss " * 4 + "gardenss " * 9 + "gardens " * 25 + "garden " * 60))
    long = "".join(rng.choice("abcde") for _ in range(4000))
    texts += [(500, f"{long} {long}x {long[:-1]} {long}"), (501, f"{long} {long}x {long[:-1]}"), (502, f"{long}x {long[:-1]}"),
              (None, "nowhere nowhere nowhere nowhare nowhare nowhare"), (None, None), (7, ""), (7, "colour " * 50), (7, "colour " * 50)]
    return texts


def test_spelling_variants_match_brute_force(spark):
    docs = spelling_docs()
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, id int, word string").repartition(5)
    got = spelling.spelling_variants(spark, df).select("word", "form", "root", "n", "n_near", "form_n")
    want = brute_variants(docs)
    assert len(want) > 100 and any(w[1] is not None and w[2] != w[1] for w in want)
    assert rows_of(got) == want


def test_trie_numbers_do_not_depend_on_ranges(spark):
    """The same prefix has one number, whichever range partitions the words fall in, and different prefixes have two."""
    words = sorted({"".join(p) for k in (5, 6) for p in itertools.product("ab", repeat=k)})
    counts = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    for parts in (1, 9):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            rows = spelling.numbered_words(spark, counts).orderBy("id").collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
        assert [r.word for r in rows] == words and [r.id for r in rows] == list(range(len(words)))
        numbers = {}
        for r in rows:
            for depth, node in enumerate(r.nodes):
                assert numbers.setdefault(r.word[:depth], node) == node
        assert sorted(numbers.values()) == list(range(len(numbers)))


def test_spelling_of_empty_tables(spark):
    docs = spark.createDataFrame([], DOC)
    assert spelling.spelling_variants(spark, docs).count() == 0
    assert spelling.spelling_variants(spark, spark.createDataFrame([(1, None), (2, "a bc def")], "doc_id long, text string")).count() == 0


# 12

def brute_audit(docs, labels):
    rows, parts = [], sorted({s or "" for _, _, s in docs})
    key = lambda i: float("inf") if i is None else i
    for i, text, source in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
                 "D": bool(re.search(r"[#$%&*|]", t)), "E": any((u or "") == t and key(j) < key(i) for j, u, _ in docs)}
        rows.append((source or "", fails, any(i is not None and j == i and q == 1 for j, q, _ in labels),
                     any(i is not None and j == i and x == 1 for j, _, x in labels)))
    out, removed = [], collections.Counter()
    for part in parts:
        mine = [r for r in rows if r[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = list(mine)
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                removed[part, f] += len(gone)
                out.append([part, "".join(order), step, len(left), len(gone), sum(r[1][f] for r in mine) - len(gone),
                            sum(r[1][f] and sum(r[1].values()) == 1 for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)])
    return sorted((tuple([*r, removed[r[0], r[1][r[2] - 1]]]) for r in out), key=repr)


def test_filter_audit_matches_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)]
    docs = []
    for i in range(60):
        text = " ".join(rng.choice(vocabulary[: rng.choice((20, 400))]) for _ in range(rng.choice((150, 250))))
        text = text.upper() if rng.random() < 0.2 else text
        docs.append((i, text + ("$" if rng.random() < 0.2 else ""), rng.choice(("a", "b", None))))
    docs += [(100 + i, rng.choice(docs[:30])[1], "a") for i in range(20)]
    docs += [(None, None, "b"), (None, "", ""), (3, docs[3][1], "a"), (-5, docs[4][1], "c"), (None, docs[5][1], None)]
    labels = [(i, rng.choice((0, 1, None)), rng.choice((0, 1, None))) for i in range(40)] + [(1, 1, 1), (1, 0, 0), (None, 1, 1), (9999, 1, 1)]
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, source string, rid int, part string").repartition(3)
    got = filter_audit.audit_filters(spark, frame, spark.createDataFrame(labels, LABEL))
    columns = "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    assert rows_of(got.select(*columns)) == brute_audit(docs, labels)


def test_filter_audit_of_clean_and_empty_tables(spark):
    none = spark.createDataFrame([], LABEL)
    assert filter_audit.audit_filters(spark, spark.createDataFrame([], DOC), none).count() == 0
    text = " ".join(f"w{i}" for i in range(300))
    clean = spark.createDataFrame([(1, text, "en", "a", 1)], DOC)
    rows = filter_audit.audit_filters(spark, clean, none).collect()
    assert len(rows) == 600 and {(r.kept, r.removed, r.redundant, r.shapley) for r in rows} == {(1, 0, 0, 0)}


def test_one_text_copied_many_times_is_dealt_over_keys(spark):
    rows = spark.range(3000).select(F.col("id").alias("rid"), F.col("id").alias("doc_id"), F.unhex(F.lit("ab")).alias("digest"))
    assert filter_audit.later_copies(rows).count() == 2999


# 13

def b32(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


PAGES = [(5, "http://a.org/x", "<p>same</p>"), (3, "http://b.org/y", "<p>same</p>"), (9, "http://é.org/\r\nWARC-Type: x", "<p>é\r\n\r\nWARC/1.1\r\n\r\n</p>"),
         (11, None, None), (12, "http://c.org", ""), (None, "http://d.org", "<p>same</p>"), (None, None, "only here"),
         (3, "http://b.org/y", "<p>same</p>"), (20, "u", "x" * 300_000), (21, "u", "x" * 300_000), (22, "u", "\r\n\r\n"), (23, "u", "\x1f\x8b\x00")]


def brute_archive():
    key = lambda i: float("inf") if i is None else i
    seen, out = {}, []
    for i, _, html in sorted(PAGES, key=lambda p: key(p[0])):
        payload = (html or "").encode()
        first = payload not in seen
        seen.setdefault(payload, i)
        out.append((i, len(payload), b32(payload), "response" if first else "revisit", None if first else seen[payload]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("archive_bytes", [1, 1 << 20])
def test_archives_match_brute_force(spark, monkeypatch, archive_bytes):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", archive_bytes)
    pages = spark.createDataFrame([(*p, 1, "x") for p in PAGES], PAGE + ", payload int, digest string").repartition(3)
    assert rows_of(warc.archive_digest(spark, pages)) == brute_archive()


def test_archives_of_no_pages(spark):
    assert warc.archive_digest(spark, spark.createDataFrame([], PAGE)).count() == 0


def test_record_round_trip():
    rec = {"record_id": "urn:page:1:0", "record_type": "response", "uri": "http://x/\n", "digest": None, "payload_bytes": None,
           "refers_to": None, "refers_uri": None, "payload": bytes(range(256)) * 3 + b"\r\n\r\nWARC/1.1"}
    copy = {**rec, "record_id": "urn:page:2:0", "record_type": "revisit", "payload": None, "digest": b32(rec["payload"]),
            "payload_bytes": 780, "refers_to": rec["record_id"], "refers_uri": "http://x/"}
    info = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:i>\r\nContent-Length: 2\r\n\r\nhi"
    data = gzip.compress(warc.BREAK.join([info, warc.format_record(rec), warc.format_record(copy)]) + warc.BREAK)
    first, second = warc.parse_records(data)
    assert first["payload"] == rec["payload"] and first["digest"] == b32(rec["payload"]) and first["uri"] == "http://x/%0A"
    assert (second["record_type"], second["refers_to"], second["digest"], second["payload"]) == ("revisit", "urn:page:1:0", b32(rec["payload"]), None)


def test_revisits_of_given_archives_are_resolved(spark):
    """Archives that hold revisits already: those with a response here refer to the first one, others stay as they are."""
    blank = dict.fromkeys(("uri", "digest", "payload_bytes", "refers_to", "refers_uri", "payload"))
    records = [{**blank, "record_id": "urn:page:7:0", "record_type": "response", "payload": b"body"},
               {**blank, "record_id": "urn:page:2:1", "record_type": "revisit", "digest": b32(b"body"), "refers_to": "urn:elsewhere"},
               {**blank, "record_id": "urn:page:4:2", "record_type": "response", "payload": b"body"},
               {**blank, "record_id": "urn:page:8:3", "record_type": "revisit", "digest": b32(b"lost"), "refers_to": "urn:elsewhere"},
               {**blank, "record_id": "urn:other", "record_type": "revisit", "refers_to": "urn:elsewhere"}]
    raw, out = scratch_path(spark, "raw"), scratch_path(spark, "out")
    warc.write_archives(spark.createDataFrame(records, warc.RECORD), raw)
    warc.dedup_archives(spark, raw, out)
    got = {r.record_id: (r.record_type, r.refers_to, r.payload) for r in warc.read_archives(spark, out, payloads=True).collect()}
    assert got == {"urn:page:4:2": ("response", None, b"body"), "urn:page:7:0": ("revisit", "urn:page:4:2", None),
                   "urn:page:2:1": ("revisit", "urn:page:4:2", None), "urn:page:8:3": ("revisit", "urn:elsewhere", None),
                   "urn:other": ("revisit", "urn:elsewhere", None)}


# 6, pages without an article element

HELD_OUT = "bHPSPPQc llHPPPSPkkkc bwHPQPPtt wHPSPPHPPc lbHQPPSPc HPPPP bHPPPtPc llPPSPPl kkHPSPPc bbHPPHSPPkkc tHPQPt cHPPPSPPb".split()


def used(tree):
    return set() if len(tree) == 1 else {html_extract.FEATURES[tree[0]]} | used(tree[2]) | used(tree[3])


def test_tree_uses_links_words_and_neighbours_and_judges_unseen_pages(spark):
    tree = html_extract.train(spark)
    marked, unmarked = tree[2], tree[3]
    assert used(marked) == {"in_article", "aside"}  # an article's blocks stay whatever their words
    assert "links" in used(unmarked) and "words" in used(unmarked) and any("before" in f or "after" in f for f in used(unmarked))
    hit = wrong = missed = 0
    for turn, outline in enumerate(HELD_OUT):
        html, labels = html_extract.outline_page(outline, turn + 5)
        got = html_extract.judge(tree, html_extract.features(html_extract.blocks(html)))
        for ok, label in zip(got, labels, strict=True):
            hit, wrong, missed = hit + (ok and label == "1"), wrong + (ok and label == "0"), missed + (not ok and label == "1")
    f1 = 2 * hit / (2 * hit + wrong + missed)
    print("block F1 on held-out outlines", round(f1, 3), used(unmarked))
    assert f1 >= 0.9


def test_pages_without_an_article(spark):
    long = "A paragraph of the page with more than a dozen of words, so that it looks like text."
    menu = "<div><a href=/1>Home</a></div><div><a href=/2>News</a></div>"
    pages = [f"<body>{menu}<h1>Title here</h1><div>{long}</div><div>Second one here.</div><div>{long} {long}</div><div><a href=/3>Next page of it</a></div></body>",
             f"<article><p>{long}</p><div class='reader-response'><p>User: a long comment of many words which was left below the text.</p></div></article>"]
    df = spark.createDataFrame([(i, "u", h) for i, h in enumerate(pages)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(spark, df).collect()}
    assert got == {0: f"Title here\n{long}\nSecond one here.\n{long} {long}", 1: long}


# 2

def test_scores_are_the_closed_form_on_a_graph_with_cycles(spark):
    rng = random.Random(9)
    hosts = [f"h{i}.net" for i in range(25)] + ["good.org", "bad.com"]
    html = {h: "".join(f'<{t} href="//{o}/x">' for t, o in zip(("a", "area", "link"), rng.sample([x for x in hosts if x != h], 3), strict=True))
            for h in hosts}
    pages = spark.createDataFrame([(i, f"http://{h}/" + ("de/1" if h == "bad.com" else ""), html[h]) for i, h in enumerate(hosts)]
                                  + [(99, "http://good.org/2", html["good.org"])], PAGE)
    got = {r.host: r for r in url_filter.judge_urls(spark, pages).collect()}
    weight = collections.Counter()
    for h in hosts:
        for o in re.findall("//([^/]+)/x", html[h]):
            weight[h, o] += 2 if h == "good.org" else 1
    names = sorted(got)
    at = {n: i for i, n in enumerate(names)}
    m = np.zeros((len(names),) * 2)
    for (a, b), k in weight.items():
        m[at[b], at[a]] += k
    d = url_filter.DAMPING
    for column, matrix, seed in (("trust", m, "good.org"), ("distrust", m.T, "bad.com")):
        sums = matrix.sum(axis=0)
        step = np.divide(matrix, sums, out=np.zeros_like(matrix), where=sums > 0)
        want = np.linalg.solve(np.eye(len(names)) - d * step, (1 - d) * np.array([float(n == seed) for n in names]))
        assert max(abs(got[n][column] - want[at[n]]) for n in names) < 1e-6


def test_no_link_no_verdict_from_a_shared_parent_domain(spark):
    pages = spark.createDataFrame([(1, "http://a.co.uk/", "<a href='/x'>"), (2, "http://b.co.uk/", None), (3, "http://bad.com/de/x", "<base href='http://a.co.uk/'>")], PAGE)
    assert {(r.src, r.dst) for r in url_filter.host_edges(pages).collect()} == {("bad.com", "a.co.uk")}
    assert {r.host: r.verdict for r in url_filter.judge_urls(spark, pages).collect()} == {"a.co.uk": "allow", "b.co.uk": "allow", "bad.com": "block"}
    assert ("b.co.uk", "co.uk") in {(r.src, r.dst) for r in url_filter.host_edges(pages, families=True).collect()}


# 3, 9

@pytest.mark.parametrize("kind,labels", [("long", (1 << 40, 7)), ("string", ("a", "b")), ("decimal(20,2)", (None, None))])
def test_labels_of_other_types(spark, kind, labels):
    rows = [(1, [1.0, 0.0, 0.2, 0.1], 0), (2, [1.0, 0.01, 0.2, 0.1], 0), (3, [1.0, 0.0, 0.2, 0.1], 1), (None, [0.0, 0.0, 1.0, 0.0], 0), (5, [1.0, 0.0, 0.2, 0.1], 0)]
    df = spark.createDataFrame([(i, v, k) for i, v, k in rows], "vec_id long, embedding array<float>, k int")
    label = F.when(F.col("k") == 0, F.lit(labels[0])).otherwise(F.lit(labels[1])).cast(kind) if labels[0] is not None else F.col("k").cast(kind)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.near_vectors(spark, df.withColumn("label", label)).collect()}
    assert got[1] == (2, 1, True) and got[2] == (2, 1, False) and got[5] == (2, 1, False) and got[3] == (0, 3, True) and got[None][0] == 0


def test_arguments_that_json_cannot_repeat(spark):
    bad = [r'{"prompt":"\ud800","turn":1}', '{"prompt":"x","turn":NaN}', '{"prompt":"x","turn":1e999}', '{"prompt":"x","turn":-Infinity}', "[" * 100_000]
    good = r'{"turn":1,"prompt":"\ud83d\ude00 ' + "y" * 200_000 + '"}'
    calls = spark.createDataFrame([(1, f"c{i}", None, i, "reply", a) for i, a in enumerate([*bad, good])],
                                  "conv_id long, call_id string, parent_id string, turn long, name string, arguments string")
    results = spark.createDataFrame([(f"c{i}", "r") for i in range(6)], "call_id string, content string")
    got = {r.call_id: r for r in tool_chat.link_calls(spark, calls, results).collect()}
    assert {got[f"c{i}"].fault for i in range(5)} == {"bad JSON"} and {got[f"c{i}"].status for i in range(5)} == {"invalid"}
    assert got["c5"].status == "ok" and json.loads(got["c5"].json)["call"]["arguments"]["prompt"].startswith("\U0001F600 yyy")
    assert tool_chat.link_calls(spark, calls.limit(0), results.limit(0)).count() == 0
    assert tool_chat.tool_chat_digest(spark, spark.createDataFrame([], "conv_id long, turn int, role string, text string, json string")).count() == 0
