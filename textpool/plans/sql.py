"""DuckDB SQL twins of the data roles and of the Column helpers (oracle side)."""

from __future__ import annotations

WS = r"[\s\p{Z}\x{0B}\x{1C}-\x{1F}\x{85}]"


def strip(x: str) -> str:
    return f"regexp_replace(CAST({x} AS VARCHAR), '^{WS}+|{WS}+$', '', 'g')"


def norm(x: str) -> str:
    return strip(f"lower({x})")


def polarity(x: str, fill: int | None = 1) -> str:
    f = "NULL" if fill is None else str(fill)
    s = f"lower({strip(x)})"
    spell = (f"CASE {s} WHEN 'negative' THEN 0 WHEN 'neg' THEN 0 WHEN 'olumsuz' THEN 0 "
             f"WHEN 'neutral' THEN 1 WHEN 'neu' THEN 1 WHEN 'notr' THEN 1 WHEN 'nötr' THEN 1 "
             f"WHEN 'positive' THEN 2 WHEN 'pos' THEN 2 WHEN 'olumlu' THEN 2 END")
    d = f"try_cast({s} AS DOUBLE)"
    num = f"CASE WHEN {d} > -1 AND {d} < 3 THEN CAST(trunc({d}) AS INTEGER) END"
    return f"CAST(CASE WHEN {x} IS NULL THEN {f} ELSE coalesce({spell}, {num}, {f}) END AS INTEGER)"


def hex_bucket(h: str, n: int) -> str:
    return f"CAST(floor(('0x' || substr({h}, 1, 8))::BIGINT * {n} / 4294967296) AS BIGINT)"


def seeded_hex(seed: int, *cols: str) -> str:
    return "md5(concat('{}', {}))".format(seed, ", ".join(f"CAST({c} AS VARCHAR)" for c in cols))


def class_name(x: str) -> str:
    return f"(CASE {x} WHEN 0 THEN 'Negative' WHEN 1 THEN 'Neutral' WHEN 2 THEN 'Positive' END)"


# ── role CTE bodies ─────────────────────────────────────────────────────────
DOC_SENTIMENT = ("CASE WHEN l.toxic = 1 THEN 'negative' WHEN l.quality = 1 THEN 'positive' "
                 "ELSE 'neutral' END")

LABELLED_DOCS = (f"SELECT d.doc_id, d.lang, d.text, {DOC_SENTIMENT} AS sentiment "
                 f"FROM documents d JOIN labels l ON d.doc_id = l.doc_id")

ALL_DOCS = (f"SELECT d.doc_id, d.lang, d.text, CASE WHEN l.toxic IS NULL AND l.quality IS NULL THEN NULL "
            f"ELSE {DOC_SENTIMENT} END AS sentiment, {hex_bucket(seeded_hex(42, 'd.doc_id'), 10000)} AS b "
            f"FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")

PART_POOL = ("SELECT concat('part ', CAST(l_partkey AS VARCHAR)) AS tweet, "
             "CASE l_returnflag WHEN 'A' THEN 'negative' WHEN 'N' THEN 'Neutral' WHEN 'R' THEN ' POS ' END AS label "
             "FROM lineitem")

CHAT_POOL = ("SELECT text AS Content, CASE role WHEN 'user' THEN 'neu' WHEN 'assistant' THEN 'positive' "
             "WHEN 'system' THEN 'olumsuz' END AS Sentiment FROM conversations")

HARD = (f"SELECT translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS sentence, CASE sentiment WHEN 'negative' THEN 2 WHEN 'positive' THEN 0 ELSE 1 END "
        f"AS polarity FROM ({LABELLED_DOCS}) WHERE lang <> 'en'")

LOGITS = ("SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) * 10 AS l0, CAST(embedding[2] AS DOUBLE) * 10 AS l1, "
          "CAST(embedding[3] AS DOUBLE) * 10 AS l2, CAST(label % 3 AS INTEGER) AS y FROM embeddings")

BATCH_ENTRIES = ("SELECT concat('c', CAST(conv_id AS VARCHAR), '-', CAST(turn AS VARCHAR)) AS id, text FROM conversations "
                 "UNION ALL SELECT concat('e', CAST(event_id AS VARCHAR)) AS id, "
                 "concat(' ', substring(event_type, 1, length(event_type) - 4)) AS text FROM events")


def contract(src: str, text: str, label: str, fill: int | None = 1) -> str:
    body = f"SELECT {strip(text)} AS Sentence, {polarity(label, fill)} AS Polarity FROM ({src})"
    cond = "length(Sentence) > 0" + (" AND Polarity IS NOT NULL" if fill is None else "")
    return f"SELECT Sentence, Polarity FROM ({body}) WHERE {cond}"


def dedup(src: str) -> str:
    """Majority vote written independently of the Spark form: count + row_number."""
    return (f"SELECT Sentence, CAST(Polarity AS INTEGER) AS Polarity FROM ("
            f"SELECT Sentence, Polarity, row_number() OVER (PARTITION BY Sentence ORDER BY n DESC, Polarity ASC) AS rn "
            f"FROM (SELECT Sentence, Polarity, count(*) AS n FROM ({src}) GROUP BY Sentence, Polarity)) WHERE rn = 1")


def seeded_sample(src: str, n: int, a: str, b: str, seed: int = 42) -> str:
    return f"SELECT {a}, {b} FROM ({src}) ORDER BY {seeded_hex(seed, a, b)}, {a}, {b} LIMIT {n}"


def merge_overrides(base: str, hard: str) -> str:
    return (f"SELECT Sentence, Polarity FROM ({base}) b WHERE {norm('b.Sentence')} NOT IN "
            f"(SELECT {norm('Sentence')} FROM ({hard})) UNION ALL SELECT Sentence, Polarity FROM ({hard})")


def remove_leakage(train: str, val: str) -> str:
    return (f"SELECT Sentence, Polarity FROM ({train}) t WHERE {norm('t.Sentence')} NOT IN "
            f"(SELECT {norm('Sentence')} FROM ({val}))")


def shape_logits(text: str) -> str:
    """SQL twin of ShapeScorer."""
    return (f"CAST(0.002 AS DOUBLE) * length({text}) AS l0, "
            f"CAST(0.5 AS DOUBLE) * (length({text}) - length(replace({text}, chr(10), '')) + 1) AS l1, "
            f"CAST(0.8 AS DOUBLE) * (length({text}) - length(replace({text}, ',', ''))) AS l2")


def scored(src: str, fallback: bool = True, threshold: float = 0.70) -> str:
    """src has l0, l1, l2 (+ passthrough cols) → adds p0..p2, raw_id, confidence, pred_id, fallback_applied."""
    pred = (f"CASE WHEN confidence < CAST({threshold} AS DOUBLE) THEN 1 ELSE raw_id END" if fallback else "raw_id")
    return (
        "SELECT *, CAST(" + pred + " AS INTEGER) AS pred_id, (" + pred + ") <> raw_id AS fallback_applied FROM ("
        "SELECT *, CAST(CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS INTEGER) AS raw_id, "
        "greatest(p0, p1, p2) AS confidence FROM ("
        "SELECT *, exp(l0 - _m) / (exp(l0 - _m) + exp(l1 - _m) + exp(l2 - _m)) AS p0, "
        "exp(l1 - _m) / (exp(l0 - _m) + exp(l1 - _m) + exp(l2 - _m)) AS p1, "
        "exp(l2 - _m) / (exp(l0 - _m) + exp(l1 - _m) + exp(l2 - _m)) AS p2 FROM ("
        f"SELECT *, greatest(l0, l1, l2) AS _m FROM ({src}))))"
    )


def valid_text(src: str, text: str = "text", keep: str = "*") -> str:
    return f"SELECT * FROM (SELECT * REPLACE ({strip(text)} AS {text}) FROM ({src})) WHERE length({text}) >= 2"
