"""Catalogue: contract normalisation and training-pool assembly."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import functions as F

from textpool.operators import contract as C
from textpool.operators import pool as P
from textpool.plans import inputs as I
from textpool.plans import sql as S
from textpool.plans.registry import register
from textpool.session import materialise, scratch_path

# ── shared stage builders (Spark) ───────────────────────────────────────────


class _PoolStages(Mapping):
    """Stages of the pool build, each constructed on first use and then shared.

    A query that needs one stage builds only that stage's lineage, so the
    driver does not analyse plans it never runs. With ``keyed`` the stages hold
    digests for texts, for queries that only count. With ``written`` each stage
    is written to the shared folder once, its rows are counted in that pass
    (``rows``), and later stages read the files.
    """

    _BUILD = {
        "splits": lambda s: I.doc_split_frames(s.spark, s.d),
        "base": lambda s: s.contract(s["splits"]["train"]),
        "val": lambda s: s.contract(s["splits"]["val"]),
        "chat": lambda s: s.contract(I.chat_pool(s.spark, s.d)),
        "merged_raw": lambda s: P.majority_dedup(P.union_pools(s["base"], s["chat"])),
        "extra": lambda s: s.contract(P.seeded_sample(I.part_pool(s.spark, s.d), I.EXTRA_SAMPLE_SIZE, I.SEED, ("tweet", "label"))),
        "merged_extra": lambda s: P.majority_dedup(P.union_pools(s["merged_raw"], s["extra"])),
        "hard": lambda s: s.contract(I.hard_examples(s.spark, s.d)),
        "overridden": lambda s: P.merge_overrides(s["merged_extra"], s["hard"]),
        "deduped": lambda s: P.majority_dedup(s["overridden"]),
        "final": lambda s: P.remove_leakage(s["deduped"], s["val"]),
    }
    _PUBLIC = ["base", "val", "chat", "merged_raw", "extra", "merged_extra", "hard", "overridden", "deduped", "final"]

    def __init__(self, spark, d: str, keyed: bool = False, written: bool = False):
        self.spark, self.d, self._keyed, self._written, self._built = spark, d, keyed, written, {}
        self.rows: dict[str, int] = {}

    def contract(self, raw):
        pool = C.normalise_contract(raw, 1)
        return P.keyed(pool) if self._keyed else pool

    def __getitem__(self, key):
        if key not in self._built:
            stage = self._BUILD[key](self)
            if self._written and key in self._PUBLIC:
                stage, seen = P.observed_write(stage, scratch_path(self.spark, f"pool-{key}"), f"pool-{key}")
                self.rows[key] = seen["rows"]
            self._built[key] = stage
        return self._built[key]

    def __iter__(self):
        return iter(self._PUBLIC)

    def __len__(self):
        return len(self._PUBLIC)


def training_pool_stages(spark, d: str, keyed: bool = False, written: bool = False) -> Mapping:
    """The reference's build order: base → +raw, dedup → +sampled extra, dedup →
    overrides → dedup → leakage report and removal against val (stages built lazily)."""
    return _PoolStages(spark, d, keyed, written)


# ── shared stage builders (SQL) ─────────────────────────────────────────────
_POOL_CTES = {
    "alldocs": S.ALL_DOCS,
    "base": S.contract("SELECT * FROM alldocs WHERE b < 8000", "text", "sentiment", 1),
    "val": S.contract("SELECT * FROM alldocs WHERE b >= 8000 AND b < 9000", "text", "sentiment", 1),
    "chat": S.contract(S.CHAT_POOL, "Content", "Sentiment", 1),
    "merged_raw": S.dedup("SELECT * FROM base UNION ALL SELECT * FROM chat"),
    "extra": S.contract(S.seeded_sample(S.PART_POOL, I.EXTRA_SAMPLE_SIZE, "tweet", "label"), "tweet", "label", 1),
    "merged_extra": S.dedup("SELECT * FROM merged_raw UNION ALL SELECT * FROM extra"),
    "hard": S.contract(S.HARD, "sentence", "polarity", 1),
    "overridden": S.merge_overrides("SELECT * FROM merged_extra", "SELECT * FROM hard"),
    "deduped": S.dedup("SELECT * FROM overridden"),
    "final": S.remove_leakage("SELECT * FROM deduped", "SELECT * FROM val"),
}


def pool_sql(select: str) -> str:
    ctes = ",\n".join(f"{k} AS ({v})" for k, v in _POOL_CTES.items())
    return f"WITH {ctes}\n{select}"


# ── P1-P5 ───────────────────────────────────────────────────────────────────
@register("contract_normalise", S.contract(S.ALL_DOCS, "text", "sentiment", 1), ("P1", "P2", "P3", "P4", "P5"))
def contract_normalise(spark, d):
    return C.normalise_contract(I.labelled_docs(spark, d, "left"), fill_missing_label=1)


@register("contract_drop_policy", S.contract(S.ALL_DOCS, "text", "sentiment", None), ("P5",))
def contract_drop_policy(spark, d):
    return C.normalise_contract(I.labelled_docs(spark, d, "left"), fill_missing_label=None)


@register("drop_any_null",
          "SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id "
          "WHERE l.quality IS NOT NULL AND l.toxic IS NOT NULL", ("P16",))
def drop_any_null_q(spark, d):
    from textpool.sources.tables import read_table
    docs = read_table(spark, d, "documents", "doc_id", "lang")
    labels = read_table(spark, d, "labels", "doc_id", "quality", "toxic")
    return C.drop_any_null(docs.join(labels, "doc_id", "left"))


# ── A1 / A2 ─────────────────────────────────────────────────────────────────
@register("majority_dedup", S.dedup(S.contract(S.LABELLED_DOCS, "text", "sentiment", 1)), ("A1",))
def majority_dedup_q(spark, d):
    return P.majority_dedup(C.normalise_contract(I.labelled_docs(spark, d), 1))


@register("majority_dedup_lineitem", S.dedup(S.contract(S.PART_POOL, "tweet", "label", 1)), ("A1",))
def majority_dedup_lineitem(spark, d):
    return P.majority_dedup(C.normalise_contract(I.part_pool(spark, d), 1))


@register("label_distribution",
          "SELECT Polarity, count(*) AS count FROM ({}) GROUP BY Polarity".format(
              S.dedup(S.contract(S.PART_POOL, "tweet", "label", 1))), ("A2",))
def label_distribution_q(spark, d):
    return P.label_distribution(majority_dedup_lineitem(spark, d))


# ── J1-J5, A5, A6 ───────────────────────────────────────────────────────────
@register("pool_union_override", pool_sql("SELECT Sentence, Polarity FROM overridden"), ("J1", "J2"))
def pool_union_override(spark, d):
    return training_pool_stages(spark, d)["overridden"]


@register("override_counts", pool_sql(
    "SELECT (SELECT count(*) FROM hard) AS hard_rows, "
    f"(SELECT count(*) FROM hard h WHERE {S.norm('h.Sentence')} IN (SELECT {S.norm('Sentence')} FROM merged_extra)) AS overrides, "
    f"(SELECT count(*) FROM hard h WHERE {S.norm('h.Sentence')} NOT IN (SELECT {S.norm('Sentence')} FROM merged_extra)) AS new_rows, "
    "(SELECT count(*) FROM merged_extra) AS pool_before, (SELECT count(*) FROM overridden) AS pool_after"), ("J3",))
def override_counts_q(spark, d):
    st = training_pool_stages(spark, d, keyed=True)
    return P.override_counts(st["merged_extra"], st["hard"])


_LEAK_SQL = pool_sql(
    "SELECT (SELECT count(*) FROM deduped) AS train_size, (SELECT count(*) FROM val) AS val_size, "
    "(SELECT count(*) FROM ov) AS overlap_count, "
    "CAST(round((SELECT count(*) FROM ov) / greatest((SELECT count(DISTINCT k) FROM vk), 1), 4) AS DOUBLE) AS overlap_ratio_of_val, "
    "(SELECT coalesce(list(k ORDER BY k), []) FROM (SELECT k FROM ov ORDER BY k LIMIT 20)) AS overlap_samples"
).replace("\nSELECT (SELECT count(*) FROM deduped)",
          f",\nvk AS (SELECT {S.norm('Sentence')} AS k FROM val),\n"
          f"ov AS (SELECT DISTINCT {S.norm('Sentence')} AS k FROM deduped INTERSECT SELECT k FROM vk)\n"
          "SELECT (SELECT count(*) FROM deduped)")


@register("leakage_report", _LEAK_SQL, ("J4", "T4"))
def leakage_report_q(spark, d):
    """The training side is digests only; val keeps its texts for the samples."""
    return P.leakage_report(training_pool_stages(spark, d, keyed=True)["deduped"], training_pool_stages(spark, d)["val"])


@register("leakage_removed", pool_sql("SELECT Sentence, Polarity FROM final"), ("J5",))
def leakage_removed(spark, d):
    return training_pool_stages(spark, d)["final"]


@register("training_pool_distribution",
          pool_sql("SELECT Polarity, count(*) AS count FROM final GROUP BY Polarity"), ("J1", "A1", "J2", "J5", "A2"))
def training_pool_distribution(spark, d):
    return P.label_distribution(training_pool_stages(spark, d, keyed=True)["final"])


_STAGES = ["base", "val", "chat", "merged_raw", "extra", "merged_extra", "hard", "overridden", "deduped", "final"]


@register("pool_stage_sizes", pool_sql(" UNION ALL ".join(
    f"SELECT '{s}' AS stage, count(*) AS rows FROM {s}" for s in _STAGES)), ("A5",))
def pool_stage_sizes(spark, d):
    """Each stage is written once as digests, from its predecessors' files, and counted while it is written."""
    st = training_pool_stages(spark, d, keyed=True, written=True)
    for stage in _STAGES:
        st[stage]
    return spark.createDataFrame([(s, st.rows[s]) for s in _STAGES], "stage string, rows long")


@register("class_weights", pool_sql(
    "SELECT Polarity, count, round(w2 / avg(w2) OVER (), 6) AS weight FROM ("
    "SELECT Polarity, count, w1 AS w2 FROM ("
    "SELECT Polarity, count, w0 / avg(w0) OVER () AS w1 FROM ("
    "SELECT c.Polarity, coalesce(n.cnt, 0) AS count, "
    "CASE WHEN sum(coalesce(n.cnt, 0)) OVER () = 0 THEN 1.0 ELSE "
    "sum(coalesce(n.cnt, 0)) OVER () / (3.0 * greatest(coalesce(n.cnt, 0), 1)) END AS w0 "
    "FROM (SELECT CAST(unnest(range(3)) AS INTEGER) AS Polarity) c "
    "LEFT JOIN (SELECT Polarity, count(*) AS cnt FROM final GROUP BY Polarity) n ON c.Polarity = n.Polarity)))"),
    ("A6",))
def class_weights_q(spark, d):
    w = P.class_weights(training_pool_stages(spark, d, keyed=True)["final"])
    return w.select("Polarity", "count", F.round("weight", 6).alias("weight"))


# ── W5 / W2 / J6 ────────────────────────────────────────────────────────────
@register("seeded_sample", pool_sql("SELECT Sentence, Polarity FROM extra"), ("W5",))
def seeded_sample_q(spark, d):
    return training_pool_stages(spark, d)["extra"]


_SPLIT_CTE = (
    "WITH pool AS ({pool}),\n"
    "c1 AS (SELECT Polarity, n_c, sum(n_c) OVER () AS n FROM (SELECT Polarity, count(*) AS n_c FROM pool GROUP BY Polarity)),\n"
    "c2 AS (SELECT *, n - CAST(ceil(n * CAST(0.2 AS DOUBLE)) AS BIGINT) AS n_train FROM c1),\n"
    "c3 AS (SELECT *, (n_train * n_c) // n AS fl, (n_train * n_c) % n AS rem FROM c2),\n"
    "c4 AS (SELECT *, fl + CASE WHEN row_number() OVER (ORDER BY rem DESC, Polarity ASC) <= n_train - sum(fl) OVER () THEN 1 ELSE 0 END AS q_train FROM c3),\n"
    "c5 AS (SELECT *, n_c - q_train AS t_c, sum(n_c - q_train) OVER () AS n_temp FROM c4),\n"
    "c6 AS (SELECT *, n_temp - CAST(ceil(n_temp * CAST(0.5 AS DOUBLE)) AS BIGINT) AS n_val FROM c5),\n"
    "c7 AS (SELECT *, (n_val * t_c) // n_temp AS fl2, (n_val * t_c) % n_temp AS rem2 FROM c6),\n"
    "q AS (SELECT Polarity, q_train, fl2 + CASE WHEN row_number() OVER (ORDER BY rem2 DESC, Polarity ASC) <= n_val - sum(fl2) OVER () THEN 1 ELSE 0 END AS q_val FROM c7),\n"
    "r AS (SELECT Sentence, Polarity, row_number() OVER (PARTITION BY Polarity ORDER BY {h}, Sentence) - 1 AS rk FROM pool),\n"
    "s AS (SELECT r.Sentence, r.Polarity, CASE WHEN rk < q_train THEN 'train' WHEN rk < q_train + q_val THEN 'val' ELSE 'test' END AS split "
    "FROM r JOIN q ON r.Polarity = q.Polarity)\n"
).format(pool=S.dedup(S.contract(S.PART_POOL, "tweet", "label", 1)), h=S.seeded_hex(42, "Sentence"))


def _split_pool(spark, d):
    return P.stratified_split(majority_dedup_lineitem(spark, d), seed=I.SEED)


@register("stratified_split", _SPLIT_CTE + "SELECT Sentence, Polarity, split FROM s", ("W2", "J6"))
def stratified_split_q(spark, d):
    """The splits are written, and leave that table only through the guard on their overlap."""
    return P.guard_splits(materialise(spark, _split_pool(spark, d), "splits"))


@register("stratified_split_sizes", _SPLIT_CTE + "SELECT split, Polarity, count(*) AS n FROM s GROUP BY split, Polarity",
          ("W2",))
def stratified_split_sizes(spark, d):
    return _split_pool(spark, d).groupBy("split", "Polarity").agg(F.count(F.lit(1)).alias("n"))


def _docsplit_sql(cond):
    return S.contract(f"SELECT * FROM ({S.ALL_DOCS}) WHERE {cond}", "text", "sentiment", 1)


@register("split_overlap", (
    f"WITH a AS ({_docsplit_sql('b < 8000')}), v AS ({_docsplit_sql('b >= 8000 AND b < 9000')}), "
    f"t AS ({_docsplit_sql('b >= 9000')}) SELECT "
    "(SELECT count(*) FROM (SELECT Sentence FROM a INTERSECT SELECT Sentence FROM v)) AS train_val_overlap, "
    "(SELECT count(*) FROM (SELECT Sentence FROM a INTERSECT SELECT Sentence FROM t)) AS train_test_overlap, "
    "(SELECT count(*) FROM (SELECT Sentence FROM v INTERSECT SELECT Sentence FROM t)) AS val_test_overlap"), ("J6",))
def split_overlap_q(spark, d):
    sp = I.doc_split_frames(spark, d)
    n = {k: C.normalise_contract(v, 1) for k, v in sp.items()}
    return P.split_overlap(n["train"], n["val"], n["test"])
