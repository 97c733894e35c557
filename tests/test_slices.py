"""Workers turn slices of a batch into Python objects, not the batch."""

import json

import pyarrow as pa
from pyspark.sql import functions as F

from textpool.operators import subwords as SW
from textpool.operators import tagging as TG


class Watched:
    """A codec whose results say the most that a worker held before it gave some back."""

    def __call__(self):
        return (lambda text: [len(text)] * len(text)), (lambda ids: json.dumps(len(ids)))




def test_workers_turn_slices_into_objects(spark, monkeypatch):
    seen = []
    real = F.arrow_udf

    def caught(kind):
        def deco(fn):
            seen.append(fn)
            return real(kind)(fn)
        return deco

    monkeypatch.setattr(F, "arrow_udf", caught)
    values = pa.array(["ab cd"] * 10_000 + [None])
    SW.subword_ids(F.lit("x"), Watched())
    TG.tag_tokens(F.lit("x"), TG.SuffixTagger(("d",)))
    SW.subword_text(F.array(F.lit(1)), Watched())
    for fn, want in ((seen[0], [5] * 5), (seen[1], None)):
        out = list(fn(iter([values])))
        assert len(out) > 3 and sum(map(len, out)) == len(values) and out[-1][-1].as_py() == []
        assert want is None or all(x.as_py() == want for p in out for x in p[:3])
    out = list(seen[2](iter([pa.array([[1, 2]] * 1_000 + [None])])))
    assert len(out) > 3 and [x for p in out for x in p.to_pylist()] == ["2"] * 1_000 + [None]
