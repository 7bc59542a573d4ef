import re
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_corpus_operators import WORDS, components

D = "/root/testdata/sf0.001"


def lose_passages(texts):
    """The texts without words in windows of 35 that start anywhere else."""
    words = [WORDS.findall(t or "") for t in texts]
    seen = Counter(tuple(w[k : k + 35]) for w in words for k in range(len(w) - 34))
    out = []
    for t, w in zip(texts, words, strict=True):
        stay = np.ones(len(w), bool)
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                stay[k : k + 35] = False
        out.append(t if stay.all() else " ".join(x for x, s in zip(w, stay, strict=True) if s))
    return out


def squeezed(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "").strip()


def test_stages(spark):
    """Each stage on what its predecessor kept: columns and rows of documents; near copies and passages by brute force."""
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, D).cache()
        assert docs.columns == columns, name
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert kept[name] and docs.count() == len(kept[name]) <= before.count()
    rows = list(kept["quality rules"].items())
    sets, _, group = components(rows, 5, 80, 100)
    of = {i: g for (i, _), g, s in zip(rows, group, sets, strict=True) if s}
    stay = [of[i] for i in kept["n-gram Jaccard join"] if i in of]
    assert len(stay) == len(set(stay)) and set(stay) == set(of.values())
    assert {i for i, _ in rows if i not in of} <= set(kept["n-gram Jaccard join"])
    ids = list(kept["n-gram Jaccard join"])
    want = lose_passages([kept["n-gram Jaccard join"][i] for i in ids])
    assert {i: squeezed(t) for i, t in kept["substring dedup"].items()} == {i: squeezed(t) for i, t in zip(ids, want, strict=True)}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, D)
    assert packed.select("doc_id").distinct().count() == docs.count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 4096").count() == 0


@pytest.mark.parametrize("whole", [True, False])
def test_stages_on_awkward_rows(spark, whole):
    """Nulls in any column, repeated rows, extra columns whose names operators use themselves; and an empty table."""
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(1, text, "en", "a", 5, "x", 1), (1, text, "en", "a", 5, "x", 1), (2, None, None, None, None, None, None), (None, text + " more", "en", None, 3, "y", 2), (None, None, None, None, None, None, None), (3, "", "de", "b", 0, "", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, predicted string, n_removed long"
    docs = spark.createDataFrame(rows if whole else [], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, D)
        assert out.columns == docs.columns, name
        assert out.count() <= docs.count() if whole else out.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, D).count() == len(rows) * whole
