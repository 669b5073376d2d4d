"""Each stage against a plain version on what the stage before kept, and the whole against its stages."""

from collections import Counter

import pytest

from tests.llm.cases import frame
from tests.llm.test_layout_ops import WORD, check_quality, rows_of
from tests.llm.test_text_ops import decontamination_reference, near_reference
from tributary.llm import mixing, quality
from tributary.llm.common import materialize, read_table

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_stages(spark, sf):
    before = read_table(spark, sf, "documents")
    names = before.columns
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        kept.append(materialize(stage(spark, before, sf), f"test-{k}"))
        before = kept[-1]
        assert k == len(corpus_pipeline.STAGES) - 1 or before.columns == names
    docs = read_table(spark, sf, "documents")
    verdicts = rows_of(quality.quality_verdicts(docs))
    check_quality(pairs(docs), verdicts)
    assert Counter(i for i, _ in pairs(kept[0])) == Counter(r["doc_id"] for r in verdicts if r["kept"])
    assert Counter(i for i, _ in pairs(kept[1])) == Counter(r[0] for r in near_reference(pairs(kept[0])).elements() if r[3])
    items = [(r["item_id"], r["text"]) for r in read_table(spark, sf, "benchmark").collect()]
    assert Counter(i for i, _ in pairs(kept[2])) == Counter(r[0] for r in decontamination_reference(pairs(kept[1]), items).elements() if not r[-1])
    taken = {r["doc_id"]: r for r in rows_of(mixing.mix_documents(kept[2]))}
    want = Counter({i: int(r["taken"] / r["size"] + 0.5) for i, r in taken.items()})
    assert Counter(i for i, _ in pairs(kept[3])) == +want
    words = sum(len(WORD.findall(t)) for _, t in pairs(kept[3]))
    assert abs(words / sum(r["taken"] for r in taken.values()) - 1) < 0.2
    last = rows_of(kept[4])
    assert Counter(r["doc_id"] for r in last) == +want
    sizes = Counter(r["shard"] for r in last)
    assert max(sizes.values()) - min(sizes[s] for s in range(16)) <= 1
    assert corpus_pipeline.run(spark, sf).count() == len(last)


def test_awkward_documents(spark, sf):
    for rows in (None, []):  # a Parquet file can't hold names that differ by case
        docs = frame(spark, rows).drop("n_chars").toDF("doc_id", "text", "lang", "source", "size", "row", "kept")
        for _, stage in corpus_pipeline.STAGES:
            docs = materialize(stage(spark, docs, sf), "awkward")
        assert "text" in docs.columns
