"""The pipeline's stages against brute force on a small table."""

import numpy as np
import pytest

import corpus_pipeline
from graphloom.llm import common, decontamination, packing, quality, simhash, toxicity
from graphloom.llm.common import table

from .test_operators import brute_contamination

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark):
    docs, out = table(spark, SF, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        from graphloom.llm.common import stored

        docs = stored(stage(spark, docs, SF))
        out.append(docs)
    return out


def brute_reach(nodes, pairs):
    root = {i: i for i in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in pairs:
        a, b = find(x), find(y)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in nodes}


def own_shingles(text):
    w = (text or "").lower().split()
    return set(zip(*[w[k:] for k in range(5)])) if len(w) > 5 else {tuple(w)}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_stages(spark, outputs):
    docs = table(spark, SF, "documents")
    for df in outputs[:-1]:
        assert df.columns == docs.columns
    text = {r.doc_id: r.text for r in docs.collect()}
    m = quality.train_quality(docs, table(spark, SF, "labels"))
    good = {i for i, t in text.items() if m.probability(np.array([quality.features((t or "").encode())], np.float32))[0] >= 0.5}
    assert ids(outputs[0]) == good
    x = toxicity.train_toxicity(docs, table(spark, SF, "labels"))
    clean = {i for i in good if x.probability(x.evidence((text[i] or "").encode())[0]) < toxicity.CUT}
    assert ids(outputs[1]) == clean
    kept = ids(outputs[2])
    order = sorted(clean)
    shingles = {i: own_shingles(text[i]) for i in clean}
    reach = brute_reach(order, [(x, y) for n, x in enumerate(order) for y in order[n + 1 :] if jaccard(shingles[x], shingles[y]) >= 0.8])
    assert kept == set(reach.values())  # every group keeps its smallest id
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    left = {i for i in kept if not brute_contamination(text[i], items)[4]}
    assert ids(outputs[3]) == left
    got = outputs[4].collect()
    assert {r.doc_id for r in got} == left
    total: dict = {}
    for r in got:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
        assert r.doc_tokens >= r.length
    assert all(total[r.doc_id] == r.doc_tokens for r in got)


def test_empty_table(spark):
    docs = table(spark, SF, "documents").limit(0)
    assert simhash.keep_one_of_each(spark, docs, SF).count() == 0
    assert decontamination.drop_contaminated(spark, docs, SF).count() == 0
    assert packing.pack_documents(docs).count() == 0


def test_stages_take_batches_of_few_rows(spark):
    """The driver of a stage runs its plan after the stage has returned: batches must be small then, too."""
    from graphloom.llm.common import ARROW_ROWS, BATCH_ROWS

    docs = table(spark, SF, "documents")
    for stage in (quality.keep_quality, toxicity.keep_clean, lambda s, d, _: packing.pack_documents(d)):
        spark.conf.set(ARROW_ROWS, "10000")
        stage(spark, docs, SF)
        assert int(spark.conf.get(ARROW_ROWS)) <= BATCH_ROWS


def test_text_goes_to_python_once(spark):
    docs = table(spark, SF, "documents")
    source, at, first = common.with_text(docs, tuple(docs.columns))
    assert source.columns == docs.columns and source.columns[at] == "text" and first == 0


def test_token_counts_in_parts():
    import pyarrow as pa

    texts = [" ".join(f"word{i * k % 97}" for k in range(1, 9)) for i in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array([i % 2 for i in range(60)]), pa.array(texts)], names=["y", "text"])

    def summed(parts):
        out: dict = {}
        for p in parts:
            for r in p.to_pylist():
                a, b = out.get(r["token"], (0, 0))
                out[r["token"]] = a + r["toxic"], b + r["clean"]
        return out

    parts = list(toxicity.token_counts([batch], 100))
    assert len(parts) > 3 and max(p.num_rows for p in parts) < 160
    assert summed(parts) == summed(toxicity.token_counts([batch]))
