"""Held-out accuracy of the registered toxicity query."""

import numpy as np
import pyarrow.parquet as pq
import pytest

from lumenframe.llm import toxicity


@pytest.mark.parametrize("sf,order,recall,clean", [("sf0.01", 0.8, 0.5, 0.95), ("sf0.1", 0.94, 0.75, 0.97)])
def test_held_out_texts(spark, sf, order, recall, clean):
    path = f"/root/testdata/{sf}"
    labels = pq.read_table(f"{path}/labels.parquet").to_pydict()
    truth = dict(zip(labels["doc_id"], labels["toxic"]))
    rows = [r for r in toxicity.op4_toxicity(spark, path).collect() if r.held_out and r.doc_id in truth]
    y, s = np.array([truth[r.doc_id] for r in rows]), np.array([r.score for r in rows])
    assert toxicity.SubwordSoftmax._quality(s, y)[0] >= order
    assert (s[y == 1] >= 0.5).mean() >= recall
    assert (s[y == 0] < 0.5).mean() >= clean


def test_training_stays_bounded():
    """Labels that say nothing: vectors must not run away, and scores stay probabilities."""
    rng = np.random.default_rng(1)
    texts = [" ".join("w%d" % k for k in rng.integers(0, 50, 60)) for _ in range(300)]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    model = toxicity.SubwordSoftmax().fit(raw, at, rng.integers(0, 2, 300))
    s = model.scores(raw, at)
    assert np.abs(model.vectors).max() < 100 and np.abs(model.weights).max() < 100
    assert ((s >= 0) & (s <= 1)).all()
