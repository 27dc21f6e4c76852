"""Models and thresholds of personal data come from every candidate of every document."""

from __future__ import annotations

import json
import random
from collections import Counter

import numpy as np

from resalio.llm import pii
from resalio.llm.boosting import boost, predict


def test_every_candidate_is_learnt_from(spark):
    rng = random.Random(5)
    phone = lambda: f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"
    texts = [f"{rng.choice(('call', 'mobile', 'at', 'see'))} {phone()} or {rng.randrange(10**9, 10**10)} {rng.randrange(10**4)} {'x' * (k % 7)} then" for k in range(5000)]
    rows = [(None if k % 10 == 0 else k // 2, t) for k, t in enumerate(texts)]
    models = json.loads(pii.train(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))
    found = [(k, x, y, h % 3 == 2) for t in texts for k, x, y, h in pii.learnt(t)]
    seen = Counter((k, y, out) for k, _, y, out in found)
    assert "phone" in models and seen[3, 1, False] > 4000 and seen[3, 0, False] > 4000
    for name, m in models.items():
        kind = pii.KINDS.index(name)
        assert np.isclose(m["model"]["base"], np.log((seen[kind, 1, False] + 0.5) / (seen[kind, 0, False] + 0.5)), rtol=1e-12)
        x, y, out = (np.array([r[c] for r in found if r[0] == kind]) for c in (1, 2, 3))
        plain = boost(x[~out], y[~out])
        assert all(np.allclose(a, b) for a, b in zip(plain["cuts"], m["model"]["cuts"], strict=True))
        p = predict(m["model"], x)
        assert np.abs(p - predict(plain, x)).max() < 0.01
        share = {t: y[out & (p >= t)].mean() for t in np.unique(np.floor(p[out] * pii.STEPS) / pii.STEPS)}
        assert m["threshold"] == max(0.5, min(t for t, s in share.items() if s >= pii.PRECISION))
