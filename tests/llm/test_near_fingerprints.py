"""near_dedup's candidates from op7's fingerprints: found without any min-hash key, and judged by the sets."""

from __future__ import annotations

import random
from functools import partial

from pyspark.sql import functions as F

from resalio.llm import jaccard, simhash


def test_fingerprints_give_candidates(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows, near = [], []
    for k in range(12):
        base = [word() for _ in range(400)]
        copy = [*base[:-1], word()]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
        if (simhash.fingerprint(rows[-1][1]) ^ simhash.fingerprint(rows[-2][1])).bit_count() <= 3:
            near.append(k)
    cycle = [word() for _ in range(11)] * 60
    rows += [(100 + k, " ".join([*cycle, *(word() for _ in range(10))])) for k in range(2)]  # one fingerprint, other sets
    assert len(near) >= 6 and (simhash.fingerprint(rows[-1][1]) ^ simhash.fingerprint(rows[-2][1])).bit_count() <= 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kinds = "doc_id long, fp long, size long, keys array<long>, print long"
    sets = docs.mapInArrow(partial(jaccard._keyed, jaccard.WIDTH), kinds).withColumnRenamed("doc_id", "least").withColumn("keys", F.expr("filter(keys, k -> false)"))
    sets = spark.createDataFrame(sets.collect(), sets.schema)
    fp = {r.least: r.fp for r in sets.collect()}
    got = {r.fp: r.root for r in jaccard.linked(sets, docs).collect()}
    root = lambda i: got.get(fp[i], fp[i])
    assert [k for k in range(12) if root(2 * k) == root(2 * k + 1)] == near
    assert root(100) != root(101)
