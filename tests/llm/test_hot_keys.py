"""What meets on one hot key: groups of near copies, samples of kinds, vectors as a query."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from resalio.llm import embeddings, jaccard, pii, simhash, toxicity
from resalio.llm.queries import queries


def recorded(monkeypatch, module):
    """Rows of every step that the module writes, by name."""
    seen, plain = {}, module.materialize

    def write(df, what, *more):
        out = plain(df, what, *more)
        seen[what] = out.count()
        return out

    monkeypatch.setattr(module, "materialize", write)
    return seen


def test_a_component_never_meets_itself(spark, monkeypatch):
    """A thousand fingerprints within 3 bits share keys: after the star pass none of them is compared again."""
    rng = random.Random(1)
    base = rng.getrandbits(64)
    near = {base ^ (1 << rng.randrange(64)) for _ in range(60)} | {base}
    far = {rng.getrandbits(64) for _ in range(200)}
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    fps = [signed(v) for v in near | far]
    seen = recorded(monkeypatch, simhash)
    got = dict(simhash.linked(spark.createDataFrame([(v,) for v in fps], "fp long")).collect())
    group = sorted(signed(v) for v in near)
    assert {v: got.get(v, v) for v in group} == dict.fromkeys(group, group[0]) and len(got) == len(group) - 1
    assert seen["unsettled"] <= 4


def test_components_that_the_stars_leave_apart_are_joined(spark):
    """Chains of links that no least or greatest of a key ties: the second pass, against all pairs."""
    rng = random.Random(2)
    for _ in range(2):
        fps = {rng.getrandbits(64) for _ in range(20)}
        for _ in range(300):
            v = rng.choice(sorted(fps))
            for _ in range(rng.randrange(1, 4)):
                v ^= 1 << rng.randrange(64)
            fps.add(v)
        signed = sorted(v - (1 << 64) if v >> 63 else v for v in fps)
        x = np.array(signed, np.int64).view(np.uint64)
        a, b = np.nonzero(np.bitwise_count(x[:, None] ^ x[None]) <= 3)
        root = embeddings.forest((a, b), len(x))
        got = dict(simhash.linked(spark.createDataFrame([(v,) for v in signed], "fp long").repartition(3)).collect())
        assert [got.get(v, v) for v in signed] == [signed[r] for r in root]


def test_near_copies_of_a_hot_group(spark, monkeypatch):
    """A passage with one word changed in many ways is one class; no two of it meet in the second pass but for what the stars left."""
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join([*words[:k], "x", *words[k + 1 :]])) for k in range(150)] + [(1000 + k, " ".join(f"u{k}v{j}" for j in range(40))) for k in range(20)]
    seen = recorded(monkeypatch, jaccard)
    got = dict(jaccard.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect())
    assert all(got[k] == (0 if k < 1000 else k) for k, _ in rows)
    assert seen["more"] <= 150


def test_samples_are_cut_by_every_task(spark):
    """No group of a sample is sorted whole: each is an order with a limit."""
    df = spark.range(5000).repartition(8).select((F.col("id") % 3).alias("kind"), F.xxhash64("id").alias("h"))
    got = pii._least(df, [F.col("kind") == k for k in range(3)], ["h"], 40)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("TakeOrderedAndProject") == 3 and "Window" not in plan
    rows = df.collect()
    for k in range(3):
        assert sorted(r.h for r in got.collect() if r.kind == k) == sorted(r.h for r in rows if r.kind == k)[:40]


def test_vectors_with_links_as_a_query(spark, tmp_path):
    """The registered query on vectors that have links: null and repeated ids, a label, an extra column."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((30, 16))
    x = np.concatenate([c + 0.2 * rng.standard_normal((25, 16)) for c in centres])
    rows = [(k, v.tolist(), k % 3) for k, v in enumerate(x)] + [(None, x[0].tolist(), 1), (5, x[5].tolist(), 0), (9000, None, 0), (9001, [0.0] * 16, 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit("x")).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries()["op9_embeddings"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    f = np.array([r[1] for r in rows if r[0] is not None and r[1] and any(r[1])], np.float32).astype(float)
    ids = [r[0] for r in rows if r[0] is not None and r[1] and any(r[1])]
    u = f / np.linalg.norm(f, axis=1)[:, None]
    link = (u @ u.T >= 0.9) & ~np.eye(len(u), dtype=bool)
    want = dict(zip(ids, link.sum(1)))
    have = {r.vec_id: r.n_links for r in got if r.vec_id is not None}
    assert sum(have.values()) >= 0.97 * sum(want.values()) and all(have[i] <= want[i] for i in want) and sum(want.values()) > 1000
    assert {(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None} == {(0, None, False)}
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)


def test_a_labelled_id_of_many_rows_is_one_text(spark):
    """The driver gets a row for each label, however many rows share its id."""
    docs = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(7, 0)], "doc_id long, toxic int")
    got = toxicity.sample(docs, labels, 1000).collect()
    asked = labels.filter(~toxicity.held_out()).join(docs.select("doc_id").distinct(), "doc_id").count()
    assert len(got) == asked and sum(r.text == "text 0" for r in got) in (0, 2)
