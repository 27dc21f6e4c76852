"""What the first tests leave out: trained models, ids of pieces, the automaton, names that clash, long texts, stages."""

from __future__ import annotations

import random
from collections import defaultdict
from functools import partial

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from resalio.llm import bpe, embeddings, lines, media, packing, pii, simhash, substring, token_files, toxicity
from resalio.sources.shared import shared_dir

from .test_operators import WORDS, corpus, plain

WORDY = "doc_id long, text string"


def luhn_number(rng):
    head = "".join(str(rng.randrange(10)) for _ in range(15))
    return next(head + c for c in "0123456789" if pii.luhn(head + c))


def test_trained_models_find_planted_spans(spark):
    """Recall and precision of added spans of every kind, forms and surroundings held out."""
    rng = random.Random(11)
    words = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    mail = lambda: f"{rng.choice(WORDS)}.{rng.choice(WORDS)}@{rng.choice(WORDS)}.example.{rng.choice(('com', 'org', 'net'))}"
    ip = lambda: ".".join(str(rng.randrange(256)) for _ in range(4))
    phone = lambda: f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"
    make = (mail, ip, lambda: luhn_number(rng), phone)
    seen = [(k, f"{words(8)} {make[k % 4]()} {words(8)} {rng.randrange(10**15, 10**16)} {words(3)} {rng.randrange(10**6)}") for k in range(1600)]
    model = pii.train(spark.createDataFrame(seen, WORDY).repartition(3))
    planted, kinds = [], {}
    for k in range(400):
        kind = k % 4
        new = next(new for new, good in iter(lambda: pii.rewritten(kind, make[kind](), rng.getrandbits(60)), None) if good and not pii.base_spans(f"a {new} b"))
        planted.append((k, f"{words(6)} {new} {words(6)}"))
        kinds[k] = (pii.KINDS[kind], new)
    clean = [(1000 + k, f"{words(6)} {rng.randrange(1, 28)}/{rng.randrange(1, 12)}/2024 {rng.randrange(24)}:{rng.randrange(60)} {words(3)} (at) {words(2)}. Then {rng.randrange(10**5)}") for k in range(200)]
    rows = {r.doc_id: r for r in pii.detect(spark.createDataFrame(planted + clean, WORDY), model).collect()}
    hit, extra = defaultdict(int), 0
    for i, r in rows.items():
        found = {(s.kind, r.text[s.start : s.end]) for s in r.pii.spans}
        if i in kinds:
            hit[kinds[i][0]] += kinds[i] in found
            extra += len(found - {kinds[i]})
        else:
            extra += len(found)
    assert all(hit[k] >= 60 for k in pii.KINDS), dict(hit)  # of 100 each
    assert extra <= 0.1 * sum(hit.values()), extra


def test_pieces_hold_every_id_once(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long, fp string, pii string, score string")
    lib = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    unique = docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).repartition(3)
    want = {r.doc_id: np.array([*lib.encode(plain(r.text), add_special_tokens=False).ids, 0], "<u4") for r in unique.collect()}
    got = defaultdict(list)
    for r in packing.pack(unique, size=64, open_windows=3, least_cut=4).collect():
        got[r.doc_id].append((r.start, np.frombuffer(bytes(r.ids), "<u4")))
        assert r.doc_tokens == len(want[r.doc_id])
    for i, ids in want.items():
        at = 0
        for start, piece in sorted(got[i], key=lambda p: p[0]):
            assert start == at and (piece == ids[at : at + len(piece)]).all()
            at += len(piece)
        assert at == len(ids)


def test_automaton_equals_edit_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            row, before = [i], row
            for j, d in enumerate(b, 1):
                row.append(min(row[-1] + 1, before[j] + 1, before[j - 1] + (c != d)))
        return row[-1]

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(3, 13)))
    lexicon = [word() for _ in range(60)]
    lex = toxicity.Lexicon(lexicon, [], lexicon, [])
    for _ in range(4000):
        token = [*rng.choice(lexicon)] if rng.random() < 0.7 else [*word()]
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(token) + 1)
            token[at : at + rng.randrange(2)] = [rng.choice("abcdef")] * rng.randrange(2)
        token = "".join(token)
        want = any(distance(token, w) <= toxicity.edits_allowed(w) for w in lexicon if toxicity.edits_allowed(w))
        assert lex.near(token) == want, token


def test_toxicity_of_long_and_repeated_texts(spark):
    rng = random.Random(6)
    calm = lambda n: " ".join(rng.choice(WORDS) + rng.choice("abcdefg") for _ in range(n))
    rows = [(k, calm(20) + (" numskull " if k % 4 == 0 else " ") + calm(20)) for k in range(400)] + [(500, calm(300_000)), (1, "repeated"), (1, "repeated")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(300)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.keep_clean(docs, labels).columns == docs.columns


def test_leaves_equal_a_brute_force_tree(spark):
    """Signatures that recur, and lines of a leaf with one family: dropped from all but the first document."""
    rng = random.Random(12)
    families = [f"{a} {b} {c}" for a, b, c in zip(WORDS, WORDS[1:], WORDS[2:])][:12]
    rows = [(k, "\n".join(f"{rng.choice(families)} of {rng.randrange(9)}{'xyz'[rng.randrange(3)]} done" for _ in range(4)) + f"\nown {k}q {WORDS[k % 24]}") for k in range(60)]
    first = {}
    docs_of = defaultdict(set)
    for i, t in rows:
        for line in t.split("\n"):
            sig = lines.VARIABLE.sub(lines.MASK, line)
            docs_of[sig].add(i)
            first[sig] = min(first.get(sig, i), i)
    want = {i: "\n".join(x for x in t.split("\n") if not (len(docs_of[s := lines.VARIABLE.sub(lines.MASK, x)]) >= lines.MIN_DOCS and i > first[s])) for i, t in rows}
    got = {r.doc_id: r.text for r in lines.drop_recurring(spark.createDataFrame(rows, WORDY).repartition(3)).select("doc_id", "kept_lines.text").collect()}
    assert got == want


def test_names_that_clash(spark):
    rows = [(k, " ".join(WORDS[:14]) + f"\nline {k}", "a", "b", "c") for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans_of_id string, same_of_sigs string, __id string")
    for made in (substring.drop_repeated(docs), lines.drop_recurring(docs), pii.detect(docs)):
        assert made.columns[:5] == docs.columns and made.select("spans_of_id", "same_of_sigs", "__id").distinct().collect() == [("a", "b", "c")]
    for make, name in ((substring.drop_repeated, "kept_words"), (lines.drop_recurring, "kept_lines"), (pii.detect, "pii")):
        made = make(docs.withColumn(name, F.lit(1)))
        assert made.columns[-2:] == [name, f"{name}_"] and made.select(name).distinct().collect() == [(1,)]


def test_texts_of_megabytes(spark):
    rng = random.Random(13)
    big = " ".join(rng.choice(WORDS) + str(rng.randrange(1000)) for _ in range(400_000))  # three megabytes
    rows = [(1, big), (2, "short text"), (3, big), (4, "x" * 2_000_000)]
    docs = spark.createDataFrame(rows, WORDY).repartition(2)
    assert substring.drop_repeated(docs).filter("doc_id = 3").first().kept_words.n_removed == 400_000
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}[3] == 1
    assert lines.drop_recurring(docs).filter("kept_lines.n_dropped > 0").count() == 0  # copies stay copies
    assert {r.doc_id: r.payload_bytes for r in media.features(media.metadata(media.by_shard(media.store(docs)))).collect()}[4] >= 2_000_000
    ids = {r.doc_id: r.n_tokens for r in token_files.read_ids(*token_files.write_ids(docs)).collect()}
    assert ids[1] == ids[3] > 400_000
    assert packing.pack(docs).agg(F.sum(F.octet_length("ids"))).first()[0] > 4 * 800_000
    assert pii.detect(docs).count() == 4 and bpe.encode_texts(docs).count() == 4


def test_recall_of_quantised_search(spark):
    """Links in many clusters, against brute force: at least 0.9 of them, none that isn't one."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(300, 24))
    x = np.concatenate([centres[rng.integers(0, 300, 3000)] + rng.normal(size=(3000, 24)) * 0.2, rng.normal(size=(1000, 24))])
    rows = [(k, [float(v) for v in r]) for k, r in enumerate(x)]
    got = {r.vec_id: r.n_links for r in embeddings.links(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4), sample=1000).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = (u @ u.T >= 0.9).sum(1) - 1
    assert near.sum() > 10_000 and all(got[k] <= near[k] for k in range(len(x)))
    assert sum(got.values()) >= 0.9 * near.sum()


def test_lists_are_parted_as_they_grow(spark):
    """Parted lists find what brute force finds, level by level, and a dense group stays whole."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(200, 24))
    x = np.concatenate([centres[rng.integers(0, 200, 2400)] + rng.normal(size=(2400, 24)) * 0.2, centres[0] + rng.normal(size=(400, 24)) * 0.05])
    rows = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = {r.vec_id: r.n_links for r in embeddings.links(rows, sample=100, leaf=40).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = (u @ u.T >= 0.9).sum(1) - 1
    assert near.sum() > 10_000 and all(got[k] <= near[k] for k in range(len(x)))
    assert sum(got.values()) >= 0.97 * near.sum()
    index = spark.sparkContext.broadcast(embeddings.Index(u[rng.choice(2800, 100, replace=False)], 2800, 0.9))
    reps = rows.selectExpr("vec_id rep", "1L n", "embedding")
    placed = reps.mapInArrow(partial(embeddings._place, index), "rep long, n long, embedding array<double>, home long, probes array<long>, codes binary, miss double").cache()
    grown = embeddings.grow(placed, index, 40).cache()
    assert grown.count() == 2800 and grown.filter("NOT array_contains(probes, home) OR size(probes) > size(array_distinct(probes))").isEmpty()
    assert grown.select("home").distinct().count() > 2 * placed.select("home").distinct().count()
    assert grown.selectExpr("home div 1024 % 8 AS level").distinct().count() > 1
    # a query meets a smaller share of all rows than before
    met = lambda df: df.selectExpr("explode(probes) AS home").groupBy("home").agg(F.count("*").alias("q")).join(df.groupBy("home").agg(F.count("*").alias("n")), "home").agg(F.sum(F.col("q") * F.col("n"))).first()[0]
    assert met(grown) < met(placed)
    # rows that all link with one another aren't worth parting
    dense = [(k, 1, [float(v) for v in r]) for k, r in enumerate(u[2400:])]
    one = spark.sparkContext.broadcast(embeddings.Index(u[2400:2500], 4, 0.9))
    dense = spark.createDataFrame(dense, reps.schema).mapInArrow(partial(embeddings._place, one), placed.schema)
    assert embeddings.grow(dense, one, 40).select("home").distinct().count() == dense.select("home").distinct().count()


def test_shared_folder_has_a_scheme(spark):
    assert shared_dir(spark).startswith("file:")


def test_stages_on_awkward_rows(spark, sf):
    """Nulls, ties, repeated rows, empty tables through every stage, columns as they were."""
    import corpus_pipeline as C

    given = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    odd = [{"doc_id": None, "text": None}, {"doc_id": None, "text": ""}, {"doc_id": 1, "text": None}, {"doc_id": 3, "text": "twice told"}, {"doc_id": 3, "text": "twice told"}, {"doc_id": None, "text": "alone and unlike all other texts"}]
    rows = spark.createDataFrame([(r["doc_id"], r["text"]) for r in odd], WORDY)
    docs = given.unionByName(rows, allowMissingColumns=True).withColumns({c: F.lit("own") for c in ("pii", "kept_lines", "row_of_docs", "doc", "score")})
    for name, stage in C.STAGES:
        out = stage(spark, docs, sf)
        if name != C.STAGES[-1][0]:
            assert out.columns == docs.columns
            n = out.count()
            assert n == docs.count() if name in ("line_dedup", "personal_data") else 0 < n <= docs.count()
            assert out.filter("doc_id IS NULL").count() >= 1
        assert stage(spark, docs.limit(0), sf).count() == 0
