"""Line templates and the pipeline's stages against plain Python, text by text."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from resalio.llm import common, lines, packing, pii, toxicity
from resalio.llm.queries import queries

WORDY = "doc_id long, text string"


def masked(line):
    tokens = [lines.MASK if any(c in "0123456789" for c in w) else w for w in line.split()]
    return tokens, 2 * tokens.count(lines.MASK) < len(tokens)


def dropped(rows, depth=lines.DEPTH, least=lines.MIN_DOCS, alike=lines.ALIKE):
    """What is left of each text of rows (doc_id, text), by the rules of the tree, one line at a time."""
    first_of = {}
    for i, t in rows:
        if i is not None and t is not None:
            first_of[t] = min(first_of.get(t, i), i)
    ways = defaultdict(dict)  # way in which a line recurs -> text -> document
    needed, tokens_of = {}, {}
    for t, i in first_of.items():
        for line in t.split("\n"):
            tokens, templated = masked(line)
            words = tuple(line.split())
            if tokens and templated:
                way = ("sig", len(tokens), tuple(tokens[:depth]), tuple(tokens))
                ways[way][t], needed[way], tokens_of[way] = i, least, [lines.hashed(w) for w in tokens]
            if words and (len(words) >= lines.LONG or not templated):
                way = ("raw", words)
                ways[way][t], needed[way] = i, min(2, least) if len(words) >= lines.LONG else least
    gone = defaultdict(set)  # text -> ways that it loses
    for way, where in ways.items():
        docs = set(where.values())
        if len(docs) >= needed[way]:
            for t, i in where.items():
                if i > min(docs):
                    gone[t].add(way)
    leaves = defaultdict(list)
    for way, where in ways.items():
        if way[0] == "sig":
            leaves[way[1:3]] += [(i, t, way) for t, i in where.items()]
    groups = [g for g in leaves.values() if len(g) >= least and len({w for _, _, w in g}) > 1]
    while groups:
        later = []
        for g in groups:
            if len(g) < least:
                continue
            places = [Counter(tokens_of[w][k] for _, _, w in g) for k in range(len(tokens_of[g[0][2]]))]
            fixed = {k: top for k, c in enumerate(places) for n, top in [max((n, t) for t, n in c.items())] if 2 * n >= len(g)}
            part = max(((sum(n for n in c.values() if n >= least), -len(c), -k) for k, c in enumerate(places) if len(c) > 1), default=None)
            fits = [sum(tokens_of[w][k] == v for k, v in fixed.items()) >= alike * len(places) for _, _, w in g]
            docs = {i for (i, _, _), f in zip(g, fits) if f}
            if len(docs) >= least:
                for (i, t, w), f in zip(g, fits):
                    if f and i > min(docs):
                        gone[t].add(w)
                later.append([r for r, f in zip(g, fits) if not f])
            elif part:
                split = defaultdict(list)
                for r in g:
                    split[tokens_of[r[2]][-part[2]]].append(r)
                later += split.values()
        groups = later
    out = []
    for i, t in rows:
        if t is None or i is None or not gone[t]:
            out.append((i, t))
            continue
        kept = []
        for line in t.split("\n"):
            tokens, templated = masked(line)
            mine = {("sig", len(tokens), tuple(tokens[:depth]), tuple(tokens))} if tokens and templated else set()
            if not (mine | {("raw", tuple(line.split()))}) & gone[t]:
                kept.append(line)
        out.append((i, "\n".join(kept)))
    return out


def key(rows):
    return sorted(((i, t) for i, t in rows), key=str)


def kept_lines(docs):
    return key(docs.select("doc_id", "kept_lines.text").collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_templates_equal_a_brute_force_tree(spark, seed):
    """Leaves in which families meet, fields without digits, lines that agree in more or fewer places than ALIKE, long lines, lines of variables, copies."""
    rng = random.Random(seed)
    word = lambda n=40: f"w{'abcdefghij'[rng.randrange(10)]}{'klmn'[rng.randrange(4)]}" if n == 40 else f"v{'abcdefghijklmnopqrstuvwxyz'[rng.randrange(n)]}"
    heads = [("the", "job", "of"), ("the", "job", "on"), ("user", "is", "at")]
    families = [(rng.choice(heads), [word() if rng.random() < 0.6 else None for _ in range(rng.randrange(2, 7))]) for _ in range(9)]
    long_lines = [" ".join(word() for _ in range(11)) for _ in range(6)]

    def line():
        kind = rng.random()
        if kind < 0.6:
            head, rest = rng.choice(families)
            return " ".join([*head, *(w or rng.choice([word(8), word(20), str(rng.randrange(99))]) for w in rest)])
        if kind < 0.7:
            return rng.choice(long_lines) if rng.random() < 0.5 else " ".join(word() for _ in range(12))
        if kind < 0.8:
            return rng.choice(["10 20 a", "1 2", "7 x", ""])
        return f"own {word()} {word()} {rng.randrange(10**6)}"

    rows = [(k, "\n".join(line() for _ in range(rng.randrange(1, 9)))) for k in range(120)]
    rows += [(200 + k, rows[k % 10][1]) for k in range(15)] + [(None, rows[0][1]), (300, None), (300, ""), (7, rows[9][1])]
    want = key(dropped(rows))
    assert kept_lines(lines.drop_recurring(spark.createDataFrame(rows, WORDY).repartition(4))) == want
    assert sum(t != u for (_, t), (_, u) in zip(key(rows), want)) > 40


def jaccard_kept(rows):
    """The row numbers that stay: of each component of texts at 0.8 or more of their 5-word shingles the least id's first."""
    sets = []
    for _, t in rows:
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets.append({tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set())
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if sets[a] == sets[b] or either and 5 * both >= 4 * either:
                root[find(a)] = find(b)
    groups = defaultdict(list)
    for k in range(len(rows)):
        groups[find(k)].append(k)
    return {min(g, key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k)) for g in groups.values()}


def test_stages_equal_plain_python(spark):
    """Every stage of the pipeline on what the one before has kept, each text against plain Python."""
    import corpus_pipeline as C

    sf = "/root/testdata/sf0.001"
    stages = dict(C.STAGES)
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    pairs = lambda df: [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]

    model = toxicity.train(docs, labels)
    lexicon, weights = toxicity._lexicon(model), np.array(__import__("json").loads(model)["weights"])
    score = lambda t: 1 / (1 + np.exp(-(np.array(lexicon.features(t or "")) @ weights[:-1] + weights[-1])))
    clean = common.materialize(stages["toxicity"](spark, docs, sf), "clean")
    assert key(pairs(clean)) == key((i, t) for i, t in pairs(docs) if score(t) < toxicity.THRESHOLD)

    fewer = common.materialize(stages["line_dedup"](spark, clean, sf), "fewer")
    assert key(pairs(fewer)) == key(dropped(pairs(clean)))
    assert fewer.filter("n_chars <> length(text)").count() == 0

    apart = common.materialize(stages["near_dedup"](spark, fewer, sf), "apart")
    rows = pairs(fewer)
    assert key(pairs(apart)) == key(rows[k] for k in jaccard_kept(rows))

    private = common.materialize(stages["personal_data"](spark, apart, sf), "private")
    models = __import__("json").loads(pii.train(apart))
    redacted = lambda t: pii.redact(t, pii.all_spans(t, pii.base_spans(t), models))
    assert key(pairs(private)) == key((i, redacted(t)) for i, t in pairs(apart))

    lib = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    lib.encode_special_tokens = True
    got = defaultdict(list)
    for r in stages["packing"](spark, private, sf).collect():
        got[r.doc_id].append(r)
    want = {i: [*lib.encode(t, add_special_tokens=False).ids, 0] for i, t in pairs(private)}
    assert got.keys() == want.keys()
    for i, ids in want.items():
        own = sorted(got[i], key=lambda r: r.start)
        assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist() and sum(r.length for r in own) == len(ids) == own[0].doc_tokens


def test_registered_queries_run(spark, tmp_path):
    """op2, op7 and op9 as they are registered, on small tables with a null id, null and repeated rows."""
    rows = [(k, f"alpha beta gamma delta {k % 7} epsilon") for k in range(30)] + [(None, "alone"), (3, None), (3, None)]
    spark.createDataFrame(rows, WORDY).write.parquet(f"{tmp_path}/documents.parquet")
    vectors = [(k, [1.0, float(k % 3), 0.5]) for k in range(12)] + [(None, None), (1, [1.0, 1.0, 0.5])]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    q = queries()
    packed = q["op2_packing"](spark, str(tmp_path))
    assert packed.agg(F.sum("length")).first()[0] > 4 * 30 and packed.filter("doc_id = 3").count() == 3
    near = {r.doc_id: r.component_id for r in q["op7_simhash"](spark, str(tmp_path)).filter("doc_id IS NOT NULL AND doc_id <> 3").collect()}
    assert all(near[k] == k % 7 if k % 7 != 3 else near[k] <= 10 for k in near)
    linked = q["op9_embeddings"](spark, str(tmp_path)).collect()
    assert len(linked) == 14 and sum(r.n_links for r in linked if r.vec_id is not None) > 0
