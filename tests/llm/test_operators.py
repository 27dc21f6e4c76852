"""Each corpus operator against a brute-force version, on rows that hold every awkward case."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

from resalio.llm import bpe, embeddings, jaccard, lines, media, packing, pii, simhash, substring, token_files, tokens, toxicity
from resalio.llm.common import components
from resalio.llm.queries import queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, pii string, score string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def corpus() -> list[tuple]:
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))
    shared, base = text(30), text(120)
    docs = [None, "", " \n\t ", "one", "Ünïcode — 中文 😀 <|endoftext|>  two", text(12), text(13), base, base, base.replace("alpha", "ALPHA"), base + " tail",
            text(20) + " " + shared + " " + text(9), shared, text(5) + " " + shared, shared + " " + shared, text(3000), "x" * 5000, "mail bob.smith@mail.example.com or +1 (555) 555-0199\n10.0.0.1 4111 1111 1111 1111"]
    docs += [text(40) + f"\nCopyright {1990 + k} by the press, all rights reserved to them\n" + text(40) for k in range(8)]
    return [(k, t, "en", "s", len(t or ""), "a", "b", "c") for k, t in enumerate(docs)] + [(7, base, "en", "s", 1, "a", "b", "c"), (None, base, "en", "s", 1, "a", "b", "c")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(t):
    return t or ""


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(5, 5), (7, 8), (8, 7)]
    least = {n: n for e in edges for n in e}
    for _ in least:
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    found = {r.u: r.v for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {n: found.get(n, n) for n in least} == least


def test_fingerprints_and_groups(docs, none):
    def one(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), plain(text)))
        rows = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in rows]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    rows = simhash.near_duplicates(docs).collect()
    print_of = {(r[0], one(r[1])) for r in corpus()}
    assert {(r.doc_id, r.fp % (1 << 64)) for r in rows} == print_of and len(rows) == len(corpus())
    prints = sorted({p for _, p in print_of})
    root = {p: p for p in prints}
    for _ in prints:
        for a in prints:
            for b in prints:
                if bin(a ^ b).count("1") <= 3:
                    root[a] = root[b] = min(root[a], root[b])
    group = defaultdict(list)
    for i, p in print_of:
        if i is not None:
            group[root[p]].append(i)
    assert all(r.component_id == min(group[root[r.fp % (1 << 64)]]) for r in rows)
    assert simhash.near_duplicates(none).count() == 0


def test_pigeonring_loses_no_pair(spark):
    rng = random.Random(3)
    prints = set()
    for _ in range(40):
        p = rng.getrandbits(64)
        prints.add(p)
        for bits in (1, 2, 3, 3, 4):
            prints.add(p ^ sum(1 << b for b in rng.sample(range(64), bits)))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = {r.fp: r.root for r in simhash.linked(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()}
    root = {p: p for p in signed}
    for _ in range(8):
        for a in signed:
            for b in signed:
                if bin((a ^ b) % (1 << 64)).count("1") <= 3:
                    root[a] = root[b] = min(root[a], root[b])
    assert {p: found.get(p, p) for p in signed} == root


def test_tokens_equal_the_library():
    rng = random.Random(2)
    parts = ["a", "B", "é", " ", "  ", "\n", " \n", "\t", ".", ",", "'s", "'", "1", "23", "…", "»", "\x1c", "\x85", " ", "<|endoftext|>", "中文", "😀", "é", "́", "İ", "ß", "Word,", "it's", "...", "x."]
    texts = [plain(r[1]) for r in corpus()] + ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(4000)]
    for name, mine in ((packing.TOKENIZER, tokens.Merger(packing.TOKENIZER)), (token_files.TOKENIZER, tokens.Merger(token_files.TOKENIZER))):
        lib = Tokenizer.from_file(public_tokenizers.path(name))
        assert [t for t, ids in zip(texts, mine(texts)) if ids != np.array(lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes()] == []
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path(bpe.RANKS)), special_tokens={})
    mine, table = bpe.byte_level(bpe.RANKS), bpe.token_bytes(bpe.RANKS)
    for t in [*texts, "a" * 20_000, "ab" * 5000, "".join(rng.choice("abcdefghij") for _ in range(20_000))]:
        assert mine(t) == np.array(lib.encode_ordinary(t), "<u4").tobytes() and bpe.decode(mine(t), table) == t.encode()


def test_packing(docs, none):
    rows = packing.pack(docs, size=64, open_windows=3, least_cut=4).collect()
    lib = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    want = sorted(((r[0] is None, r[0] or 0), np.array([*lib.encode(plain(r[1]), add_special_tokens=False).ids, 0], "<u4").tobytes()) for r in corpus())
    got, windows = defaultdict(dict), defaultdict(list)
    for r in rows:
        got[(r.doc_id is None, r.doc_id or 0), r.doc_tokens].setdefault(r.start, []).append(r.ids)
        windows[r.sequence_id].append((r.offset, len(r.ids) // 4))
    joined = b"".join(p for k in sorted(got) for _, ps in sorted(got[k].items()) for p in ps)
    assert len(joined) == sum(len(b) for _, b in want)
    for w in windows.values():
        at = 0
        for offset, n in sorted(w):
            assert offset == at
            at += n
        assert at <= 64
    assert packing.pack(none).count() == 0


def test_packer_pads_little():
    rng, p = random.Random(4), packing.Packer(1024, 64, 8)
    sizes = [rng.choice([1, 7, 100, 900, 1024, 1025, 3000]) for _ in range(2000)]
    out = [s for k, n in enumerate(sizes) for s in p.add(k, np.arange(n))] + list(p.close())
    used = [sum(len(x[2]) for x in s) for s in out]
    assert sum(used) == sum(sizes) and max(used) <= 1024
    assert sum(1024 - n for n in used if n & (n - 1)) < 0.005 * sum(sizes)


def test_token_files(docs, none):
    lib = Tokenizer.from_file(public_tokenizers.path(token_files.TOKENIZER))
    order = sorted(corpus(), key=lambda r: (r[0] is not None, r[0] or 0, plain(r[1])))
    at, want = 0, []
    for r in order:
        ids = [*lib.encode(plain(r[1]), add_special_tokens=False).ids, 1]
        want.append((r[0], at, len(ids), np.array(ids, "<u4").tobytes()))
        at += len(ids)
    rows = sorted(token_files.read_ids(*token_files.write_ids(docs)).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in rows] == want
    assert token_files.read_ids(*token_files.write_ids(none)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 1000])
def test_control_bytes_round_trip(n):
    x = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint64) >> np.random.default_rng(n + 1).integers(0, 32, n).astype(np.uint64)
    assert (token_files.decode(*token_files.encode(x.astype("<u4")), n) == x).all()


def test_substrings(docs, none):
    def brute(rows, width):
        first, words = {}, {i: plain(t).encode().split() for i, t in rows if i is not None}
        for i in sorted(words):
            for k in range(len(words[i]) - width + 1):
                first.setdefault(tuple(words[i][k : k + width]), i)
        out = {}
        for i, w in words.items():
            gone = [False] * len(w)
            for k in range(len(w) - width + 1):
                if first[tuple(w[k : k + width])] < i:
                    gone[k : k + width] = [True] * width
            out[i] = len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()
        return out

    for width in (13, 6, 3):
        want = brute([r[:2] for r in corpus()], width)
        got = substring.drop_repeated(docs, width).select("doc_id", "kept_words.*", "pii").collect()
        assert len(got) == len(corpus())
        assert all((r.n_words, r.n_removed, r.text) == want[r.doc_id] for r in got if r.doc_id is not None)
        assert all(r.n_removed == 0 for r in got if r.doc_id is None)
    assert substring.drop_repeated(none).count() == 0


def test_substrings_at_every_level(spark):
    """Runs of 4 and of 8 words that differ outside, and windows: each first length gives brute force's windows."""
    rng = random.Random(8)
    run = [rng.choice(WORDS) + str(k) for k in range(40)]
    rows = []
    for k in range(60):
        words = []
        while len(words) < 80:
            at, n = rng.randrange(30), rng.choice((3, 4, 5, 8, 9, 12, 13, 16))
            words += run[at : at + n] + [rng.choice("abc")] * rng.randrange(3)
        rows.append((k, " ".join(words)))
    first, want = {}, {}
    for i, t in rows:
        w = t.split()
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
        want[i] = {k for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert 0 < sum(map(len, want.values())) < 2500
    for length in (1, 4, 7, 13):
        got = {r.doc_id: {(s >> 6) + m for s in r.spans for m in range((s & 63) + 1)} for r in substring.repeated(docs, 13, length).collect()}
        assert all(got.get(i, set()) == want[i] for i in want)
    uneven = spark.createDataFrame([(1, rows[0][1]), (5, rows[1][1]), (5, " ".join(run[:14])), (5, "a"), (7, rows[1][1])], "doc_id long, text string")
    assert substring.drop_repeated(uneven).count() == 5


def test_media(docs, none):
    rows = media.features(media.metadata(media.by_shard(media.store(docs)))).collect()
    want = sorted(hashlib.sha256(media.pad(plain(r[1]).encode())).hexdigest() for r in corpus())
    assert sorted(r.payload_sha256 for r in rows) == want
    for r in rows:
        assert r.payload_bytes % 576 == 0 and r.payload_bytes > r.n_bytes - 1 and r.width * r.height == r.payload_bytes and r.media_sha256 == r.digest
    head = {(r.digest, r.width, r.height) for r in media.metadata(media.store(docs)).collect()}
    assert head == {(r.digest, r.width, r.height) for r in rows}
    by_text = defaultdict(set)
    for r in rows:
        by_text[r.payload_sha256].add((r.digest, r.feature, r.length))
    assert all(len(v) == 1 for v in by_text.values())
    assert zlib.crc32(media.pad(b"")[-32:]) in {r.tail_crc32 for r in rows}
    assert media.store(none).count() == 0


def naive_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and pii.luhn(d)]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_personal_data(docs, none):
    rng = random.Random(3)
    parts = ["a@b.c", "+d@e.f", "1.2.3.4", "256.1.1.1", ".5", " ", "+1 (555) 555-1234", "4111 1111 1111 1111", "12 ", "-", "@", "x", "é", "1", "+"]
    for t in ["".join(rng.choice(parts) for _ in range(rng.randrange(10))) for _ in range(5000)]:
        assert [(pii.KINDS[k], a, b) for k, a, b in pii.base_spans(t)] == naive_spans(t)
    rows = pii.detect(docs).select("doc_id", "text", "pii_.*").collect()
    assert len(rows) == len(corpus())
    for r in rows:
        base = [(s.kind, s.start, s.end) for s in r.base]
        assert base == naive_spans(plain(r.text)) and set(base) <= {(s.kind, s.start, s.end) for s in r.spans}
        assert (r.redacted is None) == (r.text is None)
    assert pii.detect(none).count() == 0
    assert len(pii.base_spans("a" * 200_000 + "@" + "1" * 200_000)) == 0


def test_boosted_trees_learn():
    from resalio.llm.boosting import boost, predict

    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) & (x[:, 1] < 0.5)).astype(float)
    assert ((predict(boost(x[:1000], y[:1000]), x[1000:]) > 0.5) == y[1000:]).mean() > 0.97


def test_line_templates(docs, none):
    rows = {r.doc_id: r for r in lines.drop_recurring(docs).select("doc_id", "text", "kept_lines.text", "kept_lines.n_lines", "kept_lines.n_dropped").toDF("doc_id", "old", "new", "n_lines", "n_dropped").collect()}
    notices = [i for i, r in rows.items() if i is not None and "Copyright" in plain(r.old)]
    assert [rows[i].n_dropped for i in sorted(notices)] == [0] + [1] * 7
    assert all("Copyright" not in rows[i].new and rows[i].new.count("\n") == 1 for i in sorted(notices)[1:])
    assert all(r.n_dropped == 0 and r.new == r.old for i, r in rows.items() if i not in notices)
    assert lines.drop_recurring(none).count() == 0


def test_copies_are_left_whole(spark):
    text = "\n".join(f"line {w} of a copied text that is long enough" for w in WORDS[:6])
    rows = lines.drop_recurring(spark.createDataFrame([(k, text) for k in range(12)], "doc_id long, text string")).select("kept_lines.*").collect()
    assert all(r.text == text and r.n_dropped == 0 for r in rows)


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 16))
    x = [*(centres[k % 30] + rng.normal(size=16) * (0.05 if k % 2 else 0.4) for k in range(240))]
    x += [x[0], x[0], x[3] * 2.5]
    rows = [(k, [float(v) for v in r]) for k, r in enumerate(x)]
    bad = [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [1.0, None]), (905, [float("inf")] * 16)]
    got = {r.vec_id: r for r in embeddings.links(spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")).collect()}
    u = np.array([r for _, r in rows])
    u /= np.linalg.norm(u, axis=1)[:, None]
    near = (u @ u.T >= 0.9) & ~np.eye(len(u), dtype=bool)
    root = np.arange(len(u))
    for _ in range(len(u)):
        root = np.minimum(root, np.where(near, root[None, :], 10**6).min(1))
    found = sum(got[k].n_links for k in range(len(u)))
    assert 0.9 * near.sum() <= found <= near.sum()
    assert all(got[k].n_links <= near[k].sum() for k in range(len(u)))
    assert np.mean([got[k].component_id == root[k] for k in range(len(u))]) > 0.95
    assert all(got[k].n_links == 0 and got[k].component_id == k and got[k].kept for k, _ in bad)
    assert embeddings.links(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_toxicity(spark):
    rng = random.Random(6)
    calm = lambda: " ".join(rng.choice(WORDS) + rng.choice("abcdefg") for _ in range(30))
    insults = ["numskull", "blockhead", "dunderhead", "nincompoop"]
    rude = lambda: " ".join([calm(), rng.choice(insults), calm(), rng.choice(insults)])
    rows = [(k, rude() if k % 4 == 0 else calm()) for k in range(800)] + [(900, None), (901, ""), (902, "you numskul and " + calm() + " blokhead"), (None, calm())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(400)] + [(5, None)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels).collect()}
    wrong = [k for k in range(400, 800) if (got[k] >= toxicity.THRESHOLD) != (k % 4 == 0)]
    assert wrong == [] and got[902] >= toxicity.THRESHOLD and max(got[900], got[901], got[None]) < toxicity.THRESHOLD
    assert toxicity.keep_clean(docs, labels).filter("doc_id < 800").count() == 600
    assert toxicity.toxicity(docs, labels.limit(0)).count() == len(rows)
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_levenshtein_automaton():
    lex = toxicity.Lexicon(["worthless", "moron"], [], ["worthless", "moron"], [])
    assert [lex.kind(t) for t in ("moron", "morn", "mroon", "w0rthles", "worthlss", "worthwhile", "mood", "maroons")] == [1, 3, 0, 3, 3, 0, 0, 0]


def test_queries_run(spark, sf):
    known = queries()
    assert {f"op{n}" for n in range(1, 11)} <= {k.split("_")[0] for k in known} and "pipeline" in known
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    for name in ("op1_pii", "op3_byte_bpe", "op4_substrings", "op5_token_files", "op6_media", "op7_simhash", "op8_line_templates", "op10_toxicity"):
        assert known[name](spark, sf).count() == n, name


def test_pipeline(spark, sf):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in C.STAGES[:-1]:
        docs = C.materialize(stage(spark, docs, sf), name)
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes[0] >= sizes[1] == sizes[2] >= sizes[3] == sizes[4] > 0
    assert C.STAGES[-1][1](spark, docs, sf).select("doc_id").distinct().count() == sizes[4]


def test_near_dedup_keeps_one_row_of_each_group(spark):
    import corpus_pipeline as C

    rng = random.Random(8)
    text = lambda: " ".join(rng.choice(WORDS) + rng.choice("abcdefg") for _ in range(60))
    alone, twice, mixed, repeated, other = (text() for _ in range(5))
    rows = [(None, alone), (None, twice), (None, twice), (None, mixed), (4, mixed), (3, mixed), (5, repeated), (5, repeated), (6, repeated), (5, other), (8, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, source string").repartition(3)
    got = C.near_dedup(spark, docs, "")
    assert got.columns == docs.columns
    want = [(None, alone), (None, twice), (3, mixed), (5, repeated), (5, other), (8, "")]
    order = lambda rs: sorted(rs, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert order((r.doc_id, r.text) for r in got.collect()) == order(want)
    assert C.near_dedup(spark, docs.limit(0), "").count() == 0


def test_near_copies_equal_brute_force(spark):
    import corpus_pipeline as C

    rng = random.Random(9)
    word = lambda: rng.choice(WORDS) + rng.choice("abcdefg")
    rows = [(None, "lone words"), (900, None), (901, " \n"), (902, "one two"), (903, "ONE two"), (904, "one two three")]
    for k in range(30):
        base = [word() for _ in range(rng.choice([20, 60, 200]))]
        for c in range(6):
            copy = [*base]
            for _ in range(rng.randrange(1 + len(base) // 25)):
                copy[rng.randrange(len(copy))] = word()
            rows.append((k * 10 + c, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)

    def sets(text):
        words = plain(text).lower().split()
        return frozenset(zip(*(words[i:] for i in range(5)))) if len(words) >= 5 else frozenset([tuple(words)] if words else [])

    found = {i: sets(t) for i, t in rows}
    root = {i: i for i in found if i is not None}
    pairs = [(a, b) for a in root for b in root if found[a] == found[b] or found[a] and found[b] and len(found[a] & found[b]) >= 0.8 * len(found[a] | found[b])]
    for _ in range(8):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.doc_id: r.component_id for r in jaccard.near_copies(docs).collect()}
    assert got.pop(None) is None and got == root
    assert len(set(root.values())) < len(root) and any(root[i] != i for i in root)
    assert {r.doc_id for r in C.near_dedup(spark, docs, "").collect()} == {None, *root.values()}
    assert jaccard.near_copies(docs.limit(0)).count() == 0


def dropped(spark, rows):
    found = lines.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).select("doc_id", "kept_lines.*").collect()
    return {r.doc_id: (r.text, r.n_dropped) for r in found}


def test_long_lines_go_from_the_second_document_on(spark):
    long, short = " ".join(WORDS[:20]), "see below"
    dated = "the press release of 2024 was sent to all readers and friends"
    got = dropped(spark, [(1, f"one\n{long}\n{short}\n{dated}"), (2, f"{long}\ntwo\n{short}"), (3, f"three\n{dated}"), (4, f"four\n{dated.replace('2024', '2023')}"), (None, long)])
    assert got == {1: (f"one\n{long}\n{short}\n{dated}", 0), 2: (f"two\n{short}", 1), 3: ("three", 1), 4: (f"four\n{dated.replace('2024', '2023')}", 0), None: (long, 0)}


def test_short_pages_lose_their_boilerplate(spark):
    notice = "all rights reserved\nterms of use\ncontact the press"
    rows = [(k, f"{notice}\nown {w}") for k, w in enumerate(WORDS[:8])] + [(20, notice)]
    rows += [(k, f"{notice}\nown alpha") for k in (30, 31)]  # copies of the first lose what that one loses: nothing
    got = dropped(spark, rows)
    assert got == {0: rows[0][1:] + (0,), 20: ("", 3), 30: rows[0][1:] + (0,), 31: rows[0][1:] + (0,)} | {k: (f"own {w}", 3) for k, w in enumerate(WORDS[:8]) if k}


@pytest.mark.parametrize("counts", [(6, 6, 6), (40, 6, 5)])
def test_families_that_share_a_leaf(spark, counts):
    ends = ["was opened by our staff on", "will be closed until noon every", "may need some more care from"]
    rows, at = [], 0
    for n, end in zip(counts, ends):
        for k in range(n):
            at += 1
            rows.append((at, f"note: the office {end} {WORDS[k % 24]}{'xyz'[k // 24]} please\nown{at} text"))
    got = dropped(spark, rows)
    firsts = {1, 1 + counts[0], 1 + counts[0] + counts[1]}
    assert {i for i, (_, n) in got.items() if n == 0} == firsts


def test_mostly_variable_lines_recur_word_for_word(spark):
    rows = [(k, f"Page 3 of 12\nPage {k} of {k}7\nTel: 555-0100\n{w}") for k, w in enumerate(WORDS[:6])]
    assert dropped(spark, rows) == {k: (t, 0) if k == 0 else (f"Page {k} of {k}7\n{WORDS[k]}", 2) for k, t in rows}
