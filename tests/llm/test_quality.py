"""Quality rules: counts against plain Python, learnt lists against planted ones, the CASE expression against the rules, held-out labels."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from resalio.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    """The five counts of the contract, one by one."""
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    again = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(again)


def verdict(counts):
    return counts[0] < 50 or 100 * counts[4] > 50 * counts[0]


def test_counts_equal_plain_python():
    rng = random.Random(4)
    texts = [None, "", " ", "\n\n", "a\x0b\x0cb\r\n c d  e", "É È <b>|x|</b> ß!", "one line\none line\n one line\none line ", "\x1c\x1d a"]
    for _ in range(300):
        texts.append("".join(rng.choice(["a", "b", "ab", "É", "1", "#", "|", "!", " ", " ", " ", "\n", "\t", "\x0b"]) for _ in range(rng.randrange(80))))
    for t in texts:
        got = dict(zip(quality.COUNTS, quality.counts(t)))
        assert tuple(quality.counts(t)[:5]) == plain(t), t
        words = WORD.findall(t or "")
        assert got["n_distinct"] == len(set(words)) and got["n_stutters"] == sum(a == b for a, b in zip(words, words[1:]))


def test_repeated_windows_of_many_words():
    """Keys that don't fit 64 bits are numbered anew; the count is the same."""
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 40, 500)
    assert quality.in_repeats(codes, 40) == quality.in_repeats(codes, 3_000_000) > 0
    assert quality.in_repeats(codes, 40, 6) == quality.in_repeats(codes, 2**31, 6)


def test_planted_rules_are_learnt():
    """Two planted conjunctions among noise: both are found, nearly all poor rows are covered, few good ones."""
    rng = np.random.default_rng(7)
    names = list(quality.FEATURES)
    x = rng.random((6000, len(names)))
    a, b, c = (names.index(f) for f in ("symbols", "repeats", "capitals"))
    poor = ((x[:, a] > 0.8) & (x[:, b] > 0.5)) | (x[:, c] <= 0.07)
    y = poor ^ (rng.random(len(x)) < 0.01)
    rules = quality.cover(x, y)
    new = rng.random((6000, len(names)))
    truth = ((new[:, a] > 0.8) & (new[:, b] > 0.5)) | (new[:, c] <= 0.07)
    found = np.any([quality.covers(r, new) for r in rules], axis=0)
    assert (found & truth).sum() >= 0.9 * truth.sum() and (found & ~truth).sum() <= 0.03 * (~truth).sum()
    assert {f for r in rules for f, _, _ in r} >= {"symbols", "repeats", "capitals"}
    assert quality.prune([["symbols", ">", 0.8], ["digits", "<=", 0.5]], x, x[:, a] > 0.8) == [["symbols", ">", 0.8]]


def test_no_rule_from_noise_or_one_kind():
    rng = np.random.default_rng(8)
    x = rng.random((3000, len(quality.FEATURES)))
    assert quality.cover(x, rng.random(3000) < 0.1) == []
    assert quality.cover(x, np.zeros(3000, bool)) == [] and quality.cover(x[:0], np.zeros(0, bool)) == []


@pytest.mark.parametrize("low, high", [(0.1, 0.2), (0.0, 1e-9), (1.0, 1.0000000000000002), (3.0, 4.0), (-2.0, -1.5)])
def test_thresholds_part_their_neighbours(low, high):
    assert low <= quality._between(low, high) < high


def test_list_is_one_ordered_expression(spark):
    """Spark's CASE names the same rule as plain Python, first rule first."""
    rules = [[["symbols", ">", 0.2], ["n_words", "<=", 80.0]], [["symbols", ">", 0.1]], [["capitals", ">", 0.4], ["calls", ">", 0.0]]]
    rng = random.Random(9)
    kinds = (["word", "plain"], ["a#", "word", "x", "y"], ["WORDS!", "LOUD!"], ["word", "plain", "x", "y", "z", "a|"])
    rows = [(k, " ".join(rng.choice(kinds[k % 4]) + str(rng.randrange(400)) for _ in range(rng.randrange(40, 120)))) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    x = {r.doc_id: np.array([list(r.x)]) for r in quality.counted(docs, "doc_id").select("row.doc_id", "found.*").select("doc_id", F.array(*(F.expr(e) for e in quality.FEATURES.values())).alias("x")).collect()}
    seen = Counter()
    for r in quality.quality_rules(docs, rules).collect():
        want = next((k for k, rule in enumerate(rules, 1) if quality.covers(rule, x[r.doc_id])[0]), 0)
        failed = verdict(plain(r.text))
        assert r.judged.base_failed == failed
        assert r.judged.rule == (0 if failed else want) and r.judged.kept == (not failed and not want)
        seen[r.judged.rule] += 1
    assert len(seen) == 4


def test_query_on_given_tables(spark):
    """Base columns by plain Python; verdicts against labels that nothing was learnt from."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r for r in quality.op11_quality_rules(spark, sf).collect()}
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert got.keys() == texts.keys()
    for i, r in got.items():
        assert tuple(r)[1:6] == plain(texts[i]) and r.base_failed == verdict(plain(texts[i]))
        assert not (r.kept and r.base_failed)
    rules = quality.learn(docs, labels.filter("doc_id % 2 = 0"))
    kept = {r.doc_id: r.judged for r in quality.quality_rules(docs, rules).collect()}
    unseen = [(r.quality, kept[r.doc_id]) for r in labels.filter("doc_id % 2 = 1").collect() if not kept[r.doc_id].base_failed]
    poor, good = [j.kept for q, j in unseen if q == 0], [j.kept for q, j in unseen if q == 1]
    assert sum(poor) <= 0.2 * len(poor) and sum(good) >= 0.98 * len(good)


def test_awkward_rows(spark):
    rows = [(None, "a " * 60), (1, None), (2, ""), (3, "word " * 500_000), (3, "word " * 500_000), (4, " ".join(f"w{k}" for k in range(70))), (None, None)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, judged string, n_words int")
    labels = spark.createDataFrame([(1, 0), (4, 1), (None, 0), (4, 7), (3, None)], "doc_id long, quality int")
    rules = quality.learn(docs, labels)
    assert rules == []
    out = quality.quality_rules(docs, rules)
    assert out.columns == ["doc_id", "text", "judged", "n_words", "judged_"] and out.schema["judged_"].dataType.names[:1] == ["n_words"]
    got = out.collect()
    assert sorted((r.judged_.n_words, r.judged_.kept) for r in got) == [(0, False)] * 3 + [(60, False), (70, True)] + [(500_000, False)] * 2
    assert quality.quality_rules(docs.limit(0), rules).count() == 0 and quality.learn(docs.limit(0), labels.limit(0)) == []
