"""Quality rules: decision lists of threshold conjunctions, learnt by sequential covering, as conditional expressions.

A pass over the texts counts what stands in each (words, symbols, repeats, capitals, ...); FEATURES are quotients of
these counts, as SQL. Rules for poor documents are learnt one after another from labelled documents: two thirds of
those not yet covered grow a rule, adding the threshold of the greatest information gain until it covers no good
document; the last third prunes it, condition by condition from the last; a rule that isn't precise on both thirds
ends the list. The list becomes one ordered CASE expression over the counts, which Spark evaluates in the JVM:
the first rule that holds drops a document, one that none covers is kept.

Learning takes a bounded sample, the SAMPLE labelled documents with the least hashes of their ids; counting and
judging take all documents, whole, in one pass without a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import small, table, unused

#: Labelled documents that are learnt from, at most; rules and conditions of one at most; precision of a rule (Laplace's estimate) and documents that it covers, at least.
SAMPLE, RULES, CONDITIONS, PRECISE, COVERED = 20_000, 24, 4, 0.9, 4
#: The base rules: fewer words, or a greater share of words in repeated windows, fail.
LEAST_WORDS, MOST_REPEATED, WINDOW = 50, 0.5, 3
SYMBOLS, BLANKS, ENDS = "#*$%&|<>", " \t\n\x0b\x0c\r", tuple(".!?:;…\"”»)")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_open_lines", "n_distinct", "n_stutters", "n_capitals", "n_digits", "n_calls", "longest_word")
#: What rules compare with thresholds: quotients of the counts, never of ids, sources or languages.
FEATURES = {
    "n_words": "cast(n_words as double)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "longest_word": "cast(longest_word as double)",
    "symbols": "n_symbols / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "open_lines": "n_open_lines / greatest(n_lines, 1)",
    "words_a_line": "n_words / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "distinct": "n_distinct / greatest(n_words, 1)",
    "stutters": "n_stutters / greatest(n_words, 1)",
    "capitals": "n_capitals / greatest(word_chars, 1)",
    "digits": "n_digits / greatest(word_chars, 1)",
    "calls": "n_calls / greatest(n_words, 1)",
}
#: A rule is [[feature, "<=" or ">", threshold], ...]: all of them hold.
Rule = list[list]


def in_repeats(codes: np.ndarray, distinct: int, window: int = WINDOW) -> int:
    """Words in windows that are found twice or more."""
    n = len(codes) - window + 1
    if n < 2:
        return 0
    keys = codes[:n]
    for k in range(1, window):
        if k > 1 and distinct ** (k + 1) >= 2**63:
            keys = np.unique(keys, return_inverse=True)[1]
        keys = keys * distinct + codes[k : n + k]
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    again = np.zeros(n, bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    covered = np.concatenate([again, np.zeros(window - 1, bool)])
    for k in range(1, window):
        covered[k : n + k] |= again
    return int(covered.sum())


def counts(text: str | None) -> tuple[int, ...]:
    """COUNTS of a text; all 0 for a null one."""
    text = text or ""
    words = text.encode().split()
    known: dict[bytes, int] = {}
    codes = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    capitals = ((points - 65 < 26) | ((points >= 0xC0) & (points <= 0xDE) & (points != 0xD7))).sum()
    return (
        len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), in_repeats(codes, len(known)), len(lines),
        sum(not line.rstrip(BLANKS).endswith(ENDS) for line in lines), len(known), int((codes[1:] == codes[:-1]).sum()), int(capitals), int((points - 48 < 10).sum()),
        text.count("!") + text.count("?"), max(map(len, known), default=0),
    )


_TYPE = StructType([StructField(c, LongType()) for c in COUNTS])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small(batches):
        rows = np.array([counts(t) for t in b.column("text").to_pylist()], np.int64).reshape(-1, len(COUNTS))
        found = pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(len(COUNTS))], list(COUNTS))
        yield pa.RecordBatch.from_arrays([b.column("row"), found], ["row", "found"])


def counted(docs: DataFrame, *carried: str) -> DataFrame:
    """One row per row of docs: `row`, a struct of the columns to carry, and `found`, a struct of COUNTS of its text."""
    plain = docs.select(F.struct(*(F.col(f"`{c}`") for c in carried)).alias("row"), "text")
    return plain.mapInArrow(_count, StructType([plain.schema["row"], StructField("found", _TYPE)]))


def base_failed() -> Column:
    """Too few words, or too many of them in repeated windows; exact in whole numbers."""
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > int(100 * MOST_REPEATED) * F.col("n_words"))


def _between(low: float, high: float) -> float:
    """The shortest decimal d with low <= d < high."""
    for digits in range(1, 17):
        if low <= (d := float(f"{(low + high) / 2:.{digits}g}")) < high:
            return d
    return low


def covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    """Rows of x (a column per FEATURES) for which all conditions hold."""
    names = list(FEATURES)
    out = np.ones(len(x), bool)
    for f, sign, t in rule:
        v = x[:, names.index(f)]
        out &= v <= t if sign == "<=" else v > t
    return out


def grow(x: np.ndarray, y: np.ndarray, most: int = CONDITIONS) -> Rule:
    """Conditions, each the one of the greatest gain for y = 1 among what those before it cover, until no y = 0 is covered."""
    rule: Rule = []
    while len(rule) < most and y.any() and not y.all():
        whole = math.log2(y.mean())
        best = (1e-9, None)
        for f, name in enumerate(FEATURES):
            order = np.argsort(x[:, f], kind="stable")
            v, hit = x[order, f], y[order]
            cut = np.flatnonzero(v[1:] > v[:-1])  # the last row at or below a threshold
            good, n = np.cumsum(hit)[cut], cut + 1
            for sign, p, k in (("<=", good, n), (">", hit.sum() - good, len(hit) - n)):
                gain = np.where(p > 0, p * (np.log2(np.maximum(p, 0.5) / k) - whole), 0)
                if len(gain) and gain.max() > best[0]:
                    at = cut[int(gain.argmax())]
                    best = gain.max(), [name, sign, _between(float(v[at]), float(v[at + 1]))]
        if best[1] is None:
            break
        rule.append(best[1])
        kept = covers([best[1]], x)
        x, y = x[kept], y[kept]
    return rule


def prune(rule: Rule, x: np.ndarray, y: np.ndarray) -> Rule:
    """The leading conditions that are worth most on other rows, (p - n) / (p + n); of equal ones the fewest."""

    def worth(k: int) -> float:
        c = covers(rule[:k], x)
        p, n = int(y[c].sum()), int(c.sum() - y[c].sum())
        return (p - n) / (p + n) if p + n else -1.0

    return rule[: max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))] if rule else rule


def precise(rule: Rule, x: np.ndarray, y: np.ndarray) -> float:
    """Laplace's estimate of the share of y = 1 among what the rule covers."""
    c = covers(rule, x)
    return (y[c].sum() + 1) / (c.sum() + 2)


def cover(x: np.ndarray, poor: np.ndarray, most: int = RULES) -> list[Rule]:
    """An ordered list of rules for poor rows. Rows are dealt to growing and pruning by their place, two to one."""
    rules: list[Rule] = []
    third = np.arange(len(x)) % 3 == 2
    y = poor.astype(bool)
    while len(rules) < most and y[~third].sum() >= COVERED:
        rule = grow(x[~third], y[~third])
        rule = prune(rule, x[third], y[third])
        c = covers(rule, x)
        if not rule or y[c].sum() < COVERED or min(precise(rule, x, y), precise(rule, x[third], y[third]) if y[c & third].sum() >= COVERED else 1.0) < PRECISE:
            break
        rules.append(rule)
        x, y, third = x[~c], y[~c], third[~c]
    return rules


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """(poor, features) of at most so many labelled documents that pass the base rules, in a defined order. Labels other than 0 and 1, and null ids, are left out; a document labelled twice counts as often."""
    chosen = labels.select("doc_id", "quality").filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(rows)
    known = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # the limit bounds what is broadcast
    x = counted(known, "doc_id", "quality").select("row.*", "found.*").filter(~base_failed())
    features = F.array(*(F.expr(e) for e in FEATURES.values())).alias("features")
    return x.select((1 - F.col("quality")).alias("poor"), features, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "poor", "features").limit(rows).select("poor", "features")  # ids may repeat


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> list[Rule]:
    """The decision list. Without labelled documents of both kinds it has no rules."""
    found = sample(docs, labels, rows).collect()  # at most `rows` short rows
    return cover(np.array([r.features for r in found], float).reshape(-1, len(FEATURES)), np.array([r.poor for r in found], bool))


def condition(rule: Rule) -> Column:
    """A rule as a conjunction over the counts."""
    out = F.lit(True)
    for f, sign, t in rule:
        v = F.expr(FEATURES[f])
        out = out & (v <= F.lit(t) if sign == "<=" else v > F.lit(t))
    return out


def decided(rules: list[Rule]) -> Column:
    """The number from 1 of the first rule that holds for a row of counts, 0 where none does: one ordered CASE."""
    if not rules:
        return F.lit(0)
    case = F.when(condition(rules[0]), F.lit(1))
    for k, rule in enumerate(rules[1:], 2):
        case = case.when(condition(rule), F.lit(k))
    return case.otherwise(F.lit(0))


def quality_rules(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """docs (text and any other columns) with one more column, `judged` (underscores follow where docs has it): COUNTS, base_failed, rule (the one that drops the document, 0 none) and kept.

    Null and empty texts have counts of 0 and fail the base rules. Repeated rows and null doc_ids are judged like any
    others; an empty table gives no rows.
    """
    name = unused(docs, "judged")
    found = counted(docs, *docs.columns).select("row", "found.*")
    rule = F.when(base_failed(), F.lit(0)).otherwise(decided(rules))
    judged = F.struct(*COUNTS, base_failed().alias("base_failed"), rule.alias("rule"), (~base_failed() & (rule == 0)).alias("kept"))
    return found.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns), judged.alias(name))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality_rules(docs, learn(docs, table(spark, sf_dir, "labels")))
    return judged.select("doc_id", *(f"judged.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")))
