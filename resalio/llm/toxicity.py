"""Toxicity: a learnt lexicon, misspellings by Levenshtein automata on its trie, and scores of what stands around.

Words and stems (leading letters) that toxic labelled documents use and clean ones don't make the lexicon. A token
matches a word or stem exactly, or a word within its edits: the automaton of the token's edit distances walks the
lexicon's trie and leaves a branch as soon as no distance can stay within the edits. Forms that clean documents use
never match by edits. Each match is judged by the tokens around it, as quotation or report, or as address; a
logistic model of the kinds of matches, fitted on the same labelled sample, gives the score.

Labels come from a bounded sample of SAMPLE labelled documents, those with the least hashes of their ids, without
the held-out ones. Everything else is one pass over the texts, without a shuffle of them.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held, materialize, table, texts

#: Labelled documents that are learnt from, at most; a document with this score or more is toxic.
SAMPLE, THRESHOLD = 20_000, 0.3
#: A lexicon entry is in this share of the toxic documents at least, and is this many times likelier there.
SHARE, TIMES = 0.01, 30.0
#: Words in this share of them are found misspelt too (rarer ones are forms of stems); such a match counts as so much of a match.
EDITED, TRUST = 0.05, 0.5
STEMS, WINDOW, KNOWN = (4, 5, 6), 5, 100_000
EDGE = "\"'“”„«»‘’‚()[]{}.,;:!?¡¿…-–—_*#"
QUOTES = "\"“”„«»"
REPORTS = frozenset("said says wrote writes quoted quote called reported claimed dijo dice escribió citó llamó sagte sagt schrieb zitierte nannte dit disait écrit cite appelé according laut según selon".split())
ADDRESS = frozenset("you your you're u ur yourself du dich dir dein ihr euch sie tu te toi vous votre tú ti usted eres vosotros are bist es sind".split())
FEATURES = ("matches", "quoted", "addressed", "any", "several", "density")


def edits_allowed(word: str) -> int:
    return 0 if len(word) < 5 else 1 if len(word) < 9 else 2


class Lexicon:
    """Words, stems that tokens may begin with, and tries of the words that edits may reach, by number of edits."""

    def __init__(self, words: list[str], stems: list[str], edited: list[str], clean: list[str]) -> None:
        self.words, self.stems, self.clean = frozenset(words), frozenset(stems), frozenset(clean)
        self.lengths = sorted({len(s) for s in stems})
        self.tries: dict[int, dict] = {}
        #: (number of edits, length of a token, its first or last letters or letters inside) of what may be near
        self.parts: dict[tuple[int, int], tuple[set, set, set]] = {}
        for w in edited:
            if k := edits_allowed(w):
                node = self.tries.setdefault(k, {})
                for c in w:
                    node = node.setdefault(c, {})
                node[""] = {}
                cut = [len(w) * i // (k + 1) for i in range(k + 2)]  # k edits leave one of k + 1 parts whole
                for n in range(len(w) - k, len(w) + k + 1):
                    heads, tails, middles = self.parts.setdefault((k, n), (set(), set(), set()))
                    heads.add(w[: cut[1]])
                    tails.add(w[cut[-2] :])
                    middles.update(w[a:b] for a, b in zip(cut[1:-2], cut[2:-1]))
        self.kinds: dict[str, int] = {}
        self.nothing: set[str] = set()

    def near(self, token: str) -> bool:
        """Whether a word that edits may reach is within its edits of the token."""
        for k, trie in self.tries.items():
            heads, tails, middles = self.parts.get((k, len(token)), ((), (), ()))
            if not (any(map(token.startswith, heads)) or any(map(token.endswith, tails)) or any(m in token for m in middles)):
                continue
            stack = [(trie, tuple(range(len(token) + 1)))]
            while stack:
                node, row = stack.pop()
                for c, below in node.items():
                    if c == "":
                        if row[-1] <= k:
                            return True
                        continue
                    state = [row[0] + 1]
                    for j, t in enumerate(token):
                        state.append(min(state[j] + 1, row[j + 1] + 1, row[j] + (t != c)))
                    if min(state) <= k:
                        stack.append((below, tuple(state)))
        return False

    def kind(self, token: str) -> int:
        """1 a word, 2 a stem, 3 misspelt, 0 nothing."""
        if token in self.words:
            return 1
        if any(token[:n] in self.stems for n in self.lengths):
            return 2
        return 3 if 4 <= len(token) <= 30 and token not in self.clean and self.near(token) else 0

    def matches(self, tokens: list[str]) -> dict[str, int]:
        """Tokens that match -> kind. What matched nothing is remembered, within a bound."""
        found = {}
        for raw in set(tokens).difference(self.nothing):
            if not (kind := self.kinds.get(raw)):
                kind = self.kind(raw.strip(EDGE))
                if kind and len(self.kinds) < KNOWN:
                    self.kinds[raw] = kind
                elif not kind:
                    if len(self.nothing) >= KNOWN:
                        self.nothing.clear()
                    self.nothing.add(raw)
            if kind:
                found[raw] = kind
        return found

    def features(self, text: str) -> list[float]:
        tokens = text.lower().split()
        found = self.matches(tokens)
        if not found:
            return [0.0] * len(FEATURES)
        n, quoted, addressed, open_quote = 0.0, 0, 0, False
        for i, token in enumerate(tokens):
            marks = sum(token.count(q) for q in QUOTES)
            if kind := found.get(token):
                around = {t.strip(EDGE) for t in tokens[max(0, i - WINDOW) : i + WINDOW + 1]}
                if open_quote or marks or around & REPORTS:
                    quoted += 1
                else:
                    n += TRUST if kind == 3 else 1.0
                    addressed += bool(around & ADDRESS)
            open_quote ^= marks % 2 == 1
        return [math.log1p(n), math.log1p(quoted), math.log1p(addressed), float(n > 0), float(n > 1.5), 10.0 * n / (len(tokens) + 20)]


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that nothing is learnt from. A null doc_id is one."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(True))


def sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(text, toxic) of at most so many labels, those with the least hashes of their doc_id. Of rows that share a doc_id, however many, the least text is the labelled one."""
    chosen = labels.select("doc_id", "toxic").filter(F.col("toxic").isin(0, 1) & ~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(rows)
    chosen = materialize(chosen, "chosen")
    known = F.broadcast(chosen)  # the limit bounds what is broadcast
    one = texts(docs).join(known, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    return one.join(known, "doc_id").select("text", F.col("toxic").cast("long").alias("toxic"))


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    docs = [0, 0]
    for b in batches:
        for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            seen = {w for t in set(text.lower().split()) if 2 < len(w := t.strip(EDGE)) <= 30}
            counts[toxic].update(seen | {f"{w[:n]}*" for w in seen for n in STEMS if len(w) > n})
            docs[toxic] += 1
    counts[0][""], counts[1][""] = docs
    both = list(counts[0].keys() | counts[1].keys())
    yield pa.RecordBatch.from_arrays([pa.array(both), pa.array([counts[1][t] for t in both], pa.int64()), pa.array([counts[0][t] for t in both], pa.int64())], ["term", "toxic", "clean"])


def _contexts(terms: frozenset, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = set()
    for b in batches:
        for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            before = ""
            for t in text.lower().split() if toxic else ():
                w = t.strip(EDGE)
                seen.update((k, before) for k in (w, *(f"{w[:n]}*" for n in STEMS if len(w) > n)) if k in terms)
                before = w
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in seen], pa.string()), pa.array([c for _, c in seen], pa.string())], ["term", "before"])


def learn_lexicon(rows: DataFrame) -> tuple[list[str], list[str], list[str], list[str]]:
    """Words, stems, words that are found misspelt too, and forms near those that clean documents use."""
    terms = materialize(rows.mapInArrow(_terms, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "terms")
    total = terms.filter("term = ''").first()
    if total is None or not total.toxic or not total.clean:
        return [], [], [], []
    lift = (F.col("toxic") / total.toxic) / ((F.col("clean") + 0.5) / total.clean)
    least = max(3, SHARE * total.toxic)
    often = frozenset(r.term for r in terms.filter((F.col("term") != "") & (F.col("toxic") >= least) & (lift >= TIMES)).collect())  # 1 / SHARE times the tokens of a document at most
    # a term counts once for each word before it: copies of one document don't make a lexicon
    apart = rows.mapInArrow(partial(_contexts, often), "term string, before string").groupBy("term").agg(F.countDistinct("before").alias("n"))
    good = sorted(r.term for r in apart.filter(F.col("n") >= least).collect())
    stems: list[str] = []
    for t in sorted((t[:-1] for t in good if t.endswith("*")), key=len):
        if not any(t.startswith(s) for s in stems):
            stems.append(t)
    words = [t for t in good if not t.endswith("*") and re.fullmatch(r"[^\W\d_]+", t)]
    main = {r.term for r in terms.filter(F.col("term").isin(words) & (F.col("toxic") >= EDITED * total.toxic)).collect()}
    edited = [w for w in words if w in main]
    inner = Lexicon(words, stems, edited, [])
    close = F.pandas_udf(lambda s: s.map(lambda t: inner.kind(t) == 3), "boolean")
    clean = [r.term for r in terms.filter((F.col("clean") >= 2) & (F.col("clean") * total.toxic > F.col("toxic") * total.clean) & ~F.col("term").endswith("*")).filter(close("term")).orderBy("term").collect()]
    return words, stems, edited, clean


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 50) -> np.ndarray:
    """Weights of a logistic model, the constant last; Newton steps with a ridge that keeps separable classes finite."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    w[-1] = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    pull = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull, x.T @ (y - p) - pull @ w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _lexicon(model: str) -> Lexicon:
    return Lexicon(*json.loads(model)["lexicon"])


def _features(model: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lexicon = held(_lexicon, model)
    for b in batches:
        rows = [lexicon.features(t) for t in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), b.column(1)], ["x", "toxic"])


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> str:
    """A model, as JSON: lexicon and weights. Without labels of both kinds the lexicon is empty and the score their share."""
    used = materialize(sample(docs, labels, rows), "labelled")
    model = json.dumps({"lexicon": learn_lexicon(used)})
    found = used.mapInArrow(partial(_features, model), "x array<double>, toxic long").collect()  # at most `rows` short rows
    x = np.array([r.x for r in found], float).reshape(-1, len(FEATURES))
    w = fit_kinds(x, np.array([r.toxic for r in found], float))
    return json.dumps(json.loads(model) | {"weights": w.tolist()})


def fit_kinds(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """fit() in which no kind of match speaks for a clean text: those that would are left out. Quotation may."""
    x = x.copy()
    while True:
        w = fit(x, y)
        wrong = [k for k, name in enumerate(FEATURES) if w[k] < -1e-9 and name not in ("quoted", "addressed")]
        if not wrong:
            return w
        x[:, wrong] = 0


def scorer(model: str):
    """score(text column): 0 to 1; a null text is an empty one."""
    weights = np.array(json.loads(model)["weights"])

    def score(batch: pd.Series) -> pd.Series:
        lexicon = held(_lexicon, model)
        x = np.array([lexicon.features(t or "") for t in batch], float).reshape(-1, len(FEATURES))
        return pd.Series(1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -35, 35))))

    return F.pandas_udf(score, "double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score of every row of docs (doc_id, text).

    Null and empty texts score as a text without matches. Repeated rows, null doc_ids stay; an empty table gives
    no rows; other columns are ignored. labels: doc_id, toxic (0, 1; others are left out).
    """
    return texts(docs).select("doc_id", scorer(train(docs, labels))("text").alias("score"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns."""
    return docs.filter(scorer(train(docs, labels))(F.col("text")) < THRESHOLD)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
