"""Personal data: format rules, and candidates judged by gradient-boosted trees.

Base spans are what the rules of each kind accept; they always stay. Generators with a high recall propose more,
overlapping spans: addresses with words for their marks, numbers with other marks between their groups or with more
or fewer groups than the rules' greedy matches, numbers without a country's plus. Boosted trees judge each by its
shape and by the text around it, one model a kind.

They learn from every document, in passes over the table of all candidates. Positives are base spans, with the signs that the rules go by hidden, and base spans rewritten in their place as
people write them to be read by people (worded, bracketed, regrouped, without a plus). Negatives are candidates that
meet no base span, other cuts of a rewritten one, and spoilt ones: a digit or a part that no such number has, an
address without a domain. A third of the candidates is kept out of the fit: on it each kind's threshold is the least
step of scores from which PRECISION of the candidates are positives. The best candidates over their thresholds that overlap
neither base spans nor each other are added.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import boosted, by_kind, matrix, predict
from .common import held, materialize, table, texts, unused

KINDS = ("email", "ip", "card", "phone")
PRECISION, LEAST_SEEN = 0.98, 20
#: Thresholds are multiples of 1 / STEPS.
STEPS = 1 << 14
AROUND = 24

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A run of digits is only tried from its start: from within it nothing else can match.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile("[0-9]")
SPOKEN = re.compile(r"([A-Za-z0-9._%+-]{1,64})\s?[\[({<]\s?(?:at|@)\s?[\])}>]\s?([A-Za-z0-9-]{1,63}(?:\s?(?:[\[({<]\s?(?:dot|\.)\s?[\])}>]|\.)\s?[A-Za-z0-9-]{1,63}){1,5})", re.I)
WORDED = re.compile(r"([A-Za-z0-9._%+-]{1,64}) (?:at|AT) ([A-Za-z0-9-]{1,63}(?: (?:dot|DOT) [A-Za-z0-9-]{1,63}){1,5})(?![A-Za-z0-9-])")
GROUPED = re.compile(r"[0-9]+(?:[\x20().\-/:\[\]]{1,3}[0-9]+)*")
GROUP, LABEL = re.compile("[0-9]+"), re.compile("[A-Za-z-]+")
CUES = {
    "email": ("mail", "contact", "write", "kontakt", "correo", "courriel"),
    "ip": ("ip", "host", "server", "addr", "login", "ping"),
    "card": ("card", "visa", "master", "amex", "pay", "karte", "tarjeta", "carte"),
    "phone": ("tel", "phone", "call", "mobil", "fax", "anruf", "llam", "appel"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def octet(part: str) -> bool:
    return len(part := part.lstrip("0")) < 4 and (not part or int(part) < 256)


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost addresses, none overlapping: each "@" once, in time linear in the text."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((start, end))
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by the rules, ordered; code points, end exclusive."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if DIGITS.search(text):
        out += [(1, *m.span()) for m in IP.finditer(text) if all(map(octet, m[0].split(".")))]
        out += [(2, *m.span()) for m in CARD.finditer(text) if 13 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d)]
        if "+" in text:
            out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) that may be personal data; they overlap. A number has as many as it has runs of at most 19 digits."""
    out = [(0, *m.span()) for m in SPOKEN.finditer(text)] if any(c in text for c in "[({<") else []
    if " at " in text or " AT " in text:
        out += [(0, *m.span()) for m in WORDED.finditer(text)]
    for m in GROUPED.finditer(text) if DIGITS.search(text) else ():
        if m.end() - m.start() < 7:
            continue
        groups = [(g.start(), g.end()) for g in GROUP.finditer(text, m.start(), m.end())]
        for i, (start, _) in enumerate(groups):
            n = 0
            for k, (a, b) in enumerate(groups[i : i + 19]):
                n += b - a
                if n > 19:
                    break
                if k == 3 and n <= 12 and len({text[groups[j][1] : groups[j + 1][0]] for j in range(i, i + 3)}) == 1:
                    out.append((1, start, b))
                if n >= 13:
                    out.append((2, start, b))
                if 9 <= n <= 15 and k:
                    at = start - 1 if start and text[start - 1] == "(" else start
                    out.append((3, at - 1 if at and text[at - 1] == "+" else at, b))
    return out


def rewritten(kind: int, span: str, pick: int) -> tuple[str, bool]:
    """A base span as people write it otherwise, or spoilt; and whether it still is one. pick: any number."""
    way, spoil, digits = pick >> 8, pick % 3 == 0, re.sub("[^0-9]", "", span)
    if kind == 0:
        at, dot = ((" [at] ", " [dot] "), ("(at)", "(dot)"), (" {at} ", "."), ("[at]", "[.]"), (" (AT) ", " (DOT) "), (" at ", " dot "))[way % 6]
        local, domain = span.split("@")[0], span.split("@")[1]
        host = domain.split(".")[0]
        odd = (f". {host.capitalize()}", f"{dot}{way % 1000}", f"{dot}{host * 4}"[:30])[way % 3]  # a sentence, a number, no such ending
        return (local + at + host + odd, False) if spoil else (local + at + domain.replace(".", dot), True)
    if kind == 1:
        parts = span.split(".")
        parts[way % 4] = str(256 + way % 700) if spoil else parts[way % 4]
        return ("[.]", " . ", ".", "-", "(.)")[way % 5].join(parts), not spoil
    if kind == 2:
        if spoil:
            digits = digits[:-1] + str((int(digits[-1]) + 1 + way % 9) % 10)
        return (". / -- . ".split(" ") + [" ", "-"])[way % 6].join(digits[k : k + 4] for k in range(0, len(digits), 4)), not spoil
    if spoil:
        return "/".join((digits[:2], digits[2:4], digits[4:8])) + " " + ":".join((digits[8:10], digits[10:12])), False
    body = digits[-10:] if len(digits) > 10 else digits
    return ("({}) {}-{}", "{}-{}-{}", "{} {} {}", "{}.{}.{}", "0{}/{} {}", "{}/{}/{}", "{} {} {} {}")[way % 7].format(body[:3], body[3:6], *((body[6:8], body[8:]) if way % 7 == 6 else (body[6:],))), True


FEATURES = ("digits", "groups", "first", "last", "longest", "shortest", "points", "spaces", "dashes", "brackets", "slashes", "alike", "luhn", "octets", "letters", "last label", "capitals", "digit before", "digit after", "letter before", "letter after", "own cue", "other cue", "number before", "number after")


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    """Shape and surroundings; a leading plus is not looked at, as it is what the rule for phones goes by."""
    s = text[start:end].lstrip("+")
    groups = GROUP.findall(s) or [""]
    digits = "".join(groups)
    sizes = [len(g) for g in groups]
    before, after = text[max(0, start - AROUND) : start].lower(), text[end : end + AROUND].lower()
    left, right = before.rstrip(" +(")[-1:], after.lstrip(" )")[:1]
    own = any(c in before for c in CUES[KINDS[kind]])
    other = any(c in before for k, cues in CUES.items() if k != KINDS[kind] for c in cues)
    label = (LABEL.findall(s) or [""])[-1]
    row = [len(digits), len(groups), sizes[0], sizes[-1], max(sizes), min(sizes), s.count("."), s.count(" "), s.count("-"), sum(map(s.count, "([{<")), s.count("/") + s.count(":"), len(set(GROUP.split(s)[1:-1])), luhn(digits), len(groups) == 4 and all(map(octet, groups))]
    row += [sum(c.isalpha() for c in s), len(label), sum(c.isupper() for c in label)]
    row += [before[-1:].isdigit(), after[:1].isdigit(), before[-1:].isalpha(), after[:1].isalpha(), own, other, left.isdigit(), right.isdigit()]
    return [float(v) for v in row]


def overlaps(spans: list[tuple[int, int, int]], start: int, end: int) -> bool:
    return any(a < end and start < b for _, a, b in spans)


def learnt(text: str) -> Iterator[tuple[int, list[float], int, int]]:
    """(kind, features, label, hash) of a text's candidates, its base spans and their rewritten forms."""
    base = base_spans(text)
    for k, s, e in {*base, *(c for c in candidates(text) if not overlaps(base, c[1], c[2]))}:
        order = xxhash.xxh64_intdigest(f"{s}:{text[max(0, s - 40):e + 40]}") >> 1
        yield k, features(text, k, s, e), int((k, s, e) in base), order
        if (k, s, e) not in base:
            continue
        for turn in range(3):
            new, good = rewritten(k, text[s:e], xxhash.xxh64_intdigest(f"{order}:{turn}"))
            before, after = text[max(0, s - 2 * AROUND) : s], text[e : e + 2 * AROUND]
            around, at, end = before + new + after, len(before), len(before) + len(new)
            for c in candidates(around):
                if c[0] == k and c[1] < end and at < c[2]:  # other cuts of it are negatives
                    yield k, features(around, *c), int(good and (c[1], c[2]) == (at, end)), xxhash.xxh64_intdigest(f"{order}:{turn}:{c}") >> 1


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = Counter((k, tuple(x), y, h % 3 == 2) for text in b.column(0).to_pylist() for k, x, y, h in learnt(text))
        columns = zip(*((*row, n) for row, n in found.items())) if found else [[]] * 5
        kinds = (pa.int64(), pa.list_(pa.float64()), pa.int64(), pa.bool_(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], ["kind", "x", "y", "out", "n"])


def _least(df: DataFrame, groups: list[Column], order: list, n: int) -> DataFrame:
    """The first n rows of each group, a few conditions: every task keeps n rows of a group, and these alone meet."""
    return reduce(DataFrame.unionAll, [df.filter(g).orderBy(*order).limit(n) for g in groups])


def _steps(models: dict[int, dict], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for kind, b in by_kind(batch):
            step = np.floor(predict(models[kind], matrix(b.column(1))) * STEPS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(step), b.column(2), b.column(3)], ["kind", "step", "y", "n"])


def train(docs: DataFrame, precision: float = PRECISION) -> str:
    """A model for each kind, as JSON: trees and threshold, from all candidates of all documents. A kind of which too little is seen gets no threshold: nothing is added."""
    spans = texts(docs).select("text").mapInArrow(_labelled, "kind long, x array<double>, y long, out boolean, n long")
    spans = materialize(spans.groupBy("kind", "x", "y", "out").agg(F.sum("n").alias("n")), "pii-spans")  # alike candidates are one row
    seen = {(r.kind, r.y, r.out): r.n for r in spans.groupBy("kind", "y", "out").agg(F.sum("n").alias("n")).collect()}
    kinds = [k for k in range(len(KINDS)) if min(seen.get((k, *part), 0) for part in ((1, False), (1, True), (0, False))) >= LEAST_SEEN]
    spans = spans.filter(F.col("kind").isin(kinds))
    learned = boosted(spans.filter(~F.col("out")))
    steps = spans.filter("out").select("kind", "x", "y", "n").mapInArrow(partial(_steps, learned), "kind long, step long, y long, n long")
    steps = steps.groupBy("kind", "step").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y")).alias("y")).collect()  # STEPS rows a kind at most
    models: dict = {}
    for kind in kinds:
        n = positives = 0
        for r in sorted((r for r in steps if r.kind == kind), key=lambda r: -r.step):
            n, positives = n + r.n, positives + r.y
            if positives >= precision * n:
                models[KINDS[kind]] = {"model": learned[kind], "threshold": max(0.5, r.step / STEPS)}
    return json.dumps(models)


def all_spans(text: str, base: list[tuple[int, int, int]], models: dict) -> list[tuple[int, int, int]]:
    """Base spans and the candidates that the models accept, ordered."""
    scored = []
    found = [c for c in candidates(text) if KINDS[c[0]] in models and not overlaps(base, c[1], c[2])]
    for kind in {k for k, _, _ in found}:
        m, own = models[KINDS[kind]], [c for c in found if c[0] == kind]
        scored += [(-p, c) for p, c in zip(predict(m["model"], np.array([features(text, *c) for c in own])), own) if p >= m["threshold"]]
    out = list(base)
    for _, c in sorted(scored):
        if not overlaps(out, c[1], c[2]):
            out.append(c)
    return sorted(out)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each stretch of spans replaced by the kind of its first."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], s[0], s[2])):
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def detect(docs: DataFrame, model: str | None = None, name: str = "pii") -> DataFrame:
    """docs with a struct column `name` beside its own: base and spans (arrays of kind, start, end) and the redacted text.

    A null text has no spans and stays null. Repeated rows, null doc_ids stay; an empty table gives no rows;
    texts of any length are taken whole. The result is the last column; where docs has one of its name, underscores
    follow the name.
    """
    name = unused(docs, name)
    model = train(docs) if model is None else model
    kind = "array<struct<kind:string,start:long,end:long>>"

    def find(batch: pd.Series) -> pd.DataFrame:
        models, rows = held(json.loads, model), []
        for text in batch:
            base = base_spans(text or "")
            spans = all_spans(text or "", base, models)
            named = [[{"kind": KINDS[k], "start": a, "end": b} for k, a, b in some] for some in (base, spans)]
            rows.append((*named, text if text is None or not spans else redact(text, spans)))
        return pd.DataFrame(rows, columns=["base", "spans", "redacted"])

    return docs.withColumn(name, F.pandas_udf(find, f"base {kind}, spans {kind}, redacted string")("text"))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(texts(table(spark, sf_dir, "documents"))).select("doc_id", "pii.base", "pii.spans")
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"))
