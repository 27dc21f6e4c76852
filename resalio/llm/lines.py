"""Line dedup by a log-template tree.

A line's tokens with digits become "<*>"; the rest is its signature. The tree has a fixed depth: a leaf is a number
of tokens and the first DEPTH of them. A leaf in which several signatures meet has templates: the first has at each
place the token that at least half of its lines share, else a variable. A line belongs to it if it agrees with it in
ALIKE of all places; the rest has the next template. Where no template is in MIN_DOCS documents, the lines part by
the place that tells families apart best, and each part goes on alone, until too few are left.

Signatures and templates that are in MIN_DOCS documents or more recur. So do lines of LONG words or more that are in
two documents word for word, which doesn't happen by chance, and lines of which half or more is variable that are in
MIN_DOCS documents word for word: these have neither signature nor template. All of them are dropped from all
documents but the first, the one with the least doc_id. Blank lines are neither counted nor dropped.

Copies count once: equal texts are one document, that of the least doc_id, and all of them lose what that one loses,
so they stay copies, for the operators on whole documents. From any other document whatever recurs is dropped, to an
empty text if need be.

Documents never meet in one task: lines, leaves and places are counted by partial aggregation, lines are found again
by joins on leaves and on hashes of texts, whose hot keys Spark can split.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial, reduce

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, materialize, small, table, texts, unused

DEPTH, MIN_DOCS, ALIKE = 3, 5, 0.7
#: Words from which on a line recurs if it is in two documents word for word.
LONG = 8
MASK = "<*>"
VARIABLE, DIGIT = re.compile(r"\S*[0-9]\S*"), re.compile("[0-9]")


def hashed(s: str, seed: int = 0) -> int:
    h = xxhash.xxh64_intdigest(s, seed)
    return h - (1 << 64) if h >> 63 else h


def parse(line: str, depth: int) -> tuple[list[str], int | None, int | None, int | None]:
    """A line's tokens with variables masked; its leaf and signature, unless half or more is variable; the hash of its words, where those count."""
    words = line.split()
    tokens = VARIABLE.sub(MASK, line).split() if DIGIT.search(line) else words
    templated = 2 * tokens.count(MASK) < len(tokens)
    raw = hashed(" ".join(words), 1) if words and (len(words) >= LONG or not templated) else None
    if not templated:
        return tokens, None, None, raw
    return tokens, hashed(" ".join([str(len(tokens)), *tokens[:depth]])), hashed(" ".join(tokens)), raw


def _lines(depth: int, min_docs: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each way in which a line may recur: leaf and signature, or its words (without a leaf); in how many documents it must be."""
    forget()
    for b in small(batches):
        rows = set()
        for doc_id, same, text in zip(*(b.column(k).to_pylist() for k in range(3))):
            for line in text.split("\n"):
                tokens, leaf, sig, raw = parse(line, depth)
                if sig is not None:
                    rows.add((doc_id, same, leaf, sig, min_docs))
                if raw is not None:
                    rows.add((doc_id, same, None, raw, min(2, min_docs) if len(tokens) >= LONG else min_docs))
        columns = zip(*rows) if rows else ((), (), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "same", "leaf", "sig", "least"])


def _places(depth: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tokens of the wanted signatures."""
    for b in small(batches):
        ids, sames, leaves, sigs, tokens = [], [], [], [], []
        for doc_id, same, text, wanted in zip(*(b.column(k).to_pylist() for k in range(4))):
            left = set(wanted)
            for line in text.split("\n"):
                words, leaf, sig, _ = parse(line, depth)
                if sig is not None and sig in left:
                    left.discard(sig)
                    ids.append(doc_id)
                    sames.append(same)
                    leaves.append(leaf)
                    sigs.append(sig)
                    tokens.append([hashed(w) for w in words])
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((ids, sames, leaves, sigs, tokens), kinds)], ["doc_id", "same", "leaf", "sig", "tokens"])


def in_templates(found: DataFrame, min_docs: int, alike: float) -> DataFrame:
    """(same, sig) of the lines (doc_id, same, leaf, sig, tokens) that belong to a template of their leaf that recurs, but where the document is the first.

    In each round a group of lines loses those that fit its template, or is parted by the place at which most lines
    have a token that recurs, of these the one with the fewest tokens. Every round makes groups smaller; those of
    under min_docs lines go.
    """
    left, out = found.select("doc_id", "same", F.col("leaf").alias("group"), "sig", "tokens"), []
    while True:
        counts = left.select("group", F.posexplode("tokens").alias("at", "token")).groupBy("group", "at", "token").agg(F.count("*").alias("n"))
        places = counts.groupBy("group", "at").agg(
            F.max(F.struct("n", "token")).alias("top"), F.sum("n").alias("size"), F.count("*").alias("kinds"), F.sum(F.when(F.col("n") >= min_docs, F.col("n")).otherwise(0)).alias("often")
        )
        fixed = F.collect_list(F.when(F.col("top.n") * 2 >= F.col("size"), F.struct("at", "top.token")))  # as many as a line has tokens
        parting = F.max(F.when(F.col("kinds") > 1, F.struct("often", (-F.col("kinds")).alias("few"), (-F.col("at")).alias("back"))))
        plan = places.groupBy("group").agg(F.max("size").alias("size"), F.map_from_entries(fixed).alias("fixed"), (-parting.getField("back")).cast("int").alias("part"))
        plan = materialize(plan.filter(F.col("size") >= min_docs).drop("size"), "templates")
        if plan.isEmpty():
            break
        agree = F.aggregate(F.transform("tokens", lambda t, i: (F.col("fixed")[i] == t).cast("int")), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
        judged = materialize(left.join(plan, "group").select(*left.columns, (agree >= alike * F.size("tokens")).alias("fits"), F.col("tokens")[F.col("part")].alias("by")), "judged")
        often = judged.filter("fits").groupBy("group").agg(F.count_distinct("doc_id").alias("n"), F.min("doc_id").alias("first")).filter(F.col("n") >= min_docs)
        known = judged.join(materialize(often, "often"), "group", "left")
        out.append(known.filter("fits AND doc_id > first").select("same", "sig"))
        rest = known.filter("n IS NULL AND by IS NOT NULL OR n IS NOT NULL AND NOT fits")
        left = materialize(rest.withColumn("group", F.when(F.col("n").isNull(), F.xxhash64("group", "by")).otherwise(F.col("group"))).select(*left.columns), "left")
    return reduce(DataFrame.unionAll, out) if out else found.select("same", "sig").limit(0)


def recurring(docs: DataFrame, depth: int = DEPTH, min_docs: int = MIN_DOCS, alike: float = ALIKE) -> DataFrame:
    """(same, sigs): by the hash of a text, the signatures and words of its lines that recur, but where the document is the first."""
    given = texts(docs).filter("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("same"), "text")
    rows = given.mapInArrow(partial(_lines, depth, min_docs), "doc_id long, same long, leaf long, sig long, least long")
    # copies become one document; counts are written before they are joined: then Spark can split hot keys of the join
    lines = materialize(rows.groupBy("same", "leaf", "sig", "least").agg(F.min("doc_id").alias("doc_id")), "lines")
    often = materialize(lines.groupBy("sig", "least").agg(F.count_distinct("doc_id").alias("n"), F.min("doc_id").alias("first")).filter("n >= least").select("sig", "first"), "often")
    drops = lines.join(often, "sig").filter("doc_id > first").select("same", "sig")
    signed = lines.filter("leaf IS NOT NULL")
    mixed = signed.groupBy("leaf").agg(F.count("*").alias("n"), F.min("sig").alias("a"), F.max("sig").alias("b")).filter((F.col("n") >= min_docs) & (F.col("a") != F.col("b")))
    mixed = materialize(mixed.select("leaf"), "mixed")
    wanted = signed.join(mixed, "leaf").groupBy("same").agg(F.min("doc_id").alias("id"), F.collect_set("sig").alias("wanted"))  # as many as a document has lines
    read = given.join(wanted, "same").filter("doc_id = id").select("doc_id", "same", "text", "wanted")
    found = read.mapInArrow(partial(_places, depth), "doc_id long, same long, leaf long, sig long, tokens array<long>")
    found = materialize(found, "places")
    return drops.unionAll(in_templates(found, min_docs, alike)).groupBy("same").agg(F.collect_set("sig").alias("sigs"))


def keep(text: str | None, sigs, depth: int) -> tuple[str | None, int, int]:
    """What is left of a text, its lines that aren't blank, and how many of them went."""
    if text is None:
        return None, 0, 0
    gone = frozenset(sigs if sigs is not None else ())
    lines = text.split("\n")
    if not gone:
        return text, sum(bool(line.strip()) for line in lines), 0
    parsed = [parse(line, depth) for line in lines]
    out = [line for line, p in zip(lines, parsed) if p[2] not in gone and p[3] not in gone]
    return "\n".join(out), sum(bool(p[0]) for p in parsed), len(lines) - len(out)


def drop_recurring(docs: DataFrame, depth: int = DEPTH, min_docs: int = MIN_DOCS, alike: float = ALIKE, name: str = "kept_lines") -> DataFrame:
    """docs with recurring lines dropped from text: struct column `name` (text, n_lines, n_dropped) beside all other columns.

    Null texts stay null, empty ones empty. Rows with a null doc_id keep all lines; rows that share a doc_id
    count as one document, and so do rows that share a text. An empty table gives no rows. The result is the last
    column; where docs has one of its name, underscores follow the name.
    """

    def cut(text: pd.Series, sigs: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([keep(t, s, depth) for t, s in zip(text, sigs)], columns=["text", "n_lines", "n_dropped"])

    name = unused(docs, name)
    same, sigs = unused(docs, "same_of_sigs"), unused(docs, "sigs_of_same")
    gone = recurring(docs, depth, min_docs, alike).select(F.col("same").alias(same), F.col("sigs").alias(sigs))
    both = docs.join(gone, F.col("doc_id").isNotNull() & (F.xxhash64("text") == F.col(same)), "left")
    return both.withColumn(name, F.pandas_udf(cut, "text string, n_lines long, n_dropped long")("text", sigs)).drop(same, sigs)


def op8_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines (lines that aren't blank), n_dropped, kept_sha256 (of the text that is left, UTF-8; null texts as empty)."""
    kept = drop_recurring(texts(table(spark, sf_dir, "documents")))
    return kept.select("doc_id", "kept_lines.n_lines", "kept_lines.n_dropped", F.sha2(F.col("kept_lines.text").cast("binary"), 256).alias("kept_sha256"))
