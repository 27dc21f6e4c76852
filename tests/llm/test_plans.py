"""How joins of the corpus operators are planned."""

import pytest

from resalio.llm import common, jaccard, simhash


@pytest.mark.parametrize("classes", [simhash.near_duplicates, jaccard.near_copies])
def test_keys_are_never_broadcast(spark, monkeypatch, classes):
    """A fingerprint or a set has tens of keys, which Spark doesn't know of when it takes a table for small."""
    plans, write = [], common.materialize

    def seen(df, *given):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return write(df, *given)

    for module in (common, jaccard, simhash):
        monkeypatch.setattr(module, "materialize", seen)
    text = " ".join(f"w{k}" for k in range(80))
    docs = spark.createDataFrame([(k, f"{text} {k % 5}") for k in range(40)] + [(k, f"other {k} text") for k in range(40, 50)], "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in classes(docs).collect()}
    assert len(found) == 50 and {found[k] for k in range(40)} == {0}
    met = [p for p in plans if "Join [key#" in p]
    assert len(met) >= 3
    assert not [p for p in met if "BroadcastHashJoin [key#" in p]
