"""Bands of fingerprints are dealt as numbers; only groups of several get the fingerprints themselves."""

from twinspark.llm import fingerprints


def test_bands_are_dealt_without_fingerprints(spark, monkeypatch):
    plans, cut = [], fingerprints.cut_lineage
    monkeypatch.setattr(fingerprints, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    words = " ".join(str(k * k) for k in range(400))
    rows = [(1, words), (2, words + " more"), (3, "another text of a few words"), (4, None), (5, ""), (6, words)]
    near = fingerprints.near_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["class_id"] for r in near.collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 1}
    dealt = [line for plan in plans for line in plan.splitlines() if "Generate posexplode(keys" in line]
    assert dealt and not any("fingerprint" in line for line in dealt)
