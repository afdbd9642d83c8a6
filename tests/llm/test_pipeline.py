"""The pipeline's stages against plain Python on the smallest tables."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

import corpus_pipeline
from fernlight.llm import secrets
from fernlight.llm.base import documents

from .conftest import ODD
from .test_operators import SF, check_packing, components_by_force


def test_stages(spark):
    docs = documents(spark, SF)
    held = {r.doc_id: r for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language ID", "exact dedup", "n-gram Jaccard join", "secret scans", "packing"]
    stage = dict(corpus_pipeline.STAGES)
    one = stage["language ID"](spark, docs, SF)
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == set(held)  # every document here has a language
    two = stage["exact dedup"](spark, one, SF)
    firsts: dict[str, int] = {}
    for i in sorted(held):
        firsts.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", held[i].text), i)
    assert {r.doc_id for r in two.collect()} == set(firsts.values())
    three = stage["n-gram Jaccard join"](spark, two, SF)
    groups = components_by_force({i: held[i].text for i in firsts.values()}, 5, 80)
    left = {r.doc_id: r.text for r in three.collect()}
    assert set(left) == {root for _, root in groups.values()}
    four = stage["secret scans"](spark, three, SF).collect()
    for r in four:
        assert not secrets.base_spans(r.text, secrets.runs(r.text)) and r.n_chars == len(r.text)
        if not secrets.base_spans(left[r.doc_id], secrets.runs(left[r.doc_id])):
            assert r.text == left[r.doc_id]
    five = stage["packing"](spark, spark.createDataFrame(four, docs.schema), SF)
    check_packing(five.collect(), {r.doc_id: r.text for r in four}, 2048)
    whole = corpus_pipeline.run(spark, SF).collect()
    check_packing(whole, {r.doc_id: r.text for r in four}, 2048)


def ids(rows):
    return sorted((r.doc_id for r in rows), key=repr)


def test_stages_on_odd_rows(spark, odd, none):
    """Nulls, empty and long texts, repeated rows, missing ids and clashing columns, stage after stage."""
    clash = odd.withColumnsRenamed({"digest": "__gone", "row": "__salt", "key": "component_id"})
    want = {
        "language ID": [1, 2, 6, 7, 8, 8, 9, None, None],
        "exact dedup": [1, 3, 6, 7, 8, 9, -5, None, 5],
        "n-gram Jaccard join": [1, 3, 4, 5, 6, 8, 8, 9, -5, None, None],
        "secret scans": [r[0] for r in ODD],
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, clash, SF)
        assert found.columns == clash.columns, name
        assert ids(found.collect()) == sorted(want[name], key=repr), name
        empty = stage(spark, none, SF)
        assert empty.columns == none.columns and empty.count() == 0, name
    packed = corpus_pipeline.pack(spark, clash, SF).where("start = 0")
    assert ids(packed.collect()) == sorted((r[0] for r in ODD), key=repr) and corpus_pipeline.pack(spark, none, SF).count() == 0


def test_corpus_without_labels_is_kept(spark):
    docs = documents(spark, SF).withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.language(spark, docs, SF).count() == docs.where("text RLIKE '[A-Za-z]'").count() > 150
