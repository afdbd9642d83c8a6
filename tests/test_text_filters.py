"""Text rules with Han characters and odd white space, coercion in conditions, vectors, ranking."""

from __future__ import annotations

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from fernlight.functions import text as T
from fernlight.functions.shared import global_rank
from fernlight.functions.vectors import cosine, cosine_to, parse_vector
from fernlight.operators import filters, fusion, keyword
from fernlight.sources.markdown import anchor_of, estimate_tokens, humanize, slug_of


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


def test_terms(spark):
    got = one(spark, T.terms(F.col("x")), x="The v1.2, of 冠状动脉 术 don't. A b")
    assert got == ["v1.2", "冠状动脉", "don", "t", "b"]
    for query in ("The Ｖ1.2 of 术 and v1.2", "ＡＢＣ ｶﾞ. x_y", "the"):  # the same rules on both sides
        assert T.query_terms(query) == list(dict.fromkeys(one(spark, T.terms(F.col("x")), x=query)))


def test_estimate_and_names(spark):
    for x in ("hello wide world", "冠状动脉 stent x", "", "a" * 50, "line\n\nline"):
        assert one(spark, T.estimate_tokens(F.col("x")), x=x) == estimate_tokens(x, 1.6)
    for x in ("my-note_one.md", "Ünï-cödé"):
        assert one(spark, T.humanize(F.col("x")), x=slug_of(x)) == humanize(slug_of(x))
    for x in ("  Hello, wide World! ", "-a--b-", "Über 冠 état 1.2", "\u3000x\u00a0y"):
        assert one(spark, T.anchor_of(F.col("x")), x=x) == anchor_of(x)
    assert [one(spark, T.slug_of(F.col("x")), x=x) for x in ("a/b.c.md", ".hidden", "x/y")] == ["b.c", ".hidden", "y"]
    assert one(spark, T.trim(F.col("x")), x="\u3000\t x \ufeff\n") == "x"
    assert len(one(spark, T.snippet(F.col("x")), x="ab " * 200)) == 260


CASES = {
    "s": "abc", "n": 5, "f": 1.5, "t": True, "z": None, "e": "", "a": ["x", 5], "ea": [], "o": {"k": 1}, "eo": {}, "d": "2024-03-05", "ns": "7", "ts": "true",
}


@pytest.mark.parametrize(
    ("name", "op", "value", "expected"),
    [
        ("s", "is", "abc", True), ("s", "=", "x", False), ("n", "is", "5", True), ("n", "is", 5, True), ("ns", "is", 7, True), ("ns", "is", "7.0", False), ("t", "is", "true", True), ("t", "is", 1, True),
        ("z", "is", "null", True), ("gone", "is", "undefined", True), ("gone", "is not", "x", True), ("z", "is", 0, True), ("gone", "is", 0, False), ("a", "is", "x,5", True), ("o", "is", "[object Object]", True),
        ("s", "contains", "b", True), ("a", "contains", "5", True), ("a", "contains", 5, True), ("a", "contains", "y", False), ("n", "contains", "5", False), ("n", "not contains", "5", True), ("s", "contains", 5, False),
        ("s", "start with", "ab", True), ("s", "end with", "bc", True), ("n", "start with", "5", False), ("n", "in", [4, "5"], True), ("s", "not in", ["abc"], False), ("gone", "not in", ["a"], True),
        ("z", "empty", None, True), ("gone", "empty", None, True), ("e", "empty", None, True), ("ea", "empty", None, True), ("eo", "empty", None, True), ("o", "empty", None, False), ("n", "not empty", None, True),
        ("n", ">", 4, True), ("n", "<", "6", True), ("z", ">", -1, True), ("gone", ">", -1, False), ("s", ">", 0, False), ("f", "≥", 1.5, True), ("e", "<=", 0, True), ("ts", "is", "true", True), ("f", "is", 1.5, True),
        ("d", "before", "2024-03-06", True), ("d", "after", "2024-03-06", False), ("s", "before", "2024-03-06", False), ("path", "end with", ".md", True), ("seq", "is", 3, True), ("seq", "is", "3", True), ("tier", ">", 1, True),
    ],
)
def test_conditions(spark, name, op, value, expected):
    rows = spark.createDataFrame([(json.dumps(CASES), "a/b.md", 3, 1.5)], ["facets", "path", "seq", "tier"])
    assert rows.select(filters.condition(name, op, value, rows.columns)).first()[0] is expected


def test_condition_errors_and_trees(spark):
    for bad in (("x", "like", 1), ("x", "is", None), ("x", "in", "a")):
        with pytest.raises(filters.FilterError):
            filters.condition(*bad, ["facets"])
    rows = spark.createDataFrame([(json.dumps(CASES),)], ["facets"])
    assert rows.where(filters.conditions({"conditions": []}, rows.columns)).count() == 1
    assert rows.where(filters.conditions({"logical_operator": "or", "conditions": []}, rows.columns)).count() == 0
    assert rows.where(filters.exact({"gone": "undefined", "n": "5", "t": "true"})).count() == 1
    assert filters.parse_cli(["a=b=c", "a=d"]) == {"a": "d"}
    assert filters.parse_http({"a": False, "b": 1.0}) == {"a": "false", "b": "1"}
    with pytest.raises(filters.FilterError):
        filters.parse_cli(["=x"])


def test_vectors(spark):
    rows = spark.createDataFrame([([1.0, 0.0, 5.0], [1.0, 1.0]), ([], [1.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [round(r[0], 9) for r in rows.select(cosine(F.col("a"), F.col("b"))).collect()] == [round(1 / math.sqrt(2), 9), 0.0, 0.0]
    assert [round(r[0], 9) for r in rows.select(cosine_to([1.0, 1.0])(F.col("a"))).collect()] == [round(1 / math.sqrt(2), 9), 0.0, 0.0]
    assert one(spark, parse_vector(F.col("x")), x="[1, 2.5]") == [1.0, 2.5]


def test_global_rank_is_row_number(spark):
    rng = random.Random(2)
    rows = spark.createDataFrame([(i, rng.randint(0, 9)) for i in range(500)], "id int, v int").repartition(7)
    got = {r.id: r.rank for r in global_rank(rows, "rank", F.col("v").desc(), F.col("id")).collect()}
    want = {i: n for n, (_, i) in enumerate(sorted((-r.v, r.id) for r in rows.collect()), 1)}
    assert got == want
    assert global_rank(rows.where("false"), "rank", F.col("id")).count() == 0


def chunk(uid, body, title="Chunk", slug="chunk", seq=0):
    return {"chunk_uid": uid, "path": f"{slug}.md", "slug": slug, "title": title, "body": body, "seq": seq}


def scored(rows, query):
    """Scores through an inverted index of the rows."""
    own = keyword.index(rows)
    return keyword.score(own, keyword.postings(own), T.query_terms(query), query)


def test_scores_against_plain_python(spark):
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "zeta", "the"]
    docs = [chunk(f"c{i}", " ".join(rng.choices(words, k=rng.randint(1, 30))), " ".join(rng.choices(words, k=2)), f"{rng.choice(words)}-{i}") for i in range(40)]
    query = "zeta alpha"
    got = {r.chunk_uid: r.keyword_score for r in scored(spark.createDataFrame(docs), query).collect()}
    terms = lambda s: [w for w in s.lower().replace("-", " ").split() if w != "the"]
    bag = {d["chunk_uid"]: terms(d["title"]) * 4 + terms(d["slug"]) * 3 + terms(d["body"]) for d in docs}
    mean = sum(max(1, len(b)) for b in bag.values()) / len(bag)
    for d in docs:
        b, s = bag[d["chunk_uid"]], 0.0
        for t in ("zeta", "alpha"):
            df, tf = sum(t in x for x in bag.values()), b.count(t)
            if tf:
                s += math.log(1 + (len(bag) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * max(1, len(b)) / mean))
        s += 2.0 * (query in d["title"].lower()) + 2.5 * ("zeta-alpha" in d["slug"] or query in d["slug"].replace("-", " "))
        assert got.get(d["chunk_uid"], 0.0) == pytest.approx(s, abs=1e-9)


def test_rare_terms_and_pooling(spark):
    rows = [chunk("common", "alpha " * 20, "Common alpha", "common-alpha"), chunk("rare", "alpha zeta guide", "Rare zeta", "rare-zeta")]
    best = scored(spark.createDataFrame(rows), "alpha zeta").orderBy(F.desc("keyword_score")).first()
    assert best.chunk_uid == "rare"
    many = [chunk(f"d{i}", "alpha alpha", "Alpha", "dominant", i) for i in range(5)] + [chunk("s", "alpha", "S", "second"), chunk("t", "alpha", "T", "third")]
    hits = scored(spark.createDataFrame(many), "alpha").withColumnRenamed("keyword_score", "score")
    assert [r.path for r in fusion.pool(hits, "path", 3, "score", "path", "seq").collect()][0] == "dominant.md"
    assert fusion.pool(hits, "path", 3, "score", "path", "seq").count() == 3
    assert scored(spark.createDataFrame(rows), "the of").count() == 0


def test_fusion(spark):
    kw, vec = spark.createDataFrame([("a", 2.0)], ["k", "keyword_score"]), spark.createDataFrame([("b", 0.95)], ["k", "vector_score"])
    even = {r.k: r.rrf for r in fusion.fuse(kw, vec, "k").collect()}
    assert even["a"] == even["b"] == pytest.approx(1 / 61)
    heavy = {r.k: r.rrf for r in fusion.fuse(kw, vec, "k", weights=(1.0, 3.0)).collect()}
    assert heavy["b"] > heavy["a"]
