"""What op3 gathers before it compares: nothing that can link may be lost, and what can't link must go early."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from fernlight.llm import jaccard


def joined(spark, texts, size=3, percent=90):
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    return jaccard._Join(rows, size, percent)


def words(rng, n):
    return [f"w{rng.randrange(10**9)}" for _ in range(n)]


def test_grams_of_sets_too_different_in_size_are_not_gathered(spark):
    rng = random.Random(1)
    shared, own = words(rng, 3), words(rng, 50)
    plain = [words(rng, n) for n in (20, 40, 80, 160, 320)]
    texts = [" ".join(w) for w in plain] * 10 + [" ".join(shared + w) for w in plain]  # the shared n-gram is rarer than most
    texts += [" ".join(own), " ".join([*own, "end"])]
    found = joined(spark, texts).shared()[0].collect()
    assert {r.nodes for r in found} == {2} and {48, 49} <= {r.n for r in found}


def test_pairs_alike_in_their_rare_grams_alone_go_before_the_fragments(spark, monkeypatch):
    """Sets of one size that share the beginning of the global order, and are unlike in the rest."""
    rng = random.Random(2)
    rare, common = words(rng, 150), words(rng, 1500)
    texts = [" ".join([*rare, *rng.sample(common, 700)]) for _ in range(20)] + [" ".join(common)] * 40
    join, seen = joined(spark, texts, size=1), []
    nodes = sorted(r.node for r in join.heads.collect())
    pairs = jaccard.staged(spark.createDataFrame([(a, b) for a in nodes for b in nodes if a < b], "a long, b long"), "pairs")
    plain = jaccard._fragments
    monkeypatch.setattr(jaccard, "_fragments", lambda *a: seen.append(plain(*a)) or seen[-1])
    assert join.links(pairs).count() == 0 and seen[0].count() == 0


@pytest.mark.parametrize("percent", [40, 80, 90, 99, 100])
def test_sets_that_may_link_have_a_key_in_common(percent):
    sizes = [*range(1, 60), 199, 200, 201, 222, 223, 1000, 1111, 1112]
    gram = np.int64(-77)
    first = [[gram] * (n - -(-percent * n // 100) + 1) for n in sizes]  # the n-gram at every place
    batch = pa.RecordBatch.from_pydict({"n": sizes, "first": pa.array(first, pa.list_(pa.int64()))}).slice(1)
    row, at, own, over, both = jaccard._firsts(batch, percent, 48)
    n = np.array(sizes[1:])[row]
    for i in range(0, len(row), 7):
        may = (np.minimum(n, n[i]) * 100 >= np.maximum(n, n[i]) * percent) & (np.minimum(n - at, n[i] - at[i]) * (100 + percent) >= (n + n[i]) * percent)
        met = (own == own[i]) | (both & (over == own[i])) | (both[i] & (own == over[i]))
        assert not (may & ~met).any()


@pytest.mark.parametrize("bits", [3, 18, 33, 48])
def test_sorted_keys_come_back(bits):
    rng = np.random.default_rng(bits)
    for number in (1, 2, 1000):
        keys = np.sort(rng.integers(0, 1 << bits, number, dtype=np.uint64))
        keys[-1] = (1 << bits) - 1
        assert jaccard.dense(jaccard.sparse(keys, bits), number, bits).tolist() == keys.tolist()


def test_counters_come_back_and_take_few_bytes():
    rng = np.random.default_rng(3)
    for most in (255, 256, 1 << 31, 1 << 40):
        counts = rng.poisson(1.0, jaccard.BLOCK).astype(np.int64)
        counts[5] = most
        assert jaccard.unpacked(jaccard.packed(counts)).tolist() == counts.tolist()
    assert len(jaccard.packed(rng.poisson(1.0, jaccard.BLOCK).astype(np.int32))) < jaccard.BLOCK * 2 // 7


def test_parities_hide_differences_and_never_make_them(spark):
    rng = np.random.default_rng(4)
    rows, alike = [], set()
    for i, (n, m, same) in enumerate([(1, 1, 0), (1, 1, 1), (30, 33, 30), (64, 65, 64), (500, 540, 500), (500, 540, 0), (3000, 900, 900), (3000, 900, 0)]):
        pool = np.unique(rng.integers(0, 1 << 64, n + m, dtype=np.uint64))
        a, b = pool[:n], np.concatenate([pool[:same], pool[n : n + m - same]])
        rows.append((i, n, np.frombuffer(jaccard.parities(a), np.int64).tolist(), i, m, np.frombuffer(jaccard.parities(b), np.int64).tolist()))
        if 100 * same >= 30 * (n + m - same):
            alike.add(i)
    pairs = spark.createDataFrame(rows, "a long, n_a long, probe_a array<long>, b long, n_b long, probe_b array<long>")
    assert alike == {1, 2, 3, 4, 6} <= {r.a for r in jaccard._near(pairs, 30).collect()}  # also where one is folded twice
    assert {r.a for r in jaccard._near(pairs, 90).collect()} == {1, 2, 3, 4}
