"""Containers and mixtures."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lipika.llm import mixture, packing
from lipika.llm.tokens import Pieces

WORDS = Pieces(["a"])


def test_complete_is_optimal_on_small_sets():
    rng = random.Random(1)
    for _ in range(60):
        sizes = [rng.randrange(1, 40) for _ in range(rng.randrange(0, 9))]
        room = rng.randrange(0, 100)
        got = packing.complete(room, packing._Sizes(sizes, 100), nodes=10_000)
        best = max((sum(c) for k in range(len(sizes) + 1) for c in itertools.combinations(sizes, k) if sum(c) <= room), default=0)
        assert sum(got) == best
        few = packing.complete(room, packing._Sizes(sizes, 100), nodes=1)  # the search ends at once: the exact bound decides
        assert sum(few) == best and not Counter(few) - Counter(sizes)


def test_packing_does_not_depend_on_the_files(spark):
    rows = [(i % 40, "a " * (i % 13 + 1)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [sorted(map(tuple, packing.pack(d, WORDS, 20, 50).collect())) for d in (df.repartition(1), df.repartition(7).orderBy(F.desc("text")))]
    assert got[0] == got[1] and len(got[0]) == 400 and len({r[4] for r in got[0]}) > 4


def test_pack_sizes_is_a_partition():
    rng = random.Random(2)
    sizes = [rng.randrange(1, 1025) for _ in range(3000)]
    bins = packing.pack_sizes(sizes)
    assert sorted(i for b in bins for i in b) == list(range(3000))
    assert max(sum(sizes[i] for i in b) for b in bins) <= 1024
    assert len(bins) <= -(-sum(sizes) // 1024) * 1.02 + 1
    assert packing.pack_sizes([]) == []


def test_pack(spark):
    texts = [None, "", "a", "a " * 10, "a " * 11, "a " * 25, "a " * 25, "a " * 7]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("tokens", F.lit(1)).withColumn("cell", F.lit(0))
    rows = packing.pack(df, WORDS, capacity=10).collect()
    per = {}
    for r in rows:
        per.setdefault((r.cell, r.container), 0)
        per[r.cell, r.container] += r.tokens
    assert max(per.values()) <= 10
    want = {0: 0, 1: 0, 2: 1, 3: 10, 4: 11, 5: 25, 6: 25, 7: 7}
    assert {d: sum(r.tokens for r in rows if r.doc_id == d) for d in want} == want
    assert {r.doc_id for r in rows if r.piece_no > 0} == {4, 5, 6}
    assert all(r.first_token == 10 * r.piece_no for r in rows)
    assert sorted(r.doc_id for r in packing.oversized(packing.pack(df, WORDS, 10)).collect()) == [4, 5, 6]
    assert packing.pack(df.where("false"), WORDS, 10).count() == 0
    assert packing.usage(packing.pack(df.where("false"), WORDS, 10)).first().containers == 0


@pytest.fixture
def mixed(spark):
    rows = [(i, s, "a " * n) for i, (s, n) in enumerate([("x", 5)] * 40 + [("y", 10)] * 10 + [("z", 1)] * 3 + [(None, 50)] * 2 + [("w", 0)])]
    docs = spark.createDataFrame([*rows, (99, "y", None)], "doc_id long, source string, text string").withColumn("cell", F.lit(0))
    targets = spark.createDataFrame([("x", 0.25, 2), ("y", 0.5, 3), ("z", 0.15, 2), ("gone", 0.05, 1), ("w", 0.05, None), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    sized = mixture.sized_documents(docs, WORDS)
    return sized, targets


def test_mixture(mixed):
    sized, targets = mixed
    total = 40 * 5 + 10 * 10 + 3 + 100
    report = {r.source: r for r in mixture.shares(mixture.mix(sized, targets), mixture.budgets(sized, targets)).collect()}
    assert set(report) == {"x", "y", "z", "gone", "w"}
    assert report["x"].mixed_tokens <= 0.25 * total < report["x"].mixed_tokens + 5
    assert report["y"].mixed_tokens <= 0.5 * total < report["y"].mixed_tokens + 10
    assert report["z"].mixed_tokens == 6 and report["z"].capped
    assert report["gone"].mixed_tokens == 0 and report["gone"].capped
    assert report["w"].mixed_tokens == 0 and not report["w"].capped
    assert sum(r.actual_share for r in report.values()) == pytest.approx(1)
    repeats = {r.doc_id: r.repeats for r in mixture.mix(sized, targets).collect()}
    assert set(repeats[i] for i in range(40, 50)) <= {2, 3} and max(repeats[i] for i in range(40)) <= 1


def test_mixture_takes_the_smallest_keys(mixed):
    """The edge cell changes nothing: the selection is the plain prefix of the keys."""
    sized, targets = mixed
    taken = {r.doc_id for r in mixture.mix(sized, targets).where("source = 'x' and repeats = 1").collect()}
    rows = sorted(((r.key, r.tokens, r.doc_id) for r in sized.where("source = 'x'").collect()))
    budget, want = 0.25 * 403, set()
    for _, n, d in rows:
        if budget < n:
            break
        budget -= n
        want.add(d)
    assert taken == want


def test_cells_of_small_weights(spark):
    """Documents of weight 0.01 have keys a hundred times as long; their cells are as small as those of the others."""
    rows = [(i, "x", "1" * 40 + " a") for i in range(4000)]
    sized = mixture.sized_documents(spark.createDataFrame(rows, "doc_id long, source string, text string"), WORDS)
    per = sized.groupBy(F.floor(F.log("key") * mixture.KEY_CELLS).alias("cell")).count().agg(F.max("count")).first()[0]
    assert per < 20


def test_mixture_of_nothing(mixed):
    sized, targets = mixed
    assert mixture.mix(sized.where("false"), targets).count() == 0
    report = mixture.shares(mixture.mix(sized.where("false"), targets), mixture.budgets(sized.where("false"), targets)).collect()
    assert all(r.mixed_tokens == 0 and r.actual_share is None for r in report)
    assert mixture.mix(sized, targets.where("false")).count() == 0
