"""Groups of near copies whose members are not all alike: every link between different components is found."""

import random

import numpy as np
import pytest

from panelspan.llm import minhash


def features(text):
    words, count = text.split(), {}
    for k in range(max(len(words) - 4, 1) if words else 0):
        count[tuple(words[k: k + 5])] = count.get(tuple(words[k: k + 5]), 0) + 1
    return count


def alike(a, b):
    both = set(a) | set(b)
    return sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in both) for i in set(a) & set(b))


@pytest.mark.parametrize("tile", [1 << 22, 3000])
def test_links_across_components(spark, monkeypatch, tile):
    monkeypatch.setattr(minhash, "TILE", tile)
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    base, rows = [rng.choice(words) for _ in range(200)], []
    for i in range(70):
        copy = list(base)
        for _ in range(rng.choice([1, 3, 5, 6, 7, 8, 9])):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        rows.append((i * 3, " ".join(copy)))
        if i % 10 == 0:
            base[rng.randrange(200)] = "moved"                      # the group drifts away from its first members
    of = {i: features(t) for i, t in rows}
    label = {i: i for i in of}
    edges = [(x, y) for x in of for y in of if x < y and alike(of[x], of[y]) >= 0.8]
    for _ in of:
        for x, y in edges:
            label[x] = label[y] = min(label[x], label[y])
    got = {r.doc_id: r.class_id for r in minhash.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == label and 2 < len(set(label.values())) < 60


def test_bound_of_common_shares_holds():
    rng = np.random.default_rng(3)
    for _ in range(300):
        a, b = ((np.sort(rng.choice(40, n, replace=False)).astype(np.uint64), rng.integers(1, 6, n)) for n in rng.integers(3, 30, 2))
        _, i, j = np.intersect1d(a[0], b[0], return_indices=True)
        bound = np.minimum(a[1][i] / a[1].sum(), b[1][j] / b[1].sum()).sum()
        assert minhash.similarity(a, b) <= bound + 1e-12


def test_links_across_components_do_not_grow_with_the_square(spark):
    rng = random.Random(8)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(60):
        copy = list(base)
        copy[rng.randrange(120)] = f"own{i}"
        rows.append((i, " ".join(copy)))
    texts = spark.createDataFrame(rows, "node long, text string")
    # every node a component of its own, in two buckets, whose centers 59 and 58 were compared with all before
    open_ = texts.selectExpr("node", "explode(array(struct(7L as bucket, 59L as center), struct(8L as bucket, 58L as center))) as b") \
        .selectExpr("b.bucket", "node", "b.center", "node as component", "b.center as main")
    found = [(r.a, r.b) for r in minhash._across(open_, texts, 0.8).collect()]
    label = list(range(60))
    for a, b in found:
        label = [label[a] if x == label[b] else x for x in label]
    assert len(set(label[:59])) == 1
    assert len(found) == 58                                          # a forest, not the 1,711 pairs
