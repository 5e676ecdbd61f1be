"""The n-gram join against brute force."""

import collections
import random

import numpy as np
import pytest

from cairn.llm import components as C
from cairn.llm import ngram_join as J
from cairn.session import ship


def brute(rows):
    sets = {}
    for i, x in rows:
        w = (x or "").encode().lower().split()
        k = min(5, len(w))
        sets.setdefault(i, {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            o = len(sets[i] & sets[j])
            if o and 100 * o >= 75 * (len(sets[i]) + len(sets[j]) - o):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {(i, len(sets[i]), find(i)) for i in ids}


def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = [(-5, None), (-4, ""), (-3, " \n"), (-2, "a b"), (-1, "A b")]
    for _ in range(4):
        base = rng.choices(vocabulary, k=60)
        for _ in range(45):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                w = w[: rng.randrange(30, 60)]
            if rng.random() < 0.3:
                w += rng.choices(vocabulary, k=rng.randrange(1, 15))
            rows.append((len(rows), " ".join(w)))
    for _ in range(60):
        rows.append((len(rows), "this is one very common line that many share " + " ".join(rng.choices(vocabulary, k=rng.randrange(0, 6)))))
    for _ in range(40):
        rows.append((len(rows), " ".join(rng.choices("abc", k=rng.randrange(1, 12)))))
    return rows + rows[10:14]


@pytest.mark.parametrize("hot,block,broadcast", [(32, 1024, 10**6), (2, 1024, 10**6), (3, 16, 5)])
def test_components_as_brute_force(spark, monkeypatch, hot, block, broadcast):
    ship(spark)
    monkeypatch.setattr(J, "HOT_COUNT", hot)
    monkeypatch.setattr(J, "BLOCK_ROWS", block)
    monkeypatch.setattr(J, "BROADCAST_IDS", broadcast)
    rows = corpus()
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, n int, component int")
    got = J.jaccard_components(df).collect()
    assert {tuple(r) for r in got} == brute(rows)
    assert len(got) == len(rows)


def test_empty_and_null_ids(spark):
    ship(spark)
    df = spark.createDataFrame([(None, "a b c d e f g"), (4, "a b c d e f g"), (None, "other words")], "doc_id long, text string")
    assert sorted(map(tuple, J.jaccard_components(df).collect()), key=str) == sorted([(None, 3, 4), (4, 3, 4), (None, 1, None)], key=str)
    assert J.jaccard_components(df.where("false")).count() == 0


def test_prefixes_meet_for_all_linked_pairs():
    rng = random.Random(2)
    for _ in range(2000):
        n = rng.randrange(3, 30)
        a = set(rng.sample(range(60), n))
        b = set(a)
        for _ in range(rng.randrange(0, 6)):
            b.discard(rng.choice(sorted(b))) if rng.random() < 0.5 and len(b) > 1 else b.add(rng.randrange(60))
        o = len(a & b)
        if len(b) < 3 or not J.linked(o, len(a), len(b)):
            continue
        assert o >= J.least_overlap(len(a), len(b))
        hot = np.array(sorted(rng.sample(range(60), 10)), np.uint64)
        x, y = sorted((a, b), key=len)
        (kx, sx, _), (ky, _, _) = (J.prefixes(np.array(sorted(s), np.uint64), hot) for s in (x, y))
        assert set(kx[:sx].tolist()) & set(ky.tolist())
        sa, sb = (J.sketch(np.array(sorted(s), np.uint64)) for s in (a, b))
        assert J.may_link(sa, len(a), sb, len(b))


def test_components_of_chains_stars_and_rings(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(i, 700 + (i - 699) % 40) for i in range(700, 740)]
    edges += [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    links = spark.createDataFrame([(b, a) if rng.random() < 0.5 else (a, b) for a, b in edges], "a long, b long")
    near = collections.defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    want = {}
    for start in sorted(x for x in near if near[x] - {x}):
        if start in want:
            continue
        todo = [start]
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = start
                todo += near[x]
    assert {tuple(r) for r in C.components(links).collect()} == set(want.items())
    assert C.components(links.where("false")).count() == 0


def test_links_as_brute_force(spark, monkeypatch):
    ship(spark)
    for block, rows in ((512, corpus()), (16, corpus() + [(None, corpus()[20][1]), (None, "in no other row")])):
        monkeypatch.setattr(J, "BLOCK_ROWS", block)
        sets = {}
        for i, x in rows:
            if i is not None:
                w = (x or "").encode().lower().split()
                k = min(5, len(w))
                sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
        want = {i: sum(j != i and bool(s & t) and 100 * len(s & t) >= 75 * len(s | t) for j, t in sets.items()) for i, s in sets.items()}
        got = J.jaccard_links(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert len(got) == len(rows) and max(want.values()) > 10
        assert {(r.doc_id, r.n_links) for r in got if r.doc_id is not None} == set(want.items())
        nulls = sorted((r.n_links for r in got if r.doc_id is None), key=str)
        assert nulls == ([want[rows[20][0]] + 1, None] if block == 16 else [])


def test_overlaps_over_blocks_of_columns():
    rng = random.Random(6)
    sets = [np.array(sorted(rng.sample(range(90), rng.randrange(1, 60))), np.uint64) for _ in range(12)]
    for columns in (7, 4096):
        assert J.overlaps(sets, columns).tolist() == [[len(set(a.tolist()) & set(b.tolist())) for b in sets] for a in sets]


def test_accumulated_places_against_sets():
    rng = random.Random(8)
    wide = lambda k: rng.sample([rng.randrange(1 << 64) for _ in range(400)], k)
    left, right = [], []
    for _ in range(300):
        base = wide(rng.randrange(1, 120))
        other = [x for x in base if rng.random() > rng.choice([0, 0.1, 0.14, 0.2, 0.5])] + wide(rng.randrange(0, 9))
        left.append(np.array(sorted(set(base)), np.uint64))
        right.append(np.array(sorted(set(other)), np.uint64))
    want = [bool(set(a.tolist()) & set(b.tolist())) and bool(J.linked(len(set(a.tolist()) & set(b.tolist())), len(a), len(b))) for a, b in zip(left, right, strict=True)]
    assert 30 < sum(want) < 270
    for blocks in (1, 4, 16):
        assert J.linked_places(left, right, blocks).tolist() == want
    assert J.linked_places([], [], 4).tolist() == []


def test_one_outsider_costs_blocks_not_their_square(spark):
    """A column whose rows are one component, but for one, gives cells of the outsider with each block only."""
    ship(spark)
    rows = [(7, i, 10, True, 0 if i < 4000 else 9000, bytes(8)) for i in range(4001)]
    df = spark.createDataFrame(rows, "h long, id long, n int, smaller boolean, component long, sketch binary").repartition(4)
    got = J._block_products(df).collect()
    assert {tuple(sorted((r.a, r.b))) for r in got} == {(i, 4000) for i in range(4000)} and len(got) == 4000
