from itertools import combinations

import numpy as np
import pytest
import xxhash

from fieldsense.llm.simhash import (Forest, block_masks, blocks_for, close_links, components, drop_near_copies, links,
                                    near_groups, signed, simhash, simhash_near_dedup)


def slow_simhash(text, width=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i:i + width]), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > n)


def brute(rows, radius=4):
    fps = [slow_simhash(t) for _, t in rows]
    root = list(range(len(rows)))
    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, j in combinations(range(len(rows)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= radius:
            root[find(i)] = find(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((doc_id, f"{fps[i]:016x}", min(ids) if ids else None))
    return sorted(out, key=str)


def text(rng, n):
    return " ".join(rng.choice(["Alpha", "beta", "gamma", "DELTA", "eps", "zeta", "eta", "É"], n))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    out = [(1, ""), (2, None), (3, " \n\t"), (4, "one two"), (5, "ONE two"), (6, "é É"), (7, "a b c d"), (7, "a b c d"),
           (None, "x y z w v"), (None, "x y z w v"), (None, "solo text of nobody else at all")]
    for i in range(25):
        base = text(rng, 250)
        out.append((100 + i * 10, base))
        for k in range(rng.integers(0, 4)):
            words = base.split()
            words[int(rng.integers(250))] = "changed"
            out.append((int(100 + i * 10 + k + 1), " ".join(words)))
    return out


def test_fingerprint_is_the_definition(rows):
    for _, t in rows:
        assert simhash(t) == slow_simhash(t)


def test_groups_against_brute_force(docs_of, clashing, rows):
    got = simhash_near_dedup(clashing(docs_of(rows))).collect()
    assert sorted([(r.doc_id, r.fingerprint, r.component_id) for r in got], key=str) == brute(rows)


def near_and_far(n, seed):
    rng = np.random.default_rng(seed)
    fps = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    for i in range(1, n):
        if rng.random() < 0.6:                       # a few bits away from an earlier one
            flips = rng.choice(64, rng.integers(0, 8), replace=False)
            fps[i] = fps[rng.integers(i)] ^ np.uint64(sum(1 << int(b) for b in flips))
    return fps


@pytest.mark.parametrize("n,radius", [(1, 4), (2, 4), (63, 4), (64, 3), (65, 0), (130, 4), (400, 7)])
def test_bit_sliced_comparison(n, radius):
    fps = near_and_far(n, n)
    cuts = sorted({0, n // 3, n // 2, n})            # several units, all pairs inside each
    ends = np.concatenate([np.full(b - a, b) for a, b in zip(cuts, cuts[1:])])
    root = close_links(fps, ends, radius, at_once=50)
    want = Forest(n)
    for i in range(n):
        for j in range(i + 1, int(ends[i])):
            if bin(int(fps[i] ^ fps[j])).count("1") <= radius:
                want.union(np.array([i]), np.array([j]))
    assert (root == want.parent).all()


@pytest.mark.parametrize("split,blocks", [(2, None), (7, None), (4096, None), (3, 7), (4096, 8), (2, 9)])
def test_links_join_everything_within_the_radius(spark, split, blocks):
    """Also when every bucket is dealt into parts, and with any number of blocks."""
    fps = np.unique(near_and_far(300, 9))
    nodes = spark.createDataFrame([(signed(int(x)),) for x in fps], "fp bigint").repartition(4)
    comp = {r.node: r.root for r in components(links(nodes, 4, split, blocks)).collect()}
    f = Forest(len(fps))
    for i, j in combinations(range(len(fps)), 2):
        if bin(int(fps[i] ^ fps[j])).count("1") <= 4:
            f.union(np.array([i]), np.array([j]))
    want = {}
    for i, x in enumerate(fps):
        want.setdefault(int(f.parent[i]), set()).add(signed(int(x)))
    have = {}
    for x in fps:
        s = signed(int(x))
        have.setdefault(comp.get(s, s), set()).add(s)
    assert sorted(map(sorted, have.values())) == sorted(map(sorted, want.values()))
    assert all(root == min(members) for root, members in have.items())


def test_long_chain_is_one_component(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(200)], "a bigint, b bigint")
    got = components(e).collect()
    assert {r.node for r in got} == set(range(1, 201)) and {r.root for r in got} == {0}


def test_stage_keeps_the_first_of_each_group(docs_of, clashing, rows):
    d = clashing(docs_of(rows))
    got = drop_near_copies(d)
    assert got.columns == d.columns
    kept = [(r.doc_id, slow_simhash(r.text)) for r in got.collect()]
    roots = [r.root for r in near_groups(docs_of(rows)).select("root").distinct().collect()]
    assert len(kept) == len(roots)                   # one row a group
    named = {c for _, _, c in brute(rows) if c is not None}
    assert named <= {i for i, _ in kept}


def test_empty_table(docs_of):
    assert simhash_near_dedup(docs_of([])).collect() == []
    assert drop_near_copies(docs_of([])).collect() == []


def test_blocks_grow_with_the_fingerprints():
    from math import comb
    assert [blocks_for(n) for n in (0, 1, 8 << 21, (8 << 21) + 1, 8 << 27, (8 << 27) + 1, 10**12)] == [6, 6, 6, 7, 7, 8, 9]
    for blocks in (6, 7, 8, 9):
        masks = [m for _, m in block_masks(4, blocks)]
        assert len(set(masks)) == comb(blocks, 4) and all(
            bin(m).count("1") >= 64 * (blocks - 4) // blocks - 1 for m in masks)
        # whatever four bits differ, some choice of blocks is left alone
        for bits in ((0, 1, 2, 3), (0, 20, 40, 63), (7, 8, 31, 32), (5, 15, 25, 35)):
            assert any(not m & sum(1 << b for b in bits) for m in masks)


def test_components_of_a_star_and_a_chain_end_exactly(spark):
    star = [(0, i) for i in range(1, 400)]
    chain = [(1000 + i, 1001 + i) for i in range(130)]
    got = {r.node: r.root for r in components(spark.createDataFrame(star + chain, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(1, 400)} | {i: 1000 for i in range(1001, 1131)}
