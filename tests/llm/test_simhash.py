import random

import pytest
import xxhash

from lotline.llm import simhash
from tests.llm.data import documents, texts, with_odd_columns


def brute_fingerprint(text):
    tokens = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else " " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    if not tokens:
        return 0
    grams = [" ".join(tokens[i : i + 3]) for i in range(len(tokens) - 2)] or [" ".join(tokens)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    group = {f: f for f in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (a ^ b).bit_count() <= 2 and group[b] < group[a]:
                    group[a] = group[b]
                    changed = True
    return group


def test_near_duplicates(spark):
    values = texts(11, 120)
    docs = documents(spark, values, first=-3)
    docs = docs.union(docs.where("doc_id < 20"))
    got = simhash.near_duplicates(with_odd_columns(docs)).collect()
    prints = {i - 3: brute_fingerprint(t) for i, t in enumerate(values)}
    group = brute_components(set(prints.values()))
    low = {}
    for i, f in prints.items():
        low[group[f]] = min(low.get(group[f], i), i)
    assert len(got) == docs.count()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(i, f"{f:016x}", low[group[f]]) for i, f in prints.items()}


@pytest.mark.parametrize("limit", [0, 4, 32])
def test_links_of_dense_fingerprints(spark, monkeypatch, limit):
    """Chains and balls of near fingerprints, through small buckets and through large ones."""
    monkeypatch.setattr(simhash, "SMALL_BUCKET", limit)
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(40):
            fps.add(centre)
            centre ^= 1 << rng.randrange(64)
    fps |= {0, 1, 3, 7, (1 << 64) - 1, (1 << 64) - 1 ^ 1 << 63}
    rows = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp bigint")
    linked = {r.node & (1 << 64) - 1: r.component & (1 << 64) - 1 for r in simhash.components(simhash.links(rows)).collect()}
    want, got = brute_components(fps), {f: linked.get(f, f) for f in fps}
    assert len(set(want.values())) == len(set(got.values()))
    assert len({(want[f], got[f]) for f in fps}) == len(set(want.values()))


def test_thresholds_are_allocated_at_least_cost():
    costs = [[0, 5, 9], [0, 4, 6], [0, 7, 8]]
    best = min((a, b, c) for a in range(3) for b in range(3) for c in range(3) if a + b + c - 3 == 0)
    assert sum(simhash.allocate(costs, 0)[1]) == 0
    every = [(sum(costs[i][k] for i, k in enumerate(x)), [k - 1 for k in x]) for x in [(a, b, c) for a in range(3) for b in range(3) for c in range(3)] if sum(x) == 3]
    assert simhash.allocate(costs, 0)[0] == min(every)[0] and best


def test_null_ids_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (None, "q r s t u v")], "doc_id bigint, text string")
    got = sorted((r.doc_id is None, r.component_id) for r in simhash.near_duplicates(docs).collect() if r.component_id is not None)
    assert got == [(False, 5), (True, 5)]
    assert simhash.near_duplicates(docs.limit(0)).collect() == []
