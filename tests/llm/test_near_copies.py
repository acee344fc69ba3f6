import random

import pytest

import corpus_pipeline
from lotline.llm import near_copies
from tests.llm.data import VOCABULARY, documents, texts, with_odd_columns


def brute_set(text):
    tokens = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else " " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ")
    tokens = [t for t in tokens if t]
    return frozenset(tuple(tokens[i : i + 5]) for i in range(len(tokens) - 4)) or frozenset([tuple(tokens)] if tokens else [])


def brute_components(values, least=0.8):
    sets, low = [brute_set(t) for t in values], list(range(len(values)))
    pairs = [(i, j) for i in range(len(values)) for j in range(i) if sets[i] == sets[j] or len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])]
    changed = True
    while changed:
        changed = False
        for i, j in pairs:
            if low[i] != low[j]:
                low[i] = low[j] = min(low[i], low[j])
                changed = True
    return low, pairs, sets


def planted(seed=3):
    """Copies with a similarity of about 0.8 to 0.95, chains of copies, and texts well below 0.8."""
    rng = random.Random(seed)
    out = [t for t in texts(seed, 40)]
    for k in range(12):
        words = rng.choices(VOCABULARY, k=200)
        out.append(" ".join(words))
        for n in (1, 2, 3, 4, 9):
            changed = list(words)
            for at in rng.sample(range(200), n):
                changed[at] = f"new{k}x{n}"
            out.append(" ".join(changed))
    words = rng.choices(VOCABULARY, k=120)
    for k in range(20):
        words = list(words)
        words[rng.randrange(120)] = f"step{k}"
        out.append(" ".join(words))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed", [3, 8])
def test_near_copies_are_the_components_of_all_pairs(spark, seed):
    values = planted(seed)
    low, pairs, sets = brute_components(values)
    between = [len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i, j in pairs if sets[i] != sets[j]]
    assert len(between) > 80 and min(between) < 0.82
    got = near_copies.near_copies(with_odd_columns(documents(spark, values))).collect()
    assert {(r.doc_id, r.component_id) for r in got} == set(enumerate(low)) and len(got) == len(values)


def test_the_stage_leaves_one_of_each_component(spark):
    values = planted(4)
    low = brute_components(values)[0]
    docs = documents(spark, values)
    got = corpus_pipeline.near_dedup(spark, docs.union(docs.limit(9)), "")
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(low))
    odd = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (None, "q r s t u v")], "doc_id bigint, text string")
    assert sorted((r.doc_id is None, r.component_id) for r in near_copies.near_copies(odd).collect() if r.component_id) == [(False, 5), (True, 5)]
    assert near_copies.near_copies(odd.limit(0)).collect() == []


def one_bucket(spark, sets):
    """Nodes that all meet in one band, with any sets."""
    nodes = spark.createDataFrame([(i, [7] + [1000 * i + k for k in range(1, 16)]) for i in range(len(sets))], "node bigint, bands array<bigint>")
    table = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "node bigint, grams array<bigint>")
    return nodes, lambda wanted: table.join(wanted, "node")


def proposed(spark, monkeypatch, sets):
    """How many pairs ``links`` compares, and the components that it finds."""
    counts, verified = [], near_copies._verified

    def counting(pairs, *rest):
        counts.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(near_copies, "_verified", counting)
    found = {r.node: r.component for r in near_copies.links(*one_bucket(spark, sets)).collect()}
    monkeypatch.setattr(near_copies, "_verified", verified)
    return sum(counts), found


@pytest.mark.parametrize("passage", [0, 60])
def test_pairs_grow_in_proportion_on_a_bucket_of_dissimilar_nodes(spark, monkeypatch, passage):
    """500, 1,000 and 2,000 nodes that share nothing, or a passage of 60 of their 100 shingles."""
    counts = []
    for n in (500, 1000, 2000):
        sets = [[*range(passage), *range(1000 * (i + 1), 1000 * (i + 1) + 100 - passage)] for i in range(n)]
        count, found = proposed(spark, monkeypatch, sets)
        assert found == {}
        counts.append(count)
    assert counts[0] >= 500 and counts[1] <= 2.1 * counts[0] and counts[2] <= 4.2 * counts[0]


def test_similar_pairs_of_a_large_bucket_are_all_found(spark, monkeypatch):
    """Chains, pairs at the limit, and nodes around several centres, among many that share a passage only."""
    rng = random.Random(2)
    sets = []
    for k in range(60):
        base = [10_000 * (k + 1) + j for j in range(90)]
        for step in range(rng.choice([1, 2, 3, 5])):
            sets.append([*range(20 if k % 2 else 80), *base[10 * step :], *(500_000 + 1000 * k + 10 * step + j for j in range(rng.choice([0, 2, 10])))])
    rng.shuffle(sets)
    sets = [list(dict.fromkeys(s)) for s in sets]
    as_sets, low = [set(s) for s in sets], list(range(len(sets)))
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if len(as_sets[i] & as_sets[j]) >= 0.8 * len(as_sets[i] | as_sets[j])]
    for _ in range(len(sets)):
        for i, j in pairs:
            low[i] = low[j] = min(low[i], low[j])
    count, found = proposed(spark, monkeypatch, sets)
    assert len(pairs) > 30 and {i: found.get(i, i) for i in range(len(sets))} == dict(enumerate(low))
    assert count < 10 * len(sets)
