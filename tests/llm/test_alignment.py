"""Alignment against plain Python: groups by walking both sides, links one by one, counts in a dictionary."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lotline.llm import alignment, queries
from tests.conftest import SMALL_TABLES
from tests.llm.data import documents, texts, with_odd_columns

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "x", "a  b", "\n", "▁a", "a▁b", "<|endoftext|> <s> </s> <unk>", "日本語です。", "😀 é é", "tab\there\r\n\n", " " * 700, "x" * 5000, "Ünïcödé " * 200, "\x00a", "ab" * 3000]


def sides(text):
    """Ids and bytes of each token, by other means than the operator's."""
    tokenizer = Tokenizer.from_file(A)
    tokenizer.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=B)

    def run(text):
        if not text:
            return [], []
        found = tokenizer.encode(" " + text, add_special_tokens=False)
        signs = {v: k for k, v in _signs().items()}
        a = [(i, bytes(signs[c] for c in t)) for i, t in zip(found.ids, found.tokens, strict=True)]
        b = [(i, bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()) for i, p in ((i, model.id_to_piece(i)) for i in model.encode(text))]
        whole = (" " + text).encode()
        return (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else ([], [])

    return run(text)


def _signs():
    visible = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out, more = {b: chr(b) for b in visible}, 256
    for b in range(256):
        if b not in out:
            out[b], more = chr(more), more + 1
    return out


def brute_groups(a, b):
    groups, i, j, at_a, at_b = [], 0, 0, 0, 0
    while i < len(a):
        start = i, j
        at_a += len(a[i][1])
        i += 1
        while at_b < at_a or at_a != at_b:
            if at_b < at_a:
                at_b += len(b[j][1])
                j += 1
            else:
                at_a += len(a[i][1])
                i += 1
        groups.append(([x for x, _ in a[start[0] : i]], [x for x, _ in b[start[1] : j]]))
    return groups


def brute(values):
    every = [sides(t) for t in values]
    grouped = [brute_groups(a, b) for a, b in every]
    links = [[(x, y) for xs, ys in g for x in xs for y in ys] for g in grouped]
    held = collections.Counter(p for found in links for p in set(found))
    best = collections.defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    out = []
    for (a, b), g, found in zip(every, grouped, links, strict=True):
        text = ";".join(f"{','.join(map(str, xs))}|{','.join(map(str, ys))}" for xs, ys in g)
        digest = hashlib.sha256(text.encode()).hexdigest() if a else ""
        out.append((len(a), len(b), len(g), len(found), sum(held[p] == best[p[0]] for p in found), sum(held[p] for p in found), digest))
    return out


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def values():
    rng = random.Random(5)
    long = "".join(rng.choice(["the ", "x", "  ", "é", "語", "ab", "1", "\n", "ing "]) for _ in range(3000))
    return [*ODD, *texts(12, 40), long, long, *ODD]


@pytest.fixture(scope="module")
def wanted(values):
    return sorted((i, *r) for i, r in enumerate(brute(values)))


@pytest.mark.parametrize("work", [7, 200, 32_768])
def test_against_brute_force_in_pieces_of_any_size(spark, values, wanted, work):
    assert any(r[1] == 0 for r in wanted) and max(r[3] for r in wanted) > 500
    got = alignment.align(with_odd_columns(documents(spark, values)).repartition(3), A, B, work=work)
    assert rows(got) == wanted


def test_joined_counts_give_the_same(spark, values, wanted, monkeypatch):
    assert rows(alignment.align(documents(spark, values), A, B, work=500, shared_pairs=0)) == wanted


def test_counting_in_little_memory_and_by_distinct_ids(spark, values, monkeypatch):
    monkeypatch.setattr(alignment, "_PLAIN_LINKS", 2)
    docs = documents(spark, values)
    single, several = alignment.parts(docs.select("doc_id", "text"), A, B, 500)
    few, many = (rows(alignment.pair_counts(single, several, A, B, counted)) for counted in (50, 10**6))
    held = collections.Counter(p for t in values for p in {(x, y) for xs, ys in brute_groups(*sides(t)) for x in xs for y in ys})
    assert few == many == sorted((x << 32 | y, n) for (x, y), n in held.items())


def test_links_of_large_groups_by_distinct_ids(monkeypatch):
    tables = alignment.Vocabularies([b"", b"a", b"aa", b"aaa"], [b"", b"a", b"aa", b"aaaaa"])
    a, b = np.array([2, 2, 2, 1, 3, 2, 2, 1, 1]), np.array([3, 1, 1, 3, 3, 1])
    found = alignment.Run.of(tables, a, b)
    want = found.pairs()
    monkeypatch.setattr(alignment, "_PLAIN_LINKS", 0)
    assert all((x == y).all() if isinstance(x, np.ndarray) else x == y for x, y in zip(want, found.pairs(), strict=True))
    assert want[1].sum() == want[2]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=40, unique=True), st.lists(st.integers(1, 60), max_size=40, unique=True), st.integers(1, 20))
def test_diagonals_cut_the_merge_into_equal_pieces(a, b, work):
    a, b = np.array(sorted(a), np.int64), np.array(sorted(b), np.int64)
    cuts = alignment.diagonals(a, b, work)
    assert cuts[0] == (0, 0) and cuts[-1] == (len(a), len(b))
    for (i, j), (k, m) in zip(cuts, cuts[1:], strict=False):
        assert k >= i and m >= j and 0 < k - i + m - j <= work + 1
        # All ends before a border are below all ends after it.
        assert not (k and m < len(b)) or a[k - 1] < b[m]
        assert not (m and k < len(a)) or b[m - 1] < a[k]


def test_null_ids_repeats_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "ab cd"), (3, "ab cd"), (3, "ab cd"), (4, None)], "doc_id bigint, text string")
    got = alignment.align(docs, A, B).collect()
    one = brute(["ab cd", "ab cd", "ab cd", None])
    assert sorted((r.doc_id or 0, *r[1:]) for r in got) == sorted([(0, *one[0]), (3, *one[0]), (3, *one[0]), (4, *one[3])])
    assert alignment.align(docs.limit(0), A, B).collect() == []


def test_the_query(spark):
    got = queries.QUERIES["op11_token_alignment"](spark, SMALL_TABLES).collect()
    docs = spark.read.parquet(f"{SMALL_TABLES}/documents.parquet").orderBy("doc_id").collect()
    want = brute([r.text for r in docs])
    assert sorted(map(tuple, got)) == sorted((r.doc_id, *w) for r, w in zip(docs, want, strict=True))
