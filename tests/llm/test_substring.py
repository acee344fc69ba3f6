import numpy as np
import pytest

from lotline.llm import substring
from lotline.llm.common import words
from tests.llm.data import documents, texts, with_odd_columns


def brute(values, length=20):
    """Words that stay, for each text in order."""
    tokens = [(v or "").encode().split() for v in values]
    first = {}
    for d, w in enumerate(tokens):
        for i in range(len(w) - length + 1):
            first.setdefault(tuple(w[i : i + length]), (d, i))
    out = []
    for d, w in enumerate(tokens):
        gone = {j for i in range(len(w) - length + 1) if first[tuple(w[i : i + length])] != (d, i) for j in range(i, i + length)}
        out.append((len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return out


@pytest.mark.parametrize("seed,length", [(21, 20), (22, 9)])
def test_repeats(spark, seed, length):
    loop = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    values = [*texts(seed, 90), " ".join(["same"] * 100), loop, f"{loop} {loop}", f"0 {loop[:-2]} 1", loop.replace(" ", "\n")]
    docs = documents(spark, values)
    got = substring.remove_repeats(with_odd_columns(docs.repartition(3)), length).collect()
    assert [tuple(r)[1:] for r in sorted(got, key=lambda r: r.doc_id)] == brute(values, length)


def test_rows_that_share_ids_and_null_ids(spark):
    long = " ".join(f"w{i}" for i in range(30))
    rows = [(1, long), (1, long), (None, long), (2, f"x {long} y"), (3, None), (3, f"z {long}"), (3, f"q {long}")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(((r.doc_id or 0, r.n_words, r.n_removed, r.kept_text[:2]) for r in substring.remove_repeats(docs).collect()))
    assert got == [(0, 30, 0, "w0"), (1, 30, 0, "w0"), (1, 30, 0, "w0"), (2, 32, 30, "x "), (3, 0, 0, ""), (3, 31, 30, "q"), (3, 31, 30, "z")]
    assert substring.remove_repeats(docs.limit(0)).collect() == []
    with pytest.raises(ValueError, match="more than"):
        substring.remove_repeats(docs, 7)


def test_every_passage_has_one_segment_and_equal_passages_equal_anchors(monkeypatch):
    for chunk in (5, 1 << 18):
        monkeypatch.setattr(substring, "_CHUNK", chunk)
        seen = {}
        for text in texts(23, 40):
            h = substring.Hashes(words(text))
            firsts, counts, anchors = substring.segments(h, 20)
            passages = np.concatenate([np.arange(f, f + c) for f, c in zip(firsts, counts, strict=True)] or [np.zeros(0, int)])
            assert passages.tolist() == list(range(max(0, h.n - 19)))
            owner = np.repeat(anchors, counts)
            for key, anchor in zip(h.of(passages, passages + 20).tolist() if len(passages) else [], owner.tolist(), strict=True):
                assert seen.setdefault(key, anchor) == anchor
