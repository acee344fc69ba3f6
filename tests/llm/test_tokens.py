"""Token ids, the Elias-Fano files and packing, against the library and plain Python."""

import functools
import json
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lotline.llm import elias_fano, packing, queries, tokens
from lotline.llm.elias_fano import EliasFano
from tests.llm.data import documents, texts, with_odd_columns

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
ODD = [
    "", None, " ", "  ", "a  b", "a \n b", " a", "a ", "a\u00a0b", "a\u2009 b\u3000 c", "x ½ y", "½", "1½ 2", "\x1c a\x1db \x1e", "it's we'll  's \n\n x",
    "é e\u0301a", "Σ ΟΔΟΣ x", "日本 語です", "😀 😀😀", "a\tb\r\nc", "<|endoftext|> x", "a<|endoftext|><|endoftext|>b <|startoftext|>", "a <|endoftext |> b",
    "don 't 's", "\x00 \x00a", "a\x0bb \x85 c", "ﬁ İ I ı", "A\nB\n\nC \nD\n", "w," * 50, "x" * 20_000, "Привет, МИР", "ÀÉ 'S", "a\u0345b",
]


@functools.cache
def library(file, special=True):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(file))
    if not special:
        tokenizer.encode_special_tokens = True
    return lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("file", FILES)
@pytest.mark.parametrize("special", [True, False])
def test_the_ids_of_the_library(file, special):
    encoder = tokens.encoder(public_tokenizers.path(file), special)
    assert encoder.segment
    whole = library(file, special)
    values = ODD + texts(2, 60)
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(values)] == [whole(t) for t in values]


def test_special_tokens_as_the_unchanged_library_has_them():
    for file, end in zip(FILES, (49407, 50256), strict=True):
        ids = np.frombuffer(tokens.encoder(public_tokenizers.path(file)).encode(["hi <|endoftext|> yo"])[0], "<u4").tolist()
        assert end in ids and ids == Tokenizer.from_file(public_tokenizers.path(file)).encode("hi <|endoftext|> yo", add_special_tokens=False).ids


@pytest.mark.parametrize("file", FILES)
@settings(max_examples=200, deadline=None)
@given(text=st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t'.,aB½éЯ中")), max_size=40))
def test_any_text(file, text):
    encoder = tokens.encoder(public_tokenizers.path(file))
    assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == library(file)(text)


def test_every_character_alone_and_among_others():
    """The tables of characters behind the faster way are those of the library."""
    points = [c for c in range(0, 0x30000, 7) if not 0xD800 <= c < 0xE000]
    values = [f"a{chr(c)}b 1{chr(c)}2 .{chr(c)}{chr(c)}. {chr(c)} Z{chr(c)}" for c in points]
    for file in FILES:
        want = [x.ids for x in Tokenizer.from_file(public_tokenizers.path(file)).encode_batch(values, add_special_tokens=False)]
        got = tokens.encoder(public_tokenizers.path(file)).encode(values)
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == want


def test_a_file_of_another_order_goes_through_the_library(tmp_path):
    whole = json.loads(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())
    merges = whole["model"]["merges"]
    merges[0], merges[1] = merges[1], merges[0]
    path = tmp_path / "other.json"
    path.write_text(json.dumps(whole))
    encoder = tokens.Encoder(str(path))
    assert encoder.segment is None
    for text in ["the thing, in there", "a  b"]:
        assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-(2**61), 2**61), max_size=60), st.integers(0, 62))
def test_elias_fano(values, shift):
    values = sorted(v >> shift for v in values)
    code = EliasFano.from_bytes(EliasFano.of(np.array(values, np.int64)).to_bytes())
    assert code.values().tolist() == values
    assert [code.select(i) for i in range(len(values))] == values
    assert all(code.select_range(i, j).tolist() == values[max(i, 0) : j] for i in range(-2, len(values) + 1, 3) for j in range(i, len(values) + 3, 5) if j >= 0)


def test_elias_fano_is_small_and_selects_far():
    values = np.cumsum(np.random.default_rng(3).integers(0, 300, 200_000))
    code = EliasFano.of(values)
    assert len(code.to_bytes()) * 8 / len(values) < 2 + np.log2(150) + 0.5
    assert [code.select(i) for i in range(0, 200_000, 997)] == values[::997].tolist()
    assert (code.values() == values).all()
    for i, j in ((0, 200_000), (511, 513), (512, 1024), (1000, 1000), (777, 90_001), (199_990, 200_000)):
        assert (code.select_range(i, j) == values[i:j]).all()
    with pytest.raises(IndexError):
        code.select(200_000)
    with pytest.raises(ValueError, match="decrease"):
        EliasFano.of(np.array([2, 1]))


def test_files_round_trip(spark):
    values = texts(4, 60) + ODD
    docs = documents(spark, values).repartition(5)
    got = queries_result(elias_fano.round_trip(with_odd_columns(docs), public_tokenizers.path("word_bpe_49k.json")))
    whole, start, want = library("word_bpe_49k.json"), 0, []
    for i, t in enumerate(values):
        ids = [*whole(t), 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want


def queries_result(df):
    return sorted((r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in df.collect())


def test_null_ids_repeats_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "a"), (3, "b"), (3, "b"), (-1, None)], "doc_id bigint, text string")
    rows = elias_fano.round_trip(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert sorted((r.start, r.doc_id, r.n_tokens) for r in rows) == [(0, None, 2), (2, -1, 1), (3, 3, 2), (5, 3, 2)]
    assert elias_fano.round_trip(docs.limit(0), public_tokenizers.path("word_bpe_49k.json")).collect() == []


def test_one_document_by_select(tmp_path, monkeypatch):
    monkeypatch.setattr(elias_fano.TaskContext, "get", classmethod(lambda cls: type("T", (), {"partitionId": lambda self: 0})()))
    writer = elias_fano.TokensWriter(f"file://{tmp_path}", 2, False)
    ids = [[5, 6], [], [7], list(range(1000))]
    raw = [np.array(x, "<u4").tobytes() for x in ids]
    message = writer.write(iter([pa.RecordBatch.from_arrays([pa.array([1, 2, 4, 9]), pa.array(raw, pa.binary())], ["doc_id", "ids"])]))
    f = pa.BufferReader((tmp_path / message.name).read_bytes())
    assert [elias_fano.document(f, i).tolist() for i in range(4)] == ids
    # Readers go by ranges: they never unpack a whole sequence.
    monkeypatch.setattr(EliasFano, "values", lambda self: pytest.fail("the whole sequence"))
    for documents_at_once in (2, 3):
        monkeypatch.setattr(elias_fano, "READ_DOCUMENTS", documents_at_once)
        assert [x.as_py() for b in elias_fano.read_file(f, 100) for x in b.column(0)] == [1, 2, 4, 9]
    monkeypatch.setattr(elias_fano, "READ_BYTES", 64)
    batches = list(elias_fano.read_file(f, 100))
    assert len(batches) > 1 and [x.as_py() for b in batches for x in b.column(3)] == raw
    assert [x.as_py() for b in batches for x in b.column(1)] == [100, 102, 102, 103]


def brute_level(levels, length, size):
    """By the definition: the sum of squares after each choice."""
    best = None
    for h in range(size - length, -1, -1):
        if h and not levels[h]:
            continue
        after = levels.copy()
        if h:
            after[h] -= 1
        if h + length < size:
            after[h + length] += 1
        cost = int((after[1:size] ** 2).sum())
        if best is None or cost < best[0]:
            best = cost, h
    return best[1]


def test_the_level_has_the_least_sum_of_squares():
    rng = np.random.default_rng(0)
    for _ in range(2000):
        size = 16
        levels = np.where(rng.random(size + 1) < 0.6, 0, rng.integers(1, 5, size + 1))
        levels[[0, size]] = 0
        packer = packing.Packer(size)
        packer.levels = levels
        length = int(rng.integers(1, size + 1))
        assert packer.best_level(length) == brute_level(levels, length, size)


@pytest.mark.parametrize("most_open", [3, 8192])
def test_packing(spark, most_open):
    values = texts(6, 80) + ODD
    docs = documents(spark, values)
    docs = with_odd_columns(docs.union(docs.where("doc_id = 9").selectExpr("CAST(NULL AS bigint)", "text", "lang", "source", "n_chars"))).repartition(3)
    size = 64
    rows = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), size=size, open_windows=most_open).collect()
    whole = library("byte_bpe_50k.json")
    for i, t in [*enumerate(values), (None, values[9])]:
        ids = np.array([*whole(t), 1], "<u4")
        pieces = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert [r.start for r in pieces] == np.cumsum([0, *(r.length for r in pieces)])[:-1].tolist()
        assert b"".join(r.ids for r in pieces) == ids.tobytes() and {r.doc_tokens for r in pieces} == {len(ids)}
    sequences = {}
    for r in sorted(rows, key=lambda r: r.offset):
        assert r.offset == sequences.get(r.sequence_id, 0)
        sequences[r.sequence_id] = r.offset + r.length
    assert all(n == size or n < size and n & (n - 1) == 0 for n in sequences.values())
    assert packing.pack(docs.limit(0), public_tokenizers.path("byte_bpe_50k.json")).collect() == []
    assert queries.packed(documents(spark, ["a"])).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
