"""Token ids of whole texts, equal to those of the tokenizers library, from a vocabulary file whose path is a parameter.

The library spends its time on merging words that it has not met before, and a corpus never runs out of
those. Where the file allows it, the merges are done by tiktoken instead: it takes the same vocabulary as
ranks, since in such files a merge with a lower number has a lower id. That is checked when the file is
read; any other file, and any text beyond what the faster way is known to read alike, goes through the
library itself. Nothing is remembered from text to text, so the cost of a gigabyte does not depend on
how many came before.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer

#: What byte-level vocabularies split a text by.
_BYTE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for a text without two white spaces in a row: no looking ahead.
_BYTE_SPLIT_SINGLE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"
_TWO_SPACES = re.compile(r"\s\s")
#: What vocabularies with word ends take as words.
_WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same for Latin-1, whose classes are few.
_LETTERS, _DIGITS, _SPACES = "a-zªµºß-öø-ÿ", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
_LATIN_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^{_SPACES}{_LETTERS}{_DIGITS}]+")
_WORDS = regex.compile(_WORD_SPLIT)
#: Beyond these, the library's tables of characters may be of another age than Python's.
_COMMON = regex.compile(r"[\x01-\x1b -ɏ̀-ͷͺ-Ϳ΄-΢Τ-ԯא-תؠ-ي٠-٩ँ-हก-ฺ‐-‧‰-⁞₠-₿←-⇿　-〿ぁ-ゖァ-ヺー-ヾ一-龥가-힣！-～\U0001f300-\U0001f5ff\U0001f600-\U0001f64f]*")
#: Stands for the end of a word; a text that holds it goes through the library.
_END = "\0"


def byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible Latin-1 for itself,
    the others from U+0100 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


_BYTES = byte_characters()


def _raw(entry: str) -> bytes:
    return bytes(map(_BYTES.__getitem__, entry))


def entry_bytes(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary; special tokens are their strings."""
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    special = {t["id"]: t["content"].encode() for t in whole["added_tokens"]}
    plain = {i: entry for entry, i in whole["model"]["vocab"].items() if i not in special}
    return [special[i] if i in special else _raw(plain[i]) for i in range(len(plain) + len(special))]


def _ranks(model: dict, special: set[str], suffix: str) -> dict[bytes, int] | None:
    """The vocabulary as ranks, if lower merges have lower ids and single characters come before all merges."""
    ranks = {}
    for entry, i in model["vocab"].items():
        if entry not in special:
            word_end = bool(suffix) and entry.endswith(suffix) and entry != suffix
            ranks[_raw(entry.removesuffix(suffix) if word_end else entry) + _END.encode() * word_end] = i
    singles = len(ranks) - len(model["merges"])
    for number, merge in enumerate(model["merges"]):
        left, right = merge if isinstance(merge, list) else merge.split(" ")
        if model["vocab"].get(left + right) != singles + number:
            return None
    return ranks if len(ranks) == len(model["vocab"]) - sum(s in model["vocab"] for s in special) else None


class Encoder:
    """Encodes whole texts. With ``special``, the library's default, the strings of special tokens in a
    text are those tokens; without, they are text."""

    def __init__(self, path: str, special: bool = True) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        added = {t["content"]: t for t in whole["added_tokens"]}
        self.special = {s: array("I", [t["id"]]).tobytes() for s, t in added.items()} if special else {}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        model, self.segment = whole["model"], None
        plain = all(t["special"] and not (t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"]) for t in added.values())
        usable = plain and model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
        ranks = _ranks(model, set(added), model.get("end_of_word_suffix") or "") if usable and array("I").itemsize == 4 else None
        if ranks and self._is_byte_level(whole):
            self.full = tiktoken.Encoding("full", pat_str=_BYTE_SPLIT, mergeable_ranks=ranks, special_tokens={})
            self.single = tiktoken.Encoding("single", pat_str=_BYTE_SPLIT_SINGLE, mergeable_ranks=ranks, special_tokens={})
            self.segment = self._bytes_segment
        elif ranks and self._has_word_ends(whole):
            self.words = tiktoken.Encoding("words", pat_str=f"[^{_END}]*{_END}", mergeable_ranks=ranks, special_tokens={})
            self.segment = self._words_segment

    @staticmethod
    def _is_byte_level(whole: dict) -> bool:
        split = whole["pre_tokenizer"] or {}
        return whole["normalizer"] is None and not whole["model"].get("end_of_word_suffix") and split.get("type") == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]

    @staticmethod
    def _has_word_ends(whole: dict) -> bool:
        steps = (whole["normalizer"] or {}).get("normalizers", [])
        splits = (whole["pre_tokenizer"] or {}).get("pretokenizers", [])
        return (
            whole["model"].get("end_of_word_suffix") == "</w>"
            and [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"]
            and steps[1]["pattern"] == {"Regex": r"\s+"}
            and steps[1]["content"] == " "
            and [s["type"] for s in splits] == ["Split", "ByteLevel"]
            and splits[0]["pattern"] == {"Regex": _WORD_SPLIT}
            and (splits[0]["behavior"], splits[0]["invert"]) == ("Removed", True)
            and not splits[1]["use_regex"]
            and not splits[1]["add_prefix_space"]
        )

    def _bytes_segment(self, text: str) -> bytes | None:
        use = self.full if _TWO_SPACES.search(text) else self.single
        return array("I", use.encode_ordinary(text)).tobytes()

    def _words_segment(self, text: str) -> bytes | None:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            if not _COMMON.fullmatch(text):
                return None
            found = _WORDS.findall(unicodedata.normalize("NFC", text).lower())
        else:
            if _END in text:
                return None
            found = _LATIN_WORDS.findall(text.lower())
        if not found:
            return b""
        return array("I", self.words.encode_ordinary(_END.join(found) + _END)).tobytes()

    def _library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _one(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.segment is None:
            return self._library(text)
        parts = self.cut.split(text) if self.cut else [text]
        ids = [self.special.get(part) or (self.segment(part) if part else b"") for part in parts]
        return self._library(text) if None in ids else b"".join(ids)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; null counts as empty."""
        return [self._one(t) for t in texts]


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, special: bool = True) -> Encoder:
    """The encoder of this process for a vocabulary file."""
    key = (path, special)
    if key not in _encoders:
        _encoders[key] = Encoder(path, special)
    return _encoders[key]
