"""Token ids of whole texts from a public tokenizer file, each distinct word encoded once.

The tokenizer library spends most of its time on the words of a text one by one,
and words repeat, so a worker keeps the words it has seen. A text of plain Latin
letters is cut at the pre-tokenizer's own pattern, and each new piece goes to the
library's BPE model. In any other text the white-space-separated chunks go to the
library as they are, since the pre-tokenizer lets no token cross white space.

Both ways follow the rules of one vocabulary file (``RULES``). A file with any other
normalizer, pre-tokenizer or model settings has its texts encoded whole by the library.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np

#: Name of the vocabulary in the public tokenizers' folder and its document end.
VOCABULARY = "word_bpe_49k.json"
END = 1
#: Words, and bytes they take, that a worker remembers before it starts afresh.
MOST_WORDS = 600_000
MOST_BYTES = 1 << 28
#: The settings of a vocabulary file under which words may be encoded alone.
RULES = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
                "behavior": "Removed",
                "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "model": {
        "type": "BPE",
        "dropout": None,
        "unk_token": None,
        "continuing_subword_prefix": None,
        "end_of_word_suffix": "</w>",
        "fuse_unk": False,
        "byte_fallback": False,
        "ignore_merges": False,
    },
}
#: Letters whose composed form and lower case are one character, texts of
#: which the lower case has no other letters, and the pre-tokenizer's pattern for these.
_LETTERS = "a-zß-öø-ɏ"
_LATIN = "".join(c for c in map(chr, range(0xC0, 0x250)) if len(c.lower()) == 1 and c.lower() <= "ɏ")
_PLAIN = re.compile(f"[\t-\r -~{_LATIN}]*")
_PIECES = re.compile(rf"[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\t-\r {_LETTERS}0-9]+")
_CHUNKS = re.compile("[^\t-\r ]+")


def byte_letters() -> dict[int, str]:
    """Character that stands for each byte in byte-level vocabularies."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + k) for k, b in enumerate(moved)}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def words_alone(path: str) -> bool:
    """Whether a vocabulary file has the settings in ``RULES``."""
    with open(path, encoding="utf-8") as file:
        given = json.load(file)
    model = {k: v for k, v in given["model"].items() if k not in ("vocab", "merges")}
    # added tokens are found in the raw text; only those that start "<|" keep to one chunk
    added = all(t["content"].startswith("<|") and not re.search(r"\s", t["content"]) for t in given["added_tokens"])
    plain = not any(t[k] for t in given["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
    return added and plain and RULES == {"normalizer": given["normalizer"], "pre_tokenizer": given["pre_tokenizer"], "model": model}


class Encoder:
    """Ids, and with ``spans`` the characters they cover, of texts given as UTF-8 bytes."""

    def __init__(self, path: str, spans: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.with_spans = spans
        self.by_words = words_alone(path)
        self.forget()

    def forget(self) -> None:
        self.words: dict[str, int] = {}
        self.flat, self.first, self.last = array("I"), array("I"), array("I")
        self.at, self.sizes = array("Q"), array("I")
        self.held = 0

    def _add(self, word: str) -> None:
        """Remember a piece, or a chunk marked by a space before it."""
        self.words[word] = len(self.sizes)
        self.at.append(len(self.flat))
        before = len(self.flat)
        if word[0] == " ":
            done = self.tokenizer.encode(word[1:], add_special_tokens=False)
            self.flat.extend(done.ids)
            spans = done.offsets if self.with_spans else []
        else:
            plain = word.isascii()
            parts = self.model.tokenize(word if plain else word.encode().decode("latin-1").translate(self.letters))
            self.flat.extend([p.id for p in parts])
            spans = []
            if self.with_spans:
                char = range(len(word)) if plain else [k for k, c in enumerate(word) for _ in c.encode()]
                at = 0
                for p in parts:  # each character of a token's name is a byte
                    end = at + len(p.value.removesuffix("</w>"))
                    spans.append((char[at], char[end - 1] + 1))
                    at = end
        self.sizes.append(len(self.flat) - before)
        self.held += sys.getsizeof(word) + 100 + 12 * self.sizes[-1]
        if self.with_spans:
            self.first.extend([a for a, _ in spans])
            self.last.extend([b for _, b in spans])

    def _numbers(self, words: list[str]) -> np.ndarray:
        if len(self.words) > MOST_WORDS or self.held > MOST_BYTES:
            self.forget()
        for word in set(words).difference(self.words):
            self._add(word)
        return np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))

    def _split(self, text: bytes) -> list[str]:
        string = text.decode()
        if _PLAIN.fullmatch(string) and "<|" not in string:
            return _PIECES.findall(string.lower())
        return [" " + chunk for chunk in _CHUNKS.findall(string)]

    def _gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in the flat arrays of the words' ids, and ids per word."""
        sizes = np.frombuffer(self.sizes, np.uint32)[numbers].astype(np.int64)
        starts = np.frombuffer(self.at, np.uint64)[numbers].astype(np.int64)
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return np.repeat(starts - (ends - sizes), sizes) + np.arange(total), sizes

    def _whole(self, text: bytes):
        return self.tokenizer.encode(text.decode(), add_special_tokens=False)

    def ids(self, text: bytes) -> np.ndarray:
        if not self.by_words:
            return np.array(self._whole(text).ids, np.uint32)
        words = self._split(text)
        if not words:
            return np.empty(0, np.uint32)
        where, _ = self._gather(self._numbers(words))
        return np.frombuffer(self.flat, np.uint32)[where]

    def count(self, text: bytes) -> int:
        if not self.by_words:
            return len(self._whole(text).ids)
        words = self._split(text)
        if not words:
            return 0
        numbers = self._numbers(words)
        return int(np.frombuffer(self.sizes, np.uint32)[numbers].sum(dtype=np.int64))

    def spans(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids with the character spans they cover in the text."""
        if not self.by_words:
            done = self._whole(text)
            ends = np.array(done.offsets, np.int64).reshape(-1, 2)
            return np.array(done.ids, np.uint32), ends[:, 0], ends[:, 1]
        words = self._split(text)
        if not words:
            return np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)
        where, sizes = self._gather(self._numbers(words))
        string = text.decode()
        pattern = _CHUNKS if words[0][0] == " " else _PIECES
        starts = np.array([m.start() for m in pattern.finditer(string if pattern is _CHUNKS else string.lower())])
        base = np.repeat(starts, sizes)
        first = np.frombuffer(self.first, np.uint32)[where].astype(np.int64) + base
        last = np.frombuffer(self.last, np.uint32)[where].astype(np.int64) + base
        return np.frombuffer(self.flat, np.uint32)[where], first, last


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, spans: bool = False) -> Encoder:
    """The worker's encoder of a vocabulary file."""
    if (path, spans) not in _ENCODERS:
        _ENCODERS[path, spans] = Encoder(path, spans)
    return _ENCODERS[path, spans]


def document_ids(path: str, text: bytes, end: int | None = END) -> np.ndarray:
    """Ids of a whole text, with the document end unless that is None."""
    ids = encoder(path).ids(text)
    return ids if end is None else np.append(ids, np.uint32(end))


def pieces_of(ids: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """Start and ids of consecutive cuts of at most ``most`` ids."""
    for start in range(0, len(ids), most):
        yield start, ids[start : start + most]
