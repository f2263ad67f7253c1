"""Token ids of whole texts, by a public tokenizer."""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Iterable, Sequence
from functools import lru_cache

import numpy as np

#: A tokenizer that lower-cases and drops white space: a text's ids are those of its words, one after the other.
WORD_TOKENIZER = "word_bpe_49k.json"
#: Words whose ids a worker remembers. It bounds memory alone: a word that was forgotten is encoded again.
REMEMBERED = 200_000

#: The word tokenizer's rules, on which the short way rests: a file with any other goes through its tokenizer whole.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: Words of these characters alone need no Unicode tables: each is its own normal form but for its case.
_PLAIN = re.compile("[!-~ß-öø-ÿÀ-ÖØ-Þ]+").fullmatch
#: The tokenizer's own split, for such words.
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+").findall
#: Signs at a word's end, after a letter or digit, are a piece of their own: set apart, a word is remembered once for all of them.
_SIGNS = re.compile(rb"[!-&(-/:-@\[-`{-~](?<=[a-z0-9].)[!-&(-/:-@\[-`{-~]*(?!\S)").sub


def tokenizer_path(name: str = WORD_TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """For each of the first 256 characters the letters by which byte-level vocabularies write its UTF-8 bytes.

    Printable bytes stand for themselves; the others are numbered from 256 on.
    """
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letter = {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(x for x in range(256) if x not in shown)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(256)}


def by_words(path: str) -> bool:
    """Whether a tokenizer's ids of a text are those of its words, one after the other: it is told by the file's rules."""
    with open(path, encoding="utf-8") as file:
        rules = json.load(file)
    plain = not any(a.get("normalized") or a.get("lstrip") or a.get("rstrip") or not a["content"].startswith("<|") for a in rules["added_tokens"])
    bare = rules["model"].get("dropout") is None and rules.get("post_processor") is None and rules.get("truncation") is None and rules.get("padding") is None
    return plain and bare and rules["normalizer"] == _NORMALIZER and rules["pre_tokenizer"] == _PRE_TOKENIZER


class _Packed(dict[int, bytes]):
    """The bytes of each id, made once: words of one id share them."""

    def __missing__(self, i: int) -> bytes:
        self[i] = struct.pack("<I", i)
        return self[i]


class WordEncoder:
    """Encodes whole texts; ids are little-endian unsigned 32-bit.

    Where the file's rules allow it, texts are taken word by word and the words' ids remembered. Plain words are split
    here and their pieces looked up in the tokenizer's model; all others, and texts that might hold a special token, go
    through the whole tokenizer, as do all texts where the file has other rules.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.by_words = by_words(path)
        self.known: dict[bytes, bytes] = {}
        self.packed = _Packed()
        self.letters = _byte_letters()

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: Iterable[bytes]) -> None:
        known = self.known
        for word in words:
            text = word.decode()
            if text.isalpha() and text.isascii():
                known[word] = self._piece(text)
            elif _PLAIN(text):
                # a piece is a word of its own, and often known as one
                pieces = _PIECES(text.lower())
                known[word] = b"".join([known.get(p.encode()) or self._piece(p if p.isascii() else p.translate(self.letters)) for p in pieces])
            else:
                known[word] = self.whole(text)

    def _piece(self, piece: str) -> bytes:
        packed = self.packed
        ids = [packed[t.id] for t in self.tokenize(piece)]
        return ids[0] if len(ids) == 1 else b"".join(ids)

    def ids(self, texts: Sequence[bytes]) -> list[bytes]:
        """The ids of each UTF-8 text as bytes."""
        return [self.of(t) for t in texts]

    def of(self, text: bytes) -> bytes:
        if not self.by_words or b"<|" in text:  # a special token's capitals would make it an ordinary word
            return self.whole(text.decode())
        words = _SIGNS(rb" \g<0>", text.lower()).split()
        found = list(map(self.known.get, words))
        if None in found:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            new = [i for i, ids in enumerate(found) if ids is None]
            self._learn({words[i] for i in new})
            # words that were forgotten just now are taken from what was found before
            for i in new:
                found[i] = self.known[words[i]]
        return b"".join(found)


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """The worker's own encoder: a worker loads the vocabulary once."""
    return WordEncoder(path)
