"""Ids of a word BPE (lower case, white space dropped, word ends) from a tokenizers JSON file, inside workers.

Such a tokenizer encodes each word by itself, so the ids of a text are those
of its words in order: a worker encodes a word once and keeps it. Words are
found here only where both libraries are sure to read a text alike: printable
characters below U+0250, which no normal form changes and whose case and
kind are the same in all Unicode versions. Other texts, and those with a
special token's string, go to the tokenizers library whole.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from array import array

from tidemark.llm.bpe import byte_of_char

#: Normaliser and word pattern of the vocabulary this reading is made for; any other file is read by the library alone.
NORMALISERS = ["NFC", "Replace", "Lowercase"]
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Longer words are encoded without being kept; so many words are kept at most.
LONGEST_KEPT, MOST_KEPT = 64, 400_000

#: Bytes of lower-case Latin letters in UTF-8, and what the last one of a word becomes: capitals, and bytes below 64.
LETTER_BYTES = {*range(97, 123), *range(0x80, 0xC0), *range(0xC3, 0xCA)}
AT_END = bytes(b - 32 if 97 <= b < 123 else b - 0x80 if 0x80 <= b < 0xC0 else b for b in range(256))


class WordBPE:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.known = [s["type"] for s in (spec.get("normalizer") or {}).get("normalizers", [])] == NORMALISERS and steps[0].get("pattern", {}).get("Regex") == WORDS
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.exact = Tokenizer.from_file(path)
        self.exact.no_truncation()
        self.exact.no_padding()
        lower = sorted({c for code in range(33, 0x250) for c in chr(code).lower()})  # some lie above U+0250
        letters, numbers = ("".join(c for c in lower if unicodedata.category(c)[0] == kind) for kind in "LN")
        self.words = re.compile(f"[{letters}]+|[{numbers}]|'s|'t|'re|'ve|'m|'ll|'d|[^\\s{letters}{numbers}]+").findall  # first characters differ: letters may come first
        self.unsure = re.compile("[^\t\n\r -~¡-ɏ]").search
        self.latin = re.compile("[%s]+" % "".join(c for c in letters if c < "{" or "ß" <= c < "ɐ")).fullmatch
        self.merge = self._merger({t: i for t, i in spec["model"]["vocab"].items() if t not in self.special}) if self.known else None
        self.kept: dict[str, bytes] = {}

    def _encode(self, text: str) -> bytes:
        return array("I", self.exact.encode(text, add_special_tokens=False).ids).tobytes()

    def _merger(self, vocabulary: dict[str, int]):
        """tiktoken's merges over words of Latin letters, several times faster; a word's last byte has a byte of its own, unused by such words."""
        import tiktoken

        code, ranks = byte_of_char(), {}
        for token, i in vocabulary.items():
            ends = token.endswith("</w>") and token != "</w>"
            data = bytes(code[c] for c in (token[:-4] if ends else token))
            if LETTER_BYTES.issuperset(data) and not (ends and data[-1] >= 0xC0):  # no word ends in a leading byte
                ranks[data[:-1] + data[-1:].translate(AT_END) if ends else data] = i
        return tiktoken.Encoding("words", pat_str=".", mergeable_ranks=ranks, special_tokens={})._encode_single_piece

    def word(self, word: str) -> bytes:
        if self.latin(word):
            data = word.encode()
            return array("I", self.merge(data[:-1] + data[-1:].translate(AT_END))).tobytes()
        return self._encode(word)

    def data(self, text: str) -> bytes:
        """The ids as unsigned 32-bit numbers (little-endian, as the machines are); strings of special tokens are those tokens, as in the library's default."""
        if not self.known or self.unsure(text) or any(s in text for s in self.special):
            return self._encode(text)
        words = self.words(text.lower())
        found = list(map(self.kept.get, words))
        if None in found:
            fresh = {w: self.word(w) for w in {w for w, f in zip(words, found, strict=True) if f is None}}
            found = [fresh[w] if f is None else f for w, f in zip(words, found, strict=True)]
            if len(self.kept) > MOST_KEPT:
                self.kept.clear()
            self.kept.update((w, ids) for w, ids in fresh.items() if len(w) <= LONGEST_KEPT)
        return b"".join(found)


@functools.lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBPE:
    """The tokenizer of a file, with the words it has met, for as long as the worker lives."""
    return WordBPE(path)
