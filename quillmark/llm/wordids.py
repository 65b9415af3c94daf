"""Token ids of whole texts with a word-level tokenizer file, at the speed of a dictionary lookup.

The vocabulary splits at white space before its merges, so a chunk between white space always
gives the same ids.  Chunks are looked up in a bounded cache; a chunk seen for the first time goes
to the tokenizers library: plain Latin chunks straight to its merge model, all else (other scripts,
control characters, special-token strings) through its whole ``encode``.  That shortcut holds for
files that normalize and split as ``RULES`` says; with any other file whole texts go to the library.
"""

from __future__ import annotations

import json
import re
import sys
from array import array

from .common import worker_state

#: Control characters that str.split() takes for white space and the tokenizer does not.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_CHUNK = re.compile(r"[^\t\n\x0b\x0c\r ]+")
#: Characters for which Python's lower() and NFC agree with the library's normalizer.
_PLAIN = re.compile("[!-~¡-įı-ɏ]+")
_NUMERIC = "²³¹¼½¾"
_PIECE = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_{_NUMERIC}]+|[\d{_NUMERIC}]|(?:[^\s\w]|_)+"
)
#: What a file must say for chunks to be independent and words to be as ``_PIECE`` finds them.
RULES = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: Marks that end a word, none of which joins with another to something else than a run of marks.
_ENDS = ".,;:!?"
#: Chunks and words of one cache generation, and the longest that is kept.
CACHE_CHUNKS, CACHE_WORDS, CACHE_CHARS = 300_000, 200_000, 40


class TwoGenerations(dict):
    """A bounded cache: a full generation becomes the old one, and what is used again moves back."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.old = limit, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= CACHE_CHARS:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value

    def make(self, key: str) -> bytes:
        raise NotImplementedError


class Words(TwoGenerations):
    """Lower-case words and runs of marks, by the merge model alone."""

    def __init__(self, model):
        super().__init__(CACHE_WORDS)
        self.model, self.alphabet = model, _byte_alphabet()

    def make(self, key: str) -> bytes:
        spelled = key.encode().decode("latin-1").translate(self.alphabet)
        return array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()


def _byte_alphabet() -> dict[int, str]:
    """Printable stand-ins for bytes, as byte-level vocabularies spell them."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class WordIds(TwoGenerations):
    """A cache from chunk to its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__(CACHE_CHUNKS)
        self.tokenizer = Tokenizer.from_file(path)
        self.words = Words(self.tokenizer.model)
        self.vocab_size = self.tokenizer.get_vocab_size()
        said = json.loads(self.tokenizer.to_str())
        self.plain = said["model"]["type"] == "BPE" and not said["model"].get("dropout") and all(said[k] == v for k, v in RULES.items())
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added)) or "(?!)")

    def make(self, key: str) -> bytes:
        if _PLAIN.fullmatch(key) and not self.special.search(key):
            low = key.lower()
            if low.isalpha():
                return self.words[low]
            word = low.rstrip(_ENDS)
            if word.isalpha():
                return self.words[word] + self.words[low[len(word) :]]
            return b"".join(map(self.words.__getitem__, _PIECE.findall(low)))
        return self.whole(key)

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.plain:
            return self.whole(text)
        chunks = _CHUNK.findall(text) if _ODD_SPACE.search(text) else text.split()
        return b"".join(map(self.__getitem__, chunks))


if sys.byteorder != "little" or array("I").itemsize != 4:
    raise ImportError("ids are kept as little-endian 32-bit integers")

def word_ids(path: str) -> WordIds:
    """The encoder of a file, kept as long as the Python worker encodes with it."""
    return worker_state(("word-ids", path), lambda: WordIds(path))
