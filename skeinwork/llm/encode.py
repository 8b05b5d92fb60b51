"""Token ids of whole texts by the tokenizers library, chunk by chunk with a bounded cache.

The byte-level pre-tokenizer starts a new piece at a space that is followed by a word and at a line break between two words,
and merges never cross pieces. A text whose words are all separated by one white-space character is therefore encoded as the
concatenation of its chunks (" word" or "\\nword"); the ids of a chunk come from the library once and are kept. Any other text
(runs of white space, white space at an end, special strings) goes to the library as a whole. tests/llm compares both.
"""

from __future__ import annotations

import os
import re
from array import array
from codecs import charmap_decode

from skeinwork.llm.common import held

# Chunks kept per worker and generation: two generations of 250,000 words take some 100 MB.
CACHE_WORDS = 250_000

# A word of Latin letters, perhaps behind a space, is one piece of the pre-tokenizer, and marks behind it are another.
MARKS = ",.!?;:*%&$#()[]{}<>=+/|@^~\"_-"
_WORD = re.compile(rf"([ \n]?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([{re.escape(MARKS)}]*)")


class TwoGenerations(dict):
    """Cache of ``size`` to 2 x ``size`` entries: when the young generation is full it becomes the old one."""

    def __init__(self, make, size: int = CACHE_WORDS):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def single_spaced(text: str) -> bool:
    """Words are separated by one white-space character each, and none is at an end."""
    words = text.split()
    return bool(words) and sum(map(len, words)) + len(words) - 1 == len(text)


class ChunkEncoder:
    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.tokenize = self.tokenizer.model.tokenize
        # The model's characters for the 256 bytes: printable ones stand for themselves, the others for 256, 257, ...
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in printable)}
        self.letters = "".join(chr(rest.get(b, b)) for b in range(256))
        self.space = self.letters[32]
        self.marks = {m: self._library(m) for m in MARKS + "\n"} | {"": b""}
        self.mark_runs = TwoGenerations(self._library, 1000)
        self.chunks = TwoGenerations(self._chunk, cache_words)

    def _library(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece, which is written in the model's characters for bytes."""
        return array("I", [t.id for t in self.tokenize(piece)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isascii():
            if chunk.isalpha():
                return self._piece(self.space + chunk)
            if chunk[:-1].isalpha() and chunk[-1] in MARKS:
                return self.chunks[chunk[:-1]] + self.marks[chunk[-1]]
        text = chunk[1:] if chunk[:1] == "\0" else chunk if chunk[:1] == "\n" else " " + chunk
        found = _WORD.fullmatch(text)
        if not found:
            return self._library(text)
        before, word, after = found.groups()
        behind = self.marks[after] if len(after) < 2 else self.mark_runs[after] if len(after) <= 64 else self._library(after)
        if before == "\n":
            return self.marks["\n"] + self._piece(charmap_decode(word.encode(), "strict", self.letters)[0]) + behind
        return self._piece(charmap_decode((before + word).encode(), "strict", self.letters)[0]) + behind

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not single_spaced(text) or any(s in text for s in self.special) or "\0" in text:
            return self._library(text) if text else b""
        parts = text.replace("\n", " \n").split(" ")
        parts[0] = "\0" + parts[0]
        chunks = self.chunks
        return b"".join(map(chunks.__getitem__, parts))


def encoder(path: str) -> ChunkEncoder:
    """One encoder per worker process and file."""
    return held(("encoder", path), lambda: ChunkEncoder(path))
