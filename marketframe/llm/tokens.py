"""Token ids from the tokenizers library, word by word and remembered."""

from __future__ import annotations

import unicodedata
from array import array
from collections.abc import Callable
from functools import cache

import numpy as np

from marketframe.llm.common import WORDS_KEPT, remembers, words_of


#: A run of these after a letter is a piece of its own, whatever letter it is.
SYMBOLS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


@cache
def byte_letters() -> dict[int, str]:
    """The letter that byte-level tokenizers write for each byte: printable Latin-1 stands for itself, the rest follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def ends_in_letter(text: str) -> bool:
    """Whether the last character is a letter of the Latin script's first blocks that stays one when composed and folded to lower case."""
    last = unicodedata.normalize("NFC", text)[-1]
    return last.isalpha() and last < "\u0250" and len(last.lower()) == 1 and last.lower().isalpha()


class _Words(dict[bytes, bytes]):
    """Ids of words; a new one is asked for and remembered."""

    def __init__(self, new: Callable[[bytes], bytes]) -> None:
        super().__init__()
        self.new = new

    def __missing__(self, word: bytes) -> bytes:
        ids = self[word] = self.new(word)
        return ids


class WordTokenizer:
    """Encodes as the tokenizers library does, for tokenizers that drop white space and so never join two words.

    A text is split at ASCII white space; each distinct word goes to the library once and its ids are remembered (at most
    ``WORDS_KEPT`` words; more start the memory afresh).  Plain lower-case letters go straight to the library's BPE model, after
    the case folding its normaliser would do; everything else takes the library's whole route, and so does a word whose last letter
    might fold to a letter and a mark (U+0130), which a symbol behind it would join.  None and empty texts have no ids.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.code = "H" if self.library.get_vocab_size() <= 1 << 16 else "I"
        self.width = np.dtype("=u2" if self.code == "H" else "=u4")
        self.words = _Words(self._new)
        self.cores: dict[bytes, bytes] = {}

    def _pack(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _whole(self, word: bytes) -> bytes:
        return self._pack(self.library.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids)

    def _letters(self, core: bytes) -> bytes:
        """Ids of a word without its full stops and commas."""
        if core.isalpha():  # A-Z and a-z only
            return self._pack([t.id for t in self.model.tokenize(core.decode())])
        text = core.decode("utf-8", "replace")
        small = text.lower()
        if small.isalpha() and max(small) < "\u0250" and text.isalpha() and unicodedata.is_normalized("NFC", text):
            return self._pack([t.id for t in self.model.tokenize(small.encode().decode("latin-1").translate(byte_letters()))])
        return self._whole(core)

    def _new(self, word: bytes) -> bytes:
        """Ids of a word not met before.  ``cores`` holds only what is sure to end in a letter when folded, and runs of symbols."""
        core, cores = word.rstrip(SYMBOLS), self.cores
        small = core.lower()  # A-Z only
        ids = cores.get(small)
        if ids is None:
            if not (core.isalpha() or core and core[-1] > 127 and ends_in_letter(core.decode("utf-8", "replace"))):
                return self._whole(word)
            ids = cores[small] = self._letters(small)
        if len(core) == len(word):
            return ids
        tail = word[len(core) :]
        ends = cores.get(tail)
        if ends is None:
            ends = cores[tail] = self._whole(tail)
        return ids + ends

    def _forget(self) -> None:
        self.words.clear()
        self.cores.clear()

    def packed(self, text: str | None) -> bytes:
        """Ids as integers of ``width``."""
        remembers(self, self._forget)
        if len(self.words) > WORDS_KEPT:
            self._forget()
        return b"".join(map(self.words.__getitem__, words_of(text)))

    def ids(self, text: str | None) -> np.ndarray:
        """Ids as unsigned 32-bit integers."""
        return np.frombuffer(self.packed(text), self.width).astype("<u4")


@cache
def word_tokenizer(path: str) -> WordTokenizer:
    """One per Python worker and file."""
    return WordTokenizer(path)
