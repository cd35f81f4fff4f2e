"""BPE encoding and decoding as streaming transducers with bounded lookahead."""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache, lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from marketframe.llm.common import WORDS_KEPT, id_text, in_batches, rows_of
from marketframe.llm.tokens import byte_letters

#: Unicode white space, as the normaliser's ``\\s`` has it.
WHITE = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_NEVER = 1 << 60
#: Bytes of a text that are encoded at once.
STRETCH = 1 << 16
#: Ids that a longer word gives at once.
AT_ONCE = 1 << 14
#: Moves between states that are remembered.
MOVES_KEPT = 1 << 17
#: A state's name, and the tokens that end there with their lengths, longest first: within a word, and at its end.
State = tuple[str, tuple[tuple[str, int], ...], tuple[tuple[str, int], ...]]
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


class Merges:
    """A merge list, read as a transducer from symbols to tokens.

    The encoding of a text is the one sequence of tokens in which every token is its own encoding and no two neighbours would have
    merged across their boundary.  So the last token of each prefix follows from the last tokens of at most ``lookahead`` shorter
    prefixes, ``lookahead`` being the longest token's length: no later symbol can open a token further back.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str) -> None:
        self.end = end
        self.rank: dict[tuple[str, str], int] = {}
        self.made: dict[str, tuple[int, str, str]] = {}
        for k, (a, b) in enumerate(merges):
            self.rank[a, b] = k
            if a + b in self.made or any(len(self._symbols(x)) > 1 and x not in self.made for x in (a, b)):
                raise ValueError("a merge list must make each token once, from tokens that are there already")
            self.made[a + b] = k, a, b
        self.vocab = vocab
        self.lookahead = max([1, *(len(self._symbols(t)) for t in self.made)])
        # The transducer's states: what some token starts with.  A state's moves and the tokens that end there are made as they are met.
        self.starts = {body[:k] for body in map(self._symbols, (*self.made, *self.vocab)) for k in range(1, len(body) + 1)}
        self.states: dict[str, State] = {}
        self.moves: dict[str, State] = {}
        self.right = lru_cache(1 << 17)(lambda t: self._spine(t, 2))
        self.left = lru_cache(1 << 17)(lambda t: self._spine(t, 1))
        self.token = lru_cache(1 << 18)(self._token)
        self.apart = lru_cache(1 << 19)(self._apart)

    def _symbols(self, token: str) -> str:
        return token[: -len(self.end)] if self.end and token.endswith(self.end) and token != self.end else token

    def _spine(self, token: str, side: int, until: int = _NEVER) -> list[tuple[str, int]]:
        """What stands at a token's edge while it is being merged, and the rank of the merge that ends each."""
        found = [(token, until)]
        while token in self.made:
            until, token = self.made[token][0], self.made[token][side]
            found.append((token, until))
        return found

    def _crossed(self, rights: list[tuple[str, int]], lefts: list[tuple[str, int]]) -> bool:
        """Whether some merge takes place across the boundary before both sides are complete.  Equal ranks: the left one is first."""
        rank = self.rank
        for x, x_ends in rights:
            for y, y_ends in lefts:
                q = rank.get((x, y))
                if q is not None and q < x_ends and q <= y_ends:
                    return True
        return False

    def _apart(self, a: str, b: str) -> bool:
        return not self._crossed(self.right(a), self.left(b))

    def _token(self, token: str) -> bool:
        """Whether a token is its own encoding."""
        if token not in self.made:
            return token in self.vocab and len(self._symbols(token)) == 1
        k, a, b = self.made[token]
        if not (self.token(a) and self.token(b)):
            return False
        rights, lefts = self._spine(a, 2, k), self._spine(b, 1, k)
        return not (self._crossed(rights[:1], lefts[1:]) or self._crossed(rights[1:], lefts))

    def _enter(self, read: str) -> State:
        """The state after ``read``, a state and one more symbol: its longest ending that some token starts with."""
        at = next((k for k in range(len(read)) if read[k:] in self.starts), len(read) - 1)
        name = read[at:]
        state = self.states.get(name)
        if state is None:
            tokens = lambda close: tuple((t, len(name) - k) for k in range(len(name)) if self.token(t := name[k:] + close))
            state = self.states[name] = (name, tokens(""), tokens(self.end))
        if len(self.moves) >= MOVES_KEPT:
            self.moves.clear()
        self.moves[read] = state
        return state

    def stream(self, symbols: Iterable[str]) -> Iterator[str]:
        """Tokens of one word, each as soon as no further symbol can change it.  Holds a few times ``lookahead`` symbols."""
        apart, moves, enter, most = self.apart, self.moves, self._enter, 4 * self.lookahead
        last, back, n = [""], [0], 0  # of each prefix: its last token and that token's length; both from the last stable place on
        state: State | None = None
        name = ""
        for s in symbols:
            if state is not None:
                for t, k in state[1]:
                    if apart(last[n - k], t):
                        break
                else:
                    raise ValueError("a symbol is not in the vocabulary")
                last.append(t)
                back.append(k)
                if n >= most:
                    stable = self._stable(back, n)
                    yield from self._path(last, back, stable)
                    n -= stable
                    last, back = last[stable:], [0, *back[stable + 1 :]]
            state = moves.get(name + s) or enter(name + s)
            name = state[0]
            n += 1
        if state is not None:
            for t, k in state[2]:
                if apart(last[n - k], t):
                    break
            else:
                raise ValueError("a symbol is not in the vocabulary")
            last.append(t)
            back.append(k)
            yield from self._path(last, back, n)

    def _stable(self, back: list[int], n: int) -> int:
        """The last boundary that all prefixes which a later token can follow have in common."""
        heads = set(range(max(0, n - self.lookahead + 1), n + 1))
        while len(heads) > 1:
            top = max(heads)
            heads.remove(top)
            heads.add(top - back[top])
        return heads.pop()

    @staticmethod
    def _path(last: list[str], back: list[int], n: int) -> list[str]:
        found = []
        while n:
            found.append(last[n])
            n -= back[n]
        return found[::-1]


class Codec:
    """Encodes and decodes as the tokenizers library does with a file of word-end BPE over byte letters.

    The file states NFC, white space and case folding; pieces by one pattern; byte letters; merges with a word end; no decoder.  Its
    added tokens are taken out of the text first.  None is an empty text.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        model = made["model"]
        self.merges = Merges(model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]], model["end_of_word_suffix"])
        self.added = {t["content"]: t["id"] for t in made["added_tokens"]}
        self.vocab = model["vocab"]
        pattern = made["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(pattern.replace("\\s", WHITE))
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")")
        strings = {i: t for t, i in [*self.vocab.items(), *self.added.items()]}
        self.strings = [strings.get(i, "").encode() for i in range(max(strings) + 1)]
        from_letter = {c: b for b, c in byte_letters().items()}
        self.raw = [self._bytes(strings.get(i, ""), from_letter) for i in range(len(self.strings))]
        self.decimals = [b"%d" % i for i in range(len(self.strings))]
        self.code = "H" if len(self.strings) <= 1 << 16 else "I"
        self.known: dict[bytes, bytes] = {}
        self.piece_ids: dict[str, bytes] = {}

    def _bytes(self, token: str, from_letter: dict[str, int]) -> bytes:
        if token in self.added:
            return token.encode()
        body = self.merges._symbols(token)
        return bytes(from_letter[c] for c in body) + (b" " if body != token else b"")

    def _piece(self, piece: str) -> bytes:
        ids = self.piece_ids.get(piece)
        if ids is None:
            found = [self.vocab[t] for t in self.merges.stream(piece.encode("utf-8").decode("latin-1").translate(byte_letters()))]
            ids = struct.pack(f"<{len(found)}{self.code}", *found)
            if len(piece) <= 64:
                self.piece_ids[piece] = ids
        return ids

    @staticmethod
    def _folded(part: str) -> str:
        return unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()

    def _long(self, word: bytes) -> Iterator[np.ndarray]:
        """Ids of a word of any length, ``AT_ONCE`` at a time; its pieces are neither gathered nor remembered."""
        text, letters, held = word.decode("utf-8", "replace"), byte_letters(), []
        for k, part in enumerate(self.specials.split(text)):
            if k % 2:
                held.append(self.added[part])
                continue
            for piece in self.pieces.finditer(self._folded(part)):
                for t in self.merges.stream(piece.group().encode("utf-8").decode("latin-1").translate(letters)):
                    held.append(self.vocab[t])
                    if len(held) == AT_ONCE:
                        yield np.array(held, "<u4")
                        held = []
        yield np.array(held, "<u4")

    def _word(self, word: bytes) -> bytes:
        text, out = word.decode("utf-8", "replace"), []
        for k, part in enumerate(self.specials.split(text) if "<|" in text else [text]):
            if k % 2:
                out.append(struct.pack(f"<{self.code}", self.added[part]))
            elif part:
                folded = self._folded(part)
                out += map(self._piece, self.pieces.findall(folded))
        return b"".join(out)

    def stream(self, text: str | None) -> Iterator[np.ndarray]:
        """Ids of a whole text, stretch by stretch (about ``STRETCH`` bytes, cut at white space, which no token reaches across).  Words are
        encoded once and remembered; one that is longer than a stretch is encoded symbol by symbol."""
        raw, at = (text or "").encode("utf-8", "surrogatepass"), 0
        while at < len(raw):
            gap = _SPACE.search(raw, at + STRETCH)
            end = gap.start() if gap else len(raw)
            words, size, at = raw[at:end].split(), end - at, end
            long = words.pop() if size > 2 * STRETCH else None  # only the last word reaches so far
            yield self._stretch(words)
            if long is not None:
                yield from self._long(long)

    def _stretch(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > WORDS_KEPT:
            known.clear()
            self.piece_ids.clear()
        found = list(map(known.get, words))
        if None in found:
            for i, ids in enumerate(found):
                if ids is None:
                    w = words[i]
                    ids = known.get(w)
                    if ids is None:
                        ids = self._word(w)
                        if len(w) <= 64:
                            known[w] = ids
                    found[i] = ids
        return np.frombuffer(b"".join(found), f"<u{struct.calcsize(self.code)}").astype("<u4")

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text at once."""
        return np.concatenate([np.empty(0, "<u4"), *self.stream(text)])

    def decode(self, ids: Iterable[int], *, spelled: bool = False, chunk: int = 4096) -> Iterator[str]:
        """Text of ids, chunk by chunk: bytes go through a UTF-8 state machine that holds at most one unfinished character.

        As the library without a decoder: tokens as written in the file, one space between.  ``spelled``: the bytes they stand for, a
        space for each word's end; invalid bytes become U+FFFD.
        """
        state, table = codecs.getincrementaldecoder("utf-8")("replace"), self.raw if spelled else self.strings
        between, first, ids = b"" if spelled else b" ", True, iter(ids)
        while part := list(map(table.__getitem__, islice(ids, chunk))):
            yield state.decode((b"" if first else between) + between.join(part))
            first = False
        yield state.decode(b"", True)


@cache
def codec(path: str) -> Codec:
    """One per Python worker and file."""
    return Codec(path)


def round_trip(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text and decode its ids: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Ids go from the encoder through the hash into the decoder stretch by stretch; beside the text itself (and, of a word longer than a
    stretch, its folded form) no more than a stretch of words and ids is held.

    Null and empty texts have no ids; their hashes are those of the empty text.  Repeated ids are separate rows; columns other than
    the two named are not read.  No shuffle.
    """
    kinds = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        c = codec(tokenizer)
        for doc, text in rows_of(batches, "id", "text"):
            seen, ids_sha, text_sha = [0], hashlib.sha256(), hashlib.sha256()

            def stretches(text: str | None = text, seen: list[int] = seen, sha=ids_sha) -> Iterator[list[int]]:
                for part in map(np.ndarray.tolist, c.stream(text)):
                    if part:
                        sha.update(b" " * bool(seen[0]) + b" ".join(map(c.decimals.__getitem__, part)))
                        seen[0] += len(part)
                        yield part

            for part in c.decode(chain.from_iterable(stretches())):
                text_sha.update(part.encode())
            yield doc, seen[0], ids_sha.hexdigest(), text_sha.hexdigest()

    return id_text(docs, id_col, text_col).mapInArrow(lambda b: in_batches(both(b), kinds), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
