"""Token ids against the library, files of planes, packing, and the BPE transducer."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from marketframe.llm import bitplanes, bpe, packing
from marketframe.llm.common import word_hashes
from marketframe.llm.tokens import WordTokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", "  \t\n", "Hello, World's .,. <|endoftext|>. x<|startoftext|>y", "naïve Éá. éx ΑΣ. ΣΑΣ İ ß. ² ½, 10.000,5", "a\x1cb　x\x85y don't I'LL. ﬁ, 日本。 a.b,c., '' 's.", "\U0001f600. é ́x", "x" * 5000,
    "ab" * 2000 + "the" * 700 + "!!!!..." * 300, "mississippi aaaaaaa aaaa aaa " * 9, "ζ" * 900, "thethethehehehaing" * 200, "!" * 999, "1234567890" * 50, "é" * 333 + ".",
]
DOCS = "doc_id long, text string, id int, start string"


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def texts(n=40):
    rng = random.Random(5)
    parts = ["the", "th", "ing", "Er", "tion", "é", "ß", "!!", ".", ",", " ", " ", "\n", "'s", "12", "ü", "日", "#", "<|endoftext|>", "AND"]
    return ODD + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 400))) for _ in range(n)]


def frame(spark, rows=None):
    """Documents with clashing extra columns, a repeated id and a null id."""
    rows = [(k, t, 7, "s") for k, t in enumerate(texts())] if rows is None else rows
    return spark.createDataFrame(rows, DOCS)


def test_word_by_word_is_the_library(library):
    t = WordTokenizer(PATH)
    for x in texts():
        assert t.ids(x).tolist() == library.encode(x or "", add_special_tokens=False).ids, x


def test_folding_at_the_end_of_a_word_is_the_library(library):
    """Capitals whose folding has a mark, marks behind letters, every letter of the first blocks before a full stop or comma."""
    t, rng = WordTokenizer(PATH), random.Random(17)
    letters = [chr(c) for c in range(0x41, 0x600) if chr(c).isalpha()] + [c for c in map(chr, range(0x600, 0x20000)) if len(c.lower()) > 1]
    marks = ["", "\u0301", "\u0307", "\u0327", "\u0345", "\u200d"]
    words = ["BELED\u0130YES\u0130. ANKARA", "\u0130STANBUL'DAK\u0130, ev", "\u0130.", "i\u0307,", "A\u030a.", "\u212b."] + [f"{w}{c}{m}{end}" for c in letters for w in ("", "ab") for m in ("", "\u0307") for end in (".", ",.x")]
    pool = [*letters, *"abcABC.,'", "\u0130", "\u0130", ".", ",", "'s"]
    words += ["".join(rng.choice(pool) + rng.choice(marks) * (rng.random() < 0.1) for _ in range(rng.randint(1, 12))) + rng.choice(["", ".", ",", ".,"]) for _ in range(10000)]
    for x in words:
        assert t.ids(x).tolist() == library.encode(x, add_special_tokens=False).ids, x


def test_transducer_is_the_library(library):
    c = bpe.Codec(PATH)
    assert c.merges.lookahead == 32
    for x in texts():
        ids = c.encode(x).tolist()
        assert ids == library.encode(x or "", add_special_tokens=False).ids, x
        assert "".join(c.decode(ids, chunk=3)) == library.decode(ids, skip_special_tokens=False)


def test_a_text_without_white_space_comes_bit_by_bit(library):
    """Letters, marks, added tokens and symbols in one word of 600,000 bytes: the library's ids, never many at once."""
    rng, c = random.Random(31), bpe.Codec(PATH)
    bits = ["the", "ing", "str", "\u00e9t\u00e9", "A", "'s", "12", "!!", "<|endoftext|>", "\u65e5", "\u0130", "e\u0301", "zzz", "\u00a0"]
    text = "some words \n " + "".join(rng.choice(bits) for _ in range(180_000)) + " and more"
    parts = list(c.stream(text))
    assert max(map(len, parts)) <= bpe.AT_ONCE and sum(map(len, parts)) > 3 * bpe.AT_ONCE
    assert np.concatenate(parts).tolist() == library.encode(text, add_special_tokens=False).ids
    word = "".join(rng.choice(["an", "ther", "q", "ou", "ing", "x"]) for _ in range(100_000))
    assert c.encode(word).tolist() == library.encode(word, add_special_tokens=False).ids


def test_stretches_change_nothing(library, monkeypatch):
    c = bpe.Codec(PATH)
    text = " \n".join(f"word{k} \u00e9t\u00e9 {'x' * (k % 40)}" for k in range(300)) + "\u00a0end"
    want = library.encode(text, add_special_tokens=False).ids
    for size in (1, 7, 100, 1 << 16):
        monkeypatch.setattr(bpe, "STRETCH", size)
        assert c.encode(text).tolist() == want and (size > 100 or len(list(c.stream(text))) > 30)


def test_transducer_holds_little():
    """Tokens come out long before a word without end is over."""
    c = bpe.Codec(PATH)
    taken, out = 0, c.merges.stream(s for s in iter_counted("thaninger" * 2000))
    first = next(out)
    taken = iter_counted.n
    assert first and taken < 12 * c.merges.lookahead
    assert "".join([first, *out]) == "thaninger" * 2000 + "</w>"


def iter_counted(text):
    iter_counted.n = 0
    for s in text:
        iter_counted.n += 1
        yield s


def test_decoded_bytes_keep_the_text():
    c = bpe.Codec(PATH)
    assert "".join(c.decode(c.encode("naïve 日本 ok!"), spelled=True, chunk=1)) == "naïve 日本 ok ! "


def test_small_merge_lists_against_plain_merging():
    """Random merge lists: the transducer gives what merging the best pair again and again gives."""
    rng = random.Random(3)
    for _ in range(60):
        known, merges = ["a", "b", "c", "a$", "b$", "c$"], []
        while len(merges) < 12:
            x, y = rng.choice([k for k in known if not k.endswith("$")]), rng.choice(known)
            if x + y not in known and len(x + y) < 9:
                merges.append((x, y))
                known.append(x + y)
        m = bpe.Merges({k: i for i, k in enumerate(known)}, merges, "$")
        rank = {p: i for i, p in enumerate(merges)}
        for _ in range(20):
            word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 40)))
            parts = [*word[:-1], word[-1] + "$"]
            while pairs := [(rank[p], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in rank]:
                i = min(pairs)[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            assert list(m.stream(word)) == parts


def test_round_trip_query(spark):
    out = bpe.round_trip(frame(spark, [(1, None, 7, "s"), (1, "a b", 7, "s"), (None, "", 7, "s")]), PATH).collect()
    assert sorted(r.n_tokens for r in out) == [0, 0, 2]
    assert bpe.round_trip(frame(spark, []), PATH).count() == 0


@pytest.mark.parametrize("kind", ["byte", "bit"])
@pytest.mark.parametrize("n", [0, 1, 7, 64, 1001])
def test_planes_round_trip(kind, n):
    ids = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint64).astype("<u4")
    planes = bitplanes.to_planes(ids, kind)
    assert len(planes) == (32 if kind == "bit" else 4)
    assert (bitplanes.from_planes(planes, n, kind) == ids).all()
    with pytest.raises(ValueError, match="planes"):
        bitplanes.to_planes(ids, "nibble")


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_files_hold_all_ids(spark, library, tmp_path, kind):
    docs = frame(spark)
    path = bitplanes.write_ids(docs.repartition(3), PATH, 2, path=f"file://{tmp_path}/{kind}", block_ids=256, kind=kind)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in bitplanes.read_documents(spark, path).collect()}
    at = 0
    for r in docs.orderBy("doc_id").collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 2]
        assert got[r.doc_id] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_files_of_odd_tables(spark, tmp_path):
    none = bitplanes.write_ids(frame(spark, []), PATH, 2, path=f"file://{tmp_path}/none")
    assert bitplanes.read_documents(spark, none).count() == 0
    twice = frame(spark, [(3, "a", 7, "s"), (3, "a", 7, "s"), (3, "b c", 7, "s"), (None, None, 7, "s")])
    out = bitplanes.read_documents(spark, bitplanes.write_ids(twice, PATH, 2, path=f"file://{tmp_path}/twice")).collect()
    assert sorted(r.n_tokens for r in out) == [1, 2, 2, 3] and sorted(r.start for r in out)[:2] == [0, 1]


def test_packing(spark, library):
    docs = frame(spark)
    out = packing.pack(packing.pieces(docs, PATH, 0, 64), 64, group_pieces=50)
    rows = out.collect()
    for r in docs.collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 0]
        own = sorted((x for x in rows if x.doc_id == r.doc_id), key=lambda x: x.piece)
        assert [(x.start, x.length) for x in own] == [(k, min(64, len(ids) - k)) for k in range(0, len(ids), 64)]
        assert [x.ids_crc32 for x in own] == [zlib.crc32(np.array(ids[k : k + 64], "<u4").tobytes()) for k in range(0, len(ids), 64)]
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 64
    assert len(sequences) <= 1.05 * sum(r.length for r in rows) / 64 + 2
    assert packing.pack(packing.pieces(frame(spark, []), PATH, 0, 64), 64).count() == 0
    same = frame(spark, [(1, "a b c", 7, "s")] * 40)
    assert packing.pack(packing.pieces(same, PATH, 0, 64), 64, group_pieces=8).count() == 40


def test_each_piece_goes_where_the_squares_stay_smallest():
    lengths, capacity = np.random.default_rng(0).integers(1, 20, 300), 20
    where, offset, left = packing.sum_of_squares(lengths, capacity)
    counts, gap = [0] * (capacity + 1), {}
    for s, b, o in zip(lengths.tolist(), where.tolist(), offset.tolist(), strict=True):

        def total(g, s=s):
            c = counts.copy()
            if g < capacity:
                c[g] -= 1
            if g > s:
                c[g - s] += 1
            return sum(x * x for x in c)

        options = [total(g) for g in range(s, capacity) if counts[g]] + [total(capacity)]
        g = gap.get(b, capacity)
        assert g >= s and o == capacity - g and total(g) == min(options)
        if g < capacity:
            counts[g] -= 1
        gap[b] = g - s
        if g > s:
            counts[g - s] += 1
    assert [gap[b] for b in range(len(left))] == left.tolist()


def test_states_hold_the_tokens_that_end_there():
    """A symbol costs one move and the tokens that can end there, not a search through all endings; reading a word again makes no move."""
    m = bpe.codec(PATH).merges
    word = "unbelievablyinternationalisation" * 9
    first = list(m.stream(word))
    moves = len(m.moves)
    assert list(m.stream(word)) == first and len(m.moves) == moves and "".join(first) == word + m.end
    for name, inside, closing in m.states.values():
        for found, close in ((inside, ""), (closing, m.end)):
            assert [t for t, _ in found] == [name[k:] + close for k in range(len(name)) if m.token(name[k:] + close)]


def test_a_worker_remembers_for_one_stage_at_a_time():
    """Pipeline stages share Python workers: what the tokenizer remembers goes when the next stage hashes words, and the other way round."""
    t = WordTokenizer(PATH)
    want = t.ids("one two, three").tolist()
    assert t.words and t.cores
    hashes = word_hashes([b"one", b"two"])
    assert not t.words and not t.cores
    assert t.ids("one two, three").tolist() == want and t.words
    assert word_hashes([b"one", b"two"]).tolist() == hashes.tolist() and not t.words
