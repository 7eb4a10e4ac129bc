import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from conftest_llm import LONG, ODD
from tokenizers import Tokenizer

from tidemark.llm.token_counts import Counter, token_counts
from tidemark.llm.word_bpe import WordBPE, code_digests, decode_ids, encode_texts

WORD, PIECE, BYTE = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "piece_bpe_32k.model", "byte_bpe_50k.json"))
PARTS = list("abAB  \t\n\x1c\x1f\x85 ''s é́ΣΑςİıßﬁ日本1²½٣🙂​　 ̈ÅÅ…—") + ["<|endoftext|>", "<|startoftext|>", "'LL", "aaaaaaa", "\x00", "ᄀ", "ᅡ", "<s>", "▁", "it's", "  "]


def texts(n, longest, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(PARTS, k=rng.randint(0, longest))) for _ in range(n)] + ["", "ab" * 3000, " <|endoftext|> ", "x" * 200 + " y"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD)


def test_encoding_and_decoding_equal_the_library(library):
    some = texts(3000, 40, 1)
    bpe = WordBPE(WORD)
    ids, ends = bpe.encode_all(some)
    numbers, decoded = list(bpe.texts_of(ids, ends, True)), list(bpe.texts_of(ids, ends, False))
    for i, t in enumerate(some):
        e = library.encode(t, add_special_tokens=False).ids
        assert numbers[i].decode() == " ".join(map(str, e)), t
        assert decoded[i].decode() == library.decode(e, skip_special_tokens=False), t


def test_merges_one_by_one_give_the_same(library):
    bpe = WordBPE(WORD)
    bpe.ordered = False
    for t in texts(200, 40, 2):
        assert bpe.encode(t) == library.encode(t, add_special_tokens=False).ids


def test_table_that_starts_anew(library, monkeypatch):
    monkeypatch.setattr("tidemark.llm.word_bpe.TABLE_WORDS", 50)
    bpe = WordBPE(WORD)
    for t in texts(50, 60, 3):
        assert bpe.encode(t) == library.encode(t, add_special_tokens=False).ids


def test_digests_of_odd_rows(documents, library):
    def expected(t):
        e = library.encode(t or "", add_special_tokens=False).ids
        return len(e), *(hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, e)), library.decode(e, skip_special_tokens=False)))

    got = sorted(map(str, (tuple(r) for r in code_digests(documents(ODD), WORD, part_bytes=1000).collect())))
    assert got == sorted(str((i, *expected(t))) for i, t in ODD)
    assert code_digests(documents([]), WORD).collect() == []


def test_round_trip_of_ids(documents):
    ids = encode_texts(documents([(1, "Hello  World"), (2, None)]), WORD)
    assert {r.doc_id: r.text for r in decode_ids(ids, WORD).collect()} == {1: "hello</w> world</w>", 2: ""}


def test_cuts_of_long_texts_change_no_count():
    counter, model = Counter(PIECE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    assert counter.split_safe
    for t in texts(3000, 60, 4):
        pieces = counter.split(t, 12)
        assert sum(counter.lengths(pieces)) == len(model.encode(t)), t


@pytest.mark.parametrize("path", [PIECE, BYTE, WORD])
def test_counts_of_odd_rows(documents, path):
    def expected(t):
        if path == PIECE:
            return len(sentencepiece.SentencePieceProcessor(model_file=PIECE).encode(t or ""))
        return len(Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids)

    got = token_counts(documents(ODD), path, limit=1000).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(str((i, len((t or "").encode()), n := expected(t), n > 1000)) for i, t in ODD)
    assert any(r.over_limit for r in got) and len(LONG) > 1 << 15
    assert token_counts(documents([]), path).collect() == []
