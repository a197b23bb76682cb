"""Token counts against the tokenizer itself on whole texts."""

import random
from collections import Counter

import public_tokenizers
import pytest
from helpers import CLASHING, frame, words
from tokenizers import Tokenizer

from parkops.llm import token_counts
from parkops.llm.common import read

WORD, BYTE = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ODD = ["a", "B", "Σ", "ς", "İ", "é", "é", "́", "ᄀ", "ᅡ", " ", "  ", "\t", "\n", "\x1c", "\x85", " ",
       " ", "　", "'s", "'", "1", "½", "²", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "日", "\U0001f600", "‍",
       "ﬁ", "\r", "\x0b", "\x0c", " ", "ß", "ẞ", "ͅ", "K", ".", "&&&"]


def rows():
    rng = random.Random(13)
    out = [(i, "".join(rng.choice(ODD) for _ in range(rng.randrange(60))), "en", "a") for i in range(300)]
    out += [(1000 + i, " ".join(words(rng, rng.randrange(1, 400))), "en", "a") for i in range(60)]
    out += [(2000 + i, "the same text, Again!", "en", "a") for i in range(200)]
    return out + [(None, None, None, None), (None, "two words", "en", "b"), (3000, "", "en", "b"), (3001, "x" * 30_000, "en", "b"),
                  (3002, "word " * 30_000, "en", "b"), out[0], out[0]]


def brute(data, path, limit):
    exact = Tokenizer.from_file(path)
    counts = [len(exact.encode(t or "", add_special_tokens=False).ids) for _, t, *_ in data]
    return Counter((i, len((t or "").encode()), n, n > limit) for (i, t, *_), n in zip(data, counts))


@pytest.mark.parametrize("path, entries", [(WORD, 16384), (WORD, 3), (BYTE, 50)])
def test_counts_equal_the_tokenizer(spark, monkeypatch, path, entries):
    monkeypatch.setattr(token_counts, "FAN_IN", 2)   # summaries are merged in rounds
    data = rows()
    got = token_counts.count_tokens(frame(spark, data, [*CLASHING, "n_tokens", "parts"]), path, limit=100, table_entries=entries)
    assert Counter(map(tuple, got.collect())) == brute(data, path, 100)


def test_empty_table(spark):
    got = token_counts.count_tokens(frame(spark, []), WORD)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and got.count() == 0


def test_which_tokenizers_are_cut_at_blanks():
    assert token_counts.Encoder(WORD).cuts and not token_counts.Encoder(BYTE).cuts


def test_caches_are_bounded(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE_ENTRIES", 10)
    encoder = token_counts.Encoder(WORD)
    for at in range(0, 100, 7):
        parts = {f"part{i}".encode() for i in range(at, at + 20)}
        assert encoder.resolve(parts) == dict(zip(parts, encoder.lengths(parts)))
        assert len(encoder.lately) <= 10 and len(encoder.before) <= 10


def test_frequent_parts_are_found_whatever_their_place(spark):
    rng = random.Random(2)
    texts = [(i, " ".join(["often"] * 4 + words(rng, 10, 10 ** 9)), "en", "a") for i in range(500)]
    found = token_counts.frequent_parts(frame(spark, texts), "text", 20)
    assert found[0] == b"often" and len(found) <= 20


def test_query_over_all_documents(spark):
    from parkops.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    data = [(r.doc_id, r.text) for r in read(spark, sf, "documents").collect()]
    assert Counter(map(tuple, QUERIES["op13_token_counts"](spark, sf).collect())) == brute(data, WORD, 2048)
