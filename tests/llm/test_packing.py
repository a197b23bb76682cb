import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from helpers import CLASHING, frame, gapless, words
from parkops.llm import packing
from parkops.llm.queries import tokenizer
from tokenizers import Tokenizer

EXACT = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
ODD = [None, "", " ", "\n\n  x", "it's  we'll ok \x85 \x1c y", "<|endoftext|> a <|endoftext|>", "émü 日本語 😀 ​", "a" * 3000, "12345 678.9 ... !!",
       "x" * 60_000 + " y", "word " * 30_000, "tab\tand \r\n line   ends   "]


def ids(text):
    return [*EXACT.encode(text or "", add_special_tokens=False).ids, 2]


def check(rows, texts):
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id].append(r)
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        want = np.array(ids(text), "<u4")
        at = 0
        for n, r in enumerate(sorted(got[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (n, at) and 0 < r.length <= 1024 and (n == 0 or r.length == 1024)
            part = want[at:at + r.length].tobytes()
            assert bytes(r.ids) == part and r.ids_crc32 == zlib.crc32(part)
            at += r.length
        assert at == len(want)
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    assert all(gapless(p) and sum(n for _, n in p) <= 1024 for p in places.values())
    return len(places)


def test_pieces_and_sequences(spark):
    rng = random.Random(5)
    texts = dict(enumerate(ODD + [" ".join(words(rng, rng.randrange(1, 300))) for _ in range(300)]))
    data = [(i, t, None, None) for i, t in texts.items()]
    out = packing.pack(frame(spark, data, CLASHING), **tokenizer(), group_items=100).collect()
    sequences = check(out, texts)
    assert sequences <= 1.05 * sum(len(ids(t)) for t in texts.values()) / 1024 + 4


def test_sum_of_squares_rule():
    """Against a plain version that tries every open bin."""
    rng = random.Random(6)
    lengths = sorted((rng.randrange(1, 64) for _ in range(300)), reverse=True)
    where, offset, bins = packing.sum_of_squares(np.array(lengths), 64)
    gaps = {}
    for s, b, o in zip(lengths, where.tolist(), offset.tolist()):
        count = defaultdict(int)
        for g in gaps.values():
            count[g] += 1

        def after(g):
            c = dict(count)
            c[g] -= 1
            if g - s:
                c[g - s] = c.get(g - s, 0) + 1
            return sum(n * n for g, n in c.items() if g)

        fits = [g for g in count if g >= s and count[g] > 0]
        if fits:
            best = min(fits, key=lambda g: (after(g), g))
            assert gaps[b] == best == 64 - o
        else:
            assert b not in gaps and o == 0
        gaps[b] = 64 - o - s
    assert bins == len(gaps) and min(gaps.values()) >= 0


@pytest.mark.parametrize("data", [[], [(None, None, None, None)], [(1, "a", None, None), (1, "a", None, None)]])
def test_small_tables(spark, data):
    out = packing.pack(frame(spark, data), **tokenizer()).collect()
    assert len(out) == len(data)
    assert len({(r.sequence_id, r.offset) for r in out}) == len(data)
