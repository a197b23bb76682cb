import random
import zlib

import pytest
from helpers import CLASHING, frame, words
from parkops.llm import sharding


def rows():
    rng = random.Random(1)
    out = [(i, " ".join(words(rng, rng.randrange(1, 60))), "en", "a") for i in range(400)]
    out += [(400 + i, "the same text", "en", "a") for i in range(200)]          # a hot group
    out += [(None, None, None, None), (700, "", "en", "b"), (701, "é" * 3000, "en", "b"), (1, out[1][1], "en", "a")]
    return out


def test_shards_are_contiguous_balanced_and_gapless(spark):
    data = rows()
    got = sharding.shard(frame(spark, data, CLASHING)).collect()
    assert len(got) == len(data)
    want = sorted((-1 if i is None else i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in data)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.text_crc32) for r in got) == want
    total, longest = sum(r.size for r in got), max(r.size for r in got)
    for s in range(8):
        mine = [r for r in got if r.shard == s]
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
        assert abs(sum(r.size for r in mine) - total / 8) <= longest
    # equal texts stay together, but for groups at one of the seven cuts
    split = [t for t in {r.text_crc32 for r in got} if len({r.shard for r in got if r.text_crc32 == t}) > 1]
    assert len(split) <= 7


def test_empty_and_single(spark):
    assert sharding.shard(frame(spark, [])).count() == 0
    one = sharding.shard(frame(spark, [(5, None, None, None)])).collect()
    assert [(r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in one] == [(5, 1, 0, 0, 0)]


@pytest.mark.parametrize("shards", [1, 8])
def test_written_shards_hold_the_same_rows(spark, tmp_path, shards):
    data = rows()
    df = frame(spark, data, ["size"])
    sharding.write_shards(df, str(tmp_path / "out"), shards)
    back = spark.read.parquet(str(tmp_path / "out"))
    want = {(r.doc_id, r.text_crc32): r.shard for r in sharding.shard(df, shards).collect()}
    got = back.select("row.doc_id", "row.text", "shard").collect()
    assert len(got) == len(data)
    for r in got:
        assert want[r.doc_id, zlib.crc32((r.text or "").encode())] == r.shard or r.text == "the same text"
