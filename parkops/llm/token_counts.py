"""Token counts by a map-side two-tier look-up, without a shuffle of pre-tokens.

A tokenizer that drops white space never joins letters across it, so a text's
count is the sum over its pre-tokens: what lies between blanks.  Tier one is
a compact table of frequent pre-tokens with their lengths in tokens, which is
broadcast; it is found by one pass over all texts, in which every task keeps
a summary of bounded size.  Tier two is a cache in every Python worker: what
neither knows is given to the tokenizer itself, all misses of a batch at once.

Both tiers only save calls of the tokenizer; the counts never depend on them.
"""

from __future__ import annotations

import json
import os
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Longer pre-tokens are neither summarised nor cached (a text without blanks is one).
LONGEST_KEY = 48
#: Entries of each of a worker's two caches (used lately, and before): at most 30 MB or so.
CACHE_ENTRIES = 200_000
#: Summaries that one task, or the driver, merges at a time.
FAN_IN = 32

_WORKERS: dict[str, "Encoder"] = {}


def cuts_at_blanks(spec: dict) -> bool:
    """Whether the counts of the tokenizer ``spec`` (its JSON) add up over stretches between blanks.

    True if it normalises by NFC, by lower-casing and by making white space one
    space only (none of these looks across a blank), and splits into the matches
    of a pattern, of which none holds white space, before anything else.  Special
    tokens must hold no blank and take none from beside them."""
    steps = spec.get("normalizer") or {"type": "Sequence", "normalizers": []}
    steps = steps["normalizers"] if steps["type"] == "Sequence" else [steps]
    plain = all(s["type"] in ("NFC", "Lowercase") or s == {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "} for s in steps)
    first = spec.get("pre_tokenizer") or {}
    first = first["pretokenizers"][0] if first.get("type") == "Sequence" else first
    words = (first.get("type") == "Split" and first.get("invert") is True and first.get("behavior") == "Removed"
             and first["pattern"].get("Regex") in (r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",))
    tokens = all(len(t["content"].split()) == 1 and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in spec["added_tokens"])
    return plain and words and tokens and not spec.get("post_processor")


class Encoder:
    """Lengths in tokens by the tokenizer file ``json_path``, with a cache of short pre-tokens."""

    def __init__(self, json_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"   # Spark's tasks fill the cores
        from tokenizers import Tokenizer
        with open(json_path, encoding="utf-8") as file:
            text = file.read()
        self.cuts = cuts_at_blanks(json.loads(text))
        self.tokenizer = Tokenizer.from_str(text)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.lately: dict[bytes, int] = {}
        self.before: dict[bytes, int] = {}

    def lengths(self, parts: Iterable[bytes]) -> list[int]:
        texts = [p.decode("utf-8", "replace") for p in parts]
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def resolve(self, missing: set[bytes]) -> dict[bytes, int]:
        """Lengths of all of ``missing``, from the caches or else from the tokenizer."""
        known = {p: n for p in missing if (n := self.lately.get(p) or self.before.get(p))}
        new = [p for p in missing if p not in known]
        for at in range(0, len(new), 100_000):   # a bounded number of encodings at a time
            some = new[at:at + 100_000]
            known.update(zip(some, self.lengths(some)))
        for p, n in known.items():
            if len(p) <= LONGEST_KEY:
                if len(self.lately) >= CACHE_ENTRIES:
                    self.lately, self.before = {}, self.lately
                self.lately[p] = n
        return known


def _encoder(json_path: str) -> Encoder:
    if json_path not in _WORKERS:
        _WORKERS[json_path] = Encoder(json_path)
    return _WORKERS[json_path]


def reduce_summary(counts: Counter, keep: int) -> Counter:
    """At most ``keep`` entries: the next largest count is taken off all (Misra and Gries), so that an
    entry's count falls short by less than its task's rows / ``keep`` in all."""
    if len(counts) <= keep:
        return counts
    ranked = counts.most_common(keep + 1)
    off = ranked[-1][1]
    return Counter({p: n - off for p, n in ranked[:-1] if n > off})


def _summaries(keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).cast(pa.large_binary()):
                counts.update(p for p in (text.as_py() or b"").split() if len(p) <= LONGEST_KEY)
                if len(counts) > 8 * keep:
                    counts = reduce_summary(counts, keep)
        counts = reduce_summary(counts, keep)
        yield pa.RecordBatch.from_pydict({"parts": pa.array([list(counts)], pa.list_(pa.binary())),
                                          "counts": pa.array([list(counts.values())], pa.list_(pa.int64()))})
    return run


def _merged(rows: Iterable, keep: int) -> Counter:
    total: Counter = Counter()
    for parts, counts in rows:
        for p, n in zip(parts, counts):
            total[bytes(p)] += int(n)
        total = reduce_summary(total, keep)
    return total


def frequent_parts(df: DataFrame, text: str, keep: int) -> list[bytes]:
    """The ``keep`` or fewer most frequent pre-tokens of all texts, most frequent first.

    Every task sums up its own texts in at most ``keep`` entries; summaries (one
    row a task, not pre-tokens) are merged 32 at a time, the last 32 by the driver."""
    schema = "parts array<binary>, counts array<long>"
    level = materialize(df.select(text).mapInArrow(_summaries(keep), schema), "summaries")
    while (n := level.count()) > FAN_IN:
        def merge(group: pd.DataFrame) -> pd.DataFrame:
            total = _merged(zip(group.parts, group.counts), keep)
            return pd.DataFrame({"parts": [list(total)], "counts": [list(total.values())]})
        groups = -(-n // FAN_IN)
        dealt = level.withColumn("g", F.pmod(F.xxhash64("parts"), F.lit(groups)))
        level = materialize(dealt.groupBy("g").applyInPandas(merge, schema), "summaries")
    total = _merged(((r.parts, r.counts) for r in level.collect()), keep)
    return [p for p, _ in sorted(total.items(), key=lambda e: (-e[1], e[0]))]


def _counts(json_path: str, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, table = _encoder(json_path), shared.value
        for batch in batches:
            sizes, totals, open_rows, missing = [], [], [], set()
            for i, text in enumerate(batch.column(1).cast(pa.large_binary())):
                raw = text.as_py() or b""
                parts = raw.split() if encoder.cuts else [raw]
                got = list(map(table.get, parts))
                unknown = [p for p, n in zip(parts, got) if n is None] if None in got else []
                sizes.append(len(raw))
                totals.append(sum(n for n in got if n is not None) if unknown else sum(got))
                if unknown:
                    open_rows.append((i, unknown))
                    missing.update(unknown)
            known = encoder.resolve(missing) if missing else {}
            for i, unknown in open_rows:
                totals[i] += sum(map(known.__getitem__, unknown))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(totals, pa.int64())],
                                             names=["doc_id", "n_bytes", "n_tokens"])
    return run


def count_tokens(df: DataFrame, json_path: str, limit: int = 2048, doc_id: str = "doc_id", text: str = "text",
                 table_entries: int = 16384) -> DataFrame:
    """Per row: ``doc_id, n_bytes, n_tokens, over_limit``.

    ``n_bytes`` is the text's UTF-8 length, ``n_tokens`` what the tokenizer file
    ``json_path`` gives for the whole text without added begin, end or padding;
    strings of special tokens inside texts count as the library reads them (one
    token).  A tokenizer whose counts don't add up over stretches between blanks
    gets every text whole.  Null text: 0 and 0; null and repeated ids are ordinary
    rows; empty table: no rows; other columns are ignored, whatever their names.
    The broadcast table has at most ``table_entries`` entries of 48 bytes."""
    light = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    encoder = _encoder(json_path)
    frequent = frequent_parts(light, "text", table_entries) if encoder.cuts else []
    shared = df.sparkSession.sparkContext.broadcast(dict(zip(frequent, encoder.lengths(frequent))))
    schema = f"doc_id {light.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long"
    return light.mapInArrow(_counts(json_path, shared), schema).withColumn("over_limit", F.col("n_tokens") > limit)
