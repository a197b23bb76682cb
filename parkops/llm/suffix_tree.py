"""Language-model scores from a probabilistic suffix tree over words.

A state is a context of one or more words.  A context is a candidate if it occurs
at least ``least_context`` times in the training texts, and is retained if its
next-word distribution diverges from that of its suffix by at least
``divergence`` nats a token.  Distributions are smoothed by absolute discounting
towards the suffix's, down to the root (the smoothed unigrams).  A token is
scored in the longest retained suffix of its history; a context that is not
retained only smooths longer ones.  Depth has no limit: contexts of two words are
tried below every candidate, longer ones below those that were retained, until a
level retains none.

All thresholds are counts, so they act alike at every size, and all that is
learned grows with the corpus and is distributed; nothing but totals reaches the
driver.  Texts lie in chunks of about ``_CHUNK`` tokens.  A chunk sends its distinct
keys with its own counts, dealt by ranges of the key (so a key is sent once a
chunk, however frequent it is), and gets what all chunks together say of them:

1. words: how often each occurs;
2. per depth, contexts with their next words, how often each follows and its
   probability in the suffix.  Dealt by context, so that one task has all of a
   context: it gives the counts, the weight of the suffix, and whether the
   context diverges from its suffix and is retained.

A depth that many tokens reach, with a long state each, deals its ranges in several rounds,
so that their messages don't lie beside the states all at once.

Chunks and their states are tables bucketed by chunk: they meet each other, and what
comes back, without being shuffled again.  Words and contexts are known by 64-bit
hashes; from step 1 on words go by the numbers that it gives, small ones for frequent
words, which take fewer bytes, and contexts by the numbers of their words.
"""

from __future__ import annotations

import gc
import pickle
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_dir
from .common import materialize, union_all
from .shingles import _GOLDEN, _words, mix

_END = 0x454E44          # stands for the end of a text
_CHUNK = 2_000_000       # tokens of a chunk (a longer text is a chunk)
_BUCKET = 2_000_000      # tokens a range of keys
_ROUNDS = 4              # a round deals about one of so many parts of all tokens
_DISCOUNT = 0.75
_QUARTER = 0.25          # the discount is a whole number of these
_SMOOTH = 0.1


def _hashes(text: str | None) -> np.ndarray:
    """Word hashes of a whole text (bytes lower-case A-Z and split at ASCII blanks only)."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(_words.__getitem__, found), np.uint64, len(found)).view(np.int64)


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct items, a place where each lies, and the place of each item of ``x`` among them (``np.unique`` would
    sort stably to give the first places, which takes twice as long)."""
    order = np.argsort(x)
    x = x[order]
    new = np.append(True, x[1:] != x[:-1])[:len(x)]
    place = np.empty(len(x), np.int64)
    place[order] = np.cumsum(new) - 1
    return x[new], order[new], place


def _steps(x: np.ndarray) -> np.ndarray:
    """Differences of whole numbers, twice their size and odd if negative: small ones of either sign are small numbers."""
    step = np.diff(x, prepend=x.dtype.type(0))
    return (step << 1) ^ (step >> (8 * step.itemsize - 1))


def _sums(x: np.ndarray) -> np.ndarray:
    """What ``_steps`` was given."""
    return np.cumsum((x >> 1) ^ -(x & 1), dtype=x.dtype)


def _pack(**arrays: np.ndarray) -> bytes:
    """Arrays as bytes; equal bytes of the items lie together, which compresses well."""
    raw = pickle.dumps({k: (a.dtype.str, np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())
                        for k, a in arrays.items()})
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(blob: bytes) -> dict[str, np.ndarray]:
    raw = pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    return {k: np.frombuffer(b, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()
            for k, (kind, b) in pickle.loads(raw).items()}


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts in chunks: words by their place among the chunk's distinct ones."""
    ids, held, parts, size = [], [], [], 0

    def chunk() -> pa.RecordBatch:
        flags = pa.concat_arrays(held)
        sizes, out = np.array([len(p) for p in parts], np.int32), np.array(flags.to_pylist(), bool)
        words, _, codes = _distinct(np.concatenate(parts))
        blob = _pack(words=np.diff(words, prepend=np.uint64(0)), codes=codes.astype(np.int32), sizes=sizes, held=out)
        row = pa.array([0, len(sizes)], pa.int32())
        return pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(row, pa.concat_arrays(ids)), pa.ListArray.from_arrays(row, flags),
             pa.array([int(sizes.sum())], pa.int64()), pa.array([int(sizes[~out].sum())], pa.int64()), pa.array([blob], pa.binary())],
            names=["doc_id", "held_out", "size", "train", "blob"])

    for batch in batches:
        first = 0
        texts = batch.column("text")
        for i in range(batch.num_rows):
            parts.append(np.append(_hashes(texts[i].as_py()), _END).view(np.uint64))
            size += len(parts[-1])
            if size >= _CHUNK or i == batch.num_rows - 1:
                ids.append(batch.column("doc_id").slice(first, i + 1 - first))
                held.append(batch.column("held_out").slice(first, i + 1 - first))
                first = i + 1
            if size >= _CHUNK:
                yield chunk()
                ids, held, parts, size = [], [], [], 0
    if parts:
        yield chunk()


def _base(c: dict, seen: np.ndarray) -> np.ndarray:
    """Probability in the root of words that occur so often."""
    return ((seen + _SMOOTH) / c["mass"]).astype(np.float32)


def _live(s: dict, c: dict) -> dict:
    """The tokens whose context of ``depth`` words is a candidate: places, context's
    count, probability in the suffix and in the longest retained one, and whether
    the suffix's next word was kept (else this one's can't be)."""
    if c["depth"] > 1:
        pos = np.cumsum(s["pos"], dtype=np.int64)
        return {"pos": pos, "tot": s["tot"], "may": s["may"], "p": s["p"], "best": np.where(s["own"], s["p"], _base(c, s["seen"][s["codes"][pos]]))}
    codes, seen = s["codes"], s["seen"]
    begins = np.zeros(len(codes), bool)
    begins[np.cumsum(s["sizes"]) - s["sizes"]] = True
    pos = np.flatnonzero(~begins & (seen[np.roll(codes, 1)] >= max(c["least_context"], c["least_word"])))
    p = _base(c, seen[codes[pos]])
    return {"pos": pos, "tot": seen[codes[pos - 1]], "may": seen[codes[pos]] >= c["least_next"], "p": p, "best": p}


def _keys(words: list[np.ndarray]) -> np.ndarray:
    """Hashes of contexts from their words' hashes, the last word first."""
    key = words[-1]
    for word in words[-2::-1]:
        key = mix(key * _GOLDEN + word)
    return key


def _contexts(s: dict, c: dict, pos: np.ndarray, key: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Distinct contexts by range, then by their words from the last one on: those words' places among the
    chunk's, where each range begins, and the place of each token's context."""
    if c["depth"] > 1:
        keys, one, ctx = _distinct(key)
        own = [s["codes"][pos[one] - i] for i in range(1, c["depth"] + 1)]
    else:
        last = s["codes"][pos - 1]
        there = np.zeros(len(s["words"]), bool)
        there[last] = True
        own, ctx = [np.flatnonzero(there)], (np.cumsum(there) - 1)[last]
        keys = s["words"][own[0]]
    bucket = _range_of(keys, c["buckets"])
    order = np.lexsort((*own[::-1], bucket))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return [x[order] for x in own], np.searchsorted(bucket[order], np.arange(c["buckets"] + 1)), place[ctx]


def _numbered(text: bytes, state: bytes) -> dict:
    """A chunk whose words have numbers (and lie by their counts), with its state."""
    s = _unpack(text) | _unpack(state)
    s["number"], s["seen"] = _sums(s["number"]), _sums(s["seen"])
    return s | {"words": _hash(s["number"])}


def _hash(number: np.ndarray) -> np.ndarray:
    return mix((number + 1).view(np.uint64) * _GOLDEN)


def _pairs(s: dict, c: dict, t: dict, of: range | None = None) -> dict:
    """Distinct contexts (``own``, their words' places; ``edges``, where ranges begin; ``tot``; ``kinds`` of next words that
    can be kept) and their next words (``word``, a place among the chunk's; ``p``), by context and count; ``ctx`` and ``pair`` are
    the places of each live token and of each that can be kept, ``n`` the training tokens among the latter.  ``of``: of these ranges only."""
    key = _keys([s["words"][s["codes"][t["pos"] - i]] for i in range(1, c["depth"] + 1)])
    if of is not None and len(of) < c["buckets"]:
        bucket = _range_of(key, c["buckets"])
        mine = (bucket >= of.start) & (bucket < of.stop)
        key, t = key[mine], {k: v[mine] for k, v in t.items()}
    own, edges, ctx = _contexts(s, c, t["pos"], key)
    may, pos = t["may"], t["pos"][t["may"]]
    # a pair of numbers in one: the context's place, and the next word's among the chunk's words
    both, one, pair = _distinct(ctx[may] * len(s["words"]) + s["codes"][pos])
    tot = np.zeros(len(own[0]), np.int64)
    tot[ctx] = t["tot"]
    train = np.repeat(~s["held"], s["sizes"])[pos]
    return {"own": own, "edges": edges, "tot": tot, "kinds": np.bincount(both // len(s["words"]), minlength=len(tot)),
            "word": both % len(s["words"]), "p": t["p"][may][one], "ctx": ctx, "pair": pair,
            "n": np.bincount(pair, weights=train, minlength=len(both)).astype(np.int64)}


def _range_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _sent(chunk: int, parts: list[tuple[int, bytes]]) -> pd.DataFrame:
    return pd.DataFrame({"chunk": chunk, "bucket": [b for b, _ in parts], "blob": [x for _, x in parts]})


def _send_words(c: dict) -> Callable:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        s = _unpack(rows.text.iloc[0])
        n = np.bincount(s["codes"][np.repeat(~s["held"], s["sizes"])], minlength=len(s["words"]))
        words = np.cumsum(s["words"], dtype=np.uint64)
        edges = np.searchsorted(_range_of(words, c["buckets"]), np.arange(c["buckets"] + 1))
        return _sent(rows.chunk.iloc[0], [(b, _pack(keys=np.diff(words[i:j], prepend=np.uint64(0)), n=n[i:j]))
                                          for b, (i, j) in enumerate(zip(edges[:-1], edges[1:])) if j > i])
    return run


def _send(c: dict, of: range | None = None) -> Callable:
    """A chunk's contexts and next words, dealt by ranges of the context (``of``: these ranges only).  Contexts and next words lie by
    their words' counts, so steps are small; of the first depth each next word is sent once, with its count, which tells the probability in the root."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        if not rows.live.iloc[0]:
            return _sent(rows.chunk.iloc[0], [])
        s = _numbered(rows.text.iloc[0], rows.state.iloc[0])
        m = _pairs(s, c, _live(s, c), of)
        edges, at, out = m["edges"], np.concatenate([[0], np.cumsum(m["kinds"])]), []
        for b, (i, j) in enumerate(zip(edges[:-1], edges[1:])):
            if j > i:
                own = slice(at[i], at[j])
                if c["depth"] > 1:
                    follow = {"next": _steps(s["number"][m["word"][own]]), "p": m["p"][own]}
                else:
                    words, place = np.unique(m["word"][own], return_inverse=True)
                    follow = {"words": _steps(s["number"][words]), "seen": _steps(s["seen"][words]), "place": _steps(place.astype(np.int32))}
                out.append((b, _pack(**{f"own{k}": _steps(s["number"][x[i:j]]) for k, x in enumerate(m["own"])},
                                     tot=_steps(m["tot"][i:j]) if c["depth"] == 1 else m["tot"][i:j].astype(np.int32),
                                     kinds=m["kinds"][i:j].astype(np.int32), n=m["n"][own].astype(np.int32), **follow)))
        return _sent(rows.chunk.iloc[0], out)
    return run


def _returned(rows: pd.DataFrame, blobs: list[bytes], kinds: int = 0) -> pd.DataFrame:
    return pd.DataFrame({"chunk": rows.chunk.to_numpy(), "bucket": rows.bucket.to_numpy(), "blob": blobs, "kinds": [kinds] + [0] * (len(blobs) - 1)})


def _total_words(c: dict) -> Callable:
    """Counts over all chunks of one range of words, and a number for each word, for each chunk in its order."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [_unpack(b) for b in rows.blob]
        _, _, at = _distinct(np.concatenate([np.cumsum(p["keys"], dtype=np.uint64) for p in parts]))
        n = np.bincount(at, weights=np.concatenate([p["n"] for p in parts])).astype(np.int64)
        rank = np.empty(len(n), np.int64)   # frequent words first
        rank[np.argsort(-n, kind="stable")] = np.arange(len(n))
        ends = np.cumsum([len(p["n"]) for p in parts])
        return _returned(rows, [_pack(n=n[x], rank=rank[x]) for x in np.split(at, ends[:-1])], int((n > 0).sum()))
    return run


def _total(c: dict) -> Callable:
    """What all chunks together say of one range of contexts: counts of the next words, weight
    of the suffix, and whether the context is retained; for each chunk in its order."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [_unpack(b) for b in rows.blob]
        for p in parts:
            p["keys"] = _keys([_hash(_sums(p.pop(f"own{k}"))) for k in range(c["depth"])])
            if c["depth"] > 1:
                p["next"] = _sums(p["next"])
            else:
                place, p["tot"] = _sums(p.pop("place")), _sums(p["tot"])
                p["next"], p["p"] = _sums(p.pop("words"))[place], _base(c, _sums(p.pop("seen")))[place]
        sizes = [(len(p["tot"]), len(p["n"])) for p in parts]
        every = lambda name: np.concatenate([p.pop(name) for p in parts])  # noqa: E731  (held once)
        keys, one, ctx = _distinct(every("keys"))
        tot = every("tot")[one].astype(np.float64)
        of = np.repeat(ctx, every("kinds"))   # each pair's context
        _, lead, pair = _distinct(mix(keys[of] * _GOLDEN + every("next").view(np.uint64)))
        n = np.bincount(pair, weights=every("n"), minlength=len(lead))
        kept = n >= c["least_next"]
        of, p, m = of[lead][kept], every("p")[lead][kept].astype(np.float64), n[kept]
        taken = np.bincount(of, weights=m, minlength=len(keys))
        left = tot - taken + _DISCOUNT * np.bincount(of, minlength=len(keys))   # a whole number of quarters
        rest = left / tot
        ratio = np.log(((m - _DISCOUNT) / tot[of] + rest[of] * p) / p)
        gain = np.bincount(of, weights=m * ratio, minlength=len(keys)) + (tot - taken) * np.log(np.maximum(rest, 1e-300))
        stays = gain / tot >= c["divergence"]
        n, left = n.astype(np.int32), (left / _QUARTER).astype(np.int64)
        contexts, pairs = (np.split(x, np.cumsum(own)[:-1]) for x, own in zip((ctx, pair), zip(*sizes)))
        return _returned(rows, [_pack(n=n[x], left=left[y], stays=stays[y]) for x, y in zip(pairs, contexts)])
    return run


def _by_text(s: dict, pos: np.ndarray, values: np.ndarray) -> np.ndarray:
    text = np.searchsorted(np.cumsum(s["sizes"]), pos, side="right")
    return np.bincount(text, weights=values, minlength=len(s["sizes"]))


def _state(chunk: int, s: dict, live: int, retained: int) -> pd.DataFrame:
    kept = ("sizes", "base", "known", "tree", "last", "pos", "tot", "may", "p", "own")
    return pd.DataFrame({"chunk": [chunk], "state": [_pack(**{k: s[k] for k in kept if k in s})], "live": [live], "retained": [retained]})


def _got(totals: pd.DataFrame) -> dict:
    totals = totals.sort_values("bucket")
    parts = [_unpack(b) for b in totals.blob]
    parts = [p | {"bucket": np.full(len(p["n"]), b)} for p, b in zip(parts, totals.bucket)]
    return {k: np.concatenate([p[k] for p in parts]) for k in (parts[0] if parts else ())}


def _take_words(c: dict) -> Callable:
    """A chunk with numbers instead of its words' hashes, frequent words first, and its first state: the base
    scores, and the tokens that follow a candidate."""
    def run(rows: pd.DataFrame, totals: pd.DataFrame) -> pd.DataFrame:
        s = _unpack(rows.text.iloc[0])
        got = _got(totals)
        number = got["rank"] * c["buckets"] + got["bucket"]   # no two ranges share one
        order = np.lexsort((number, -got["n"]))
        code = np.empty(len(order), np.int32)
        code[order] = np.arange(len(order), dtype=np.int32)
        s["codes"], s["seen"] = code[s["codes"]], got["n"][order]
        text = _pack(number=_steps(number[order]), seen=_steps(s["seen"]), codes=s["codes"], held=s["held"])
        every = np.arange(len(s["codes"]))
        base = np.log10((s["seen"] + _SMOOTH) / c["mass"])[s["codes"]]
        s["base"] = _by_text(s, every, base)
        s["known"] = _by_text(s, every, s["seen"][s["codes"]] > 0).astype(np.int64)
        pos = _live(s, c | {"depth": 1})["pos"]
        s["last"] = _by_text(s, pos, base[pos])
        s["tree"] = s["base"] - s["last"]
        return _state(rows.chunk.iloc[0], s, len(pos), 0).assign(text=text)
    return run


def _take(c: dict) -> Callable:
    """A chunk's next state: tokens that stay ``live``, and how many had a context that was retained."""
    def run(rows: pd.DataFrame, totals: pd.DataFrame) -> pd.DataFrame:
        if not rows.live.iloc[0]:   # ``last`` is 0
            return _state(rows.chunk.iloc[0], _unpack(rows.state.iloc[0]), 0, 0)
        s = _numbered(rows.text.iloc[0], rows.state.iloc[0])
        t = _live(s, c)
        pos, got = t["pos"], _got(totals)
        if not len(pos):
            return _state(rows.chunk.iloc[0], s, 0, 0)
        m = _pairs(s, c, t)
        n = np.zeros(len(pos), np.int64)
        n[t["may"]] = got["n"][m["pair"]]
        own = np.where(n >= c["least_next"], (n - _DISCOUNT) / t["tot"], 0.0)
        rest = (got["left"] * _QUARTER / m["tot"]).astype(np.float32)
        p = own + rest.astype(np.float64)[m["ctx"]] * t["p"]
        stays = got["stays"][m["ctx"]]
        best = np.where(stays, p, t["best"])
        before = np.zeros(len(s["codes"]), np.int64)   # a longer context's count: its last word is the token before
        before[pos] = n
        since = pos - np.repeat(np.cumsum(s["sizes"]) - s["sizes"], s["sizes"])[pos]
        on = ((since > c["depth"]) & (before[pos - 1] >= c["least_context"])
              & (s["seen"][s["codes"][pos - 1]] >= c["least_word"]) & (stays | (c["depth"] == 1)))
        s["tree"] = s["tree"] + _by_text(s, pos[~on], np.log10(best[~on]))
        s |= {"pos": np.diff(pos[on], prepend=0).astype(np.int32), "tot": before[pos[on] - 1].astype(np.int32),
              "may": n[on] >= c["least_next"], "p": p[on].astype(np.float32), "own": stays[on],
              "last": _by_text(s, pos[on], np.log10(best[on].astype(np.float32).astype(np.float64)))}
        return _state(rows.chunk.iloc[0], s, int(on.sum()), int(stays.sum()))
    return run


def _finish(c: dict) -> Callable:
    """A chunk's texts' figures, with the tokens that were live to the end (``last``)."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        s = _unpack(rows.state.iloc[0])
        return pd.DataFrame([(rows.chunk.iloc[0], s["sizes"].astype(np.int64), s["known"], s["base"], s["tree"] + (s["last"] if "pos" in s else 0))],
                            columns=["chunk", "n_tokens", "n_known", "base_score", "score"])
    return run


def _delete(df: DataFrame) -> None:
    """Delete a written intermediate that nothing reads any more."""
    sc = df.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path(folder).getFileSystem(sc._jsc.hadoopConfiguration()).delete(path(folder), True)


class _Tables:
    """Tables bucketed by chunk, in the checkpoint folder; a table that is no longer read is dropped."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.buckets, self.paths = spark, int(spark.conf.get("spark.sql.shuffle.partitions")), {}

    def write(self, df: DataFrame) -> DataFrame:
        name = f"suffix_tree_{uuid.uuid4().hex}"
        self.paths[name] = scratch_dir(self.spark, name)
        df.write.bucketBy(self.buckets, "chunk").option("path", self.paths[name]).saveAsTable(name)
        return self.spark.table(name)

    def drop(self, keep: int = 0) -> None:
        """Drop all but the newest ``keep``; shuffle files go when the driver collects its garbage."""
        sc = self.spark.sparkContext
        names = list(self.paths)
        for name in names[:len(names) - keep]:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            at = sc._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
        gc.collect()
        sc._jvm.System.gc()


def score(df: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text", least_word: float = 2,
          least_context: float = 10, least_next: float = 2, divergence: float = 0.01) -> DataFrame:
    """Per input row: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    The tree is learned from rows that are not ``held_out`` and scores all rows.
    ``base_score`` is the smoothed unigram score, ``score`` the tree's log10
    probability of the text (its words and the end).  ``least_word`` (of a word in a
    context), ``least_context`` and ``least_next`` (of a next word in a context, two
    or more) are counts; a value below 1 is a share of all training tokens.  Null
    text is an empty text (the end alone); a null ``held_out`` counts as false;
    without training rows every token is unknown; repeated rows are texts of their
    own; empty table: no rows; other columns are ignored, whatever their names."""
    kind = df.schema[doc_id].dataType
    docs = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"),
                     F.col(text).alias("text"))
    row = T.StructType([T.StructField("doc_id", T.ArrayType(kind)), T.StructField("held_out", T.ArrayType(T.BooleanType())),
                        T.StructField("size", T.LongType()), T.StructField("train", T.LongType()), T.StructField("blob", T.BinaryType())])
    tables, kept = _Tables(df.sparkSession), _Tables(df.sparkSession)
    chunks = docs.mapInArrow(_chunks, row).withColumn("chunk", F.monotonically_increasing_id())
    texts = tables.write(chunks.withColumnRenamed("blob", "text"))
    ids = kept.write(texts.select("chunk", "doc_id", "held_out"))
    sizes = texts.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.coalesce(F.sum("train"), F.lit(0)).alias("train")).first()
    tokens = sizes["train"]
    count = lambda x: x if x >= 1 else x * tokens
    c = {"buckets": sizes["size"] // _BUCKET + 1, "least_word": count(least_word), "least_context": max(1, count(least_context)),
         "least_next": max(2, count(least_next)), "divergence": divergence}
    sent, back, held = "chunk long, bucket int, blob binary", "chunk long, bucket int, blob binary, kinds long", \
        "chunk long, state binary, live long, retained long"

    hashed = texts.select("chunk", "text")
    words = materialize(hashed.groupBy("chunk").applyInPandas(_send_words(c), sent).groupBy("bucket").applyInPandas(_total_words(c), back), "words")
    tables.drop(1)
    kinds = words.agg(F.coalesce(F.sum("kinds"), F.lit(0))).first()[0]
    c["mass"] = tokens + _SMOOTH * (kinds + 1)
    state = kept.write(hashed.groupBy("chunk").cogroup(words.groupBy("chunk")).applyInPandas(_take_words(c), held + ", text binary"))
    bodies = state.select("chunk", "text")
    _delete(words)
    tables.drop()
    left = state.agg(F.sum("live")).first()[0]
    c["depth"] = 1
    while left:
        rows = bodies.join(state.select("chunk", "state", "live"), "chunk")
        rounds = 1 if c["depth"] == 1 else int(min(1 + _ROUNDS * left // sizes["size"], c["buckets"]))   # first states are small
        parts = []
        for i in range(rounds):
            of = range(i * c["buckets"] // rounds, (i + 1) * c["buckets"] // rounds)
            parts.append(materialize(rows.groupBy("chunk").applyInPandas(_send(c, of), sent).groupBy("bucket").applyInPandas(_total(c), back), "contexts"))
            tables.drop(1)
        found = union_all(*parts)
        state = tables.write(rows.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInPandas(_take(c), held))
        for part in parts:
            _delete(part)
        tables.drop(1)
        found = state.agg(F.sum("live").alias("live"), F.sum("retained").alias("retained")).first()
        left = found["live"] if found["retained"] else 0
        c["depth"] += 1
    scores = state.select("chunk", "state").groupBy("chunk").applyInPandas(
        _finish(c), "chunk long, n_tokens array<long>, n_known array<long>, base_score array<double>, score array<double>")
    each = ids.join(scores, "chunk").select(
        F.explode(F.arrays_zip("doc_id", "held_out", "n_tokens", "n_known", "base_score", "score")).alias("d"))
    out = materialize(each.select("d.doc_id", "d.held_out", "d.n_tokens", "d.n_known", F.lit(int(tokens)).cast("long").alias("train_tokens"),
                                  "d.base_score", "d.score"), "scores")
    tables.drop()
    kept.drop()
    return out
