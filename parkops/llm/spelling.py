"""Spelling variants: words one edit apart, by a frequency-vector trie.

A word's vector counts its letters by group.  One insertion adds one to one
count (a surplus), one deletion takes one (a deficit), one replacement does
both; so the words near a word lie within a budget of one surplus and one
deficit of its vector.

Cells are the vectors over four coarse groups; a word is sent to the cells that
a shorter word reaches by a surplus, or an equally long one by a surplus in an
earlier group and a deficit in a later one, so that each pair meets exactly
once.  In a cell a trie over the counts of single letters is searched depth
first, in blocks, and what the leaves hold is verified.  Big cells are dealt in
blocks of members and slices of probes; every block meets every slice.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from math import ceil, floor, log2, log10

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Letters from frequent to rare: neighbours in it go to different coarse groups, and the trie asks for them in this order.
BY_FREQUENCY = "etaoinshrdlcumwfgypbvkjxqz"
#: The letters beyond a to z that a word may hold, upper and lower.
_BEYOND = range(0xC0, 0x100)
COARSE = 4
#: Letters of each coarse group.
GROUPS = ["".join([*BY_FREQUENCY[g::COARSE], *(chr(c) for c in _BEYOND if c % COARSE == g)]) for g in range(COARSE)]
#: The trie's level of each letter: one a letter from a to z, four for the others.
_LEVELS = len(BY_FREQUENCY) + 4
_LEVEL_OF = np.zeros(256, np.int64)
for _i, _c in enumerate(BY_FREQUENCY):
    _LEVEL_OF[ord(_c)] = _i
for _c in _BEYOND:
    _LEVEL_OF[_c] = len(BY_FREQUENCY) + _c % 4

#: Latin-1 bytes: A to Z become lower case, other letters stay, the rest separates words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))

MEMBER, SAME, LONGER, OTHER = range(4)   # what a row does in a cell: be found, or probe for words of each kind


# ---------------------------------------------------------------------------
# Words and how often they occur
# ---------------------------------------------------------------------------
def spoilt(run: bytes, prefix: int, every: int) -> bytes:
    """The run without the letter that its crc32 names, if ``every`` divides that."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), prefix)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def _tally(least_length: int, every: int | None, entries: int = 300_000):
    def flush(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in counts], pa.string()),
                                           pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                runs = (text.as_py() or "").encode("latin-1", "replace").translate(_FOLD).split()
                own = Counter(r for r in runs if len(r) >= least_length)
                if every:
                    prefix = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                    for r, n in own.items():
                        w = spoilt(r, prefix, every)
                        if len(w) >= least_length:
                            counts[w] += n
                else:
                    counts.update(own)
                if len(counts) > entries:
                    yield flush(counts)
                    counts = Counter()
        yield flush(counts)
    return run


def count_words(df: DataFrame, least_length: int = 7, least_count: int = 2, spoil_every: int | None = None,
                doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, n``: maximal runs of the letters A-Z, a-z and U+00C0 to U+00FF of all whole
    texts, with A-Z lower-cased, that have ``least_length`` letters and occur ``least_count`` times or more.

    With ``spoil_every`` a run first loses one letter where that number divides the
    crc32 of ``<doc_id>:<run>`` (a planted misspelling; a null id counts as empty).
    Null text: no words.  Tasks count their own words before the shuffle."""
    light = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    own = light.mapInArrow(_tally(least_length, spoil_every), "word string, n long")
    return own.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# ---------------------------------------------------------------------------
# Words one edit apart
# ---------------------------------------------------------------------------
def one_edit(a: bytes, b: bytes) -> bool:
    """Whether ``b`` is ``a`` with exactly one letter replaced (same length) or inserted (one longer)."""
    i = 0
    for x, y in zip(a, b):
        if x != y:
            break
        i += 1
    else:
        return len(b) == len(a) + 1
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def letter_counts(words: list[bytes]) -> np.ndarray:
    """One row a word, one column a trie level."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), sizes)
    letters = np.frombuffer(b"".join(words), np.uint8)
    return np.bincount(owner * _LEVELS + _LEVEL_OF[letters], minlength=len(words) * _LEVELS).reshape(-1, _LEVELS)


class Trie:
    """Members arranged by root, then by the counts of one level after another.

    A level holds its nodes' keys in order: the parent's number times ``base``
    plus the count; a node's number is its key's place."""

    def __init__(self, roots: np.ndarray, counts: np.ndarray) -> None:
        self.base = int(counts.max(initial=0)) + 3
        self.roots = np.unique(roots)
        node = np.searchsorted(self.roots, roots)
        self.levels = []
        for column in counts.T:
            keys, node = np.unique(node * self.base + column + 1, return_inverse=True)
            self.levels.append(keys)
        self.order = np.argsort(node, kind="stable")   # members by leaf
        self.first = np.searchsorted(node[self.order], np.arange(len(self.levels[-1]) + 1))

    def search(self, roots: np.ndarray, counts: np.ndarray, deficits: np.ndarray, block: int = 16384) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs ``(probe, member)`` in the same root whose counts differ by at most one
        surplus and ``deficits`` (0 or 1) of the probe: depth first over blocks of probes,
        so that what is held at a time is bounded whatever the number of probes."""
        start = np.searchsorted(self.roots, roots)
        there = np.flatnonzero((start < len(self.roots)) & (self.roots[np.minimum(start, len(self.roots) - 1)] == roots))
        stack = [(0, p, start[p], np.ones(len(p), bool), deficits[p] > 0)
                 for p in (there[i:i + block] for i in range(0, len(there), block))]
        while stack:
            level, probe, node, surplus, deficit = stack.pop()
            if level == len(self.levels):
                sizes = self.first[node + 1] - self.first[node]
                place = np.repeat(self.first[node] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                yield np.repeat(probe, sizes), self.order[place]
                continue
            keys, found = self.levels[level], []
            at = node * self.base + counts[probe, level] + 1
            for step, may in ((0, None), (1, surplus), (-1, deficit)):
                row = np.arange(len(probe)) if may is None else np.flatnonzero(may)
                key = at[row] + step
                place = np.searchsorted(keys, key)
                hit = keys[np.minimum(place, len(keys) - 1)] == key
                row, place = row[hit], place[hit]
                found.append((probe[row], place, surplus[row] & (step != 1), deficit[row] & (step != -1)))
            frontier = [np.concatenate(x) for x in zip(*found)]
            for i in range(0, len(frontier[0]), 4 * block):
                stack.append((level + 1, *[x[i:i + 4 * block] for x in frontier]))


def _links(table: pa.Table) -> pa.Table:
    """Rows ``(root, role, word, n)`` of some cells to links in both directions."""
    words = [w.encode("latin-1") for w in table.column("word").to_pylist()]
    roots = table.column("root").combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
    role, n = table.column("role").to_numpy(), table.column("n").to_numpy()
    counts = letter_counts(words)
    members, probes = np.flatnonzero(role == MEMBER), np.flatnonzero(role != MEMBER)
    out: tuple[list, list, list] = ([], [], [])
    if len(members) and len(probes):
        trie = Trie(roots[members], counts[members])
        for p, m in trie.search(roots[probes], counts[probes], (role[probes] != LONGER).astype(np.int64)):
            for x, y in zip(probes[p].tolist(), members[m].tolist()):
                a, b = words[x], words[y]
                if (role[x] != SAME or a < b) and one_edit(a, b):
                    for u, v, k in ((a, b, y), (b, a, x)):
                        out[0].append(u.decode("latin-1"))
                        out[1].append(v.decode("latin-1"))
                        out[2].append(n[k])
    return pa.table({"word": pa.array(out[0], pa.string()), "near": pa.array(out[1], pa.string()), "near_n": pa.array(out[2], pa.int64())})


def _vector(word: Column) -> list[Column]:
    """Letters of each coarse group."""
    rest = [F.length(word) - F.length(F.translate(word, letters, "")) for letters in GROUPS[:-1]]
    return [*rest, F.length(word) - sum(rest, F.lit(0))]


def _cell(vector: list[Column]) -> Column:
    return F.concat_ws(",", *[c.cast("string") for c in vector])


def _targets(vector: list[Column]) -> Column:
    """Cells where a word probes, with the role."""
    step = lambda up, down=None: _cell([c + (1 if i == up else -1 if i == down else 0) for i, c in enumerate(vector)])
    at = lambda cell, role: F.struct(cell.alias("cell"), F.lit(role).alias("role"))
    found = [at(_cell(vector), SAME), *[at(step(i), LONGER) for i in range(COARSE)]]
    found += [F.when(vector[j] > 0, at(step(i, j), OTHER)) for j in range(COARSE) for i in range(j)]
    return F.array_compact(F.array(*found))


def links(words: DataFrame, block: int = 50_000, per_task: int = 100_000) -> DataFrame:
    """``word, near, near_n``: all pairs of words one edit apart, in both directions.

    ``words`` holds distinct ``word``s of letters as :func:`count_words` finds them and ``n``.
    Cells beyond ``block`` members are dealt in blocks, and their probes in slices of
    about as many; tasks get about ``per_task`` rows or one block and slice."""
    v = [F.col(f"v{i}") for i in range(COARSE)]
    placed = words.select("word", "n", *[c.alias(f"v{i}") for i, c in enumerate(_vector(F.col("word")))])
    cells = materialize(placed.groupBy(*v).agg(F.count(F.lit(1)).alias("members")), "cells")
    loads = cells.select("members", F.explode(_targets(v)).alias("t")).groupBy("t.cell").agg(F.sum("members").alias("probes"))
    sizes = cells.select(_cell(v).alias("cell"), "members").join(loads, "cell").select(
        "cell", "members", "probes", F.ceil(F.col("members") / block).alias("blocks"), F.ceil(F.col("probes") / block).alias("slices"))
    sizes = materialize(sizes, "cell-sizes")
    total = sizes.agg(F.sum(F.col("members") * F.col("slices") + F.col("probes") * F.col("blocks"))).first()[0] or 0
    rows = placed.select("word", "n", F.explode(F.concat(F.array(F.struct(_cell(v).alias("cell"), F.lit(MEMBER).alias("role"))), _targets(v))).alias("t"))
    rows = rows.select("word", "n", "t.*").join(sizes.drop("members", "probes"), "cell")
    own = lambda n: F.pmod(F.xxhash64("word"), F.col(n))
    member = F.col("role") == MEMBER
    meets = F.explode(F.when(member, F.sequence(F.lit(0), F.col("slices") - 1)).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("k", meets).select(
        "word", "n", "role", F.concat_ws("/", "cell", F.when(member, own("blocks")).otherwise(F.col("k")),
                                         F.when(member, F.col("k")).otherwise(own("slices"))).alias("root"))
    rows = rows.withColumn("grp", F.pmod(F.xxhash64("root"), F.lit(max(1, ceil(total / per_task)))))
    return rows.groupBy("grp").applyInArrow(_links, "word string, near string, near_n long")


# ---------------------------------------------------------------------------
# Forms and their roots
# ---------------------------------------------------------------------------
def roots(forms: DataFrame, steps: int) -> DataFrame:
    """``word, root``: the last word that is reached from a ``word`` by following ``form``s,
    at most ``steps`` of them; distances double with each join."""
    at = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(ceil(log2(steps)) if steps > 1 else 0):
        then = at.select(F.col("word").alias("root"), F.col("root").alias("_further"))
        at = materialize(at.join(then, "root", "left").select("word", F.coalesce("_further", "root").alias("root")), "roots")
    return at


def variants(words: DataFrame, times: int = 10) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for a table of distinct ``word``s with their ``n``.

    Two words are near if they differ by exactly one inserted, deleted or replaced
    letter.  A word's form is its near word of largest n (ties: smallest in code-point
    order) if that n is ``times`` the word's or more, else null; its root is the last
    word that following forms reaches, or the word itself.  Empty table: no rows."""
    words = materialize(words.select("word", "n"), "words")
    best = links(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("b"))
    found = words.join(best, "word", "left")
    is_form = -F.col("b.m") >= times * F.col("n")
    found = found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                         F.when(is_form, F.col("b.near")).alias("form"), F.when(is_form, -F.col("b.m")).alias("form_n"))
    found = materialize(found, "forms")
    low, high = words.agg(F.min("n"), F.max("n")).first()
    # each form occurs `times` as often, which bounds the chain
    steps = floor(log10(high / low) / log10(times)) + 1 if high else 0
    ends = roots(found.where(F.col("form").isNotNull()), steps)
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
