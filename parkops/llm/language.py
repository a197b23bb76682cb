"""Language identification by rank-order profiles.

A language's profile is its most frequent character n-grams in order of
frequency.  A document's own most frequent n-grams are compared with each
profile by the out-of-place distance: the sum of how far each n-gram's rank is
from its rank in the profile, with the largest distance for n-grams that the
profile lacks.  The nearest profile wins.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Letters, and number signs that are no decimal digits, which :func:`words` takes out.
_LETTERS = re.compile(r"[^\W\d_]+")
_WORDS = 50_000    # words whose n-grams a task counts at a time
_FLUSH = 200_000   # distinct (language, word) pairs that a task gathers before it hands them on


def _windows(listed: list[str], longest: int) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """n-grams of words with a blank on either side: ``(names, slots, starts, sizes)``.

    ``names`` are the distinct n-grams by code point.  Word ``i`` has
    ``slots[starts[i]:starts[i] + sizes[i]]``: places in ``names``, or ``len(names)``
    for a window that is none.  All words are one row of characters, and a
    window is a number made of its characters' places in the alphabet."""
    points = np.frombuffer(f" {' '.join(listed)} ".encode("utf-32-le"), np.uint32)
    blank = points == 32
    alphabet, letter = np.unique(points, return_inverse=True)
    bits = len(alphabet).bit_length()
    if bits * longest > 63:   # more letters than a number holds: name the windows instead
        whole = points.tobytes().decode("utf-32-le")
    keys = np.zeros((len(points), longest), np.int64 if bits * longest <= 63 else f"U{longest}")
    valid = np.zeros((len(points), longest), bool)
    inner = np.zeros(len(points), bool)   # whether a blank stands inside the window
    for n in range(1, longest + 1):
        count = len(points) - n + 1
        if count <= 0:
            break
        if n == 1:
            valid[:, 0] = ~blank
        else:
            if n > 2:
                inner[:count] |= blank[n - 2:n - 2 + count]
            valid[:count, n - 1] = ~inner[:count]
        if keys.dtype.kind == "U":
            keys[:count, n - 1] = [whole[i:i + n] for i in range(count)]
        else:
            for i in range(n):   # shorter windows sort before longer ones that begin alike
                keys[:count, n - 1] |= (letter[i:i + count] + 1) << (bits * (longest - 1 - i))
    found, where = np.unique(keys[valid], return_inverse=True)
    slots = np.full(valid.shape, len(found), np.int64)
    slots[valid] = where
    if keys.dtype.kind == "U":
        names = found.tolist()
    else:
        mask = (1 << bits) - 1
        parts = [(found >> (bits * (longest - 1 - i))) & mask for i in range(longest)]
        signs = ["", *map(chr, alphabet.tolist())]
        names = ["".join(signs[c] for c in g) for g in zip(*(p.tolist() for p in parts))]
    lengths = np.array([len(w) for w in listed], np.int64) + 1
    return names, slots.ravel(), (np.cumsum(lengths) - lengths) * longest, lengths * longest


def words(text: str | None) -> Counter:
    """Runs of letters (Unicode category L), lower-cased, with their counts."""
    found = Counter(_LETTERS.findall((text or "").lower()))
    for mixed in [w for w in found if not w.isalpha()]:   # superscripts, fractions, Roman numerals, circled digits
        n = found.pop(mixed)
        for w in "".join(c if c.isalpha() else " " for c in mixed).split():
            found[w] += n
    return found


def _word_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict[str, Counter] = {}

    def flush() -> pd.DataFrame:
        rows = [(lang, w, n) for lang, c in held.items() for w, n in c.items()]
        held.clear()
        return pd.DataFrame(rows, columns=["lang", "word", "n"])

    for batch in batches:
        for lang, text in zip(batch.lang, batch.text):
            held.setdefault(lang, Counter()).update(words(text))
            if sum(map(len, held.values())) >= _FLUSH:
                yield flush()
    yield flush()


def _gram_counts(longest: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Counter] = {}

        def flush() -> pd.DataFrame:
            rows = [(lang, g, n) for lang, c in held.items() for g, n in c.items()]
            held.clear()
            return pd.DataFrame(rows, columns=["lang", "gram", "n"])

        def gathered() -> Iterator[pd.DataFrame]:
            parts, size = [], 0
            for batch in batches:
                parts.append(batch)
                size += len(batch)
                if size >= _WORDS:
                    yield pd.concat(parts)
                    parts, size = [], 0
            if parts:
                yield pd.concat(parts)

        for batch in gathered():
            for lang, part in batch.groupby("lang"):
                names, slots, _, sizes = _windows(part.word.tolist(), longest)
                total = np.bincount(slots[:sizes.sum()], weights=np.repeat(part.n.to_numpy(), sizes), minlength=len(names) + 1)
                held.setdefault(lang, Counter()).update(dict(zip(names, total.astype(np.int64).tolist())))
            if sum(map(len, held.values())) >= _FLUSH:
                yield flush()
        yield flush()
    return run


def profiles(df: DataFrame, lang: str = "lang", text: str = "text", longest: int = 4, size: int = 400) -> DataFrame:
    """``lang, rank, gram`` (ranks from 0): at most ``size`` rows a language.

    Rows whose language or text is null teach nothing.  Words are counted before
    n-grams are made of them, so what is shuffled is words and n-grams with
    counts, never texts.  The ranking window sees the best of salted groups."""
    told = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    counted = (told.mapInPandas(_word_counts, "lang string, word string, n long")
               .groupBy("lang", "word").agg(F.sum("n").alias("n")))
    grams = (counted.mapInPandas(_gram_counts(longest), "lang string, gram string, n long")
             .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    best = [F.col("n").desc(), F.col("gram")]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("gram"), F.lit(64))).orderBy(*best)
    few = grams.withColumn("r", F.row_number().over(part)).where(F.col("r") <= size)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*best)) - 1
    return few.withColumn("rank", rank).where(F.col("rank") < size).select("lang", "rank", "gram")


def _distances(counts: list[Counter], learned: dict[str, dict[str, int]], longest: int, size: int) -> list[tuple[np.ndarray, int]]:
    """Per text: its distance to each profile, and how many n-grams it was taken over.

    Texts are taken a few at a time: the n-grams of their words become one count
    matrix; a text's ranks come from its row, by count, then code point."""
    listed = list({w for c in counts for w in c})
    place = {w: i for i, w in enumerate(listed)}
    names, flat, starts, sizes = _windows(listed, longest)
    away = np.array([[p.get(g, -1) for p in learned.values()] for g in names]).reshape(len(names), len(learned))
    width = len(names) + 1   # the last column gathers what is no n-gram
    out: list[tuple[np.ndarray, int]] = []
    step = max(1, 1_000_000 // width)
    for at in range(0, len(counts), step):
        part = counts[at:at + step]
        row = np.repeat(np.arange(len(part)), [len(c) for c in part])
        word = np.array([place[w] for c in part for w in c], np.int64)
        times = np.array([n for c in part for n in c.values()], np.float64)
        long = sizes[word]
        inside = np.arange(long.sum()) - np.repeat(np.cumsum(long) - long, long)
        cell = np.repeat(row, long) * width + flat[np.repeat(starts[word], long) + inside]
        total = np.bincount(cell, weights=np.repeat(times, long), minlength=len(part) * width).reshape(len(part), -1)[:, :-1]
        for counted in total:
            own = np.flatnonzero(counted)
            n = counted[own]
            if len(own) > size:
                least = np.partition(n, len(n) - size)[len(n) - size]
                own, n = own[n >= least], n[n >= least]
            own = own[np.lexsort((own, -n))][:size]
            there = away[own]
            apart = np.where(there < 0, size, np.abs(there - np.arange(len(own))[:, None])).sum(axis=0)
            out.append((apart, len(own)))
    return out


def _predict(learned: dict[str, list[str]], longest: int, size: int):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        langs = sorted(learned)
        places = {lang: {g: r for r, g in enumerate(learned[lang])} for lang in langs}
        for batch in batches:
            found, scores = ["und"] * len(batch), [0.0] * len(batch)
            waiting: list[tuple[int, Counter]] = []

            def settle() -> None:
                for (i, _), (apart, n) in zip(waiting, _distances([c for _, c in waiting], places, longest, size)):
                    best = int(apart.argmin())
                    found[i], scores[i] = langs[best], 1 - float(apart[best]) / (size * n)
                waiting.clear()

            held = 0
            for i, text in enumerate(batch):
                c = words(text)
                if c and langs:
                    waiting.append((i, c))
                    held += len(c)
                    if held > _FLUSH:
                        settle()
                        held = 0
            if waiting:
                settle()
            yield pd.DataFrame({"lang_pred": found, "score": scores})
    return run


def identify(df: DataFrame, training: DataFrame, text: str = "text", lang: str = "lang", longest: int = 4, size: int = 400) -> DataFrame:
    """``df`` with ``lang_pred`` (the nearest learned language, ``und`` for a null text
    or one without a letter, or if nothing was learned) and ``score`` (1 minus the
    distance as a share of the largest possible one; 0 for ``und``).

    Only the text is looked at, whole.  Ties go to the first language by code
    point; repeated rows get equal results; empty table: no rows; ``lang_pred``
    and ``score`` replace columns of those names.  The profiles, ``size`` n-grams
    a language, are all that the driver sees."""
    learned: dict[str, list[str]] = {}
    for row in profiles(training, lang, text, longest, size).orderBy("lang", "rank").collect():
        learned.setdefault(row["lang"], []).append(row["gram"])
    predict = _predict(learned, longest, size)

    def guesses(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        return predict(texts)

    # marked so that a later filter on the result is not moved below, which would run it twice
    guess = F.pandas_udf(guesses, "lang_pred string, score double").asNondeterministic()
    rest = [c for c in df.columns if c not in ("lang_pred", "score")]
    told = df.select(F.struct(*rest).alias("row"), guess(F.col(text)).alias("guess"))   # no name of theirs can clash
    return told.select(*[F.col("row")[c].alias(c) for c in rest], F.col("guess.lang_pred").alias("lang_pred"), F.col("guess.score").alias("score"))
