"""All five stages of the pipeline against plain Python, on planted documents."""

import random
from collections import Counter, defaultdict

import corpus_pipeline
import duckdb
import numpy as np
import pandas as pd
import pytest
from helpers import words
from pyspark.sql import types as T
from test_language import grams
from test_minhash import brute as brute_classes
from test_packing import ids
from test_secrets import HEX, KEY, base

from parkops.llm.queries import ORACLES

STEMS = {"en": ["the", "ing", "tion", "ou"], "fr": ["é", "eux", "ent", "qu"]}
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
                       # columns whose names the operators also use inside
                       *[T.StructField(c, T.StringType()) for c in ("row", "_t", "uid", "_key", "size", "lang_pred", "kept", "_text")]])


def prose(rng, lang, n):
    return ["".join(rng.choice(STEMS[lang]) for _ in range(rng.randrange(1, 5))) for _ in range(n)]


def planted():
    rng = random.Random(21)
    out = []
    for i in range(60):
        lang = "en" if i % 3 else "fr"
        out.append([i, " ".join(prose(rng, lang, rng.randrange(8, 90))), lang, rng.choice(["hot", "hot", "hot", "b", None])])
    out[4][1] = f"{out[4][1]} password = 'hunter2222' and {KEY} {HEX}{HEX} {out[5][1]}"
    out[7][1] = f"token: abcdefgh {out[7][1]}"
    near = out[8][1].split()
    copies = [[100 + i, " ".join([*near[:-1], f"edit{i}"]), "en", "b"] for i in range(6)]        # near copies of a text
    copies += [[200 + i, out[9][1], "en", "hot"] for i in range(40)]                             # a third of all rows
    odd = [[300, None, "en", "b"], [301, "", None, "b"], [302, " \n\t", "fr", None], [303, "12 345 ½ !!", "en", "hot"],
           [304, out[10][1] + " again", None, None], [305, " ".join(prose(rng, "en", 3000)), "en", "b"], [None, " ".join(prose(rng, "en", 30)), "en", "b"]]
    rows = [*out, *copies, *odd, out[11], out[11], out[11]]                                      # rows repeated whole
    return [(i, t, lang, s, len(t or ""), *["x"] * 8) for i, t, lang, s in rows]


def stay_language(rows):
    counts = defaultdict(Counter)
    for _, t, lang, *_ in rows:
        if lang and t is not None:
            counts[lang] += grams(t, 400)[1]
    profile = {lang: {g: r for r, (g, _) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0]))[:400])} for lang, c in counts.items()}
    kept = []
    for i, t, lang, *rest in rows:
        own = grams(t, 400)[0]
        if own:
            apart = {k: sum(abs(p[g] - r) if g in p else 400 for r, g in enumerate(own)) for k, p in profile.items()}
            best = min(sorted(apart), key=apart.get)
            if 1 - apart[best] / (400 * len(own)) >= corpus_pipeline.LEAST_SCORE:
                kept.append((i, t, lang or best, *rest))
    return kept


def stay_distinct(rows):
    """One row of each class, that of the smallest id (null ids last)."""
    number = {id_: n for n, id_ in enumerate(sorted({r[0] for r in rows}, key=lambda x: (x is None, x or 0)))}
    classes = brute_classes([(number[r[0]], r[1], None, None) for r in rows])
    return [r for n, r in {number[r[0]]: r for r in rows}.items() if classes[n] == n]


def without_secrets(rows):
    out = []
    for i, t, lang, source, _, *rest in rows:
        spans, text, at = sorted((a, b) for _, a, b in base(t)), "", 0
        for a, b in spans:
            if a > at or not at:
                text += t[at:a] + "[SECRET]"
            at = max(at, b)
        text += t[at:]
        out.append((i, text, lang, source, len(text), *rest))
    return out


def mixed(rows):
    frame = pd.DataFrame([(i, t, s) for i, t, _, s, *_ in rows], columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"})
    con = duckdb.connect()
    con.register("documents", frame)
    sql = ORACLES["op4_source_mixing"]
    by_id = "md5('mix:' || doc_id::VARCHAR)"
    assert by_id in sql
    found = con.execute(sql.replace(by_id, "md5(concat_ws(':', 'mix', doc_id::VARCHAR))")).df()   # a null id has a hash too
    times = {None if pd.isna(i) else int(i): int(taken // size) if size else 0 for i, size, taken in zip(found["doc_id"], found["size"], found["taken"])}
    return [r for r in rows for _ in range(times[r[0]])]


PLAIN = {"language_id": stay_language, "near_dedup": stay_distinct, "secret_scan": without_secrets, "mixing": mixed}


def key(row):
    return str(tuple(row))


def test_every_stage_equals_its_plain_version(spark, tmp_path):
    rows = planted()
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        docs, rows = spark.read.parquet(str(tmp_path / name)), PLAIN[name](rows)
        assert sorted(map(key, docs.collect())) == sorted(map(key, rows)), name
        assert n or len(rows) < len(planted())
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # each copy of a document once, whole, and sequences that are gapless and nearly full
    texts = Counter((r[0], r[1]) for r in rows)
    want = Counter()
    for (doc, text), times in texts.items():
        tokens = np.array(ids(text), "<u4")
        first = len(tokens) % 1024 or 1024
        for piece, stop in enumerate(range(first, len(tokens) + 1, 1024)):
            want[doc, piece, stop - (1024 if piece else first), 1024 if piece else first] += times
    assert Counter((r.doc_id, r.piece, r.start, r.length) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        p.sort()
        assert p[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(p, p[1:])) and sum(p[-1]) <= 1024
    assert len(places) <= 1.05 * sum(r.length for r in got) / 1024 + 2


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, 0, *["x"] * 8)]])
def test_tables_without_text(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_columns_stay_without_n_chars(spark):
    rng = random.Random(1)
    docs = spark.createDataFrame([(i, " ".join(words(rng, 20)) + " password=abcdef12", "en", "a") for i in range(20)],
                                 "doc_id long, text string, lang string, source string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns, name
