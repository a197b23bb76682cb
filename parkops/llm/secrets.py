"""Secret scan with multipart credential linking.

Strong parts are found by pattern alone.  Weak parts (identifiers, endpoints,
mixed tokens) are common in clean text, so they are reported only where the
complementary part of a credential stands close by: parts are joined on the
text and on scope-wide buckets of their start (an interval join that keeps one
row per bucket and role, so no pairs are made).  Only DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, union_all

_QUOTED = r"""["']?\x20*[:=]\x20*["']?"""
#: The kinds in their order, each with pattern, group and least length of that group.
KINDS: list[tuple[str, str, int, int]] = [
    ("assign", r"(?i:(password|passwd|secret|token|api_?key))" + _QUOTED + r"([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),   # a shorter run holds no longer one
    ("hex", r"[0-9a-f]{24,}", 0, 24),
    ("ident", r"(?i:\b(user_?name|user_?id|user|login|account|client_?id|access_?key_?id))" + _QUOTED + r"([A-Za-z0-9@._-]+)", 2, 3),
    ("endpoint", r"(?:https?|ftp|s3|jdbc|postgres|postgresql|mysql|mongodb|redis|amqp)://[^\x20\x09-\x0D\"'<>]+", 0, 8),
    ("weak", r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}", 0, 16),
]
BASE = 3   # the first three kinds are strong
_IDENT, _ENDPOINT, _WEAK = 3, 4, 5
_SPAN = "struct<kind:int,start:int,end:int>"
_SALTS = 16
_LONG = 20   # least length of a weak secret with letters of one case only


def _parts(text: Column, kind: int) -> Column:
    """Spans of one kind, code points, end exclusive: ``split`` gives what lies
    between the matches, so starts are running lengths."""
    _, pattern, group, least = KINDS[kind]
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    gaps = F.split(text, pattern, -1)
    ok = lambda v: F.length(v) >= least
    if kind == _WEAK:   # a mixed token: digits with letters of both cases, or with those of one if it is longer
        both = lambda v: v.rlike("[a-z]") & v.rlike("[A-Z]")
        ok = lambda v: (F.length(v) >= least) & v.rlike("[0-9]") & (both(v) | ((F.length(v) >= _LONG) & v.rlike("[A-Za-z]")))
    rows = F.zip_with(F.arrays_zip(hits.alias("m"), value.alias("v")), F.slice(gaps, 1, F.size(hits)),
                      lambda x, gap: F.struct(x["m"].alias("m"), x["v"].alias("v"), gap.alias("g")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + F.length(x["g"])
        end = start + F.length(x["m"])
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(ok(x["v"]), F.concat(a["out"], F.array(span))).otherwise(a["out"]).alias("out"))

    found = F.aggregate(rows, zero, step, lambda a: a["out"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _scan(df: DataFrame, text: str) -> DataFrame:
    """``df`` plus ``_key`` (digest of the text), ``_base`` and ``_soft`` (weak parts
    that overlap no strong one), each sorted by start, then kind."""
    body = F.coalesce(F.col(text), F.lit(""))
    raw = df.withColumns({"_key": F.md5(body)} | {f"_p{k}": _parts(body, k) for k in range(len(KINDS))})
    by_start = lambda *cols: F.transform(F.array_sort(F.transform(F.concat(*cols), lambda s: F.struct(
        s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))), lambda s: F.struct(
            s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    raw = raw.withColumn("_base", by_start(*[F.col(f"_p{k}") for k in range(BASE)]))
    clear = lambda s: ~F.exists(F.col("_base"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    soft = F.filter(F.concat(*[F.col(f"_p{k}") for k in range(BASE, len(KINDS))]), clear)
    return raw.withColumn("_soft", by_start(soft)).drop(*[f"_p{k}" for k in range(len(KINDS))])


def _possible() -> Column:
    """Whether parts of two roles meet in the text at all, one of them weak."""
    has = lambda arr, *kinds: F.exists(F.col(arr), lambda s: s["kind"].isin(*kinds))
    ident = has("_base", 1) | has("_soft", _IDENT)
    secret = has("_base", 0, 2) | has("_soft", _WEAK)
    return (F.size("_soft") > 0) & ident & secret


def _links(found: DataFrame, scope: int) -> DataFrame:
    """``_key, _linked``: weak parts with their complement in scope.  An
    identifier needs a secret, a weak secret an identifier, an endpoint both."""
    texts = (found.where(_possible()).groupBy("_key")   # copies of a text have the same parts
             .agg(F.first("_base").alias("_base"), F.first("_soft").alias("_soft")))
    parts = (texts.select("_key", F.explode(F.concat("_base", "_soft")).alias("p"))
             .select("_key", "p.*", F.floor(F.col("p.start") / scope).alias("bucket")))
    role = {"ident": F.col("kind").isin(1, _IDENT), "secret": F.col("kind").isin(0, 2, _WEAK)}
    edges = parts.groupBy("_key", "bucket").agg(
        *[f(F.when(is_role, F.col("start"))).alias(f"{n}_{r}") for r, is_role in role.items() for n, f in (("lo", F.min), ("hi", F.max))])
    probes = parts.where(F.col("kind") >= BASE).withColumn("own", F.col("bucket")).withColumn(
        "bucket", F.explode(F.array(F.col("own") - 1, F.col("own"), F.col("own") + 1)))
    met = probes.join(edges, ["_key", "bucket"])
    near = {r: (F.col(f"hi_{r}") >= F.col("start") - scope) & (F.col(f"lo_{r}") <= F.col("start") + scope) for r in role}
    seen = met.groupBy("_key", "kind", "start", "end").agg(
        *[F.max(F.coalesce(near[r], F.lit(False))).alias(r) for r in role])
    linked = seen.where(F.when(F.col("kind") == _IDENT, F.col("secret")).when(F.col("kind") == _WEAK, F.col("ident"))
                        .otherwise(F.col("ident") & F.col("secret")))
    return linked.groupBy("_key").agg(F.collect_list(F.struct("kind", "start", "end")).alias("_linked"))


def _with_links(found: DataFrame, links: DataFrame) -> DataFrame:
    """``found`` plus ``_linked``.  Only rows that can have links are joined; a
    text with many copies is dealt over salted keys."""
    none = F.array().cast(f"array<{_SPAN}>")
    salted = found.where(_possible()).withColumn("_salt", F.floor(F.rand(7) * _SALTS).cast("int"))
    each = links.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    joined = salted.join(each, ["_key", "_salt"], "left").drop("_salt")
    return union_all(joined.withColumn("_linked", F.coalesce("_linked", none)),
                     found.where(~_possible()).withColumn("_linked", none))


def _named(spans: Column) -> Column:
    """Spans by start, then kind, with the kind's name."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    return F.transform(ordered, lambda s: F.struct(F.get(names, s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text", scope: int = 256) -> DataFrame:
    """Per input row: ``doc_id, base, spans`` (arrays of ``kind, start, end``; code
    points, end exclusive; by start, then kind).

    ``base`` holds the strong kinds, ``spans`` also the linked weak ones: an identifier (``user: name``)
    with a secret, a weak secret with an identifier or access key, an endpoint with both, whose
    starts are at most ``scope`` code points away.  A weak secret is a token of 16 characters or more
    with digits and letters of both cases, or of 20 with digits and letters of one.  Null
    text is an empty text; empty table: no rows; repeated rows are each
    reported; other columns are ignored, whatever their names.  Whole texts of
    any length are read once; what is kept of them is written once."""
    light = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    found = materialize(_scan(light, "_text").drop("_text"), "secret-parts")
    both = _with_links(found, _links(found, scope))
    return both.select("doc_id", _named(F.col("_base")).alias("base"), _named(F.concat("_base", "_linked")).alias("spans"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(df: DataFrame, text: str = "text", scope: int = 256, mark: str = "[SECRET]") -> DataFrame:
    """``df`` with every reported span of ``text`` replaced by ``mark`` (spans that
    overlap or touch become one).  All rows and columns stay; a null text stays null."""
    packed = df.select(F.struct("*").alias("row"), F.col(text).alias("_text"))
    # written with the rows: three branches read the spans, and the patterns are the work
    scanned = materialize(_scan(packed, "_text").drop("_text"), "secret-rows").withColumn("_text", F.col("row")[text])
    both = _with_links(scanned, _links(scanned.select("_key", "_base", "_soft"), scope))
    spans = F.array_sort(F.transform(F.concat("_base", "_linked"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    # a span that starts inside the last one only moves its end
    step = lambda a, s: F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(
        (s["start"] < a["at"]) | ((s["start"] == a["at"]) & (a["at"] > 0)), a["out"]).otherwise(
            F.concat(a["out"], F.substring(F.col("_text"), a["at"] + 1, s["start"] - a["at"]), F.lit(mark))).alias("out"))
    clean = F.aggregate(spans, zero, step, lambda a: F.concat(a["out"], F.substring(F.col("_text"), a["at"] + 1, F.length("_text"))))
    new = F.when(F.size(spans) > 0, clean).otherwise(F.col("_text"))
    return both.select(*[new.alias(c) if c == text else F.col("row")[c].alias(c) for c in df.columns])
