"""Registered queries of the operators, with their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, embedding_dedup, language, minhash, mixing, multi_index, packing, periodic_runs, secrets, sharding, spelling, suffix_tree, token_counts
from .common import prepare, read

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def keep(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)
        run.__doc__, run.__name__ = fn.__doc__, fn.__name__
        QUERIES[fn.__name__] = run
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn
    return keep


def crc_of_id() -> Column:
    return F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))


@query()
def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link counts and components of all vectors at cosine 0.95."""
    return embedding_dedup.links(read(spark, sf_dir, "embeddings"))


@query()
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from three quarters of those with a known one."""
    docs = read(spark, sf_dir, "documents")
    docs = docs.withColumn("held_out", F.coalesce(crc_of_id() % 4 == 2, F.lit(False)))
    return language.identify(docs.select("doc_id", "held_out", "text"), docs.where(~F.col("held_out"))).drop("text")


@query()
def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suffix-tree and unigram scores of every document, learned from nine tenths of them."""
    return suffix_tree.score(read(spark, sf_dir, "documents"), crc_of_id() % 10 == 0)


@query("""
WITH light AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5('mix:' || doc_id::VARCHAR) AS h, md5(coalesce(text, '')) AS t, row_number() OVER () AS uid
  FROM documents),
done AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY h, doc_id NULLS FIRST, t, uid ROWS UNBOUNDED PRECEDING) AS done FROM light),
named AS (SELECT source, sum(size) AS total, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM light GROUP BY source),
weighed AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
                   sum(total) OVER ()::DOUBLE * 1.5::DOUBLE AS budget, (total * 2)::DOUBLE AS cap FROM named),
levels AS (SELECT *, cap / weight AS ratio,
                  (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                  / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level
           FROM weighed),
targets AS (SELECT source, total, budget, CASE WHEN level > ratio THEN cap
                   ELSE weight * (SELECT arg_min(level, ratio) FROM levels WHERE level <= ratio) END AS target FROM levels),
copies AS (SELECT d.uid, d.doc_id, d.source, d.size, d.h, d.t, e.epoch, t.total, t.target, t.budget,
                  CASE WHEN t.target > 0 THEN (e.epoch * t.total + d.done)::DOUBLE / t.target END AS finish
           FROM done d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source CROSS JOIN (VALUES (0), (1)) e(epoch)),
merged AS (SELECT *, sum(size) OVER (ORDER BY finish NULLS LAST, source NULLS LAST, epoch, h, doc_id NULLS FIRST, t, uid
                                     ROWS UNBOUNDED PRECEDING) AS upto FROM copies)
SELECT any_value(doc_id) AS doc_id, any_value(size) AS size, any_value(total)::BIGINT AS source_size, any_value(target) AS target,
       sum(CASE WHEN finish IS NOT NULL AND upto <= budget THEN size ELSE 0 END)::BIGINT AS taken
FROM merged GROUP BY uid
""")
def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents to the weights 5, 2, 1 at 150 % of all words."""
    return mixing.mix(read(spark, sf_dir, "documents"))


def tokenizer() -> dict[str, str]:
    """The byte-level BPE's files and its pre-token pattern."""
    import public_tokenizers
    return {"json_path": public_tokenizers.path("byte_bpe_50k.json"), "ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken"),
            "pattern": public_tokenizers.PATTERN}


@query()
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    return packing.pack(read(spark, sf_dir, "documents"), **tokenizer()).drop("ids")


@query()
def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that is full of control strings, formatted and read back."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], turns.schema)
    out = chat.format_conversations(turns.unionByName(extra))
    return out.select("conv_id", chat.digests().alias("d")).select("conv_id", "d.*")


@query()
def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents: class id and which document stays."""
    return minhash.classes(read(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept", "n_shingles")


@query()
def op8_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest by inner product of every vector whose id is divisible by 20."""
    return multi_index.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query()
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: counts and digest of the strong kinds, and all spans."""
    found = secrets.scan(read(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(k[0]).alias(f"n_{k[0]}") for k in secrets.KINDS[:secrets.BASE]],
                        F.sha2(secrets.joined(F.col("base")), 256).alias("base_sha256"),
                        secrets.joined(F.col("spans")).alias("spans"))


@query()
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight contiguous shards of near equal bytes."""
    return sharding.shard(read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def planted_repeats() -> Column:
    """The text, whose tail repeats itself in a tenth of the documents (told by the id's crc32)."""
    h, words, n = F.col("h"), F.col("words"), F.size("words")
    g = F.floor(h / 10)
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    from_word = lambda w, i: F.when(i < a, w).otherwise(F.element_at(words, (a + (i - a) % p + 1).cast("int")))
    return F.when((h % 10 == 0) & (n > 0), F.array_join(F.transform(words, from_word), " ")).otherwise(F.col("text"))


@query()
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in every document, some of which get a repeating tail first."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", crc_of_id().alias("h"))
    words = F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)))
    docs = docs.withColumn("words", words).select("doc_id", planted_repeats().alias("text"))
    best, milli = F.col("strongest"), F.expr("1000 * strongest.length div strongest.period")
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return periodic_runs.find_runs(docs).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[best[c].alias(c) for c in ("start", "length", "period")],
        milli.alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query()
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents, where one run in 31 loses a letter first."""
    return spelling.variants(spelling.count_words(read(spark, sf_dir, "documents"), spoil_every=31))


@query()
def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by the word BPE, and which exceed 2048."""
    import public_tokenizers
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
