"""Registered queries of the training-data operators and the SQL they must agree with."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe,
    chat,
    cotraining,
    divergence,
    exact_dedup,
    html_text,
    jaccard,
    near_vectors,
    packing,
    ring,
    surrogates,
    vector_codes,
    warc,
)
from .common import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function name."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op1_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives with revisits, and read back."""
    warc.register(spark)
    path = shared_folder(spark, "pages-warc")
    warc.page_records(table(spark, sf_dir, "pages")).write.format("warc").mode("append").save(path)
    read = spark.read.format("warc").option("payload", "digest").load(path)
    return read.where(F.col("record_type").isin("response", "revisit")).select(
        warc.page_id(F.col("record_id")).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        warc.page_id(F.col("refers_to")).alias("refers_to"),
        "digest_ok",
        F.col("target_uri").alias("url"),
    )


@query()
def op4_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1,024 tokens."""
    pieces = packing.pack_documents(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )
    return pieces.select(
        "doc_id", "start", "length", F.crc32("token_bytes").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query()
def op7_segment_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the bytes that they decode to, as digests."""
    files = (public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    encoded = bpe.encode_documents(table(spark, sf_dir, "documents"), *files)
    return bpe.decode_documents(encoded, *files).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


_CONTROL = r"([<\[])(\\*)(/?s>|/?INST\]|\|(?:image|audio|document)\|>)"


@query(
    rf"""
    WITH rows AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
      UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
    )
    SELECT conv_id, count(*) AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
      coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
      sum(17 + length(regexp_replace(role, '{_CONTROL}', '\1\\\2\3', 'g'))
             + length(regexp_replace(text, '{_CONTROL}', '\1\\\2\3', 'g')))::BIGINT AS formatted_chars,
      0::BIGINT AS n_attachments
    FROM rows GROUP BY conv_id
    """
)
def op8_typed_content_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, formatted, with turns and loss text read back from the string."""
    own = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(own).alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    chats = chat.format_chats(rows.withColumn("content", chat.text_part(F.col("text"))))
    read = chats.select(
        "conv_id",
        chat.read_turns(F.col("formatted")).alias("turns"),
        chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.size("attachments").cast("long").alias("n_attachments"),
    )
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "n_attachments",
    )


@query(
    """
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
      doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """
)
def op9_heavy_hitter_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which document of each group of equal texts stays."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@query()
def op2_sign_hash_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and survivor of every embedding, within its label."""
    return near_vectors.cosine_components(table(spark, sf_dir, "embeddings"), cosine=0.93)


@query()
def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document: four-word shingles, similarity of 85 in 100."""
    return jaccard.jaccard_components(
        table(spark, sf_dir, "documents"), jaccard.JaccardSpec(words=4, share=85, over=100)
    )


@query()
def op10_min_cut_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = html_text.extract_main_text(table(spark, sf_dir, "pages"))
    return pages.withColumn("n_chars", F.length("text").cast("long"))


@query()
def op3_surrogate_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with surrogates for personal data."""
    return surrogates.replace_personal_data(table(spark, sf_dir, "documents"), key="a key of the corpus owner").select(
        "doc_id", "text", "n_entities"
    )


@query()
def op6_co_training_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents from two views taught by the labels and by each other."""
    return cotraining.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op11_bounded_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and place of every document; the shards' row counts are at most one apart."""
    placed = ring.ring_shards(table(spark, sf_dir, "documents"), ring.RingSpec(shards=8, slack=0.0))
    return placed.select("*", F.lit("rows").alias("law"), F.lit(None).cast("int").alias("grown_shard"))


@query(
    r"""
    WITH read AS (
      SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
      FROM documents
    ),
    words AS (SELECT id, lang, source, unnest(words) AS term FROM read),
    kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY ALL HAVING count(DISTINCT id) >= 30),
    langs AS (SELECT lang, count(*) AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
    found AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
    groups AS (
      SELECT g.lang, g.source, coalesce(any_value(l.v), 0) AS v, any_value(l.total) AS lang_total,
        coalesce(sum(f.n), 0)::HUGEINT AS total
      FROM (SELECT DISTINCT lang, source FROM read) g
      LEFT JOIN langs l ON l.lang = g.lang LEFT JOIN found f ON f.lang = g.lang AND f.source = g.source
      GROUP BY g.lang, g.source
    ),
    shares AS (
      SELECT g.lang, g.source, k.term, coalesce(f.n, 0) AS n,
        (1 + (1000000000::HUGEINT * (coalesce(f.n, 0) + 5)) // (g.total + 5 * g.v))::BIGINT AS p,
        (1 + (1000000000::HUGEINT * (k.n + 5)) // (g.lang_total + 5 * g.v))::BIGINT AS q
      FROM groups g JOIN kept k ON k.lang = g.lang
      LEFT JOIN found f ON f.lang = g.lang AND f.source = g.source AND f.term = k.term
    ),
    sums AS (
      SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
      FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
    ),
    parts AS (
      SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
      FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
      UNION ALL SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q
    )
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
    FROM parts QUALIFY part = 'pair' OR rank <= 50
    """
)
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each source of a language is from each other one, and the terms it uses more than its language."""
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def _codes_sql(rounds: int = 6) -> str:
    """Codebooks of 8 parts and 16 entries, one pair of steps per round, then the codes."""
    steps = []
    for r in range(rounds + 1):
        steps.append(
            f"""
    far{r} AS (
      SELECT x.vec_id, x.part, c.entry, sum((x.v - c.v) * (x.v - c.v)) AS d
      FROM x JOIN book{r} c ON x.part = c.part AND x.place = c.place GROUP BY ALL
    ),
    near{r} AS (
      SELECT vec_id, part, entry, d FROM far{r}
      QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY d, entry) = 1
    )"""
        )
        if r < rounds:
            steps.append(
                f"""
    sum{r} AS (
      SELECT n.part, n.entry, x.place, sum(x.v)::BIGINT AS s, count(*) AS n
      FROM near{r} n JOIN x ON x.vec_id = n.vec_id AND x.part = n.part GROUP BY ALL
    ),
    book{r + 1} AS (
      SELECT b.part, b.entry, b.place, coalesce((s - ((s % n) + n) % n) // n, v) AS v
      FROM book{r} b LEFT JOIN sum{r} t ON b.part = t.part AND b.entry = t.entry AND b.place = t.place
    )"""
            )
    return f"""
    WITH kept AS (
      SELECT vec_id, label, embedding, len(embedding) // 8 AS width, row_number() OVER (ORDER BY vec_id) - 1 AS nth
      FROM embeddings
      WHERE embedding IS NOT NULL AND len([e FOR e IN embedding IF e IS NULL OR NOT isfinite(e)]) = 0
    ),
    x AS MATERIALIZED (
      SELECT vec_id, nth, (i - 1) // width AS part, (i - 1) % width AS place,
        floor(4096 * embedding[i]::DOUBLE)::BIGINT AS v
      FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM kept)
    ),
    book0 AS (SELECT part, nth AS entry, place, v FROM x WHERE nth < 16),{','.join(steps)},
    codes AS (
      SELECT vec_id, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, sum(d)::BIGINT AS error
      FROM near{rounds} GROUP BY vec_id
    )
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
      (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, place)) FROM book{rounds}) AS codebooks_sha256
    FROM codes JOIN kept USING (vec_id)
    """


@query(_codes_sql())
def op13_grid_cell_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings by codebooks fitted on all of them."""
    vectors = table(spark, sf_dir, "embeddings")
    codebooks = vector_codes.fit_codebooks(vectors)
    return vector_codes.encode_vectors(vectors, codebooks).withColumn(
        "codebooks_sha256", F.lit(vector_codes.codebooks_sha256(codebooks))
    )
