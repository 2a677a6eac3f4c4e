"""Registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from popatlas.llm import (
    bpe,
    chat_format,
    embedding_dedup,
    exact_dedup,
    html_extract,
    lexical_search,
    merkle,
    packing,
    quality,
    quality_rules,
    sharding,
    simhash,
    token_files,
)
from popatlas.plans.storage import new_folder, stored

SHARDS = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.assign_shards(table(spark, sf_dir, "documents"), SHARDS)
    return dealt.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "tokens")
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    token_files.write_tokens(table(spark, sf_dir, "documents"), tokenizer, path)
    return token_files.token_index(spark, path)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    encoded = bpe.encode_texts(table(spark, sf_dir, "documents"), vocabulary)
    decimal = F.array_join(F.col("ids").cast("array<string>"), ",")
    return bpe.decode_ids(encoded, vocabulary).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(decimal.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack_documents(table(spark, sf_dir, "documents"), path, with_ids=False)


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.similar_vectors(table(spark, sf_dir, "embeddings"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat_format.adjacent_pairs(table(spark, sf_dir, "conversations"))
    return chat_format.preference_pairs(turns)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"), words=4, limit=4)


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(table(spark, sf_dir, "pages"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = stored(quality_rules.statistics(table(spark, sf_dir, "documents")), "statistics")
    rules = quality_rules.learn(stats, table(spark, sf_dir, "labels"))
    return quality_rules.judge(stats, rules)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lexical_search.search(docs, table(spark, sf_dir, "benchmark"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_dedup,
        op2_sharding,
        op3_token_files,
        op4_quality,
        op5_bpe,
        op6_packing,
        op7_embedding_dedup,
        op8_chat_format,
        op9_simhash,
        op10_html_extract,
        op11_quality_rules,
        op12_lexical_search,
        op13_merkle_manifest,
    )
}
ORACLES: dict[str, str] = {
    "op1_exact_dedup": """
        WITH hashed AS (
          SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                          'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
          FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
               count(*) OVER (PARTITION BY text_sha256) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
        FROM hashed""",
    "op8_chat_format": """
        WITH turns AS (
          SELECT DISTINCT CAST(floor(conv_id / 2.0e0) AS BIGINT) AS pair_id,
                 conv_id % 2 = 0 AS chosen,
                 coalesce(CAST(turn AS BIGINT), -4611686018427387904) AS turn, role, text
          FROM conversations WHERE conv_id IS NOT NULL),
        sides AS (
          SELECT pair_id, turn,
                 list({'role': role, 'text': text} ORDER BY role NULLS FIRST, text NULLS FIRST)
                   FILTER (WHERE chosen) AS c,
                 list({'role': role, 'text': text} ORDER BY role NULLS FIRST, text NULLS FIRST)
                   FILTER (WHERE NOT chosen) AS r
          FROM turns GROUP BY pair_id, turn),
        firsts AS (
          SELECT pair_id, min(turn) AS first_difference FROM sides
          WHERE c IS DISTINCT FROM r GROUP BY pair_id),
        drawn AS (
          SELECT t.pair_id, CAST(floor(t.turn / 1000.0e0) AS BIGINT) AS part, t.turn, role, text,
                 CASE WHEN first_difference IS NULL OR t.turn < first_difference
                      THEN CASE WHEN chosen THEN 'p' END
                      WHEN chosen THEN 'c' ELSE 'r' END AS goes_to,
                 concat('<|im_start|>', replace(replace(coalesce(role, 'unknown'),
                   '<|im_start|>', '<im_start>'), '<|im_end|>', '<im_end>'), chr(10)) AS head,
                 replace(replace(coalesce(text, ''), '<|im_start|>', '<im_start>'),
                   '<|im_end|>', '<im_end>') AS body
          FROM turns t LEFT JOIN firsts f ON f.pair_id = t.pair_id),
        placed AS (
          SELECT *, row_number() OVER w AS place,
                 sum(length(head) + length(body) + 11) OVER w - length(body) - 11 AS body_start
          FROM drawn
          WINDOW w AS (PARTITION BY pair_id, part, goes_to
                       ORDER BY turn, role NULLS FIRST, text NULLS FIRST)),
        lines AS (
          SELECT pair_id, part, goes_to, place, concat(head, body, '<|im_end|>', chr(10)) AS line,
                 CASE WHEN role = 'assistant'
                      THEN concat(body_start, '-', body_start + length(body)) END AS span
          FROM placed)
        SELECT pair_id, part,
               count(*) FILTER (WHERE goes_to = 'p') AS n_prompt_turns,
               count(*) FILTER (WHERE goes_to = 'c') AS n_chosen_turns,
               count(*) FILTER (WHERE goes_to = 'r') AS n_rejected_turns,
               coalesce(string_agg(line, '' ORDER BY place) FILTER (WHERE goes_to = 'p'), '')
                 AS prompt,
               coalesce(string_agg(line, '' ORDER BY place) FILTER (WHERE goes_to = 'c'), '')
                 AS chosen,
               coalesce(string_agg(span, ',' ORDER BY place) FILTER (WHERE goes_to = 'c'), '')
                 AS chosen_spans,
               coalesce(string_agg(line, '' ORDER BY place) FILTER (WHERE goes_to = 'r'), '')
                 AS rejected,
               coalesce(string_agg(span, ',' ORDER BY place) FILTER (WHERE goes_to = 'r'), '')
                 AS rejected_spans
        FROM lines GROUP BY pair_id, part""",
    "op12_lexical_search": r"""
        WITH docs AS (
          SELECT row_number() OVER () AS place, doc_id,
                 regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
          FROM documents WHERE text IS NOT NULL),
        corpus AS (
          SELECT count(*) AS total, CAST(sum(len(terms)) AS BIGINT) AS length
          FROM docs WHERE len(terms) > 0),
        wanted AS (
          SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text,
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
          FROM benchmark),
        found AS (
          SELECT place, doc_id, any_value(n) AS n, term, count(*) AS tf
          FROM (SELECT place, doc_id, len(terms) AS n, unnest(terms) AS term FROM docs)
          WHERE term IN (SELECT term FROM wanted)
          GROUP BY place, doc_id, term),
        weights AS (
          SELECT term, CAST(floor(1000 * ln((2 * any_value(total) + 2) / (2 * count(*) + 1)))
                            AS BIGINT) AS w
          FROM found, corpus GROUP BY term),
        scored AS (
          SELECT item_id, place, doc_id,
                 CAST(sum(w * ((1000000000 * tf)
                   // (1000 * tf + 20 * (50 + (50 * n * total) // length)))) AS BIGINT) AS score
          FROM found JOIN weights USING (term) JOIN wanted USING (term), corpus
          GROUP BY item_id, place, doc_id),
        ranked AS (
          SELECT item_id, doc_id, score,
                 CAST(row_number() OVER (PARTITION BY item_id
                        ORDER BY score DESC, doc_id ASC NULLS LAST) AS INTEGER) AS rank
          FROM scored WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50""",
    "op13_merkle_manifest": """
        WITH RECURSIVE framed AS (
          SELECT doc_id, lang, n_chars,
                 coalesce(concat(strlen(CAST(doc_id AS VARCHAR)), ':', doc_id), '-') AS d,
                 coalesce(concat(strlen(source), ':', source), '-') AS s,
                 coalesce(concat(strlen(lang), ':', lang), '-') AS l,
                 coalesce(concat(strlen(text), ':', text), '-') AS t,
                 coalesce(xor(4294967295, list_reduce(list_concat([4294967295],
                   list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
                   lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
                     lambda x, y: xor(x >> 1, (x & 1) * 3988292384)))) % 7 = 0, false) AS hit
          FROM documents),
        hashed AS (
          SELECT doc_id, lang,
                 sha256(concat(d, s, l, CASE WHEN n_chars IS NULL THEN '-' ELSE
                   concat(strlen(CAST(n_chars AS VARCHAR)), ':', n_chars) END, t)) AS leaf,
                 sha256(concat(d, s, l, CASE WHEN n_chars IS NULL THEN '-' ELSE
                   concat(strlen(CAST(n_chars + CAST(hit AS INTEGER) AS VARCHAR)), ':',
                          n_chars + CAST(hit AS INTEGER)) END, t)) AS changed
          FROM framed),
        langs AS (
          SELECT lang, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, count(*) AS n
          FROM hashed GROUP BY lang),
        leaves AS (
          SELECT tree, doc_id, leaf, changed, n,
                 row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, changed)
                   - 1 AS pos
          FROM hashed JOIN langs ON hashed.lang IS NOT DISTINCT FROM langs.lang),
        nodes AS (
          SELECT tree, 0 AS level, pos, leaf AS h, n FROM leaves
          UNION ALL
          SELECT tree, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2
          FROM nodes WHERE n > 1 GROUP BY tree, level, pos // 2, n),
        subroots AS (SELECT tree, h FROM nodes WHERE n = 1),
        tops AS (
          SELECT 0 AS level, tree AS pos, h, (SELECT count(*) FROM subroots) AS n FROM subroots
          UNION ALL
          SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2
          FROM tops WHERE n > 1 GROUP BY level, pos // 2, n),
        -- Trees below, the last tree above, as one list of levels for each leaf.
        heights AS (SELECT tree, max(level) AS height FROM nodes GROUP BY tree),
        steps AS (
          SELECT l.tree, l.pos, x.level, b.h AS sibling, (l.pos >> x.level) % 2 = 1 AS is_left
          FROM leaves l JOIN nodes x ON x.tree = l.tree AND x.pos = l.pos >> x.level AND x.n > 1
          LEFT JOIN nodes b ON b.tree = x.tree AND b.level = x.level AND b.pos = xor(x.pos, 1)
          UNION ALL
          SELECT l.tree, l.pos, height + x.level, b.h, x.pos % 2 = 1
          FROM leaves l JOIN heights USING (tree)
          JOIN tops x ON x.pos = l.tree >> x.level AND x.n > 1
          LEFT JOIN tops b ON b.level = x.level AND b.pos = xor(x.pos, 1)),
        folded AS (
          SELECT tree, pos, 0 AS level, changed AS h FROM leaves
          UNION ALL
          SELECT f.tree, f.pos, f.level + 1,
                 sha256(CASE WHEN is_left THEN concat(sibling, f.h) ELSE concat(f.h, sibling) END)
          FROM folded f JOIN steps s ON s.tree = f.tree AND s.pos = f.pos AND s.level = f.level),
        ends AS (SELECT tree, pos, arg_max(h, level) AS folded_root FROM folded GROUP BY tree, pos),
        proofs AS (
          SELECT tree, pos, sha256(coalesce(string_agg(sibling, '' ORDER BY level), '')) AS p
          FROM steps GROUP BY tree, pos)
        SELECT doc_id, leaf, subroots.h AS subroot, (SELECT h FROM tops WHERE n = 1) AS root,
               coalesce(p, sha256('')) AS proof_sha256, folded_root,
               folded_root = (SELECT h FROM tops WHERE n = 1) AS verified
        FROM leaves JOIN subroots USING (tree)
        JOIN ends USING (tree, pos) LEFT JOIN proofs USING (tree, pos)""",
}
