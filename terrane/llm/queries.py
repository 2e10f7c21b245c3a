"""The corpus operators as queries on the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm import decontaminate, html_extract, langid, merkle, near_dedup, packing, passages, pii, piece_codec, quality, suffix_dedup, topk, url_filter, vector_codes
from terrane.session import table

URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stripped = suffix_dedup.strip_repeats(docs.withColumn("key", passages.text_key("text"))).select("key", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    return stripped.join(passages.shared_words(docs), "key", "left").drop("key").fillna(0, ["n_shared_words"])


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dedup.near_duplicates(docs, shingle_words=2).select("doc_id", "n_shingles", "component_id", "kept")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), TOKENIZER)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = decontaminate.judge(docs, table(spark, sf_dir, "benchmark"))
    return judged.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_filter.apply_rules(pages, url_filter.rule_frame(spark, URL_RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


OP7_SQL = """
WITH rules(verdict, host, path) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
  ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
rest AS (SELECT row_number() OVER () AS n, page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT n, page_id,
  translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
hits AS (SELECT n, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY n)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN hits USING (n)
"""


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.classify(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.identify(docs).select("doc_id", "held_out", "lang_pred", "score")


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


OP10_SQL = """
WITH q AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM q a JOIN q b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*merkle.COLUMNS)
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = merkle.leaf_digest([lowered if c == "text" else F.col(c) for c in merkle.COLUMNS])
    rows = merkle.manifest(docs, F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, tampered))
    out = rows.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), merkle.folded(F.col("presented"), F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


# Its CRC-32 goes bit by bit through the decimal digits of doc_id. A tree's nodes of all levels come from one recursion, and each leaf then
# climbs with its presented digest, first through its language's levels, then through those of the tree over the languages.
OP11_SQL = """
WITH RECURSIVE docs AS (SELECT *, coalesce(':' || lang, '') AS tree, coalesce(xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT)),
    lambda c, b: list_reduce(range(8), lambda a, i: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384::BIGINT) ELSE a // 2 END, xor(c, b)), 4294967295::BIGINT), 4294967295::BIGINT) % 3 = 0, false) AS tampered FROM documents),
shown AS (SELECT *, unnest([false, true]) AS again FROM docs),
parts AS (SELECT doc_id, tree, again, [CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR),
    CASE WHEN again AND tampered THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END] AS fields FROM shown),
digests AS (SELECT doc_id, tree, again, sha256(list_aggregate(list_transform(fields, lambda f: CASE WHEN f IS NULL THEN '-' ELSE CAST(strlen(f) AS VARCHAR) || ':' || f END), 'string_agg', '')) AS digest FROM parts),
leaves AS (SELECT a.doc_id, a.tree, a.digest AS leaf, b.digest AS presented, row_number() OVER (PARTITION BY a.tree ORDER BY a.doc_id) - 1 AS pos
    FROM digests a JOIN digests b USING (doc_id) WHERE NOT a.again AND b.again),
nodes(tree, level, pos, digest) AS (SELECT tree, 0, pos, leaf FROM leaves
    UNION ALL SELECT tree, level + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM nodes) WHERE n > 1 GROUP BY tree, level, pos // 8),
subroots AS (SELECT tree, arg_max(digest, level) AS subroot, max(level) AS height FROM nodes GROUP BY tree),
places AS (SELECT *, row_number() OVER (ORDER BY encode(tree)) - 1 AS place FROM subroots),
outer_nodes(level, pos, digest) AS (SELECT 0, place, subroot FROM places
    UNION ALL SELECT level + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER () AS n FROM outer_nodes) WHERE n > 1 GROUP BY level, pos // 8),
roots AS (SELECT arg_max(digest, level) AS root, max(level) AS outer_height FROM outer_nodes),
runs AS (SELECT tree, level, pos // 8 AS run, string_agg(digest, '' ORDER BY pos) AS text FROM nodes GROUP BY ALL),
outer_runs AS (SELECT level, pos // 8 AS run, string_agg(digest, '' ORDER BY pos) AS text FROM outer_nodes GROUP BY ALL),
climb AS (SELECT doc_id, leaf, presented, subroot, root, height, outer_height, l.tree, l.pos, place FROM leaves l JOIN places USING (tree), roots),
inner_steps AS (SELECT doc_id, c.tree, level AS step, text, CAST((c.pos >> (3 * level)) % 8 AS BIGINT) AS i FROM climb c JOIN runs r ON r.tree = c.tree AND level < height AND r.run = c.pos >> (3 * level + 3)),
outer_steps AS (SELECT doc_id, tree, height + level AS step, text, CAST((place >> (3 * level)) % 8 AS BIGINT) AS i FROM climb JOIN outer_runs r ON level < outer_height AND r.run = place >> (3 * level + 3)),
steps AS (SELECT doc_id, step, substr(text, 1, 64 * i) AS before, substr(text, 64 * i + 65) AS after FROM (SELECT * FROM inner_steps UNION ALL SELECT * FROM outer_steps)),
proofs AS (SELECT doc_id, string_agg(before || after, '' ORDER BY step) AS proof FROM steps GROUP BY doc_id),
folds(doc_id, step, digest) AS (SELECT doc_id, 0, presented FROM climb UNION ALL SELECT f.doc_id, f.step + 1, sha256(before || digest || after) FROM folds f JOIN steps s ON s.doc_id = f.doc_id AND s.step = f.step),
ends AS (SELECT doc_id, arg_max(digest, step) AS folded_root FROM folds GROUP BY doc_id)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM climb LEFT JOIN proofs USING (doc_id) JOIN ends USING (doc_id)
"""


def op12_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = piece_codec.encode(docs, PIECES, back=True)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2(F.col("text"), 256).alias("decoded_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, codec = vector_codes.compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return codes.select("vec_id", code.alias("code"), "error", "label_error", F.lit(hashlib.sha256(codec.text().encode()).hexdigest()).alias("codebooks_sha256"))


def _op13_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    apart = "list_sum(list_transform(list_zip(k.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    out = [
        "rows AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"k AS MATERIALIZED (SELECT vec_id, label, part, v[part * len(v) // {parts} + 1 : (part + 1) * len(v) // {parts}] AS v FROM rows, range({parts}) r(part))",
        f"b0 AS MATERIALIZED (SELECT part, entry, v FROM (SELECT part, v, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry FROM k) WHERE entry < {entries})",
    ]
    for n in range(rounds + 1):
        out.append(f"a{n} AS MATERIALIZED (SELECT vec_id, label, part, k.v, CAST(min(ROW({apart}, entry)) AS STRUCT(far BIGINT, entry BIGINT)) AS near FROM k JOIN b{n} b USING (part) GROUP BY vec_id, label, part, k.v)")
        if n < rounds:
            out.append(f"s{n} AS (SELECT part, near.entry AS entry, position, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT part, near, unnest(v) AS x, unnest(range(len(v))) AS position FROM a{n}) GROUP BY ALL)")
            out.append(f"m{n} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY position) AS v FROM s{n} GROUP BY part, entry)")
            out.append(f"b{n + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.v, b.v) AS v FROM b{n} b LEFT JOIN m{n} m USING (part, entry))")
    out.append(f"codes AS (SELECT vec_id, label, string_agg(lower(lpad(to_hex(near.entry), 2, '0')), '' ORDER BY part) AS code, CAST(sum(near.far) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id, label)")
    books = f"(SELECT sha256(string_agg(list_aggregate(v, 'string_agg', ','), ',' ORDER BY part, entry)) FROM b{rounds})"
    return f"WITH {', '.join(out)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, {books} AS codebooks_sha256 FROM codes"


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_near_dedup": op2_near_dedup,
    "op3_html_extraction": op3_html_extraction,
    "op4_packing": op4_packing,
    "op5_pii": op5_pii,
    "op6_decontamination": op6_decontamination,
    "op7_url_filter": op7_url_filter,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_language_id": op9_language_id,
    "op10_topk_search": op10_topk_search,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_piece_codec": op12_piece_codec,
    "op13_vector_codes": op13_vector_codes,
}

ORACLES = {"op7_url_filter": OP7_SQL, "op10_topk_search": OP10_SQL, "op11_merkle_manifest": OP11_SQL, "op13_vector_codes": _op13_sql()}
