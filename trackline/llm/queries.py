"""The registered queries of this subpackage, thin layers over its operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackline.llm import archive, bpe, html, lines, merkle, neardup, neighbours, packing, quality, sharding, suffixes, tokencount, whitening
from trackline.sources.tables import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return entries.select(
        "doc_id", *quality.MEASURES, "fail_bits",
        quality.base_failed().alias("base_failed"),
        (quality.verdict("base/1") & quality.verdict("prose/3")).alias("kept"),
    )


def op2_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"), F.lit("key").alias("law"))
    rows = sharding.assign(rows, ["doc_id"], sharding.topology(8))
    rows = sharding.assign(rows, ["doc_id"], sharding.topology(9), "grown_shard")
    rows = sharding.number_slots(rows, ["doc_id", "text_crc32", "size"])
    return rows.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op3_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, threshold=85)


def op4_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.deduplicate_lines(docs, exact_words=1).select("doc_id", "n_lines", "n_removed", "text")


def public_vocabulary(name: str) -> str:
    """The installed file of a public tokenizer; a parameter of the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_segment_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.encode_documents(docs, public_vocabulary("byte_bpe_50k.json"), ids=False, digests=True)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op6_grouping_genetic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pieces_of(table(spark, sf_dir, "documents"), public_vocabulary("word_bpe_49k.json"))
    return packing.pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = archive.plan_records(table(spark, sf_dir, "pages"))
    stored = archive.read_back(archive.normalise(archive.write_monolithic(records), remove=True), payloads=False)
    return stored.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_multi_index_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), queries=F.col("id") % 20 == 0, k=20)


def op9_block_rule_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op10_suffix_radix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.remove_repeated(table(spark, sf_dir, "documents"), length=400, unit="bytes")
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    lowered = F.translate("text", merkle.UPPER, merkle.LOWER)
    some = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return merkle.manifest(table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], {"text": lowered}, some)


def op12_pretoken_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tokencount.count_tokens(table(spark, sf_dir, "documents"), public_vocabulary("byte_bpe_50k.json"), ["doc_id"])
    return out.withColumn("over_limit", F.col("n_tokens") > 512)


def op13_refined_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op")}


ORACLE = {
    "op1_quality_rules": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
v AS (SELECT rid, i, list_aggregate(w[i:i+4], 'string_agg', ' ') AS win
      FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM v) WHERE n > 1),
c AS (SELECT rid, sum(least(5, nxt - i)) AS n FROM (SELECT rid, i, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i), i + 5) AS nxt FROM r) GROUP BY rid),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN c USING (rid)),
f AS (SELECT *, ((n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT + 4 * (n_symbols * 10 > n_words)::BIGINT
        + 8 * (word_chars < 2 * n_words)::BIGINT + 16 * (word_chars > 20 * n_words)::BIGINT
        + 32 * (n_lines > 3 AND 10 * n_dup_lines > 3 * n_lines)::BIGINT + 64 * (n_lines > 3 AND 10 * n_dup_lines > 5 * n_lines)::BIGINT)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, fail_bits,
  (fail_bits & 3) <> 0 AS base_failed, (fail_bits & 95) = 0 AS kept FROM f
""",
}


ORACLE["op7_warc_normaliser"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to FROM m
"""


ORACLE["op11_merkle_manifest"] = """
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || source, '') AS grp, text,
    coalesce(strlen(doc_id::VARCHAR)::VARCHAR || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source)::VARCHAR || ':' || source, '-')
      || coalesce(strlen(lang)::VARCHAR || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR)::VARCHAR || ':' || n_chars::VARCHAR, '-') AS head,
    list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(doc_id::VARCHAR) + 1),
        lambda i: [ord(substr(doc_id::VARCHAR, i, 1))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
      lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))) AS crc FROM documents),
e AS (SELECT rid, doc_id, grp, sha256(head || coalesce(strlen(text)::VARCHAR || ':' || text, '-')) AS leaf,
    CASE WHEN xor(crc, 4294967295) % 5 = 0 THEN sha256(head || coalesce(strlen(text)::VARCHAR || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS other FROM d),
num AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS n FROM e),
lv AS (SELECT 0 AS lvl, grp, idx, leaf AS h, n FROM num
  UNION ALL SELECT lvl + 1, grp, idx // 16, sha256(string_agg(h, '' ORDER BY idx)), max((n + 15) // 16) FROM lv WHERE n > 1 GROUP BY lvl, grp, idx // 16),
kids AS (SELECT lvl, grp, idx // 16 AS p, list(h ORDER BY idx) AS hs FROM lv WHERE n > 1 GROUP BY lvl, grp, idx // 16),
sub AS (SELECT grp, h AS subroot, row_number() OVER (ORDER BY grp) - 1 AS idx, count(*) OVER () AS n FROM lv WHERE n = 1),
tl AS (SELECT 0 AS lvl, idx, subroot AS h, n FROM sub
  UNION ALL SELECT lvl + 1, idx // 16, sha256(string_agg(h, '' ORDER BY idx)), max((n + 15) // 16) FROM tl WHERE n > 1 GROUP BY lvl, idx // 16),
tk AS (SELECT lvl, idx // 16 AS p, list(h ORDER BY idx) AS hs FROM tl WHERE n > 1 GROUP BY lvl, idx // 16),
f AS (SELECT rid, grp, 0 AS lvl, idx, coalesce(other, leaf) AS cur, '' AS sib FROM num
  UNION ALL SELECT rid, f.grp, f.lvl + 1, idx // 16, sha256(array_to_string(hs[1:idx % 16] || [cur] || hs[idx % 16 + 2:], '')),
    sib || array_to_string(hs[1:idx % 16] || hs[idx % 16 + 2:], '') FROM f JOIN kids k ON k.grp = f.grp AND k.lvl = f.lvl AND k.p = f.idx // 16),
g AS (SELECT rid, grp, max_by(cur, lvl) AS cur, max_by(sib, lvl) AS sib FROM f GROUP BY rid, grp),
u AS (SELECT rid, 0 AS lvl, idx, cur, sib FROM g JOIN sub USING (grp)
  UNION ALL SELECT rid, u.lvl + 1, idx // 16, sha256(array_to_string(hs[1:idx % 16] || [cur] || hs[idx % 16 + 2:], '')),
    sib || array_to_string(hs[1:idx % 16] || hs[idx % 16 + 2:], '') FROM u JOIN tk k ON k.lvl = u.lvl AND k.p = u.idx // 16),
v AS (SELECT rid, max_by(cur, lvl) AS folded_root, sha256(max_by(sib, lvl)) AS proof_sha256 FROM u GROUP BY rid)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified
FROM num JOIN v USING (rid) JOIN sub USING (grp) CROSS JOIN (SELECT h AS root FROM tl WHERE n = 1)
"""


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
