"""The operators applied to the whole given tables, with production parameters, and the SQL that some must equal."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import (
    exact_dedup,
    host_rules,
    language_id,
    licences,
    line_dedup,
    merkle,
    min_max_dedup,
    mixing,
    pii_segments,
    piece_transducer,
    prefix_trie,
    quality_mil,
    substring_dedup,
)

PIECE_MODEL = os.path.join(os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers"), "piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_min_max_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return min_max_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, mixing.source_rates(docs))


def op3_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op4_fm_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.drop_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op5_pii_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii_segments.find(docs, pii_segments.train(docs))
    return found.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans"
    )


def op6_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = host_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op7_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.report(table(spark, sf_dir, "documents"))


def op8_attention_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality_mil.score(docs, quality_mil.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality_mil.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op9_piece_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = piece_transducer.encode(table(spark, sf_dir, "documents"), PIECE_MODEL)
    return encoded.select("doc_id", "n_ids", "ids", "round_trip")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup.drop_frequent_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return cut.select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    picked = F.pmod(F.crc32(docs["doc_id"].cast("string")), F.lit(7)) == 0
    claimed = {f: docs[f] for f in merkle.FIELDS} | {"n_chars": docs["n_chars"] + F.when(picked, 1).otherwise(0)}
    manifest = merkle.build(docs, claimed=merkle.leaf(list(claimed.values())))
    return merkle.verified(manifest.proofs(), "claimed").select(
        F.col("id").alias("doc_id"), F.col("node").alias("leaf"), "subroot", "root",
        merkle.proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", "verified",
    )


def op12_language_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    told = language_id.identify(docs, language_id.train(docs))
    return told.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.rebuilt_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_min_max_dedup": op1_min_max_dedup,
    "op2_poisson_mix": op2_poisson_mix,
    "op3_licence_scan": op3_licence_scan,
    "op4_fm_index_dedup": op4_fm_index_dedup,
    "op5_pii_segments": op5_pii_segments,
    "op6_host_rules": op6_host_rules,
    "op7_stream_dedup": op7_stream_dedup,
    "op8_attention_mil": op8_attention_mil,
    "op9_piece_transducer": op9_piece_transducer,
    "op10_line_dedup": op10_line_dedup,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_language_families": op12_language_families,
    "op13_prefix_trie": op13_prefix_trie,
}

_BLANK = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
#: CRC-32 of a decimal number, from a table of 256 entries that is made by the polynomial.
_CRC_TABLE = """crc_table AS (
  SELECT list(v ORDER BY n) AS crcs FROM (
    SELECT n, list_reduce(list_concat([n], range(8)),
      lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v
    FROM range(256) AS bytes(n)))"""


def _crc(number: str) -> str:
    return f"""xor(4294967295, list_reduce(
      list_concat([4294967295::BIGINT], list_transform(string_split({number}::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])))"""


def _sized(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLES: dict[str, str] = {
    "op2_poisson_mix": """
WITH RECURSIVE sizes AS (
  SELECT source, sum(length(coalesce(text, '')))::BIGINT AS size FROM documents GROUP BY source),
total AS (SELECT sum(size)::DOUBLE AS size, sum(sqrt(size::DOUBLE)) AS weight FROM sizes),
rates AS (SELECT source, CASE WHEN s.size = 0 THEN 1.0
    ELSE (t.size / t.weight) * sqrt(s.size::DOUBLE) / s.size END AS rate FROM sizes s, total t),
terms(source, rate, k, term, below) AS (
  SELECT source, rate, 0, -rate, exp(-rate) FROM rates
  UNION ALL
  SELECT source, rate, k + 1, term + ln(rate) - ln((k + 1)::DOUBLE), below + exp(term + ln(rate) - ln((k + 1)::DOUBLE))
  FROM terms WHERE rate > 0 AND k < ceil(rate + 10 * sqrt(rate) + 20)),
drawn AS (
  SELECT d.*, (('0x' || substr(md5('7:' || doc_id), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u FROM documents d),
counted AS (
  SELECT d.doc_id, d.u, count(*) FILTER (WHERE t.below < d.u) AS n
  FROM drawn d JOIN terms t ON d.source IS NOT DISTINCT FROM t.source GROUP BY d.doc_id, d.u)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, c.copy::INTEGER AS copy,
  md5('order-7:' || d.doc_id || ':' || c.copy) AS shuffle_key
FROM documents d JOIN (SELECT doc_id, unnest(range(n)) AS copy FROM counted) c USING (doc_id)""",
    "op6_host_rules": r"""
WITH split_up AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
places AS (
  SELECT doc_id, unnest(range(1, len(words) - 6)) AS i, words FROM split_up WHERE len(words) >= 8),
runs AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS run FROM places),
twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, run) AS n FROM runs) WHERE n > 1),
covered AS (
  SELECT doc_id, sum(least(8, coalesce(following - i, 8)))::BIGINT AS n FROM (
    SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS following FROM twice) GROUP BY doc_id),
measured AS (
  SELECT s.doc_id, s.source, len(words)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM split_up s LEFT JOIN covered c USING (doc_id)),
failing AS (
  SELECT *, n_words < 20 AS f1, 100 * n_repeat_words > 30 * n_words AS f2, 100 * n_symbols > 10 * word_chars AS f3,
    100 * n_dup_lines > 30 * n_lines AS f4, (word_chars < 2 * n_words OR word_chars > 12 * n_words) AS f5
  FROM measured),
hosts AS (
  SELECT source, rule, count(*) AS n, count(*) FILTER (WHERE failed) AS k
  FROM (SELECT source, unnest([1, 2, 3, 4, 5]) AS rule, unnest([f1, f2, f3, f4, f5]) AS failed FROM failing)
  GROUP BY source, rule),
moments AS (
  SELECT rule, sum(k) / sum(n) AS m, coalesce(var_samp(k / n), 0) AS spread, avg(1.0 / n) AS noise
  FROM hosts GROUP BY rule),
prior AS (SELECT rule, m, spread - m * (1 - m) * noise AS between_hosts FROM moments),
fitted AS (
  SELECT h.*, m, between_hosts, CASE
    WHEN between_hosts > 0 AND m * (1 - m) > between_hosts THEN m * (1 - m) / between_hosts - 1 END AS strength
  FROM hosts h JOIN prior USING (rule)),
posterior AS (SELECT *, k + strength * m AS a, n - k + strength * (1 - m) AS b FROM fitted),
rejected AS (
  SELECT source, bool_or(CASE
    WHEN strength IS NOT NULL THEN a / (a + b) - 2.0 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > 0.5
    WHEN between_hosts > 0 THEN k / n > 0.5 ELSE m > 0.5 END) AS bad
  FROM posterior GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f1 OR f2 AS base_failed,
  NOT (f1 OR f2) AND NOT bad AS kept
FROM failing f JOIN rejected r ON f.source IS NOT DISTINCT FROM r.source""",
    "op7_stream_dedup": r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM n""",
    "op10_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
keyed AS (SELECT *, translate(trim(line, {_BLANK}), '{_UP}', '{_LOW}') AS key FROM lines),
frequent AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT k.*, f.key IS NOT NULL AS gone FROM keyed k LEFT JOIN frequent f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op11_merkle_manifest": f"""
WITH RECURSIVE {_CRC_TABLE},
leaves AS (
  SELECT doc_id, lang, sha256({' || '.join(_sized(c) for c in ('doc_id', 'source', 'lang', 'n_chars', 'text'))}) AS leaf,
    sha256({_sized('doc_id')} || {_sized('source')} || {_sized('lang')} ||
      {_sized(f"(n_chars + CASE WHEN {_crc('doc_id')} % 7 = 0 THEN 1 ELSE 0 END)")} || {_sized('text')}) AS claimed
  FROM documents, crc_table),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
    dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM leaves),
levels(tree, l, nodes) AS (
  SELECT tree, 0, list(leaf ORDER BY i) FROM placed GROUP BY tree
  UNION ALL
  SELECT tree, l + 1,
    list_transform(range(1, len(nodes) + 1, 2), lambda j: sha256(nodes[j] || coalesce(nodes[j + 1], '')))
  FROM levels WHERE len(nodes) > 1),
subroots AS (SELECT tree, nodes[1] AS subroot FROM levels WHERE len(nodes) = 1),
tops(l, nodes) AS (
  SELECT 0, list(subroot ORDER BY tree) FROM subroots
  UNION ALL
  SELECT l + 1, list_transform(range(1, len(nodes) + 1, 2), lambda j: sha256(nodes[j] || coalesce(nodes[j + 1], '')))
  FROM tops WHERE len(nodes) > 1),
steps AS (
  SELECT p.tree, p.i, v.l, (p.i >> v.l) & 1 AS odd, coalesce(v.nodes[xor(p.i >> v.l, 1) + 1], '') AS beside
  FROM placed p JOIN levels v ON p.tree = v.tree AND len(v.nodes) > 1
  UNION ALL
  SELECT p.tree, p.i, 1000 + t.l, (p.tree >> t.l) & 1, coalesce(t.nodes[xor(p.tree >> t.l, 1) + 1], '')
  FROM placed p, tops t WHERE len(t.nodes) > 1),
proofs AS (
  SELECT tree, i, string_agg(beside, '' ORDER BY l) AS proof,
    list(CASE WHEN odd = 1 THEN 'l' ELSE 'r' END || beside ORDER BY l) AS path
  FROM steps GROUP BY tree, i),
folding AS (
  SELECT p.doc_id, p.leaf, s.subroot, (SELECT nodes[1] FROM tops WHERE len(nodes) = 1) AS root,
    sha256(coalesce(f.proof, '')) AS proof_sha256,
    list_reduce(list_concat([p.claimed], coalesce(f.path, [])), lambda node, s:
      sha256(CASE WHEN s[1] = 'l' THEN s[2:] || node ELSE node || s[2:] END)) AS folded_root
  FROM placed p JOIN subroots s USING (tree) LEFT JOIN proofs f USING (tree, i))
SELECT *, folded_root = root AS verified FROM folding""",
    "op13_prefix_trie": f"""
WITH {_CRC_TABLE},
turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, list({{'code': strlen(role) || ':' || role || strlen(text) || ':' || text, 'chars': length(text)}}
    ORDER BY turn NULLS FIRST, role, md5(text)) AS turns FROM turns GROUP BY conv_id),
shared AS (SELECT own.*, {_crc('conv_id')} % 6 AS h FROM own, crc_table),
rebuilt AS (
  SELECT s.conv_id, list_concat(coalesce(b.turns, [])[1:s.h], s.turns[s.h + 1:]) AS turns
  FROM shared s LEFT JOIN own b ON b.conv_id = s.conv_id - s.conv_id % 100),
prefixes AS (
  SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS depth FROM rebuilt),
keyed AS (
  SELECT conv_id, depth, len(turns) AS total, list_transform(turns[1:depth], lambda t: t.code) AS codes,
    coalesce(turns[depth].chars, 0) AS chars FROM prefixes),
nodes AS (
  SELECT depth, codes, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE total = depth), '')) AS ends_sha256
  FROM keyed GROUP BY depth, codes),
children AS (SELECT depth - 1 AS depth, codes[1:depth - 1] AS codes, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
counted AS (
  SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c USING (depth, codes)),
spread AS (
  SELECT unnest(range(depth + 1)) AS above, codes, n_children, (n_convs - 1) * chars AS saved FROM counted),
sums AS (
  SELECT above AS depth, codes[1:above] AS codes, count(*) FILTER (WHERE n_children = 0) AS n_leaves,
    sum(saved)::BIGINT AS saved_tokens FROM spread GROUP BY ALL)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM counted n JOIN sums s USING (depth, codes)
LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.codes = n.codes[1:n.depth - 1]""",
}
