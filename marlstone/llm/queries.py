"""The registered queries of the training-data operators, and their SQL where DuckDB can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents"))[0]


def op3_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc_zip import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents")).drop("row")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan

    return scan(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import similarity_join

    return similarity_join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "set_id", "n_links", "n_classes")


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import score

    scored = score(table(spark, sf_dir, "documents"))
    return scored.withColumns({k: F.round(k, 6) for k in ("base_score", "score")})


def lm_base_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of op9."""
    return op9_lm_score(spark, sf_dir).drop("score")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fit, held_out, identify

    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit(docs), keep={"doc_id": docs["doc_id"], "held_out": held_out(docs["doc_id"], 3)})
    return found.withColumn("score", F.round("score", 6))


def language_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of op10."""
    return op10_language_id(spark, sf_dir).select("doc_id", "held_out", (F.col("lang_pred") == "und").alias("undetermined"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extract": op1_html_extract,
    "op2_mix_sources": op2_mix_sources,
    "op3_warc_zip": op3_warc_zip,
    "op4_decontaminate": op4_decontaminate,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_license_scan": op6_license_scan,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_lm_score": op9_lm_score,
    "op10_language_id": op10_language_id,
    "lm_base_score": lm_base_score,
    "language_folds": language_folds,
}

ORACLE_SQL: dict[str, str] = {}

#: CRC-32 of a text of ASCII characters.
_CRC = """
tab AS (
  SELECT list_transform(range(0, 256), lambda i: list_reduce([i::UBIGINT] || list_transform(range(0, 8), lambda k: 0::UBIGINT),
           lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)) AS t),
crc AS (
  SELECT *, xor(list_reduce([4294967295::UBIGINT] || list_transform(range(1, length(coalesce(doc_id::VARCHAR, '')) + 1), lambda k: ascii(substr(doc_id::VARCHAR, k, 1))::UBIGINT),
           lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)::INTEGER])), 4294967295::UBIGINT) AS crc
  FROM documents, tab)"""

ORACLE_SQL["lm_base_score"] = rf"""
WITH {_CRC},
word AS (
  SELECT row, doc_id, held_out,
         unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') || ['\n']) AS w
  FROM (SELECT *, row_number() OVER () AS row, crc % 5 = 1 AS held_out FROM crc)),
seen AS (SELECT w, count(*) AS c FROM word WHERE NOT held_out GROUP BY w),
size AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM seen)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, n AS train_tokens,
       round(sum(log10((coalesce(c, 0) + 0.5e0) / (n + 0.5e0 * (v + 1)))), 6) AS base_score
FROM word LEFT JOIN seen USING (w), size GROUP BY row, doc_id, held_out, n
"""

ORACLE_SQL["language_folds"] = rf"""
WITH {_CRC}
SELECT doc_id, crc % 3 = 1 AS held_out, NOT regexp_matches(coalesce(text, ''), '\p{{L}}') AS undetermined FROM crc
"""

ORACLE_SQL["op3_warc_zip"] = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first, (unhex(hex)::BIT)::VARCHAR AS bits FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (1 + list_sum(list_transform(range(0, 5), lambda j: CASE WHEN bits[5 * k + j + 1] = '1' THEN 1 << (4 - j)::INTEGER ELSE 0 END)))::INTEGER, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM q
"""

ORACLE_SQL["op5_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

ORACLE_SQL["op4_decontaminate"] = r"""
WITH item AS (
  SELECT coalesce(item_id::VARCHAR, 'null') AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, n, w[s : s + n - 1] AS win
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM item WHERE len(w) > 0)),
doc AS (
  SELECT doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
span AS (
  SELECT doc_id, n, p, w[p : p + n - 1] AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM doc, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, p, span.n FROM span JOIN win ON span.n = win.n AND span.win = win.win),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

ORACLE_SQL["op2_mix_sources"] = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5e0, 2e0, 1e0][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3] AS weight
  FROM d GROUP BY source),
r AS (SELECT *, 2e0 * source_size AS cap, 2e0 * source_size / weight AS ratio FROM s),
f AS (
  SELECT *, (1.5e0 * sum(source_size) OVER () - coalesce(sum(cap) OVER full_ones, 0e0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER full_ones, 0e0)) AS level
  FROM r WINDOW full_ones AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size,
         least(cap, coalesce((SELECT arg_min(level, ratio) FROM f WHERE level <= ratio) * weight, cap)) AS target
  FROM f),
p AS (SELECT *, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS key, floor(target)::BIGINT AS words, greatest(source_size, 1) AS sz FROM t),
q AS (SELECT *, words % sz AS rest, least(8192, greatest(64, (sum(words) OVER ())::BIGINT >> 14)) AS block FROM p),
plan AS (
  SELECT *, (sz + block - 1) // block AS blocks, (words // sz) * ((sz + block - 1) // block) + (rest + block - 1) // block AS turns,
         CASE WHEN rest > 0 THEN rest - ((rest + block - 1) // block - 1) * block ELSE 0 END AS cut
  FROM q),
share AS (
  SELECT *, slots, upto / slots::DOUBLE AS hi, (upto - turns) / slots::DOUBLE AS lo
  FROM (SELECT *, (sum(turns) OVER (ORDER BY key))::BIGINT AS upto, (sum(turns) OVER ())::BIGINT AS slots FROM plan) WHERE turns > 0),
point AS (SELECT slot, (slot + 1) * 0.6180339887498949e0 - floor((slot + 1) * 0.6180339887498949e0) AS u FROM (SELECT unnest(range(max(slots))) AS slot FROM share)),
drawn AS (SELECT slot, key, turns, slots, row_number() OVER (PARTITION BY key ORDER BY slot) - 1 AS turn FROM point JOIN share ON u >= lo AND u < hi),
late AS (
  SELECT turn + slots AS slot, key, turn
  FROM (SELECT key, slots, unnest(range(coalesce((SELECT count(*) FROM drawn WHERE drawn.key = share.key), 0), turns)) AS turn FROM share)),
slot AS (
  SELECT slot, key, block, turn % blocks AS nth, CASE WHEN turn = turns - 1 AND cut > 0 THEN cut ELSE least(block, source_size - (turn % blocks) * block) END AS long
  FROM (SELECT slot, key, turn FROM drawn WHERE turn < turns UNION ALL SELECT slot, key, turn FROM late) JOIN plan USING (key)),
line AS (
  SELECT row_number() OVER () AS row, d.*, t.key, t.source_size, t.target, block,
         (sum(size) OVER (PARTITION BY d.source ORDER BY h, size ROWS UNBOUNDED PRECEDING))::BIGINT - size AS start
  FROM d JOIN plan t ON d.source IS NOT DISTINCT FROM t.source),
piece AS (SELECT *, unnest(range(start // block, (start + greatest(size, 1) - 1) // block + 1)) AS nth FROM line),
took AS (
  SELECT piece.*, slot, greatest(0, least(piece.block, start + size - piece.nth * piece.block, coalesce(long, 0)) - greatest(0, start - piece.nth * piece.block)) AS took
  FROM piece LEFT JOIN slot ON piece.key = slot.key AND piece.nth = slot.nth)
SELECT doc_id, size, source_size, target, sum(took)::BIGINT AS taken, min(slot) FILTER (took > 0) AS first_slot, max(slot) FILTER (took > 0) AS last_slot
FROM took GROUP BY row, doc_id, size, source_size, target
"""

ORACLE_SQL["op8_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(ws[p : p + n - 1], ' ')) AS g
  FROM (SELECT doc_id, ws, least(5, len(ws)) AS n, unnest(range(1, len(ws) - least(5, len(ws)) + 2)) AS p FROM w WHERE len(ws) > 0)),
sets AS (SELECT doc_id, count(*) AS size, md5(string_agg(g, ' ' ORDER BY g)) AS key FROM s GROUP BY doc_id),
named AS (SELECT doc_id, size, min(doc_id) OVER (PARTITION BY key) AS set_id FROM sets),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b, y.set_id AS other, x.set_id AS own
  FROM met JOIN named x ON a = x.doc_id JOIN named y ON b = y.doc_id
  WHERE shared >= 0.8e0 * (x.size + y.size - shared) - 1e-9),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
classes AS (SELECT a, least(a, min(b)) AS class_id FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n_links, count(DISTINCT other) FILTER (other <> own) AS n_classes FROM links GROUP BY a)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(set_id, doc_id) AS set_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(n_classes, 0)::BIGINT AS n_classes
FROM documents LEFT JOIN named USING (doc_id) LEFT JOIN classes ON doc_id = classes.a LEFT JOIN counts ON doc_id = counts.a
"""

ORACLE_SQL["op7_substring_dedup"] = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(string_split(regexp_replace(regexp_replace(coalesce(text, ''), '([.!?。！？])([ \t\r\f\v]+)', '\1\2' || chr(1), 'g'), '\s*\n\s*', '\0' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS parts
  FROM documents),
cut AS (
  SELECT doc_id, text, list_filter(flatten(list_transform(parts, lambda s: CASE
           WHEN len(list_filter(regexp_split_to_array(s, '\s+'), lambda x: x <> '')) > 24
           THEN string_split(list_aggregate(list_transform(regexp_extract_all(s, '\s*\S+\s*'),
                  lambda x: x || CASE WHEN md5(lower(trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))))[-1] IN ('0', '8') THEN chr(1) ELSE '' END), 'string_agg', ''), chr(1))
           ELSE [s] END)), lambda x: x <> '') AS parts
  FROM t),
p AS (
  SELECT doc_id, k, parts[k] AS piece, list_filter(regexp_split_to_array(lower(parts[k]), '\s+'), lambda x: x <> '') AS ws
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS k FROM cut)),
u AS (SELECT doc_id, k, piece, array_to_string(ws, ' ') AS norm, len(ws) AS n, sum(len(ws)) OVER (PARTITION BY doc_id ORDER BY k)::BIGINT AS upto FROM p),
edges AS (SELECT doc_id, k, upto FROM u UNION ALL SELECT DISTINCT doc_id, 0, 0 FROM u),
ahead AS (
  SELECT a.doc_id, a.k AS s, greatest(min(b.k), a.k + 2) AS e
  FROM edges a ASOF JOIN (SELECT doc_id, upto, min(k) AS k FROM edges GROUP BY ALL) b ON a.doc_id = b.doc_id AND a.upto + 16 <= b.upto GROUP BY a.doc_id, a.k),
back AS (
  SELECT a.doc_id, least(max(b.k), a.k - 2) AS s, a.k AS e
  FROM edges a ASOF JOIN (SELECT doc_id, upto, max(k) AS k FROM edges GROUP BY ALL) b ON a.doc_id = b.doc_id AND a.upto - 16 >= b.upto WHERE a.k > 0 GROUP BY a.doc_id, a.k),
span AS (
  SELECT doc_id, s, e FROM ahead UNION SELECT doc_id, s, e FROM back WHERE s >= 0 UNION SELECT doc_id, k - 1, k FROM u WHERE n >= 20),
run AS (
  SELECT span.doc_id, s, e, count(*) || ' ' || string_agg(norm, chr(1) ORDER BY k) AS h
  FROM span JOIN u ON span.doc_id = u.doc_id AND k > s AND k <= e GROUP BY span.doc_id, s, e HAVING count(*) = e - s),
again AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, h ORDER BY s) AS nth, min(doc_id) OVER (PARTITION BY h) AS first FROM run),
gone AS (SELECT DISTINCT again.doc_id, k FROM again JOIN u ON again.doc_id = u.doc_id AND k > s AND k <= e WHERE nth > 1 OR again.doc_id <> first),
done AS (
  SELECT u.doc_id, count(*) AS n_sentences, count(gone.k) AS n_removed, sum(CASE WHEN gone.k IS NOT NULL THEN n ELSE 0 END)::BIGINT AS words_removed,
         string_agg(piece, '' ORDER BY u.k) FILTER (gone.k IS NULL) AS kept
  FROM u LEFT JOIN gone ON u.doc_id = gone.doc_id AND u.k = gone.k GROUP BY u.doc_id)
SELECT doc_id, coalesce(n_sentences, 0)::BIGINT AS n_sentences, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(words_removed, 0)::BIGINT AS words_removed,
       CASE WHEN coalesce(n_removed, 0) = 0 THEN text ELSE trim(coalesce(kept, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) END AS text
FROM t LEFT JOIN done USING (doc_id)
"""
