"""The registered queries of this package, one per operator, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .conversation_repair import damage, repair_conversations
from .decontamination import find_items
from .html_extraction import extract_main_text
from .jaccard_join import jaccard_join
from .license_scan import scan_licenses
from .line_dedup import dedup_lines
from .lm_scoring import lm_scores
from .minhash_dedup import near_duplicates
from .mixing import mix_sources, taken
from .pii import replace_pii
from .quality_classifier import fit, fold, score
from .quality_rules import quality_rules
from .spelling_variants import spelling_forms, word_counts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the class of its near copies and its links to other texts."""
    return jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies", "is_first")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pseudo-log-likelihood of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm_scores(docs).select("doc_id", "n_tokens", "log_likelihood", "mean_log_prob")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of all documents takes of each."""
    return taken(mix_sources(table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken", "first_shard")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that many sources share."""
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "lines_removed", "words_left")


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data and secrets replaced."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return replace_pii(docs, key="surrogates-1").select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"), F.col("entities.kind").alias("kinds"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the benchmark items that it holds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_items(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.size("matches") > 0).alias("contaminated"), F.col("matches.item_id").alias("item_ids"), F.array_max("matches.similarity").alias("similarity"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the licenses that it holds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan_licenses(docs)
    return found.select("doc_id", F.col("licenses.license_id").alias("license_ids"), F.col("licenses.coverage").alias("coverages"), F.col("licenses.first_word").alias("first_words"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of every document and whether it is kept."""
    return quality_rules(table(spark, sf_dir, "documents")).drop("rkey")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every damaged conversation with its cheapest repair."""
    rows = table(spark, sf_dir, "conversations")
    return repair_conversations(damage(rows), rows)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the corpus with the form and the root that it is a variant of."""
    return spelling_forms(word_counts(table(spark, sf_dir, "documents"), damaged_in=31).where("n >= 2"))


def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the component of its near copies."""
    return near_duplicates(table(spark, sf_dir, "documents")).drop("rkey")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_source_mixing": op3_source_mixing,
    "op4_line_dedup": op4_line_dedup,
    "op5_pii_surrogates": op5_pii_surrogates,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_license_scan": op8_license_scan,
    "op9_quality_rules": op9_quality_rules,
    "op10_html_extraction": op10_html_extraction,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_minhash_dedup": op13_minhash_dedup,
}

_WORDS = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)"
_SWAP = "".join(
    f"""
, r{r + 1} AS (SELECT * REPLACE (CASE WHEN substr(md5(concat_ws('|', 'mix-1', src, turn, {r}, greatest(place, (((k{r} - place) % blocks) + blocks) % blocks))), 1, 1) < '8'
    THEN (((k{r} - place) % blocks) + blocks) % blocks ELSE place END AS place) FROM r{r})"""
    for r in range(6)
)

ORACLE_SQL: dict[str, str] = {
    "op3_source_mixing": f"""
WITH d AS (SELECT doc_id, source, coalesce('=' || source, '~') AS src, substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 3) AS bucket, CAST({_WORDS} AS BIGINT) AS size FROM documents)
, place AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY src ORDER BY bucket, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d)
, s0 AS (SELECT src, any_value(source) AS source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY src)
, s1 AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight, source_size * 3.0::DOUBLE AS most, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM s0)
, s2 AS (SELECT *, (total - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0::DOUBLE))
    / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s1)
, s3 AS (SELECT *, max(CASE WHEN NOT most < weight * level THEN level END) OVER () AS shared FROM s2)
, s4 AS (SELECT src, source_size, CASE WHEN most < weight * level THEN most ELSE least(most, weight * shared) END AS target, CAST(ceil(source_size / 128) AS BIGINT) AS blocks FROM s3)
, s5 AS (SELECT *, CAST(CASE WHEN source_size > 0 THEN least(floor(target * blocks / source_size + 0.5::DOUBLE), blocks * 3) ELSE 0 END AS BIGINT) AS quota FROM s4)
, s AS (SELECT *, CAST(sum(quota) OVER (ORDER BY src) - quota AS BIGINT) AS off, CAST(sum(quota) OVER () AS BIGINT) AS total FROM s5)
, m AS (SELECT max(total) AS total, CAST(greatest(1, (max(total) + 63) // 64) AS BIGINT) AS per FROM s)
, g AS (SELECT g // per AS shard, CAST(('0x' || substr(md5('mix-1|draw|' || g), 1, 15)) AS BIGINT) % total AS d FROM (SELECT per, total, unnest(range(total)) AS g FROM m))
, c AS (SELECT shard, src, any_value(quota) AS quota, count(*) AS n FROM g JOIN s ON d >= off AND d < off + quota GROUP BY ALL)
, c1 AS (SELECT *, CAST(sum(n) OVER (PARTITION BY src) AS BIGINT) AS every, CAST(sum(n) OVER (PARTITION BY src ORDER BY shard) AS BIGINT) AS high FROM c)
, own AS (SELECT src, shard, high - n - floor(greatest(every - quota, 0) * (high - n) / every) AS low, high - floor(greatest(every - quota, 0) * high / every) AS high FROM c1)
, room AS (SELECT k AS shard, CAST(least(per, total - k * per) - coalesce(o.n, 0) AS BIGINT) AS n FROM (SELECT per, total, unnest(range((total + per - 1) // per)) AS k FROM m) LEFT JOIN (SELECT shard, sum(high - low) AS n FROM own GROUP BY shard) o ON o.shard = k)
, open_in AS (SELECT shard, row_number() OVER (ORDER BY shard) AS unit FROM (SELECT shard, unnest(range(n)) FROM room))
, lack AS (SELECT src, slot, row_number() OVER (ORDER BY src, slot) AS unit FROM (SELECT s.src, unnest(range(CAST(coalesce(o.n, 0) AS BIGINT), quota)) AS slot FROM s LEFT JOIN (SELECT src, max(high) AS n FROM own GROUP BY src) o USING (src)))
, j AS (SELECT src, shard, unnest(range(CAST(low AS BIGINT), CAST(high AS BIGINT))) AS slot FROM own UNION ALL SELECT src, shard, slot FROM lack JOIN open_in USING (unit))
, r0 AS (SELECT j.src, blocks, slot, slot // blocks AS turn, slot % blocks AS place, shard,
    {", ".join(f"CAST(('0x' || substr(md5('mix-1|' || src || '|key|{r}'), 1, 15)) AS BIGINT) % blocks AS k{r}" for r in range(6))} FROM j JOIN s USING (src)){_SWAP}
, draws AS (SELECT src, place AS block, count(*) AS times, min(shard) AS shard FROM r6 GROUP BY ALL)
, met AS (SELECT p.*, unnest(CASE WHEN size > 0 THEN range(CAST(start // 128 AS BIGINT), CAST((start + size - 1) // 128 + 1 AS BIGINT)) ELSE [NULL::BIGINT] END) AS block FROM place p)
SELECT m.doc_id, m.size, s.source_size, s.target, CAST(coalesce(sum((least(m.start + m.size, (m.block + 1) * 128) - greatest(m.start, m.block * 128)) * d.times), 0) AS BIGINT) AS taken, CAST(min(d.shard) AS INTEGER) AS first_shard
FROM met m JOIN s USING (src) LEFT JOIN draws d ON d.src = m.src AND d.block = m.block GROUP BY m.doc_id, m.src, m.bucket, m.start, m.size, s.source_size, s.target
""",
    "op4_line_dedup": r"""
WITH cut AS (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents)
, raw AS (SELECT doc_id, source, unnest(range(len(parts))) AS pos, unnest(parts) AS line FROM cut)
, lines AS (SELECT doc_id, source, pos, lower(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13))) AS line FROM raw)
, common AS (SELECT line FROM lines WHERE length(line) >= 20 GROUP BY line HAVING count(DISTINCT source) >= 6)
, hits AS (SELECT l.*, row_number() OVER (PARTITION BY line ORDER BY doc_id NULLS LAST, pos) AS k FROM lines l SEMI JOIN common c ON l.line = c.line)
, kept AS (SELECT r.doc_id, string_agg(CASE WHEN h.pos IS NULL THEN r.line END, chr(10) ORDER BY r.pos) AS text, count(h.pos) AS lines_removed FROM raw r LEFT JOIN (SELECT * FROM hits WHERE k > 1) h ON h.doc_id = r.doc_id AND h.pos = r.pos GROUP BY r.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, CAST(coalesce(k.lines_removed, 0) AS BIGINT) AS lines_removed,
    coalesce(regexp_matches(CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END, '[^ 	-
]'), false) AS words_left
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
""",
    "op9_quality_rules": r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)
, win AS (SELECT doc_id, unnest(range(greatest(len(w) - 7, 0))) AS i, w FROM d)
, keyed AS (SELECT doc_id, i, md5(array_to_string(w[i + 1 : i + 8], ' ')) AS k FROM win)
, rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM keyed) WHERE c > 1) GROUP BY doc_id)
, line AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS raw FROM d)
, full_line AS (SELECT doc_id, source, raw, regexp_extract_all(raw, '[^\x20\x09-\x0D]+') AS w FROM line WHERE regexp_matches(raw, '[^\x20\x09-\x0D]'))
, dup AS (SELECT doc_id, count(*) - count(DISTINCT raw) AS n FROM full_line GROUP BY doc_id)
, own AS (SELECT doc_id, source, array_to_string(w, ' ') AS norm, sum(len(w)) AS words FROM full_line GROUP BY ALL)
, host AS (SELECT source, count(*) AS docs FROM d GROUP BY source)
, often AS (SELECT o.source, norm FROM own o JOIN host h ON h.source IS NOT DISTINCT FROM o.source GROUP BY ALL HAVING count(*) > 30 AND count(*) * 100 > max(h.docs))
, cut AS (SELECT o.doc_id, sum(o.words) AS n FROM own o JOIN often f ON f.norm = o.norm AND f.source IS NOT DISTINCT FROM o.source GROUP BY o.doc_id)
, r AS (SELECT d.doc_id, len(d.w) AS n_words, length(array_to_string(d.w, '')) AS word_chars, length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, CAST(coalesce(cut.n, 0) AS BIGINT) AS removed_words
    FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN cut USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, removed_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_words - removed_words >= n_words * 0.5 AS kept FROM r
""",
    # Of pages as the given tables have them: one article, its blocks in p and h1 elements, and four named references.
    "op10_html_extraction": r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS t FROM pages)
, b AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(t, '\s+', ' ', 'g'), '<(/?b|br)>', ' ', 'g'), '<[^>]*>', chr(10), 'g') AS t FROM a)
, c AS (SELECT page_id, url, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(
    replace(replace(replace(replace(x, '&quot;', '"'), '&quot', '"'), '&amp;', '&'), '&amp', '&'), '\s+', ' ', 'g'))), lambda x: x <> '') AS blocks FROM b)
SELECT page_id, url, array_to_string(blocks, chr(10)) AS text, CAST(length(array_to_string(blocks, chr(10))) AS BIGINT) AS n_chars FROM c
""",
    # The cheapest way to each state after each turn: what may follow is decided by the last role alone.  crc32 by its table of 256 values.
    "op11_conversation_repair": r"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i)) AS t)
, kind AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c, x: xor(c >> 8, t[1 + xor(c & 255, CAST(unicode(x) AS BIGINT))]), 4294967295), 4294967295) % 20 AS d FROM conversations, crc)
, damaged AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE d WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM kind)
, turns AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS k, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS ends FROM damaged)
, f AS MATERIALIZED (SELECT *, substr(role, 1, 1) AS i, CASE WHEN ends = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate' WHEN ends NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'fine' END AS fault,
    CASE WHEN k > 1 THEN lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY k) || substr(role, 1, 1) NOT IN ('su', 'ua', 'au') ELSE false END AS illegal FROM turns)
, one(st, st2, said) AS (VALUES ('0', 'u', 'user'), ('s', 'u', 'user'), ('a', 'u', 'user'), ('u', 'a', 'assistant'))
, ins AS (SELECT st, 0 AS n, st AS st2, '' AS said FROM one UNION ALL SELECT st, 1, st2, chr(10) || said || ':' FROM one UNION ALL SELECT x.st, 2, y.st2, chr(10) || x.said || ':' || chr(10) || y.said || ':' FROM one x JOIN one y ON y.st = x.st2)
, r AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS k, '0' AS st, 0 AS cost, '' AS audit, '' AS made FROM f UNION ALL SELECT conv_id, k, st, cost, audit, made FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, st ORDER BY cost, audit) AS best FROM (
    SELECT f.conv_id, f.k, CASE e WHEN 'D' THEN ins.st2 WHEN 'K' THEN f.i ELSE one.st2 END AS st, CAST(r.cost + 3 * n + CASE e WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN e <> 'D' AND fault = 'truncated' THEN 3 ELSE 0 END AS INTEGER) AS cost, r.audit || repeat('I', n) || e AS audit,
        r.made || ins.said || CASE e WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || f.role || ':' || f.text ELSE chr(10) || one.said || ':' || f.text END AS made
    FROM r JOIN f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.k = r.k + 1 JOIN ins ON ins.st = r.st JOIN one ON one.st = ins.st2, (VALUES ('D'), ('K'), ('R')) AS edit(e)
    WHERE e = 'D' OR (fault NOT IN ('blank', 'duplicate') AND (e = 'R' OR f.i = one.st2 OR (f.i = 's' AND ins.st2 = '0'))))) WHERE best = 1)
, n AS (SELECT conv_id, count(*) AS n, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal FROM f GROUP BY conv_id)
, z AS (SELECT r.conv_id, r.cost + 3 * ins.n AS cost, r.audit || repeat('I', ins.n) AS audit, substr(r.made || ins.said, 2) AS made FROM r JOIN n ON n.conv_id IS NOT DISTINCT FROM r.conv_id AND n.n = r.k JOIN ins ON ins.st = r.st WHERE ins.st2 IN ('0', 'a') QUALIFY row_number() OVER (PARTITION BY r.conv_id ORDER BY r.cost + 3 * ins.n, r.audit || repeat('I', ins.n)) = 1)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(made, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM c.conv_id
""",
    # crc32 by its table of 256 values, over the UTF-8 bytes of letters below U+0100.
    "op12_spelling_variants": r"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i)) AS t)
, runs AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents) WHERE length(run) >= 7 GROUP BY ALL)
, coded AS (SELECT run, n, list_reduce(flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [192 | (unicode(x) >> 6), 128 | (unicode(x) & 63)] END)),
    lambda c, b: xor(c >> 8, t[1 + xor(c & 255, CAST(b AS BIGINT))]), 4294967295) AS c FROM runs, crc)
, hashed AS (SELECT run, n, xor(c, 4294967295) AS h FROM coded)
, words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed) WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2)
, skips AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) AS a, substr(word, i + 2) AS b FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words))
, less AS (SELECT DISTINCT s.word, s.n, w.word AS other, w.n AS m FROM skips s JOIN words w ON w.word = a || b)
, near AS MATERIALIZED (SELECT s.word, s.n, o.word AS other, o.n AS m FROM skips s JOIN skips o USING (i, a, b) WHERE s.word <> o.word UNION ALL SELECT * FROM less UNION ALL SELECT other, m, word, n FROM less)
, best AS (SELECT word, n, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM near GROUP BY ALL)
, forms AS MATERIALIZED (SELECT word, other AS form, m AS form_n FROM best WHERE m >= 10 * n)
, led AS (SELECT word, form AS root FROM forms UNION ALL SELECT l.word, f.form FROM led l JOIN forms f ON f.word = l.root)
, ends AS (SELECT word, root FROM led l ANTI JOIN forms f ON f.word = l.root)
SELECT w.word, f.form, coalesce(e.root, w.word) AS root, w.n, CAST(coalesce(b.n_near, 0) AS BIGINT) AS n_near, f.form_n FROM words w LEFT JOIN best b USING (word) LEFT JOIN forms f USING (word) LEFT JOIN ends e USING (word)
""",
    # All pairs of texts that share a shingle, then what they reach.
    "op13_minhash_dedup": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents)
, s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 2, 1))) AS i FROM d WHERE len(w) > 0))
, n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id)
, links AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY ALL) JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c))
, reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
, least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(l.b, d.doc_id) AS component_id, coalesce(l.b, d.doc_id) = d.doc_id AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least l ON l.a = d.doc_id
""",
}
