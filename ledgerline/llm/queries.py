"""The registered queries of the training-data operators and their DuckDB SQL.

Each applies its operator, with the production parameters, to its whole table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import bpe, collocations, exact_dedup, language_id, license_scan, line_dedup, ngram_join, packing, quality_ranker, repetition, url_rules, warc_revisit, whitening
from ledgerline.llm.common import table

VOCABULARY = "word_bpe_49k.json"
#: Runs that ``op1_packing`` remembers: its executors hold nothing else, and new runs are what takes its time.
PACKING_REMEMBERED = 1_200_000


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), remembered=PACKING_REMEMBERED)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicates(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP2_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"), wrapped=True).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def _template_rows() -> str:
    return ", ".join(f"({k}, '{t.label}', [{', '.join(repr(w) for w in t.words)}], {len(t.sequence)})" for k, t in enumerate(license_scan.TEMPLATES))


OP3_SQL = f"""
WITH templates(template, label, own, length) AS (VALUES {_template_rows()}),
texts AS (SELECT doc_id, text, {_LOW} AS low FROM documents),
docs AS (SELECT doc_id, text, low, list_filter(regexp_split_to_array(low, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS words FROM texts),
places AS (
  SELECT doc_id, text, low, words,
         list_filter(range(1, len(words)), lambda i: words[i] = 'mit' AND words[i + 1] = 'license') AS mit,
         list_filter(range(1, len(words)), lambda i: words[i] = 'apache' AND words[i + 1] = 'license') AS apache,
         list_filter(range(1, len(words)), lambda i: words[i] = 'general' AND words[i + 1] = 'public' AND words[i + 2] = 'license') AS gpl
  FROM docs),
lines AS (SELECT doc_id, text, unnest(string_split(low, chr(10))) AS line FROM docs),
matches AS (
  SELECT doc_id, text, list(DISTINCT label) AS found, max(overlap / len(own)) AS best
  FROM (SELECT l.doc_id, l.text, t.label, t.own,
               len(list_intersect(t.own, regexp_split_to_array(l.line, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'))) AS overlap
        FROM lines l, templates t UNION ALL
        SELECT d.doc_id, d.text, t.label, t.own, list_max([len(list_intersect(t.own, d.words[i : i + t.length - 1])) for i in range(1, len(d.words) + 1) if list_contains(t.own, d.words[i])])
        FROM docs d, templates t WHERE len(list_intersect(t.own, d.words)) >= {license_scan.THRESHOLD} * len(t.own) - 1e-9) WHERE overlap >= {license_scan.THRESHOLD} * len(own) - 1e-9
  GROUP BY doc_id, text),
labelled AS (
  SELECT p.*, list_filter(['apache', 'gpl', 'mit'], lambda x: len(CASE x WHEN 'mit' THEN mit WHEN 'apache' THEN apache ELSE gpl END) > 0) AS base,
         coalesce(m.found, []) AS found, m.best
  FROM places p LEFT JOIN matches m ON p.doc_id IS NOT DISTINCT FROM m.doc_id AND p.text IS NOT DISTINCT FROM m.text)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(mit) + len(apache) + len(gpl))::BIGINT AS n_base,
       list_min(mit || apache || gpl)::BIGINT - 1 AS first_word, list_max(mit || apache || gpl)::BIGINT - 1 AS last_word,
       array_to_string(base, ',') AS base_labels,
       array_to_string(list_sort(list_distinct(base || found)), ',') AS labels,
       CASE WHEN len(base) > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
FROM labelled
"""


def page_captures(pages: DataFrame) -> DataFrame:
    """Two captures of every page: its response, and a revisit.

    Revisits come an hour and more after, those of every seventh page before. Those of every
    fifth page bring the tag of another version, of every third the response's date and of
    every thirteenth another one, of every fourth its digest and of every eleventh another;
    those of every eighth have no tag, and names of headers in capitals.
    """
    p = F.col("page_id")
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 16), F.lit('"'))
    at = F.lit(1_700_000_000) + (p % 1000) * 60
    digest = F.sha2(F.coalesce("html", F.lit("")), 256)
    date = F.concat(F.lit("day "), (p % 28 + 1).cast("string"))
    response = pages.select((p * 2).alias("record_id"), "url", at.alias("captured_at"), F.lit(False).alias("is_revisit"), tag.alias("etag"), date.alias("last_modified"), digest.alias("payload_digest"), F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("ETag"), tag, F.lit("Cache-Control"), F.lit("max-age=60"), F.lit("Server"), F.lit("a")).alias("headers"))
    own = F.when(p % 5 == 0, F.concat(F.lit('"'), p.cast("string"), F.lit('"'))).otherwise(F.concat(F.lit("W/"), tag))
    later = at + F.when(p % 7 == 0, F.lit(-30)).otherwise(3600 + (p % 11) * 7200)
    own, own_date, own_digest = F.when(p % 8 != 0, own), F.when(p % 13 == 0, F.lit("day 0")).when(p % 3 == 0, date), F.when(p % 11 == 0, F.lit("other")).when(p % 4 == 0, digest)
    headers = F.when(p % 8 == 0, F.create_map(F.lit("CACHE-CONTROL"), F.lit("max-age=600"), F.lit("EXPIRES"), date)).otherwise(F.create_map(F.lit("Cache-Control"), F.lit("max-age=600"), F.lit("Server"), F.lit("b"), F.lit("Date"), date))
    revisit = pages.select((p * 2 + 1).alias("record_id"), "url", later.alias("captured_at"), F.lit(True).alias("is_revisit"), own.alias("etag"), own_date.alias("last_modified"), own_digest.alias("payload_digest"), headers.alias("headers"))
    return response.unionByName(revisit)


def op4_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc_revisit.resolve_revisits(page_captures(table(spark, sf_dir, "pages")))
    pairs = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return found.select("record_id", "canonical", "response_id", "outcome", F.when(F.col("headers").isNotNull(), F.array_join(pairs, ";")).alias("headers"), "payload_digest")


OP4_SQL = f"""
WITH parts AS (
  SELECT page_id, url, html, regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM pages),
asked AS (
  SELECT page_id, html, regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^www\\.|:(80|443)$', '', 'g') AS host,
         regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
         list_sort(list_filter(string_split(regexp_extract(rest, '\\?(.*)$', 1), '&'),
           lambda x: x <> '' AND NOT list_contains({list(warc_revisit.TRACKING)!r}, split_part(x, '=', 1)))) AS query FROM parts),
urls AS (
  SELECT page_id, nullif(host || path || CASE WHEN len(query) > 0 THEN '?' || array_to_string(query, '&') ELSE '' END, '') AS canonical,
         '"' || substr(md5(coalesce(html, '')), 1, 16) || '"' AS tag, sha256(coalesce(html, '')) AS digest,
         1700000000 + (page_id % 1000) * 60 AS at_s FROM asked),
responses AS (SELECT page_id * 2 AS id, canonical, at_s, tag, digest, 'day ' || (page_id % 28 + 1) AS day FROM urls),
revisits AS (
  SELECT page_id, page_id * 2 + 1 AS id, canonical,
         at_s + CASE WHEN page_id % 7 = 0 THEN -30 ELSE 3600 + (page_id % 11) * 7200 END AS at_s,
         CASE WHEN page_id % 8 = 0 THEN NULL WHEN page_id % 5 = 0 THEN '"' || page_id || '"' ELSE tag END AS tag,
         CASE WHEN page_id % 13 = 0 THEN 'day 0' WHEN page_id % 3 = 0 THEN 'day ' || (page_id % 28 + 1) END AS day,
         CASE WHEN page_id % 11 = 0 THEN 'other' WHEN page_id % 4 = 0 THEN digest END AS digest FROM urls),
found AS (
  SELECT v.*,
         (SELECT max({{'at_s': r.at_s, 'id': r.id}}).id FROM responses r WHERE r.canonical = v.canonical AND r.at_s < v.at_s) AS response
  FROM revisits v),
joined AS (
  SELECT f.page_id, f.id, f.canonical, f.response, r.tag AS their_tag, r.digest AS their_digest,
         CASE WHEN r.id IS NULL THEN 'no earlier response' WHEN f.tag <> r.tag THEN 'other entity tag' WHEN f.day <> r.day THEN 'other modification date' WHEN f.digest <> r.digest THEN 'other payload'
              WHEN f.tag IS NULL AND f.day IS NULL AND f.digest IS NULL THEN 'no common validator' ELSE 'resolved' END AS outcome
  FROM found f LEFT JOIN responses r ON r.id = f.response)
SELECT id AS record_id, canonical, CASE WHEN outcome = 'resolved' THEN response END AS response_id, outcome,
       CASE WHEN outcome = 'resolved' THEN 'cache-control=max-age=600;content-type=text/html;' || CASE WHEN page_id % 8 = 0 THEN 'etag=' || their_tag || ';expires=day ' || (page_id % 28 + 1)
            ELSE 'date=day ' || (page_id % 28 + 1) || ';etag=' || their_tag END || ';server=a' END AS headers,
       CASE WHEN outcome = 'resolved' THEN their_digest END AS payload_digest
FROM joined
"""


def op5_quality_ranker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_ranker.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(table(spark, sf_dir, "documents"))


_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"
#: Words are numbered, so that sets of three are compared as numbers.
OP6_SQL = f"""
WITH RECURSIVE docs AS (SELECT doc_id, {_WORDS.format(_LOW)} AS words FROM documents),
members AS (
  SELECT doc_id, unnest(CASE WHEN len(words) >= 3 THEN list_distinct([array_to_string(words[i : i + 2], ' ') for i in range(1, len(words) - 1)]) WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS member
  FROM docs),
sizes AS (SELECT doc_id, count(*) AS n FROM members GROUP BY 1),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n
  FROM members a JOIN members b ON a.member = b.member AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM shared h JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y
  WHERE 100 * h.n >= {ngram_join.PERCENT} * (a.n + b.n - h.n)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached AS (SELECT doc_id, doc_id AS other FROM docs UNION SELECT r.doc_id, y FROM reached r JOIN both_ways ON x = r.other)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, (SELECT min(other) FROM reached r WHERE r.doc_id = d.doc_id) AS component_id,
       (SELECT count(*) FROM both_ways WHERE x = d.doc_id) AS n_links
FROM docs d LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


_OP7_SITES = ", ".join(f"('{r.name}', '{r.name.partition('/')[0]}', '/{r.name.partition('/')[2]}', '{r.verdict}')" for r in url_rules.SITES)
OP7_SQL = f"""
WITH rules(name, host, path, verdict) AS (VALUES {_OP7_SITES}),
after AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM after),
split AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM parts),
judged AS (
  SELECT s.*, (SELECT arg_max(r.name, length(r.name)) FROM rules r WHERE (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path)) AS rule
  FROM split s)
SELECT page_id, j.host, j.path, rule,
       coalesce(r.verdict, CASE WHEN regexp_matches(translate(j.host || j.path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(^|[^0-9a-z])({"|".join(w.replace(" ", "[^0-9a-z]+") for w in url_rules.PATTERN_WORDS)})([^0-9a-z]|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM judged j LEFT JOIN rules r ON r.name = j.rule
"""


def op8_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_rules(table(spark, sf_dir, "documents"))


_SHARES = sorted({*repetition.LIMITS, repetition.WINDOW})
OP8_SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS words FROM documents),
lines AS (
  SELECT doc_id, i, {_WORDS.format("line")} AS own, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS again
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM docs) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
repeated_lines AS (SELECT doc_id, count(*) FILTER (again) AS n, coalesce(sum(list_sum([length(w) for w in own])) FILTER (again), 0) AS chars FROM lines GROUP BY 1),
sizes(k) AS (VALUES {", ".join(f"({k})" for k in _SHARES)}),
grams AS (SELECT doc_id, k, [array_to_string(words[i : i + k - 1], ' ') for i in range(1, len(words) - k + 2)] AS all_of FROM docs, sizes),
placed AS (SELECT doc_id, k, unnest(all_of) AS gram, generate_subscripts(all_of, 1) AS pos FROM grams),
windows AS (SELECT p.doc_id, p.k, pos FROM placed p JOIN (SELECT doc_id, k, gram FROM placed GROUP BY ALL HAVING count(*) > 1) m ON p.doc_id = m.doc_id AND p.k = m.k AND p.gram = m.gram),
covered AS (SELECT DISTINCT doc_id, k, unnest(range(pos, pos + k)) AS pos FROM windows),
sized AS (SELECT doc_id, unnest([length(w) for w in words]) AS chars, generate_subscripts(words, 1) AS pos FROM docs),
counted AS (SELECT c.doc_id, k, count(*) AS n, sum(chars) AS chars FROM covered c JOIN sized s ON s.doc_id = c.doc_id AND s.pos = c.pos GROUP BY ALL),
base AS (
  SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum([length(w) for w in words]), 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce((SELECT n FROM counted c WHERE c.doc_id = d.doc_id AND k = {repetition.WINDOW}), 0)::BIGINT AS n_repeat_words,
         coalesce(l.chars, 0) / greatest(coalesce(list_sum([length(w) for w in words]), 0), 1) AS dup_line_share,
         {", ".join(f"coalesce((SELECT chars FROM counted c WHERE c.doc_id = d.doc_id AND k = {k}), 0) / greatest(coalesce(list_sum([length(w) for w in words]), 0), 1) AS share_{k}" for k in sorted(repetition.LIMITS))}
  FROM docs d LEFT JOIN repeated_lines l ON l.doc_id = d.doc_id),
judged AS (SELECT *, n_words < {repetition.LEAST_WORDS} OR 100 * n_repeat_words > {repetition.MOST_REPEATED} * n_words AS base_failed FROM base)
SELECT *, NOT base_failed AND dup_line_share <= {repetition.LINE_LIMIT} AND n_symbols <= {repetition.SYMBOL_LIMIT} * word_chars AND {" AND ".join(f"share_{k} <= {v}" for k, v in repetition.LIMITS.items())} AS kept
FROM judged
"""


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predictions(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine_phrases(table(spark, sf_dir, "documents"))


OP11_SQL = f"""
WITH docs AS (SELECT coalesce(lang, 'und') AS lang, {_LOW} AS low FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(low, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM docs),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS words FROM pieces),
grams AS (
  SELECT lang, k, unnest([array_to_string(words[i : i + k - 1], ' ') for i in range(1, len(words) - k + 2)]) AS phrase
  FROM worded, (VALUES {", ".join(f"({k})" for k in range(1, collocations.MOST_WORDS + 1))}) sizes(k)),
counts AS (SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM grams GROUP BY ALL),
candidates AS (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS words FROM counts WHERE k >= 2 AND f >= {collocations.LEAST}),
cuts AS (SELECT *, unnest(range(1, k)) AS cut FROM candidates),
scored AS (
  SELECT c.lang, c.phrase, c.f AS a, cut, x.f AS l, y.f AS r, 1000000::HUGEINT * c.f * c.f // (x.f * y.f) AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(words[1 : cut], ' ')
  JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(words[cut + 1 :], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
around AS (
  SELECT lang, unnest([array_to_string(words[i : i + size - 1], ' ') for i in range(1, k - size + 2)]) AS phrase, f
  FROM (SELECT *, unnest(range(2, k)) AS size FROM candidates)),
longer AS (SELECT lang, phrase, max(f) AS f FROM around GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN longer o ON o.lang = b.lang AND o.phrase = b.phrase WHERE o.f IS NULL OR 100 * o.f < {collocations.SHARE} * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, (SELECT sum(f) FROM counts c WHERE c.lang = ranked.lang AND k = 1)::BIGINT AS n, score::BIGINT AS score
FROM ranked WHERE rank <= {collocations.TOP}
"""


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_shared_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP12_SQL = f"""
WITH rows_of AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS own FROM documents),
lines AS (SELECT r, doc_id, unnest(own) AS line, generate_subscripts(own, 1) AS i FROM rows_of),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
shared AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= {line_dedup.SHORTEST} GROUP BY key HAVING count(DISTINCT coalesce(doc_id, -1)) >= {line_dedup.DOCUMENTS}),
judged AS (SELECT k.*, s.key IS NOT NULL AND k.doc_id IS DISTINCT FROM s.first AS gone FROM keyed k LEFT JOIN shared s ON s.key = k.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY r
"""


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_license_scan": op3_license_scan,
    "op4_warc_revisit": op4_warc_revisit,
    "op5_quality_ranker": op5_quality_ranker,
    "op6_ngram_join": op6_ngram_join,
    "op7_url_rules": op7_url_rules,
    "op8_repetition": op8_repetition,
    "op9_bpe": op9_bpe,
    "op10_language_id": op10_language_id,
    "op11_collocations": op11_collocations,
    "op12_line_dedup": op12_line_dedup,
    "op13_whitening": op13_whitening,
}
ORACLE_SQL = {
    "op2_exact_dedup": OP2_SQL,
    "op3_license_scan": OP3_SQL,
    "op4_warc_revisit": OP4_SQL,
    "op6_ngram_join": OP6_SQL,
    "op7_url_rules": OP7_SQL,
    "op8_repetition": OP8_SQL,
    "op11_collocations": OP11_SQL,
    "op12_line_dedup": OP12_SQL,
}
