"""The registered queries of this subpackage and their SQL, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from plotlens.llm import bpe, exact_dedup, fill_in_middle, fingerprints, language_id, mixing, pii, runs, secrets, simhash_dedup, substring_dedup, url_filter, warc


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.summary(_documents(spark, sf_dir))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_documents(spark, sf_dir)).drop("repeats")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_documents(spark, sf_dir))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_documents(spark, sf_dir), bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.simhash_groups(_documents(spark, sf_dir))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_documents(spark, sf_dir))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.summary(_documents(spark, sf_dir))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(_documents(spark, sf_dir))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.transformed(_documents(spark, sf_dir))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.periodic_runs(_documents(spark, sf_dir))


def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts of op2 alone, which SQL can express."""
    return op2_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts of op9 alone, which SQL can express."""
    return op9_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def edited_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op10 says of texts and edited texts, which SQL can express."""
    return op10_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


OP1_SQL = """
WITH p AS (
  SELECT page_id, url, encode(coalesce(html, '')) AS payload, row_number() OVER (PARTITION BY sha256(coalesce(html, '')) ORDER BY page_id DESC) AS k,
         max(page_id) OVER (PARTITION BY sha256(coalesce(html, ''))) AS first FROM pages),
h AS (SELECT *, sha1(payload) AS hex FROM p)
SELECT page_id, octet_length(payload)::bigint AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((cast('0x' || substr(hex, (5 * i // 4 + 1)::int, 2) AS bigint) >> (3 - 5 * i % 4)) & 31)::int + 1, 1)), '') AS payload_digest,
       CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN first END AS refers_to, url AS target_uri, 1 AS n_requests
FROM h
"""

PII_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (
  SELECT doc_id, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS email, regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS ip,
         list_transform(regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS card,
         list_transform(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g'))) AS phone FROM d)
SELECT doc_id, len(email)::bigint AS n_email,
       len(list_filter(ip, lambda x: list_max(list_transform(string_split(x, '.'), lambda o: length(ltrim(o, '0')))) <= 3
                                     AND list_max(list_transform(string_split(x, '.'), lambda o: cast('0' || right(o, 3) AS int))) <= 255))::bigint AS n_ip,
       len(list_filter(card, lambda x: length(x) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, length(x) + 1), lambda i:
         CASE WHEN i % 2 = 1 THEN cast(substr(x, -i, 1) AS int) ELSE 2 * cast(substr(x, -i, 1) AS int) - CASE WHEN cast(substr(x, -i, 1) AS int) > 4 THEN 9 ELSE 0 END END)) % 10 = 0))::bigint AS n_card,
       len(list_filter(phone, lambda n: n BETWEEN 8 AND 15))::bigint AS n_phone
FROM m
"""

SECRETS_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id,
       len(list_filter(regexp_extract_all(t, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda x: length(x) >= 6))::bigint AS n_assign,
       len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20))::bigint AS n_access,
       len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 24))::bigint AS n_hex
FROM d
"""

EDITED_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id DESC), first_value(coalesce(text, '')) OVER (ORDER BY doc_id DESC)) AS next FROM documents)
SELECT doc_id, length(t) AS n_chars, sha256(substr(t, 1, length(t) - length(t) // 3) || substr(next, 1, length(t) // 3)) AS edited_sha256 FROM d
"""

OP3_SQL = r"""
WITH split AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
windows AS (
  SELECT doc_id, start, md5(array_to_string(words[start : start + 49], ' ')) AS content
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS start FROM split WHERE len(words) >= 50)),
least AS (SELECT content, min(doc_id) AS low FROM windows GROUP BY content),
covered AS (
  SELECT w.doc_id, list(w.start ORDER BY w.start) AS starts
  FROM windows w JOIN least l USING (content) WHERE l.low < w.doc_id GROUP BY w.doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start, start + 50)) AS place FROM (SELECT doc_id, unnest(starts) AS start FROM covered)),
places AS (SELECT doc_id, list(place) AS places FROM gone GROUP BY doc_id),
kept AS (
  SELECT s.doc_id, string_agg(s.word, ' ' ORDER BY s.place) AS kept
  FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM split) s
  LEFT JOIN gone g ON g.doc_id = s.doc_id AND g.place = s.place WHERE g.place IS NULL GROUP BY s.doc_id)
SELECT s.doc_id, len(s.words)::bigint AS n_words, coalesce(len(p.places), 0)::bigint AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM split s LEFT JOIN places p USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""

OP4_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) = 1 AS kept,
       text_sha256
FROM t
"""

OP6_SQL = """
WITH counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (SELECT source, (SELECT sum(n) FROM counts) * 1.0::double / (SELECT count(*) FROM counts) / n AS mean FROM counts),
steps AS (
  SELECT source, sum(p) OVER (PARTITION BY source ORDER BY k ROWS UNBOUNDED PRECEDING) AS step
  FROM (SELECT source, k, exp(-mean) * pow(mean, k) / gamma(k + 1) AS p FROM rates, range(0, 100) r(k))),
drawn AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars,
         cast('0x' || substr(md5(d.doc_id || ':17:1'), 1, 13) AS ubigint) / pow(2, 52) AS u
  FROM documents d),
counted AS (
  SELECT d.doc_id, any_value(d.text) AS text, any_value(d.lang) AS lang, any_value(d.source) AS source,
         any_value(d.n_chars) AS n_chars, count(*) AS n
  FROM drawn d JOIN steps s ON s.source = d.source AND s.step < d.u GROUP BY d.doc_id)
SELECT doc_id, text, lang, source, n_chars, unnest(range(1, n + 1))::int AS copy FROM counted
"""


OP11_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::varchar, 'null')) AS h FROM documents),
k AS (SELECT *, ('0x' || substr(h, 1, 8))::bigint AS h1, ('0x' || substr(h, 9, 8))::bigint AS h2, ('0x' || substr(h, 17, 8))::bigint AS h3, ('0x' || substr(h, 25, 8))::bigint AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""

OP12_SQL = rf"""
WITH RECURSIVE rules AS (SELECT * FROM (VALUES {url_filter.rules_sql(url_filter.RULES)}) v(own, start, rule, verdict)),
u AS (SELECT row_number() OVER () AS r, page_id, html, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT r, page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), '{url_filter.UPPER}', '{url_filter.LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
hits AS (SELECT r, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS ruled FROM h JOIN rules ON (host = own OR ends_with(host, '.' || own)) AND starts_with(path, start) GROUP BY r),
judged AS (SELECT h.*, rule, ruled FROM h LEFT JOIN hits USING (r)),
seeds AS (SELECT host, count(*) FILTER (ruled = 'allow') / count(*) AS trust, count(*) FILTER (ruled = 'block') / count(*) AS distrust FROM judged WHERE host <> '' GROUP BY host),
links AS (SELECT host AS src, translate(unnest(regexp_extract_all(html, '{url_filter.HREF.replace("'", "''")}', 1)), '{url_filter.UPPER}', '{url_filter.LOWER}') AS dst FROM h WHERE host <> ''),
names AS (SELECT string_split(host, '.') AS l FROM seeds WHERE contains(host, '.')),
family AS (SELECT DISTINCT array_to_string(l[k:], '.') AS low, array_to_string(l[k + 1:], '.') AS high FROM (SELECT l, unnest(range(1, len(l) - 1)) AS k FROM names)),
edges AS (SELECT src, dst, sum(n) AS n FROM (SELECT src, dst, count(*) AS n FROM links WHERE src <> dst GROUP BY ALL UNION ALL SELECT low, high, 1 FROM family) GROUP BY ALL),
steps AS (SELECT f, t, sum(wt) AS wt, sum(wd) AS wd FROM (
  SELECT src AS f, dst AS t, {url_filter.DAMPING} * n / sum(n) OVER (PARTITION BY src) AS wt, 0.0 AS wd FROM edges UNION ALL SELECT dst, src, 0.0, {url_filter.DAMPING} * n / sum(n) OVER (PARTITION BY dst) FROM edges) GROUP BY ALL),
term AS (
  SELECT host, trust::double AS trust, distrust::double AS distrust, 0 AS k FROM seeds
  UNION ALL SELECT t, sum(wt * trust)::double, sum(wd * distrust)::double, any_value(k) + 1 FROM term JOIN steps ON f = host WHERE k < {url_filter.ROUNDS} GROUP BY t),
scores AS (SELECT host, round(sum(trust), 9) AS trust, round(sum(distrust), 9) AS distrust FROM term GROUP BY host)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN distrust > trust AND distrust >= {url_filter.THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict FROM judged LEFT JOIN scores USING (host)
"""

def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": op1_warc,
        "op2_pii": op2_pii,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_bpe": op5_bpe,
        "op6_mixing": op6_mixing,
        "op7_simhash_dedup": op7_simhash_dedup,
        "op8_language_id": op8_language_id,
        "op9_secrets": op9_secrets,
        "op10_fingerprints": op10_fingerprints,
        "op11_fill_in_middle": op11_fill_in_middle,
        "op12_url_filter": op12_url_filter,
        "op13_periodic_runs": op13_periodic_runs,
        "pii_counts": pii_counts,
        "secret_counts": secret_counts,
        "edited_documents": edited_documents,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    sql = {"op1_warc": OP1_SQL, "pii_counts": PII_SQL, "secret_counts": SECRETS_SQL, "edited_documents": EDITED_SQL, "op3_substring_dedup": OP3_SQL, "op4_exact_dedup": OP4_SQL, "op6_mixing": OP6_SQL, "op11_fill_in_middle": OP11_SQL, "op12_url_filter": OP12_SQL}
    if corpus_pipeline.ORACLE_SQL:
        sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    return sql
