"""The registered queries of the subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import collocations, decontaminate, fim, licenses, pii, repeats, secrets, sentencepiece, simhash, tokenfiles, toxicity, warc
from .quality import STOP_WORDS, quality

#: The public tokenizers' files, which are never part of the repository: a SentencePiece model and a byte-level BPE vocabulary.
PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.encode_documents(_read(spark, sf_dir, "documents"), PIECES)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(decontaminate.decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(simhash.near_duplicates(_read(spark, sf_dir, "documents")))


def op4_tokenfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.read_tokens(tokenfiles.write_tokens(_read(spark, sf_dir, "documents"), BYTES))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents"))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_read(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(warc.read_archives(warc.write(_read(spark, sf_dir, "pages"))))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(_read(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    # which rule rejects first depends on measured times, the verdict does not
    return quality(_read(spark, sf_dir, "documents")).drop("rejected_by")


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.report(fim.restore(fim.transform(_read(spark, sf_dir, "documents"))))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(_read(spark, sf_dir, "documents"))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.detect(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_decontaminate": op2_decontaminate,
    "op3_simhash": op3_simhash,
    "op4_tokenfiles": op4_tokenfiles,
    "op5_licenses": op5_licenses,
    "op6_repeats": op6_repeats,
    "op7_toxicity": op7_toxicity,
    "op8_warc": op8_warc,
    "op9_pii": op9_pii,
    "op10_quality": op10_quality,
    "op11_fim": op11_fim,
    "op12_collocations": op12_collocations,
    "op13_secrets": op13_secrets,
}

ORACLE_SQL: dict[str, str] = {
    "op2_decontaminate": r"""
WITH b AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(len(w), 10) AS l, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS s
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dw AS (
  SELECT k, i, l, array_to_string(list_slice(w, i, i + l - 1), ' ') AS s
  FROM (SELECT k, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM bw) WHERE len(w) >= l)),
hit AS (SELECT k, i, l, item FROM dw JOIN bw USING (l, s)),
n AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(i, i + l)) AS p FROM (SELECT DISTINCT k, i, l FROM hit)) GROUP BY k),
t AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT k, item FROM hit) GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (k) LEFT JOIN t USING (k)""",
    "op5_licenses": licenses.oracle_sql(),
    "op8_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT *, sha1(html) AS x, max(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(x, (1 + 5 * (i // 4))::BIGINT, 5))::INTEGER >> (15 - 5 * (i % 4))::INTEGER) & 31))::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN first > page_id OR page_id IS NULL AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first > page_id OR page_id IS NULL THEN first END AS refers_to FROM f""",
    "op10_quality": r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT k, line, row_number() OVER (PARTITION BY k, line ORDER BY i) AS nth FROM (SELECT k, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
lines AS (SELECT k, count(*) AS n_lines, count(*) FILTER (nth > 1) AS dup, count(*) FILTER (regexp_matches(line, '^[\x20\x09-\x0D]*(?:-|\*|•)')) AS bullets, count(*) FILTER (regexp_matches(line, '(?:\.\.\.|…)[\x20\x09-\x0D]*$')) AS ellipses FROM l GROUP BY k),
g AS (SELECT k, i, count(*) OVER (PARTITION BY k, w[i], w[i + 1], w[i + 2]) AS n FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
again AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n > 1) GROUP BY k),
top AS (SELECT k, max(n) AS n, max(strlen(x)) AS longest FROM (SELECT k, x, count(*) AS n FROM (SELECT k, unnest(w) AS x FROM d) GROUP BY k, x) GROUP BY k),
c AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, coalesce(dup, 0) AS dup, coalesce(n_lines, 0) AS n_lines, coalesce(bullets, 0) AS bullets, coalesce(ellipses, 0) AS ellipses, coalesce(again.n, 0) AS rep, coalesce(top.n, 0) AS top, coalesce(longest, 0) AS longest,
    len(regexp_extract_all(t, '[^\x20\x09-\x0D]*(?:[A-Za-z]|[^\x00-\x7F])[^\x20\x09-\x0D]*')) AS lettered, len(list_filter(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), lambda x: x IN (STOPS))) AS stops,
    len(regexp_extract_all(t, '[A-Z]')) AS capitals, len(regexp_extract_all(t, '[A-Za-z]')) AS alpha
  FROM d LEFT JOIN lines USING (k) LEFT JOIN again USING (k) LEFT JOIN top USING (k)),
b AS (SELECT *, n_words < 50 OR 100 * rep > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, dup::BIGINT AS n_dup_lines, rep::BIGINT AS n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols * 10 > n_words OR dup * 10 > n_lines * 3 OR word_chars < 3 * n_words OR word_chars > 10 * n_words OR lettered * 10 < n_words * 8 OR stops < 2 OR capitals * 2 > alpha
    OR bullets * 10 > n_lines * 9 OR ellipses * 10 > n_lines * 3 OR longest > 1000 OR top * 4 > n_words) AS kept FROM b""".replace("STOPS", ", ".join(f"'{w}'" for w in STOP_WORDS)),
    "op11_fim": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
h AS (SELECT *, len(w) AS n, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(w[1:a], '') AS p, array_to_string(w[a + 1:b], '') AS m, array_to_string(w[b + 1:], '') AS s FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN t ELSE p || m || s END) AS restored_sha256 FROM p""",
    "op12_collocations": r"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(regexp_extract_all(t, '[^.,;:!?\x0A-\x0D]+')) AS p FROM d)),
runs AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM runs GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND f >= 10),
cuts AS (SELECT lang, k, phrase, a, j, array_to_string(w[1:j], ' ') AS x, array_to_string(w[j + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
s AS (SELECT cuts.lang, cuts.k, cuts.phrase, a, j, x.f AS l, y.f AS r, 1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f) AS score FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = cuts.x JOIN f y ON y.lang = cuts.lang AND y.phrase = cuts.y),
low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
gone AS (SELECT DISTINCT b.lang, b.phrase FROM low b JOIN (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS part FROM c WHERE k = 3) t ON b.lang = t.lang AND b.phrase = t.part AND 100 * t.a >= 50 * b.a),
kept AS (SELECT low.*, row_number() OVER (PARTITION BY low.lang ORDER BY score DESC, a DESC, low.phrase) AS rank FROM low ANTI JOIN gone ON low.lang = gone.lang AND low.phrase = gone.phrase)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM kept JOIN n USING (lang) WHERE rank <= 2000""",
}
