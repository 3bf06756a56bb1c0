"""The registered queries of this subpackage and their SQL twins.

Each query is a thin reading of its operator: it applies the operator to the
whole table with production parameters and derives the columns it returns.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from secrets import token_hex

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Where a session names the secret of its pseudonyms; without one a run draws its own, and its pseudonyms are linked to no other run's.
PSEUDONYM_KEY = "spark.lectern.pseudonymKey"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer(name: str) -> str:
    """The place of a public vocabulary file; operators take any other path as well."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per document and the verdict of the adaptive rules."""
    from lectern.llm.quality import RESULT, quality

    return quality(_documents(spark, sf_dir)).select("doc_id", *RESULT)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, and what decoding them gives back."""
    from lectern.llm import sentencepiece

    path = tokenizer("piece_bpe_32k.model")
    found = sentencepiece.encode(_documents(spark, sf_dir), sentencepiece.Pieces(path=path), decoded=True)
    return found.select(
        "doc_id",
        "n_chunks",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and class of every document."""
    from lectern.llm.simhash import near_duplicates

    return near_duplicates(_documents(spark, sf_dir))


def op4_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with its personal data replaced by pseudonyms; the key is the session's secret."""
    from lectern.llm.pii import RESULT, Pseudonyms, pseudonymize

    config = Pseudonyms(key=spark.conf.get(PSEUDONYM_KEY, None) or token_hex(32))
    return pseudonymize(_documents(spark, sf_dir), config).select("doc_id", *RESULT, "text")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the ids of all documents to files and digests what is read back from them."""
    from lectern.llm import rans
    from lectern.llm.storage import fresh_path

    path = fresh_path(spark, "token-ids")
    rans.write(_documents(spark, sf_dir), path, rans.TokenFiles(path=tokenizer("word_bpe_49k.json"), end_id=1))
    return rans.digests(spark, path)


def op6_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all texts and their edited twins, with likenesses."""
    from lectern.llm.imatch import compare

    return compare(_documents(spark, sf_dir))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from four fifths of the labelled ones."""
    from lectern.llm.langid import identify

    docs = _documents(spark, sf_dir)
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return identify(docs, teach=~held_out).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every text."""
    from lectern.llm.secrets import BASE, RULES, scan

    found = scan(_documents(spark, sf_dir)).select("doc_id", "secrets")
    names = F.array(*[F.lit(r.kind) for r in RULES])
    line = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["order"]), s["start"], s["end"])), ","
    )
    count = lambda k: F.size(F.filter("secrets", lambda s: s["order"] == k)).cast("long")
    base = F.filter("secrets", lambda s: s["order"] < len(BASE))
    counts = [count(k).alias(f"n_{r.kind}") for k, r in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(line(base), 256).alias("base_sha256"), line(F.col("secrets")).alias("spans"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1,024 ids."""
    from lectern.llm.packing import Packing, pack

    return pack(_documents(spark, sf_dir), Packing(path=tokenizer("byte_bpe_50k.json"), end_id=2, length=1024))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of every page."""
    from lectern.llm.html import render_pages

    return render_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text")


def op11_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty clusters of all vectors after five rounds."""
    from lectern.llm.clusters import clusters

    return clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language are apart, and the terms that set each one off."""
    from lectern.llm.divergence import divergence

    return divergence(_documents(spark, sf_dir))


def op13_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of every document by two-word shingles and a Jaccard of 0.8."""
    from lectern.llm.minhash import near_duplicates

    return near_duplicates(_documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_pii_pseudonyms": op4_pii_pseudonyms,
    "op5_token_files": op5_token_files,
    "op6_imatch_fingerprints": op6_imatch_fingerprints,
    "op7_language_id": op7_language_id,
    "op8_secret_scan": op8_secret_scan,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_html_text": op10_html_text,
    "op11_sort_means": op11_sort_means,
    "op12_source_divergence": op12_source_divergence,
    "op13_minhash_near_dedup": op13_minhash_near_dedup,
}

#: The same counts, sketches, merges and fences as in ``quality``, over rows and lists.
QUALITY_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
windows AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM docs)),
repeated AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS p
    FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM windows) WHERE c > 1)
  GROUP BY doc_id),
measured AS (
  SELECT d.doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
         coalesce(r.n, 0) AS n_repeat_words, len(l) AS n_lines
  FROM docs d LEFT JOIN repeated r ON d.doc_id = r.doc_id),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured),
scaled AS (
  SELECT doc_id, lang, source, base_failed, unnest([
    {'r': 1, 'k': 2, 'v': (n_symbols + 1) * 1048576 // (n_words + 1)},
    {'r': 2, 'k': 4, 'v': (n_dup_lines + 1) * 1048576 // (n_lines + 1)},
    {'r': 3, 'k': 4, 'v': (n_repeat_words + 1) * 1048576 // (n_words + 1)},
    {'r': 4, 'k': 5, 'v': (word_chars + 1) * 1048576 // (n_words + 1)}], recursive := true)
  FROM judged),
own AS (
  SELECT lang, source, r, CASE WHEN v < 32 THEN v ELSE length(bin(v)) * 32 + (v >> greatest(length(bin(v)) - 5, 0)) END AS b, count(*) AS n
  FROM scaled WHERE NOT base_failed GROUP BY ALL),
ranked AS (
  SELECT lang, source, r, b, sum(n) OVER (PARTITION BY lang, source, r ORDER BY b) AS below, sum(n) OVER (PARTITION BY lang, source, r) AS total
  FROM own
  UNION ALL BY NAME
  SELECT lang, NULL AS source, r, b, sum(n) OVER (PARTITION BY lang, r ORDER BY b) AS below, sum(n) OVER (PARTITION BY lang, r) AS total
  FROM (SELECT lang, r, b, sum(n) AS n FROM own GROUP BY ALL)),
places AS (
  SELECT lang, source, r, max(total) AS total, min(CASE WHEN 4 * below >= total THEN b END) AS b1, min(CASE WHEN 4 * below >= 3 * total THEN b END) AS b3
  FROM ranked GROUP BY ALL),
edges AS (
  SELECT lang, source, r, total,
         CASE WHEN b1 < 32 THEN b1::DOUBLE ELSE (b1 % 32) * pow(2.0, b1 // 32 - 5) END AS q1,
         CASE WHEN b3 < 32 THEN b3::DOUBLE ELSE (b3 % 32 + 1) * pow(2.0, b3 // 32 - 5) END AS q3
  FROM places),
fences AS (
  SELECT g.lang, g.source, g.r, CASE WHEN g.total >= 100 THEN g.q1 ELSE a.q1 END AS low, CASE WHEN g.total >= 100 THEN g.q3 ELSE a.q3 END AS high
  FROM edges g JOIN edges a ON g.lang = a.lang AND g.r = a.r AND a.source IS NULL WHERE g.source IS NOT NULL),
verdicts AS (
  SELECT doc_id, bool_and(v <= list_reduce(list_concat([high], list_resize([]::DOUBLE[], k, spread)), lambda x, y: x * y)
                          AND (s.r < 4 OR v >= list_reduce(list_concat([low], list_resize([]::DOUBLE[], k, spread)), lambda x, y: x / y))) AS inside
  FROM scaled s JOIN (SELECT *, high / low AS spread FROM fences) f ON s.lang = f.lang AND s.source = f.source AND s.r = f.r
  GROUP BY doc_id)
SELECT j.doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND coalesce(inside, true) AS kept
FROM judged j LEFT JOIN verdicts v ON j.doc_id = v.doc_id
"""



def _secrets_sql() -> str:
    """Spans of every rule from the texts between its matches, joined as in the contract."""
    from lectern.llm.secrets import BASE, RULES

    parts = []
    for order, rule in enumerate(RULES):
        # Letters that count in either case are spelled out, so that no other letter folds into them.
        pattern = re.sub(r"\(\?i:([^)]*)\)", lambda m: "(?:" + re.sub("[a-z]", lambda c: f"[{c[0]}{c[0].upper()}]", m[1]) + ")", rule.pattern)
        quoted = "'" + pattern.replace("'", "''") + "'"
        parts.append(
            f"SELECT d, {order} AS k, '{rule.kind}' AS kind, f, p, list_transform(g, lambda x: length(x)) AS n, {rule.least} AS least FROM ("
            f"SELECT d, regexp_extract_all(t, {quoted}) AS f, string_split_regex(t, {quoted}) AS p, regexp_extract_all(t, {quoted}, {rule.part}) AS g "
            f"FROM texts WHERE regexp_matches(t, {quoted}))"
        )
    counts = ", ".join(f"count(*) FILTER (k = {k})::BIGINT AS n_{r.kind}" for k, r in enumerate(BASE))
    line = "coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) {}, '')"
    return f"""
WITH texts AS (SELECT doc_id AS d, coalesce(text, '') AS t FROM documents),
hits AS ({" UNION ALL ".join(parts)}),
placed AS (
  SELECT d, k, kind, n[i] >= least AS enough, length(f[i]) AS size,
         list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0) AS s
  FROM (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM hits)),
spans AS (SELECT d, k, kind, s::BIGINT AS s, (s + size)::BIGINT AS e FROM placed WHERE enough)
SELECT x.d AS doc_id, {counts}, sha256({line.format(f"FILTER (k < {len(BASE)})")}) AS base_sha256, {line.format("")} AS spans
FROM texts x LEFT JOIN spans y ON x.d = y.d GROUP BY x.d
"""


def _clusters_sql(clusters: int = 40, rounds: int = 5) -> str:
    """Every distance of every round, by joins over the components."""
    parts = [
        """
WITH vectors AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS k, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
parts AS MATERIALIZED (SELECT k, unnest(range(1, 65)) AS i, unnest(x) AS x FROM vectors)""",
        f"""
means0 AS MATERIALIZED (
  SELECT c, unnest(range(1, 65)) AS i, unnest(x) AS x FROM (
    SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, x FROM vectors) WHERE c < {clusters})""",
    ]
    for r in range(rounds + 1):
        parts.append(f"""
near{r} AS MATERIALIZED (
  SELECT k, c, d FROM (SELECT p.k, m.c, sum((p.x - m.x) * (p.x - m.x)) AS d FROM parts p JOIN means{r} m ON p.i = m.i GROUP BY p.k, m.c)
  QUALIFY row_number() OVER (PARTITION BY k ORDER BY d, c) = 1)""")
        if r < rounds:
            parts.append(f"""
means{r + 1} AS MATERIALIZED (
  SELECT m.c, m.i, coalesce((s - (s % n + n) % n) // n, m.x)::BIGINT AS x FROM means{r} m LEFT JOIN (
    SELECT c, i, sum(x) AS s, count(*) AS n FROM parts p JOIN near{r} a ON p.k = a.k GROUP BY c, i) t ON m.c = t.c AND m.i = t.i)""")
    return ",".join(parts) + f"""
SELECT vec_id, a.c::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia, h AS centroid_sha256
FROM near{rounds} a JOIN vectors v ON a.k = v.k
JOIN (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS h FROM means{rounds} GROUP BY c) s ON a.c = s.c
"""


#: Every two documents that share a shingle, and all that can be reached from each.
MINHASH_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words),
shingles AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS MATERIALIZED (
  SELECT a.doc_id AS u, b.doc_id AS v FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY u, v, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reached AS (SELECT doc_id AS u, doc_id AS v FROM sets UNION SELECT r.u, l.v FROM reached r JOIN links l ON r.v = l.u)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN (SELECT u, min(v) AS component_id FROM reached GROUP BY u) ON doc_id = u
"""

#: Every kept term against every pair of sources.
DIVERGENCE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
occurring AS MATERIALIZED (SELECT DISTINCT lang, source FROM docs),
held AS MATERIALIZED (SELECT d, lang, source, w, count(*) AS n FROM (SELECT d, lang, source, unnest(w) AS w FROM docs) GROUP BY ALL),
kept AS MATERIALIZED (SELECT lang, w FROM held GROUP BY lang, w HAVING count(*) >= 10),
cells AS MATERIALIZED (SELECT lang, source, w, sum(n)::HUGEINT AS n FROM held JOIN kept USING (lang, w) GROUP BY ALL),
kinds AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
full_cells AS (
  SELECT o.lang, o.source, k.w, coalesce(c.n, 0) AS n FROM occurring o JOIN kept k USING (lang) LEFT JOIN cells c ON o.lang = c.lang AND o.source = c.source AND k.w = c.w),
shares AS MATERIALIZED (
  SELECT lang, source, w, n, 1 + 1000000000 * (n + 2) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS p FROM full_cells JOIN kinds USING (lang)),
wholes AS (
  SELECT lang, w, 1 + 1000000000 * (n + 2) // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS q
  FROM (SELECT lang, w, sum(n) AS n FROM cells GROUP BY lang, w) JOIN kinds USING (lang)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.w = b.w AND a.source <> b.source GROUP BY ALL),
terms AS (SELECT lang, source, w AS item, (p - q) * (p - q) // (p + q) AS value FROM shares JOIN wholes USING (lang, w) WHERE n > 0 AND p > q)
SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value,
       (row_number() OVER (PARTITION BY a.lang, a.source ORDER BY coalesce(value, 0) DESC, b.source))::INTEGER AS rank
FROM occurring a JOIN occurring b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
UNION ALL
SELECT lang, source, 'term' AS part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank
FROM terms QUALIFY rank <= 10
"""

ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": QUALITY_SQL,
    "op8_secret_scan": _secrets_sql(),
    "op11_sort_means": _clusters_sql(),
    "op12_source_divergence": DIVERGENCE_SQL,
    "op13_minhash_near_dedup": MINHASH_SQL,
}
