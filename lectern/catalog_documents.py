"""Registered queries of read models, runs, research text, sections and summaries, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.catalog import CHUNKS_SQL, INVOICES_SQL, LEXICAL_SQL, _chunked, _collapsed_sql, _hit_chunks, _hits, _invoices, _lexical, _matching_sql, _search_sql, query, table
from lectern.functions import research as T
from lectern.functions import words as W
from lectern.operators import execution as E
from lectern.operators import likeness as L
from lectern.operators import facts as X
from lectern.operators import ranking as K
from lectern.operators import reading as D
from lectern.operators import runs as N
from lectern.operators import search as S
from lectern.operators import section_answers as A
from lectern.operators import summaries as M
from lectern.operators import study as Y
from lectern.operators.study import SIMILAR_STOPWORDS
from lectern.sources import ingest as G
from lectern.sources import snapshots as H
from lectern.storage import fresh_path, stored
from lectern.streaming import incremental as I


@query(f"""WITH {CHUNKS_SQL},
    c AS (SELECT doc_id, count(*) AS chunk_count, sum(n_words)::BIGINT AS token_estimate FROM chunks GROUP BY doc_id),
    p AS (SELECT doc_id, text, coalesce(chunk_count, 0) AS chunk_count, coalesce(token_estimate, 0) AS token_estimate,
          CASE doc_id % 3 WHEN 0 THEN 'native' WHEN 1 THEN 'ocr' ELSE 'hybrid' END AS src, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE ((doc_id * 37) % 101)::DOUBLE END AS conf,
          {_collapsed_sql("text")} AS flat FROM documents LEFT JOIN c USING (doc_id)),
    q AS (SELECT *, CASE WHEN src = 'native' THEN 'native' WHEN conf IS NULL THEN 'missing' WHEN conf >= 85 THEN 'strong' WHEN conf >= 65 THEN 'moderate' ELSE 'weak' END AS ocr_quality FROM p)
    SELECT doc_id, chunk_count, token_estimate, length(text) AS character_count, ocr_quality,
        CASE ocr_quality WHEN 'native' THEN 'native_text' WHEN 'missing' THEN 'missing_text' ELSE 'ocr_' || ocr_quality END AS processing_status,
        trim(text) = '' OR chunk_count = 0 OR ocr_quality IN ('weak', 'missing') AS needs_review,
        CASE WHEN length(flat) <= 240 THEN flat ELSE rtrim(flat[:239]) || '...' END AS text_preview FROM q""")
def page_reads(spark, sf):
    """Every document read as a page: preview, counts, quality and whether it needs review; sources and confidences are made up."""
    key = F.col("doc_id")
    pages = table(spark, sf, "documents").select(
        "doc_id", "text", F.when(key % 3 == 0, "native").when(key % 3 == 1, "ocr").otherwise("hybrid").alias("text_source"),
        F.when(key % 5 != 0, ((key * 37) % 101).cast("double")).alias("ocr_confidence"), F.lit(600.0).alias("width"), F.lit(800.0).alias("height"),
    )
    chunks = _chunked(spark, sf).select("doc_id", F.col("n_words").cast("long").alias("token_estimate"))
    read = D.page_reads(pages, chunks, ["doc_id"])
    return read.select(
        "doc_id", "chunk_count", "token_estimate", F.col("character_count").cast("long").alias("character_count"), "ocr_quality",
        "processing_status", "needs_review", "text_preview",
    )


@query(f"""WITH {CHUNKS_SQL}, s AS (SELECT source, count(*) AS page_count FROM documents GROUP BY source),
    c AS (SELECT source, count(*) AS chunk_count FROM chunks JOIN documents USING (doc_id) GROUP BY source)
    SELECT source, page_count, coalesce(chunk_count, 0) AS chunk_count FROM s LEFT JOIN c USING (source)""")
def document_list(spark, sf):
    """Sources read as documents, with their counts of pages and chunks."""
    pages = table(spark, sf, "documents").select("doc_id", "source")
    chunks = _chunked(spark, sf).select("doc_id").join(pages, "doc_id")
    return D.documents(pages.select("source").distinct(), pages, chunks, "source")


@query("""SELECT source, count(*) FILTER (doc_id % 3 <> 0) AS ocr_pages, sum(CASE WHEN doc_id % 3 = 0 THEN 0 ELSE n_chars END)::BIGINT AS ocr_duration_ms
    FROM documents GROUP BY source""")
def ocr_totals(spark, sf):
    """Recognized pages and time per source; which pages are recognized is made up."""
    key = F.col("doc_id")
    pages = table(spark, sf, "documents").select(
        "source", F.when(key % 3 == 0, "native").when(key % 3 == 1, "ocr").otherwise("hybrid").alias("text_source"),
        F.when(key % 3 != 0, F.col("n_chars")).alias("ocr_duration_ms"),
    )
    return D.ocr_totals(pages, "source")


@query("""SELECT lang AS suite_id, count(*) AS case_count, count(*) FILTER (quality = 1) AS reviewed_count FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang""")
def suite_counts(spark, sf):
    """Languages read as suites: their cases, and how many are reviewed, being labelled good."""
    docs = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("suite_id"))
    labels = table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, "reviewed").otherwise("draft").alias("review_state"))
    return D.suites(docs.select("suite_id").distinct(), docs.join(labels, "doc_id", "left"))


RESULTS_SQL = """results AS (SELECT user_id AS run_id, event_id, CASE event_type WHEN 'purchase' THEN 'pass' WHEN 'click' THEN 'fail' WHEN 'view' THEN 'error' ELSE 'unavailable' END AS status,
    CASE event_id % 3 WHEN 0 THEN 'hybrid' WHEN 1 THEN 'lexical' ELSE NULL END AS retrieval_mode, CASE WHEN event_id % 4 = 0 THEN 'no embedding' ELSE '' END AS fallback_reason FROM events)"""


def _results(spark, sf) -> DataFrame:
    """Events read as results of runs, users being the runs."""
    kind, key = F.col("event_type"), F.col("event_id")
    return table(spark, sf, "events").select(
        F.col("user_id").alias("run_id"), "event_id",
        F.when(kind == "purchase", "pass").when(kind == "click", "fail").when(kind == "view", "error").otherwise("unavailable").alias("status"),
        F.when(key % 3 == 0, "hybrid").when(key % 3 == 1, "lexical").alias("retrieval_mode"),
        F.when(key % 4 == 0, "no embedding").otherwise("").alias("fallback_reason"),
    )


@query(f"""WITH {RESULTS_SQL} SELECT run_id, count(*) FILTER (status = 'pass') AS passed, count(*) FILTER (status = 'fail') AS failed, count(*) FILTER (status = 'error') AS errors,
    count(*) FILTER (status = 'unavailable') AS unavailable, count(*) FILTER (fallback_reason <> '') AS fallbacks,
    count(*) FILTER (status IN ('pass', 'fail') AND retrieval_mode = 'hybrid') AS hybrid, count(*) FILTER (status IN ('pass', 'fail') AND retrieval_mode = 'lexical') AS lexical
    FROM results GROUP BY run_id""")
def run_report(spark, sf):
    """Counters of every run, with how often each mode served a scored case."""
    found = D.run_counters(_results(spark, sf))
    mode = lambda m: F.coalesce(F.try_element_at("modes", F.lit(m)), F.lit(0).cast("long")).alias(m)
    return found.select("run_id", "passed", "failed", "errors", "unavailable", "fallbacks", mode("hybrid"), mode("lexical"))


@query(f"""WITH {RESULTS_SQL}, t AS (SELECT status, event_id % 2 = 0 AS is_table, event_id % 5 = 0 AS is_multi FROM results WHERE status IN ('pass', 'fail'))
    SELECT 'outcome_match' AS metric, count(*) FILTER (status = 'pass')::DOUBLE AS numerator, count(*)::BIGINT AS denominator, count(*) FILTER (status = 'pass') / nullif(count(*), 0)::DOUBLE AS value FROM t
    UNION ALL SELECT 'table_case_pass_rate', count(*) FILTER (is_table AND status = 'pass')::DOUBLE, count(*) FILTER (is_table), count(*) FILTER (is_table AND status = 'pass') / nullif(count(*) FILTER (is_table), 0)::DOUBLE FROM t
    UNION ALL SELECT 'multi_part_case_pass_rate', count(*) FILTER (is_multi AND status = 'pass')::DOUBLE, count(*) FILTER (is_multi), count(*) FILTER (is_multi AND status = 'pass') / nullif(count(*) FILTER (is_multi), 0)::DOUBLE FROM t""")
def case_measurements(spark, sf):
    """Ratios of sums over the scored results, and the pass rates of tagged cases."""
    results = _results(spark, sf).select(
        F.col("event_id").alias("case_id"), "status",
        F.array_compact(F.array(F.when(F.col("event_id") % 2 == 0, "table"), F.when(F.col("event_id") % 5 == 0, "multi-part"))).alias("tags"),
    )
    right = (F.col("status") == "pass").cast("double")
    scores = results.select("case_id", F.lit("outcome_match").alias("metric"), right.alias("numerator"), F.lit(1).alias("denominator"))
    return N.measurements(results, scores)


@query("""WITH c AS (SELECT doc_id, quality = 1 AS passed, CASE WHEN toxic = 0 THEN 'answerable' ELSE 'insufficient_evidence' END AS expected, lang, source FROM labels JOIN documents USING (doc_id))
    SELECT count(*) AS total, count(*) FILTER (passed) AS passed, count(*) FILTER (expected = 'answerable') AS answerable, round(count(*) FILTER (passed) / count(*)::DOUBLE, 4) AS pass_rate,
    (SELECT string_agg(lang || '=' || n, ',' ORDER BY lang) FROM (SELECT lang, count(*) AS n FROM c GROUP BY lang)) AS document_types,
    (SELECT string_agg(source || '=' || n, ',' ORDER BY source) FROM (SELECT source, count(*) AS n FROM c GROUP BY source)) AS quality_dimensions FROM c""")
def golden_summary(spark, sf):
    """Labelled documents read as golden cases: passes and histograms."""
    cases = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang", "source"), "doc_id").select(
        (F.col("quality") == 1).alias("passed"), F.when(F.col("toxic") == 0, "answerable").otherwise("insufficient_evidence").alias("expected_status"),
        F.col("lang").alias("document_type"), F.col("source").alias("quality_dimension"),
    )
    line = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias(m)
    return N.golden_summary(cases).select("total", "passed", "answerable", "pass_rate", line("document_types"), line("quality_dimensions"))


STATES_SQL = """SELECT o_orderkey AS run_id, CASE o_orderstatus WHEN 'O' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'completed' ELSE 'cancelled' END
    WHEN 'F' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'running' ELSE 'cancelled' END ELSE 'failed' END AS status FROM orders"""


@query(STATES_SQL)
def run_states(spark, sf):
    """Runs made of orders after their events: begun, finished, cancelled before or after they began, or failed."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), "o_orderstatus")
    even = F.col("run_id") % 2 == 0
    listed = (
        F.when(F.col("o_orderstatus") == "O", F.when(even, F.array(F.lit("start"), F.lit("finish"), F.lit("cancel"))).otherwise(F.array(F.lit("cancel"), F.lit("start"))))
        .when(F.col("o_orderstatus") == "F", F.when(even, F.array(F.lit("start"), F.lit("start"))).otherwise(F.array(F.lit("start"), F.lit("cancel"), F.lit("finish"))))
        .otherwise(F.array(F.lit("start"), F.lit("fail"), F.lit("interrupt")))
    )
    events = orders.select("run_id", F.posexplode(listed).alias("seq", "event"))
    return N.replay(orders.select("run_id", F.lit("queued").alias("status")), events).select("run_id", "status")


@query("""WITH p AS (SELECT doc_id, text, CASE WHEN doc_id % 7 = 0 THEN sha256(text || ' ') ELSE sha256(text) END AS kept FROM documents)
    SELECT doc_id AS case_id, kept = sha256(text) AS fresh, CASE WHEN doc_id % 11 = 0 THEN 'unavailable' WHEN doc_id % 5 = 0 THEN 'draft'
        WHEN kept <> sha256(text) THEN 'stale' WHEN e.vec_id IS NULL THEN 'unavailable' ELSE 'ready' END AS availability FROM p LEFT JOIN embeddings e ON doc_id = vec_id""")
def stale_reviews(spark, sf):
    """Whether reviewed pages are as they were: every seventh page has changed since."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    cases = docs.select(
        F.col("doc_id").alias("case_id"), F.col("doc_id").alias("document_id"), F.lit(False).alias("negative"), F.array(F.lit(1)).alias("anchor_pages"),
        F.create_map(F.lit("1"), F.when(F.col("doc_id") % 7 == 0, F.sha2(F.concat("text", F.lit(" ")), 256)).otherwise(F.sha2("text", 256))).alias("review_hashes"),
    )
    pages = docs.select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page_number"), "text")
    found = cases.join(N.page_hashes(cases, pages), "case_id", "left").withColumn("fresh", N.same_hashes(F.col("review_hashes"), F.col("hashes")))
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("document_id"), F.lit(True).alias("has_chunks"))
    stated = found.join(vectors, "document_id", "left").withColumns(
        {
            "document_status": F.when(F.col("case_id") % 11 == 0, "failed").otherwise("indexed"), "has_file": F.lit(True),
            "review_state": F.when(F.col("case_id") % 5 == 0, "draft").otherwise("reviewed"), "n_pages": F.lit(1), "unresolved": F.lit(0),
        }
    )
    return N.readiness(stated).select("case_id", "fresh", "availability")


@query("""SELECT user_id AS question_id, count(*) AS answer_count, arg_max(event_id, (ts, event_id)) AS latest, CASE WHEN user_id % 3 > 0 THEN 'grounded' ELSE 'ungrounded' END AS citation_quality
    FROM events GROUP BY user_id""")
def study_reads(spark, sf):
    """Users read as study questions and their events as answers: counts, the latest, and whether the question is grounded."""
    events = table(spark, sf, "events").select(F.col("user_id").alias("question_id"), F.col("event_id").alias("answer_id"), F.col("ts").alias("created_at"))
    cited = F.when(F.col("question_id") % 3 > 0, F.array(F.lit("c"))).otherwise(F.array().cast("array<string>"))
    read = D.study_reads(events.select("question_id").distinct().withColumn("citations", cited), events)
    return read.select("question_id", "answer_count", F.get("recent", F.lit(0)).alias("latest"), "citation_quality")


PAPER_SQL = """papers AS (SELECT o_orderkey AS id, CASE o_orderkey % 8
    WHEN 0 THEN 'Received 12 March 2024 Accepted 3 May 2024 We propose a model for ' || o_orderpriority || ' of orders in factories.'
    WHEN 1 THEN 'TOP1 (%) TOP5 ' || o_totalprice::DECIMAL(14,2)::VARCHAR || ' 81.2 90.5 77.3'
    WHEN 2 THEN 'Journal of ' || o_clerk
    WHEN 3 THEN 'The results in this section show that order ' || o_orderkey || ' improves accuracy over the baseline.'
    WHEN 4 THEN 'School of Engineering, China 200240' WHEN 5 THEN 'See the details that are listed in Fig.' WHEN 6 THEN 'Smith J, Jones et al. studied many orders and their clerks'
    ELSE '1.2 Contents ....... 3 overview ....... 9' END AS line FROM (SELECT o_orderkey, o_orderpriority, o_totalprice, 'Clerk#' || (o_custkey % 10) AS o_clerk FROM orders))"""


def _papers(spark, sf) -> DataFrame:
    """Lines as papers have them, made from orders."""
    key, text = F.col("o_orderkey"), F.lit
    lines = (
        F.concat(text("Received 12 March 2024 Accepted 3 May 2024 We propose a model for "), "o_orderpriority", text(" of orders in factories.")),
        F.concat(text("TOP1 (%) TOP5 "), F.col("o_totalprice").cast("decimal(14,2)").cast("string"), text(" 81.2 90.5 77.3")),
        F.concat(text("Journal of Clerk#"), (F.col("o_custkey") % 10).cast("string")),
        F.concat(text("The results in this section show that order "), key.cast("string"), text(" improves accuracy over the baseline.")),
        text("School of Engineering, China 200240"), text("See the details that are listed in Fig."),
        text("Smith J, Jones et al. studied many orders and their clerks"), text("1.2 Contents ....... 3 overview ....... 9"),
    )
    line = lines[7]
    for n in range(7):
        line = F.when(key % 8 == n, lines[n]).otherwise(line)
    return table(spark, sf, "orders").select(key.alias("id"), line.alias("line"))


def _boilerplate_sql(text: str) -> str:
    for pattern in T.BOILERPLATE:
        text = f"regexp_replace({text}, '{pattern}', ' ', 'gi')"
    return _collapsed_sql(text)


@query(f"""WITH {PAPER_SQL}, c AS (SELECT id, line, {_boilerplate_sql("line")} AS clean FROM papers),
    n AS (SELECT *, len(regexp_extract_all(clean, '\\b\\d+(?:\\.\\d+)?\\b')) AS figures FROM c),
    w AS (SELECT *, list_filter(string_split(clean, ' '), lambda x: x <> '') AS ws FROM n),
    f AS (SELECT *, len(list_filter(ws, lambda x: regexp_matches(trim(x, '.,;()'), '^\\d+(?:\\.\\d+)?%?$'))) AS nums,
          regexp_matches(clean, '{T.TABLE_HEAD}') OR regexp_matches(clean, '{T.TABLE_SIGNAL}') AND figures >= 2 AS table_like,
          line = '' OR regexp_matches(line, '(?i){"|".join((*T.NOISE_LINES, *T.BOILERPLATE))}') AS noise_line FROM w)
    SELECT id, clean, noise_line, table_like, regexp_matches(line, '\\b\\d{{5,}}\\b') AND regexp_matches(line, '{T.PLACES}') AS location_like,
        len(ws) < 5 OR regexp_matches(clean, '{T.DANGLING}') OR nums >= 2 AND nums * 3 >= len(ws) AND table_like OR nums >= 3 AND nums * 3 >= len(ws)
            OR regexp_matches(clean, '{T.AUTHORS}') AND NOT regexp_matches(clean, '{T.CONTRIBUTES}')
            OR clean = '' OR regexp_matches(clean, '(?i){"|".join((*T.NOISE_LINES, *T.BOILERPLATE))}') AS noise_sentence,
        len(regexp_extract_all(line, '\\.{{4,}}')) >= 2 AND regexp_matches(lower(line), 'contents|overview') AS contents_like FROM f""")
def research_lines(spark, sf):
    """Lines of papers, cleaned and told apart: publishers' lines, tables, places, sentences that say nothing, contents."""
    line = F.col("line")
    return _papers(spark, sf).select(
        "id", T.clean_research(line).alias("clean"), T.noise_line(line).alias("noise_line"), T.table_like(line).alias("table_like"),
        T.location_like(line).alias("location_like"), T.noise_sentence(line).alias("noise_sentence"), W.contents_like(line).alias("contents_like"),
    )


NUMBERS_SQL = r"list_distinct(list_transform(regexp_extract_all({}, '(?i)\b\d[\d,]*(?:\.\d+)?(?:st|nd|rd|th)?%?\b'), lambda x: regexp_replace(replace(x, ',', ''), '(?i)(?:st|nd|rd|th|%)$', '')))"


@query(f"""WITH {INVOICES_SQL}, p AS (SELECT page, text, CASE page % 3 WHEN 0 THEN 'Order ' || page || ' costs 1,234.50' WHEN 1 THEN 'The 2nd order is ' || page ELSE 'no number' END AS answer FROM invoices)
    SELECT page AS order_id, len({NUMBERS_SQL.format("answer")}) AS n_numbers, len(list_filter({NUMBERS_SQL.format("answer")}, lambda x: NOT list_contains({NUMBERS_SQL.format("text")}, x))) > 0 AS unsupported FROM p""")
def unsupported_numbers(spark, sf):
    """Whether made-up answers have numbers that the pages made of orders lack."""
    key = F.col("page")
    answer = F.when(key % 3 == 0, F.concat(F.lit("Order "), key.cast("string"), F.lit(" costs 1,234.50"))).when(key % 3 == 1, F.concat(F.lit("The 2nd order is "), key.cast("string"))).otherwise("no number")
    pairs = _invoices(spark, sf).select(key, "text", answer.alias("answer"))
    return pairs.select(key.alias("order_id"), F.size(T.number_set(F.col("answer"))).cast("long").alias("n_numbers"), T.unsupported_numbers(F.col("answer"), F.col("text")).alias("unsupported"))


@query("""WITH r AS (SELECT c_custkey AS id, c_name, 'Course Code: CS' || (c_custkey % 90 + 10) || ' Lecturer: Dr ' || c_mktsegment || ' Prepared by: ' || c_name || CASE WHEN c_custkey % 2 = 0 THEN ' Mark 80' ELSE '' END
    || ' Table of Contents Lecturer: nobody' AS t, 'CS' || (c_custkey % 90 + 10) AS code, 'Dr ' || c_mktsegment AS lecturer FROM customer)
    SELECT id, 'course code' AS label, code AS value FROM r UNION ALL SELECT id, 'lecturer', lecturer FROM r UNION ALL SELECT id, 'prepared by', c_name FROM r""")
def report_labels(spark, sf):
    """Labelled values on the first pages of reports made from customers."""
    code = F.concat(F.lit("Course Code: CS"), (F.col("c_custkey") % 90 + 10).cast("string"))
    who = F.concat(F.lit(" Lecturer: Dr "), "c_mktsegment", F.lit(" Prepared by: "), "c_name", F.when(F.col("c_custkey") % 2 == 0, " Mark 80").otherwise(""))
    pages = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.concat(code, who, F.lit(" Table of Contents Lecturer: nobody")).alias("text"))
    return pages.select("id", F.explode(T.report_labels(F.col("text"))).alias("x")).select("id", "x.label", "x.value")


TURNS_SQL = """turns AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'METHOD' WHEN role = 'system' THEN 'REFERENCES' END AS heading, text FROM conversations)"""


def _turns(spark, sf) -> DataFrame:
    """Conversations read as documents: what a user says stands under a heading, a system turn under references."""
    heading = F.when(F.col("role") == "user", "METHOD").when(F.col("role") == "system", "REFERENCES")
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("document_id"), F.lit(1).alias("page_number"), F.col("turn").cast("int").alias("chunk_index"), heading.alias("heading"), "text"
    )


@query(f"""WITH {TURNS_SQL},
    m AS (SELECT *, CASE WHEN heading = 'REFERENCES' OR starts_with({_collapsed_sql("lower(coalesce(heading || ' ', '') || text)")}, 'references') THEN 0 WHEN heading = 'METHOD' THEN 1 END AS event,
          contains({_collapsed_sql("lower(coalesce(heading || ' ', '') || text)")}, 'the') AS told FROM turns),
    c AS (SELECT *, coalesce(last_value(event IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), 0) AS open FROM m),
    b AS (SELECT *, CASE WHEN heading = 'METHOD' OR heading IS NULL AND open = 1 THEN 0 WHEN told THEN 1 END AS way FROM c WHERE event IS DISTINCT FROM 0),
    h AS (SELECT *, min(way) OVER (PARTITION BY conv_id) AS least FROM b WHERE way IS NOT NULL)
    SELECT conv_id AS qid, turn AS chunk_index, way::BIGINT AS way, row_number() OVER (PARTITION BY conv_id ORDER BY way, turn) AS place FROM h
    WHERE way = 0 OR least = 1 OR conv_id % 2 = 1""")
def section_evidence(spark, sf):
    """Turns that serve a question about methods: those under the heading, what follows without one, else those with a term."""
    turns = _turns(spark, sf)
    asked = turns.select("document_id").distinct().select(
        F.col("document_id").alias("qid"), "document_id", F.array(F.lit("METHOD")).alias("headings"), F.array(F.lit("the")).alias("terms"),
        (F.col("document_id") % 2 == 0).alias("prefer_headings"), F.lit(False).alias("skip_tables"), F.lit(True).alias("follow"),
    )
    found = A.matching_chunks(asked, turns)
    return found.select("qid", F.col("chunk_index").cast("long"), F.col("by").cast("long").alias("way"), F.col("place").cast("long"))


@query(f"""WITH {INVOICES_SQL}, f AS (SELECT doc, strftime(o_orderdate, '%Y') AS value FROM (SELECT DISTINCT o_custkey AS doc, o_orderdate FROM orders) GROUP BY ALL)
    SELECT f.doc AS document_id, value, min(page) AS page_number FROM f JOIN invoices i ON f.doc = i.doc AND contains(lower(text), lower(value)) GROUP BY ALL""")
def fact_chunks(spark, sf):
    """The first page of each customer that holds a year of their orders."""
    pages = _invoices(spark, sf).select(F.col("doc").alias("document_id"), F.col("page").alias("page_number"), F.lit(0).alias("chunk_index"), "text")
    facts = table(spark, sf, "orders").select(F.col("o_custkey").alias("document_id"), F.date_format("o_orderdate", "yyyy").alias("value")).distinct()
    facts = facts.join(pages.select("document_id").distinct(), "document_id", "left_semi")
    return A.chunk_of_facts(facts, pages).select("document_id", "value", "page_number")


@query(f"""WITH {TURNS_SQL}, u AS (SELECT * FROM turns WHERE NOT (heading IS NOT DISTINCT FROM 'REFERENCES') AND NOT starts_with({_collapsed_sql("lower(coalesce(heading || ' ', '') || text)")}, 'references'))
    SELECT conv_id AS document_id, turn AS chunk_index FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM u) WHERE n <= 3""")
def opening_chunks(spark, sf):
    """The first three turns of every conversation that are no references: the limit is the feature."""
    return A.opening_chunks(_turns(spark, sf)).select("document_id", F.col("chunk_index").cast("long"))


HEADINGS_SQL = "CASE turn % 4 WHEN 0 THEN 'ABSTRACT' WHEN 1 THEN 'METHOD' WHEN 2 THEN 'REFERENCES' ELSE NULL END"


@query(f"""WITH t AS (SELECT conv_id, turn, {HEADINGS_SQL} AS heading, text FROM conversations WHERE trim(text) <> ''),
    w AS (SELECT *, CASE heading WHEN 'ABSTRACT' THEN 80 WHEN 'METHOD' THEN 45 WHEN 'REFERENCES' THEN -100 ELSE 10 END AS worth, CASE heading WHEN 'ABSTRACT' THEN 0 WHEN 'METHOD' THEN 1 END AS part FROM t),
    r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY worth DESC, turn) AS n FROM w),
    g AS (SELECT conv_id, turn, part, worth, row_number() OVER (PARTITION BY conv_id, part ORDER BY worth DESC, turn) AS k FROM w WHERE part IS NOT NULL),
    a AS (SELECT w.conv_id, w.turn, CASE WHEN g.k = 1 THEN g.part ELSE 9 END AS own, w.worth FROM w LEFT JOIN g ON w.conv_id = g.conv_id AND w.turn = g.turn),
    b AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY own, worth DESC, turn) AS n FROM a)
    SELECT 'ranked' AS way, conv_id AS document_id, turn AS chunk_index FROM r WHERE n <= 3 UNION ALL SELECT 'balanced', conv_id, turn FROM b WHERE n <= 3""")
def summary_chunks(spark, sf):
    """The turns that a summary of each conversation draws on, by headings that are made up: ranked, and balanced over groups; three each."""
    turn = F.col("turn")
    heading = F.when(turn % 4 == 0, "ABSTRACT").when(turn % 4 == 1, "METHOD").when(turn % 4 == 2, "REFERENCES")
    turns = table(spark, sf, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("chunk_index"), heading.alias("heading"), "text")
    way = lambda found, name: found.select(F.lit(name).alias("way"), "document_id", "chunk_index")
    return way(M.ranked(turns, "document_id", 3), "ranked").unionByName(way(M.balanced(turns, "document_id", 3), "balanced"))


@query(f"""WITH {CHUNKS_SQL}, asked AS (SELECT item_id, item_id AS scope, len(q) AS n, unnest(q) AS word FROM (SELECT item_id, {_search_sql("text")} AS q FROM benchmark)),
    postings AS (SELECT doc_id, chunk_index, unnest({_search_sql("chunk")}) AS word FROM chunks),
    scored AS (SELECT item_id, doc_id, chunk_index, round_even(count(*) / any_value(n)::DOUBLE, 6) AS score FROM postings JOIN asked USING (word) WHERE doc_id = scope GROUP BY ALL)
    SELECT item_id, doc_id, chunk_index::BIGINT AS chunk_index, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, chunk_index) AS rank FROM scored) WHERE rank <= 5""")
def scoped_topk(spark, sf):
    """Every benchmark question asked of the document with its number alone."""
    asked = table(spark, sf, "benchmark").withColumn("doc_id", F.col("item_id"))
    found = S.lexical_top(asked, _chunked(spark, sf), 5, "item_id", "text", ["doc_id", "chunk_index"], "chunk", scope="doc_id")
    return found.select("item_id", "doc_id", F.col("chunk_index").cast("long"), "score", F.col("rank").cast("long"))


@query(f"""WITH {CHUNKS_SQL}, {LEXICAL_SQL},
    hits AS (SELECT item_id, doc_id, chunk_index, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, chunk_index) AS place FROM scored QUALIFY place <= 5),
    cited AS (SELECT item_id, doc_id, chunk_index, 1 AS cited FROM hits WHERE place = 4 UNION ALL SELECT item_id, doc_id, chunk_index, 2 FROM chunks JOIN benchmark ON doc_id = item_id WHERE chunk_index = 0),
    c AS (SELECT item_id, doc_id, chunk_index, min(cited) AS cited FROM cited GROUP BY ALL),
    every AS (SELECT item_id, doc_id, chunk_index, cited, place FROM c FULL JOIN hits USING (item_id, doc_id, chunk_index))
    SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY (cited IS NULL), cited, place) AS shown_at FROM every""")
def evidence_first(spark, sf):
    """Hits with what an answer cites before them: the fourth hit and the first chunk of the document with the question's number."""
    ident = F.concat_ws("|", "doc_id", "chunk_index").alias("chunk_id")
    hits = _hits(spark, sf, 5)
    items = table(spark, sf, "benchmark").select("item_id")
    # Looked up are the hits and the documents with a question's number.
    named = hits.select("doc_id").union(items.select(F.col("item_id").alias("doc_id")))
    texts = stored(_hit_chunks(spark, sf, named).select(ident, F.col("chunk").alias("text"), "doc_id", "chunk_index"), "texts")
    shown = hits.select("item_id", ident, "score", F.col("rank").alias("place")).join(texts.select("chunk_id", "text"), "chunk_id")
    fourth = hits.where("rank = 4").select("item_id", ident, F.lit(1).alias("place"))
    own = texts.where("chunk_index = 0").join(items, F.col("doc_id") == F.col("item_id")).select("item_id", "chunk_id", F.lit(2).alias("place"))
    cited = fourth.unionByName(own).groupBy("item_id", "chunk_id").agg(F.min("place").alias("place"))
    found = K.cited_first(shown, cited, texts.select("chunk_id", "text"), ["item_id"], "chunk_id")
    return found.select("item_id", F.split("chunk_id", r"\|")[0].cast("long").alias("doc_id"), F.col("shown_at").cast("long"))


@query(f"""WITH w AS (SELECT item_id, text, {_matching_sql("text")} AS q FROM benchmark)
    SELECT item_id, array_to_string(list_sort(list_distinct(list_filter([CASE WHEN contains(lower(text), 'the') THEN 'articles' END, CASE WHEN contains(lower(text), 'and') THEN 'lists' END,
        CASE WHEN contains(lower(text), 'ing') THEN 'motion' END], lambda x: x IS NOT NULL))), '|') AS phrases, len(q) AS n FROM w""")
def phrase_lists(spark, sf):
    """The phrases whose markers a question holds."""
    found = T.unique_phrases(F.col("text"), [("the", "articles"), ("and", "lists"), ("ing", "motion")])
    return table(spark, sf, "benchmark").select("item_id", F.array_join(F.array_sort(found), "|").alias("phrases"), F.size(W.matching_words(F.col("text"))).cast("long").alias("n"))


@query("""WITH u AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user')
    SELECT conv_id AS document_id, 'answer' AS role, turn AS chunk_index, '/documents/' || conv_id || '?page=1&chunk=' || turn AS document_page_url,
        CASE WHEN length(t) <= 260 THEN t ELSE rtrim(t[:257]) || '...' END AS snippet FROM (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM u)
    UNION ALL SELECT conv_id, 'related', turn, '/documents/' || conv_id || '?page=1&chunk=' || turn, CASE WHEN length(t) <= 260 THEN t ELSE rtrim(t[:257]) || '...' END
    FROM (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM conversations WHERE role <> 'user')""")
def shown_hits(spark, sf):
    """Turns as hits are shown, those of users being cited: role, snippet and link."""
    turns = _turns(spark, sf).withColumn("chunk_id", F.col("chunk_index").cast("long"))
    cited = table(spark, sf, "conversations").where("role = 'user'").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("chunk_id"))
    found = D.shown_hits(turns, cited, ["document_id", "chunk_id"])
    return found.select("document_id", "role", F.col("chunk_id").alias("chunk_index"), "document_page_url", "snippet")


@query("""WITH c AS (SELECT o_orderkey AS case_id, o_orderstatus AS content, o_orderkey % 3 AS version FROM orders),
    n AS (SELECT case_id, CASE WHEN case_id % 4 = 0 THEN 'X' ELSE content END AS new FROM c WHERE case_id % 2 = 0)
    SELECT case_id, coalesce(new, content) AS content, version + (new IS NOT NULL AND new <> content)::INT AS content_version,
        CASE WHEN new IS NOT NULL AND new <> content THEN 'draft' ELSE 'reviewed' END AS review_state FROM c LEFT JOIN n USING (case_id)""")
def case_versions(spark, sf):
    """Cases made of orders after an edit of every second: only real changes make a new version and a draft."""
    key = F.col("o_orderkey")
    cases = table(spark, sf, "orders").select(
        key.alias("case_id"), F.col("o_orderstatus").alias("content"), (key % 3).alias("content_version"), F.lit("reviewed").alias("review_state"),
        F.create_map(F.lit("1"), F.lit("h")).alias("review_hashes"),
    )
    changes = cases.where("case_id % 2 = 0").select("case_id", F.when(F.col("case_id") % 4 == 0, "X").otherwise(F.col("content")).alias("content"))
    return N.updated(cases, changes, "case_id", ["content"]).select("case_id", "content", "content_version", "review_state")



@query("""WITH r AS (SELECT event_id, CASE event_type WHEN 'purchase' THEN 'pass' WHEN 'click' THEN 'fail' WHEN 'view' THEN 'error' ELSE 'unavailable' END AS status,
        CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'needs_review' ELSE 'correct' END AS human FROM events)
    SELECT 'All' AS list, count(*) AS n FROM r UNION ALL SELECT 'Failed', count(*) FILTER (status = 'fail') FROM r UNION ALL SELECT 'Unavailable', count(*) FILTER (status = 'unavailable') FROM r
    UNION ALL SELECT 'Errors', count(*) FILTER (status = 'error') FROM r UNION ALL SELECT 'Needs review', count(*) FILTER (human IS NULL OR human = 'needs_review') FROM r""")
def review_lists(spark, sf):
    """How many results each list shows; what reviewers said is made up."""
    key = F.col("event_id")
    results = _results(spark, sf).withColumn("human_assessment", F.when(key % 3 == 1, "needs_review").when(key % 3 == 2, "correct"))
    found = None
    for name in ("All", "Failed", "Unavailable", "Errors", "Needs review"):
        counted = D.result_filter(results, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("list"), "n")
        found = counted if found is None else found.unionByName(counted)
    return found


@query("""SELECT count(*) FILTER (doc_id % 10 > 0) AS indexed, sum(CASE WHEN n_chars < 80 THEN 2 WHEN n_chars < 400 THEN 1 ELSE 0 END)::BIGINT AS warnings FROM documents""")
def dashboard(spark, sf):
    """Indexed documents and all their warnings; states are made up, warnings go by size."""
    warnings = F.when(F.col("n_chars") < 80, F.array(F.lit("a"), F.lit("b"))).when(F.col("n_chars") < 400, F.array(F.lit("a"))).otherwise(F.array().cast("array<string>"))
    docs = table(spark, sf, "documents").select(F.when(F.col("doc_id") % 10 > 0, "indexed").otherwise("failed").alias("status"), warnings.alias("warnings"))
    return D.dashboard(docs)


@query("""WITH f AS (SELECT o_custkey AS document_id, o_orderkey AS n, CASE WHEN o_orderkey % 2 = 0 THEN 'Date' ELSE 'date ' END AS label, strftime(o_orderdate, '%Y') AS value FROM orders)
    SELECT document_id, lower(trim(label)) AS label, value, min(n) AS first FROM f GROUP BY document_id, lower(trim(label)), value""")
def unique_facts(spark, sf):
    """The years of every customer's orders, each shown once, case and blanks of its label aside."""
    key = F.col("o_orderkey")
    facts = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("document_id"), key.alias("n"), F.when(key % 2 == 0, "Date").otherwise("date ").alias("label"), F.date_format("o_orderdate", "yyyy").alias("value")
    )
    found = D.unique_facts(facts, "document_id", "n")
    return found.select("document_id", F.lower(F.trim("label")).alias("label"), "value", F.col("n").alias("first"))


@query(f"""WITH {CHUNKS_SQL}, {LEXICAL_SQL}, t AS (SELECT item_id, doc_id, chunk_index, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, chunk_index) AS place FROM scored),
    seen AS (SELECT DISTINCT item_id, doc_id, chunk_index FROM t WHERE place <= 3 UNION SELECT item_id, doc_id, chunk_index FROM t WHERE place BETWEEN 3 AND 5)
    SELECT item_id, doc_id, chunk_index::BIGINT AS chunk_index FROM seen WHERE doc_id % 2 = 0""")
def cited_hits(spark, sf):
    """Citations of even documents that the trace (the first three hits) or the pack (the third to fifth) has."""
    keys = ["item_id", "doc_id", "chunk_index"]
    # The first five of twenty hits are the five hits.
    found = _hits(spark, sf, 20)
    hits = found.where("rank <= 5")
    trace, pack = hits.where("rank <= 3").select(*keys), hits.where("rank >= 3").select(*keys)
    cited = found.where("doc_id % 2 = 0").select(*keys)
    return N.cited_hits(cited, trace, pack, keys).select("item_id", "doc_id", F.col("chunk_index").cast("long"))


@query("""SELECT doc_id AS case_id FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang <> 'fr') AND doc_id IN (SELECT vec_id FROM embeddings)""")
def owned_cases(spark, sf):
    """Labelled documents read as cases whose suite, their language, and whose document, with a vector, are still there."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), F.col("lang").alias("suite_id"))
    cases = table(spark, sf, "labels").select(F.col("doc_id").alias("case_id"), F.col("doc_id").alias("document_id")).join(docs, "document_id")
    there = N.with_chunks(docs.select("document_id"), table(spark, sf, "embeddings").select(F.col("vec_id").alias("document_id")))
    return N.owned(cases, docs.where("suite_id <> 'fr'").select("suite_id").distinct(), there).select("case_id")


@query("""SELECT o_orderkey AS run_id FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100""")
def newest_runs(spark, sf):
    """The hundred newest orders read as runs: the limit of a list is the feature."""
    return D.newest(table(spark, sf, "orders"), "o_orderdate", "o_orderkey", 100).select(F.col("o_orderkey").alias("run_id"))


_PHRASES = [p for phrases in X.TYPE_WORDS.values() for p in phrases] + ["student id", "course name", "api contract"]
_HEADS = ["ABSTRACT", "REFERENCES", "METHOD", "TOTAL", "PARTIES", "EDUCATION", "FINDINGS", "OVERVIEW", "RESULTS"]


def _typed_sql() -> str:
    quote = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
    words = ", ".join(f"('{t}', {r}, '{p}', {w})" for r, (t, ps) in enumerate(X.TYPE_WORDS.items(), 1) for p, w in ps.items())
    bonus = ", ".join(f"('{t}', {w}, {quote(names)}, {least})" for t, w, names, least in X.BONUSES)
    signs = " + ".join(f"regexp_matches(low, '{p}')::INT" for p in X.SIGNALS)
    n, h = len(_PHRASES), len(_HEADS)
    return f"""WITH d AS (SELECT o_orderkey AS id, lower({quote(_PHRASES)}[o_orderkey % {n} + 1] || ' and ' || {quote(_PHRASES)}[(o_orderkey * 7 + o_custkey) % {n} + 1] || ' and ' || {quote(_PHRASES)}[(o_orderkey * 3 + 5) % {n} + 1]) AS low,
        list_distinct([{quote(_HEADS)}[o_orderkey % {h} + 1], {quote(_HEADS)}[o_custkey % {h} + 1]]) AS heads FROM orders),
    s AS (SELECT *, regexp_replace(low, '{X.TECHNICAL}', ' ', 'g') AS plain, {signs} AS signs FROM d),
    k AS (SELECT id, name, rank, sum(CASE WHEN contains(CASE WHEN name = 'contract' THEN plain ELSE low END, phrase) THEN weight ELSE 0 END) AS words FROM s, (VALUES {words}) AS t(name, rank, phrase, weight) GROUP BY ALL),
    b AS (SELECT id, name, sum(CASE WHEN len(list_intersect(heads, names)) >= least THEN weight ELSE 0 END) AS extra FROM s, (VALUES {bonus}) AS t(name, weight, names, least) GROUP BY ALL),
    a AS (SELECT k.id, k.name, CASE WHEN words > 0 THEN rank ELSE rank + {len(X.TYPE_WORDS)} END AS place, words + coalesce(extra, 0)
              + CASE WHEN k.name = 'academic_report' AND signs >= 2 THEN 6 + 2 * signs + CASE WHEN len(list_intersect(heads, {quote(X.ACADEMIC_HEADINGS)})) >= 1 THEN 3 ELSE 0 END ELSE 0 END
              - CASE WHEN k.name = 'contract' AND signs >= 3 THEN 4 ELSE 0 END AS score
          FROM k JOIN s ON k.id = s.id LEFT JOIN b ON k.id = b.id AND k.name = b.name
          UNION ALL SELECT id, 'generic', 0, 1 FROM s)
    SELECT id, arg_max(name, score * 100 - place) AS document_type, max(score)::INTEGER AS type_score FROM a GROUP BY id"""


@query(_typed_sql())
def typed_documents(spark, sf):
    """Types of texts made of three telling phrases and two headings each, chosen by the keys of orders."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda values, n: F.get(F.array(*[F.lit(v) for v in values]), (n % len(values)).cast("int"))
    text = F.concat_ws(" and ", pick(_PHRASES, key), pick(_PHRASES, key * 7 + customer), pick(_PHRASES, key * 3 + 5))
    heads = F.array_distinct(F.array(pick(_HEADS, key), pick(_HEADS, customer)))
    docs = table(spark, sf, "orders").select(key.alias("id"), text.alias("text"), heads.alias("heads"))
    return X.document_types(docs, "id", "text", headings="heads")


@query()
def answered_questions(spark, sf):
    """Every benchmark question from end to end over the chunks of all documents, with what was shown counted; gated sentence by sentence, so without SQL."""
    chunks = _chunked(spark, sf).select(
        F.xxhash64("doc_id", "chunk_index").alias("chunk_id"), F.col("doc_id").alias("document_id"), F.lit(1).alias("page_number"),
        F.col("chunk_index").cast("int").alias("chunk_index"), F.lit(None).cast("string").alias("section_heading"), F.col("chunk").alias("text"),
    )
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"), F.lit(None).cast("long").alias("document_id"))
    return E.execute(asked, chunks).answers.select("qid", "status", "confidence", "answer", "retrieval_mode", "query_intent", "answer_evidence_count", "related_count")


@query("""WITH last AS (SELECT user_id, arg_max(event_type, event_id) AS measure, floor(arg_max(value, event_id)) AS n FROM events GROUP BY user_id)
    SELECT measure, sum(n)::DOUBLE AS numerator, sum(CASE WHEN n > 0 THEN 1 ELSE 0 END)::DOUBLE AS denominator, count(*) AS cases,
        sum(n) / nullif(sum(CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END), 0)::DOUBLE AS value FROM last GROUP BY measure""")
def corrected_measures(spark, sf):
    """A stream of all events, of which a user's latest is the one that counts: sums that follow every correction."""
    events = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events.parquet*")
    amount = F.floor("value").cast("double")
    judged = events.select(
        F.col("user_id").alias("case_id"), F.col("event_id").alias("version"), F.col("event_type").alias("measure"),
        amount.alias("numerator"), (amount > 0).cast("double").alias("denominator"),
    )
    out = fresh_path(spark, "measures")
    I.running_measures(judged, out, fresh_path(spark, "measures-checkpoint")).awaitTermination()
    return I.measures(spark, out)


@query(f"""WITH {CHUNKS_SQL} SELECT 'pages' AS name, count(*) AS n, count(DISTINCT doc_id) AS documents FROM documents
    UNION ALL SELECT 'chunks', count(*), count(DISTINCT doc_id) FROM chunks""")
def index_snapshot(spark, sf):
    """All documents as pages in a folder of snapshots: what a reader sees once they are committed."""
    folder = fresh_path(spark, "index")
    pages = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.lit(1).alias("page_number"), "text")
    G.write_tables(pages, folder)
    now = H.current(spark, folder)
    read = H.read(spark, folder, "pages", now)
    chunks = H.read(spark, folder, "chunks", now).join(read.select("page_id", "path"), "page_id")
    rows = lambda name, df: df.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.countDistinct("path").alias("documents"))
    return rows("pages", read).unionByName(rows("chunks", chunks))


_LIKE_WORDS = "list_filter(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')), lambda w: NOT list_contains([" + ", ".join(f"'{w}'" for w in SIMILAR_STOPWORDS) + "], w) AND length(w) > 1)"


@query(f"""WITH s AS (SELECT role, id, {_LIKE_WORDS} AS w FROM (SELECT role, min(conv_id * 1000 + turn) AS id, text FROM conversations GROUP BY role, text)),
    j AS (SELECT a.role, a.id AS first, b.id AS second, len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w)))::DOUBLE AS jaccard
          FROM s a JOIN s b ON a.role = b.role AND a.id < b.id AND len(a.w) > 0 AND len(b.w) > 0)
    SELECT * FROM j WHERE jaccard >= 0.2""")
def similar_turns(spark, sf):
    """Different turns of a role that share a fifth of their words, copies once, as study questions are told apart by more."""
    turns = table(spark, sf, "conversations").groupBy(F.col("role").alias("group"), "text").agg(F.min(F.col("conv_id") * 1000 + F.col("turn")).alias("id"))
    return L.word_pairs(turns, 0.2).withColumnRenamed("group", "role")


@query(f"""WITH pairs AS (SELECT a.conv_id, a.turn, u.text AS expected, a.text AS given FROM conversations a JOIN conversations u
        ON a.conv_id = u.conv_id AND u.turn = a.turn - 1 WHERE a.role = 'assistant' AND u.role = 'user'),
    w AS (SELECT conv_id, turn, {Y.grading_sql("coalesce(expected, '')")} AS e, {Y.grading_sql("coalesce(given, '')")} AS g FROM pairs),
    m AS (SELECT *, list_sort(list_filter(e, lambda x: NOT list_contains(g, x))) AS missing FROM w),
    s AS (SELECT *, round_even((len(e) - len(missing)) / nullif(len(e), 0)::DOUBLE, 2) AS part, '{Y.MISSING}' || array_to_string(missing[1:8], ', ') || '.' AS line FROM m)
    SELECT conv_id, turn, CASE WHEN len(e) = 0 THEN 0.0 WHEN len(missing) = 0 THEN 1.0 ELSE part END AS score,
        CASE WHEN len(e) = 0 THEN '{Y.NOTHING_EXPECTED}' WHEN len(missing) = 0 THEN '{Y.ALL_SAID}' WHEN part = 0 THEN '{Y.NONE_SAID}' || line ELSE line END AS feedback FROM s""")
def evaluated_answers(spark, sf):
    """Assistant turns evaluated against the user turns before them, with what their writers are told."""
    talk = table(spark, sf, "conversations")
    given = talk.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("given"))
    expected = talk.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("expected"))
    pairs = given.join(expected, ["conv_id", "turn"]).withColumn("question", F.lit(""))
    return Y.evaluate(pairs, "question", "expected", "given").select("conv_id", "turn", "score", "feedback")
