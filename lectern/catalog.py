"""All registered queries of the engine, each with the SQL it is checked against.

A query takes (spark, sf_dir) and runs over whole tables. Where a query searches,
its questions are stated: all rows of ``benchmark``, or the vectors whose id is
divisible by 20.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern import section_sql
from lectern.functions import words as W
from lectern.operators import anchors as Q
from lectern.operators import answers as A
from lectern.operators import chunks as C
from lectern.operators import evaluation as E
from lectern.operators import evidence as V
from lectern.operators import facts as D
from lectern.operators import ranking as K
from lectern.operators import pivots as N
from lectern.operators import profile as X
from lectern.operators import routing as R
from lectern.operators import search as S
from lectern.operators import headings as P
from lectern.operators import study as T
from lectern.operators import tables as B
from lectern.storage import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL."""

    def register(run):
        QUERIES[run.__name__] = run
        if sql is not None:
            ORACLE_SQL[run.__name__] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# SQL of the tokenizers, made from the same fixed values.
def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _words_sql(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '[a-z0-9]+')"


def _matching_sql(text: str) -> str:
    forms = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in W.VARIANTS.items())
    return f"list_distinct(list_transform({_words_sql(text)}, lambda w: CASE w {forms} ELSE w END))"


def _search_sql(text: str) -> str:
    return f"list_filter({_matching_sql(text)}, lambda w: NOT list_contains({_list(W.SEARCH_STOPWORDS)}, w) AND length(w) > 1)"


def _verifier_sql(text: str) -> str:
    stop = _list(W.VERIFIER_STOPWORDS)
    return f"list_filter(list_distinct({_words_sql(text)}), lambda w: NOT list_contains({stop}, w) AND length(w) > 1)"


def _collapsed_sql(text: str) -> str:
    return rf"trim(regexp_replace({text}, '\s+', ' ', 'g'))"


CHUNKS_SQL = rf"""
    tokens AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda w: w <> '') AS w FROM documents),
    placed AS (SELECT doc_id, w, unnest(range(0, len(w), 780)) AS pos FROM tokens WHERE len(w) > 0),
    windows AS (SELECT doc_id, pos AS word_start, array_to_string(w[pos + 1 : pos + 900], ' ') AS chunk,
                       len(w[pos + 1 : pos + 900]) AS n_words FROM placed),
    chunks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY word_start) - 1 AS chunk_index,
                      word_start, n_words, chunk FROM windows
               WHERE len(regexp_extract_all(chunk, '[A-Za-z0-9]+')) >= 4
                 AND len(regexp_extract_all(chunk, '[A-Za-z]')) >= 16
                 AND NOT regexp_matches(chunk, '\.{{4,}}'))"""
LEXICAL_SQL = rf"""
    asked AS (SELECT item_id, len(q) AS n, unnest(q) AS word FROM (SELECT item_id, {_search_sql("text")} AS q FROM benchmark)),
    postings AS (SELECT doc_id, chunk_index, unnest({_search_sql("chunk")}) AS word FROM chunks),
    scored AS (SELECT item_id, doc_id, chunk_index, round_even(count(*) / any_value(n)::DOUBLE, 6) AS score
               FROM postings JOIN asked USING (word) GROUP BY ALL)"""
LEXICAL_TOP_SQL = f"""WITH {CHUNKS_SQL}, {LEXICAL_SQL}
    SELECT * FROM (SELECT item_id, doc_id, chunk_index, score,
        row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, chunk_index) AS rank FROM scored) WHERE rank <= 5"""


@query(f"SELECT doc_id, len(w) AS n_words, array_to_string(list_sort(w), ' ') AS words FROM (SELECT doc_id, {_matching_sql('text')} AS w FROM documents)")
def token_sets(spark, sf):
    """The folded words of every document."""
    words = W.matching_words(F.col("text"))
    docs = table(spark, sf, "documents").select("doc_id", words.alias("w"))
    return docs.select("doc_id", F.size("w").cast("long").alias("n_words"), F.array_join(F.array_sort("w"), " ").alias("words"))


@query(f"WITH {CHUNKS_SQL} SELECT doc_id, word_start, n_words, sha256(chunk) AS chunk_sha256 FROM windows")
def chunk_windows(spark, sf):
    """All word windows of every document."""
    found = C.windows(table(spark, sf, "documents"))
    return found.select("doc_id", F.col("word_start").cast("long"), F.col("n_words").cast("long"), F.sha2("chunk", 256).alias("chunk_sha256"))


@query(rf"""WITH {CHUNKS_SQL} SELECT doc_id, chunk_index, n_words,
    round_even(len(regexp_extract_all(chunk, '[A-Za-z]')) / length(regexp_replace(chunk, '\s+', '', 'g'))::DOUBLE, 4) AS density FROM chunks""")
def usable_chunks(spark, sf):
    """The numbered usable windows with their density of letters."""
    found = C.chunks(table(spark, sf, "documents"))
    return found.select("doc_id", F.col("chunk_index").cast("long"), F.col("n_words").cast("long"), "density")


@query(rf"""WITH s AS (SELECT source, length({_collapsed_sql("text")}) AS n FROM documents),
    g AS (SELECT source, count(*) AS pages, count(*) FILTER (n >= 20) AS text_pages, count(*) FILTER (n = 0) AS empty_pages,
          count(*) FILTER (n < 80) AS low_pages, sum(n)::BIGINT AS total_chars FROM s GROUP BY source)
    SELECT *, round_even(total_chars / pages::DOUBLE, 2) AS mean_chars, round_even(low_pages / pages::DOUBLE, 4) AS low_ratio,
        CASE WHEN low_pages / pages::DOUBLE >= 0.75 THEN 'high' WHEN low_pages / pages::DOUBLE >= 0.35 THEN 'medium' ELSE 'low' END AS scan_likelihood
    FROM g""")
def parse_quality_by_source(spark, sf):
    """Parse quality, each source being a document and its documents the pages."""
    found = C.parse_quality(table(spark, sf, "documents"), "source")
    return found.select("source", "pages", "text_pages", "empty_pages", "low_pages", "total_chars", "mean_chars", "low_ratio", "scan_likelihood")


@query("""WITH p AS (SELECT doc_id, n_chars, (doc_id * 37) % 101 AS confidence, (doc_id % 7) * 100.0 AS width FROM documents)
    SELECT doc_id, CASE WHEN confidence >= 85 THEN 'strong' WHEN confidence >= 65 THEN 'moderate' ELSE 'weak' END AS ocr_quality,
        CASE WHEN width <= 0 THEN 0.0 ELSE n_chars / (width * 800.0) * 1000 END::DOUBLE AS page_density FROM p""")
def page_review_flags(spark, sf):
    """OCR quality and density of pages, with made-up confidences and sizes."""
    docs = table(spark, sf, "documents")
    confidence, width = (F.col("doc_id") * 37) % 101, (F.col("doc_id") % 7).cast("double") * 100
    return docs.select(
        "doc_id", C.ocr_quality(confidence).alias("ocr_quality"),
        C.page_density(F.col("n_chars").cast("double"), width, F.lit(800.0)).alias("page_density"),
    )


@query("""WITH low AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn FROM documents
    WHERE length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) < 80) SELECT source, doc_id FROM low WHERE turn <= 25""")
def sparse_page_selection(spark, sf):
    """The first 25 pages per source that need OCR: the limit is the feature."""
    return C.sparse_pages(table(spark, sf, "documents"), "source", "doc_id").select("source", "doc_id")


def _chunked(spark, sf) -> DataFrame:
    return C.chunks(table(spark, sf, "documents"))


def _lexical(spark, sf, k: int) -> DataFrame:
    return S.lexical_top(table(spark, sf, "benchmark"), _chunked(spark, sf), k, "item_id", "text", ["doc_id", "chunk_index"], "chunk")


def _hits(spark, sf, k: int) -> DataFrame:
    """The hits of ``_lexical``, searched once and written, for queries that go on with them."""
    return stored(_lexical(spark, sf, k), "hits")


def _hit_chunks(spark, sf, named: DataFrame) -> DataFrame:
    """The chunks of the documents that ``named`` (doc_id) names: no other text is cut or moved."""
    docs, ids = table(spark, sf, "documents"), named.select(F.col("doc_id").alias("named_id")).distinct()
    return C.chunks(docs.join(ids, F.col("doc_id").eqNullSafe(F.col("named_id")), "left_semi"))


@query(LEXICAL_TOP_SQL.replace("SELECT * FROM (SELECT", "SELECT item_id, doc_id, chunk_index::BIGINT AS chunk_index, score, rank FROM (SELECT"))
def lexical_topk(spark, sf):
    """The five best chunks of all documents for every benchmark question."""
    found = _lexical(spark, sf, 5)
    return found.select("item_id", "doc_id", F.col("chunk_index").cast("long"), "score", F.col("rank").cast("long"))


VECTOR_SQL = """
    q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS a FROM embeddings WHERE vec_id % 20 = 0),
    near AS (SELECT query_id, vec_id, round(greatest(0, least(1, list_cosine_similarity(a, embedding::DOUBLE[]))), 6) AS score
             FROM q, embeddings),
    nearest AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM near)"""


def _vector(spark, sf, k: int) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    asked = vectors.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    return S.vector_top(asked, vectors, k, "query_id", "vec_id")


@query(f"WITH {VECTOR_SQL} SELECT query_id, vec_id, score, rank FROM nearest WHERE rank <= 5")
def vector_topk(spark, sf):
    """The five nearest vectors for every vector whose id is divisible by 20."""
    return _vector(spark, sf, 5).select("query_id", "vec_id", "score", F.col("rank").cast("long"))


@query(f"WITH {VECTOR_SQL} SELECT query_id, vec_id, score, rank FROM nearest WHERE rank <= 5")
def vector_topk_pivots(spark, sf):
    """The same by blocks around pivots, as for questions that no task can hold."""
    vectors = table(spark, sf, "embeddings")
    asked = vectors.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    found = N.top(asked, vectors, 5, "query_id", "vec_id")
    return found.select("query_id", "vec_id", "score", F.col("rank").cast("long"))


HYBRID_SQL = f"""WITH {CHUNKS_SQL},
    asked AS (SELECT item_id AS query_id, len(q) AS n, unnest(q) AS word FROM (SELECT item_id, {_search_sql("text")} AS q FROM benchmark)),
    postings AS (SELECT doc_id, unnest({_search_sql("text")}) AS word FROM documents),
    lex AS (SELECT query_id, doc_id, round_even(count(*) / any_value(n)::DOUBLE, 6) AS score FROM postings JOIN asked USING (word) GROUP BY ALL),
    l AS (SELECT query_id, doc_id, score FROM lex QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 20),
    {VECTOR_SQL.replace("SELECT vec_id AS query_id, embedding::DOUBLE[] AS a FROM embeddings WHERE vec_id % 20 = 0", "SELECT item_id AS query_id, embedding::DOUBLE[] AS a FROM benchmark JOIN embeddings ON item_id = vec_id")},
    v AS (SELECT query_id, vec_id AS doc_id, score FROM nearest WHERE rank <= 20),
    m AS (SELECT query_id, doc_id, coalesce(v.score, 0.0) AS vector_score, coalesce(l.score, 0.0) AS lexical_score
          FROM v FULL JOIN l USING (query_id, doc_id)),
    best AS (SELECT *, greatest(vector_score, lexical_score) AS score,
          row_number() OVER (PARTITION BY query_id ORDER BY greatest(vector_score, lexical_score) DESC, doc_id) AS rank FROM m)"""


def _hybrid(spark, sf, k: int = 5) -> DataFrame:
    docs, vectors = table(spark, sf, "documents"), table(spark, sf, "embeddings").select("vec_id", "embedding")
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    fetched = S.candidate_limit(k)
    lexical = S.lexical_top(asked, docs, fetched, "query_id", "question", ["doc_id"], "text")
    embedded = asked.join(vectors, F.col("query_id") == F.col("vec_id")).select("query_id", "embedding")
    vector = S.vector_top(embedded, vectors, fetched, "query_id", "vec_id").withColumnRenamed("vec_id", "doc_id")
    return S.merge_hybrid(vector, lexical, k, ["query_id", "doc_id"], "query_id")


@query(HYBRID_SQL + " SELECT query_id, doc_id, vector_score, lexical_score, score, rank FROM best WHERE rank <= 5")
def hybrid_topk(spark, sf):
    """Words and vectors together: every benchmark question asks with all its words and the vector of its number."""
    return _hybrid(spark, sf).select("query_id", "doc_id", "vector_score", "lexical_score", "score", F.col("rank").cast("long"))


@query(f"""WITH {CHUNKS_SQL}, {LEXICAL_SQL},
    hits AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, chunk_index) <= 20),
    w AS (SELECT item_id, doc_id, chunk_index, score, {_matching_sql("b.text")} AS q, {_matching_sql("c.chunk")} AS d
          FROM hits JOIN benchmark b USING (item_id) JOIN chunks c USING (doc_id, chunk_index)),
    r AS (SELECT item_id, doc_id, chunk_index::BIGINT AS chunk_index, len(list_intersect(q, d)) / len(q)::DOUBLE AS keyword, score AS source FROM w)
    SELECT item_id, doc_id, chunk_index, keyword, round(0.75 * source + 0.15 * keyword, 9) AS score FROM r""")
def rerank(spark, sf):
    """The candidates of every question with their reranked scores."""
    hits = _hits(spark, sf, 20).drop("rank").withColumnRenamed("score", "source")
    texts = _hit_chunks(spark, sf, hits).select("doc_id", "chunk_index", "chunk")
    asked = table(spark, sf, "benchmark").withColumnRenamed("text", "question")
    both = hits.join(asked, "item_id").join(texts, ["doc_id", "chunk_index"])
    keyword = W.overlap(W.matching_words(F.col("question")), W.matching_words(F.col("chunk")))
    scored = both.select("item_id", "doc_id", F.col("chunk_index").cast("long"), "source", keyword.alias("keyword"))
    final = F.round(S.rerank_score(F.col("source"), F.col("keyword"), F.lit(0.0)), 9)
    return scored.select("item_id", "doc_id", "chunk_index", "keyword", final.alias("score"))


def _intent_sql(norm: str) -> str:
    cases = " ".join(f"WHEN {' OR '.join(f'''contains({norm}, '{p}')''' for p in phrases)} THEN '{name}'" for name, phrases in R.RULES)
    return f"CASE {cases} ELSE '{R.FALLBACK}' END"


ASKED_SQL = """asked AS (SELECT o_orderkey AS qid, CASE o_orderkey % 6 WHEN 0 THEN 'When is payment due for ' WHEN 1 THEN 'What methods does '
    WHEN 2 THEN 'Who are the parties of ' WHEN 3 THEN 'Summarize ' WHEN 4 THEN 'What is the total due of ' ELSE 'Tell me about ' END
    || o_orderpriority || '?' AS question, CASE o_orderkey % 4 WHEN 0 THEN 'invoice' WHEN 1 THEN 'research_paper' WHEN 2 THEN 'resume' ELSE 'contract' END AS kind FROM orders)"""


@query(f"""WITH {ASKED_SQL}, n AS (SELECT qid, kind, array_to_string({_words_sql("question")}, ' ') AS norm FROM asked),
    i AS (SELECT *, {_intent_sql("norm")} AS intent FROM n)
    SELECT qid, intent, CASE WHEN kind = 'research_paper' AND intent = 'parties' THEN '{R.NO_PARTIES}'
        WHEN kind = 'research_paper' AND (intent IN ('payment_due', 'payment_terms') OR intent = 'amounts' AND ({" OR ".join(f"contains(norm, '{p}')" for p in R.INVOICE_AMOUNTS)})) THEN '{R.NO_INVOICE_IN_PAPER}'
        WHEN kind = 'invoice' AND intent IN ('methods', 'datasets', 'results', 'limitations') THEN '{R.NO_RESEARCH_IN_INVOICE}'
        WHEN kind = 'resume' AND intent IN ('amounts', 'parties', 'obligations', 'risks') THEN '{R.NO_CONTRACT_IN_RESUME}'
        WHEN kind = 'contract' AND intent IN ('methods', 'datasets', 'results', 'limitations') THEN '{R.NO_RESEARCH_IN_CONTRACT}' END AS mismatch FROM i""")
def route_intents(spark, sf):
    """Intents of questions made from orders, held against document types."""
    key = F.col("o_orderkey")
    starts = ["When is payment due for ", "What methods does ", "Who are the parties of ", "Summarize ", "What is the total due of ", "Tell me about "]
    kinds = ["invoice", "research_paper", "resume", "contract"]
    pick = lambda values, n: F.get(F.array(*[F.lit(v) for v in values]), (key % n).cast("int"))
    asked = table(spark, sf, "orders").select(
        key.alias("qid"), F.concat(pick(starts, 6), F.col("o_orderpriority"), F.lit("?")).alias("question"), pick(kinds, 4).alias("kind")
    )
    found = asked.withColumn("intent", R.intent(F.col("question")))
    return found.select("qid", "intent", R.mismatch(F.col("question"), F.col("intent"), F.col("kind")).alias("mismatch"))


INVOICES_SQL = """invoices AS (SELECT o_custkey AS doc, o_orderkey AS page, 'Invoice ' || o_orderkey || '. Bill to: ' || c_name || '. Issue date '
    || strftime(o_orderdate, '%Y-%m-%d') || '. Total due USD ' || o_totalprice::DECIMAL(14,2)::VARCHAR || '.' AS text
    FROM orders JOIN customer ON o_custkey = c_custkey)"""


def _invoices(spark, sf) -> DataFrame:
    """A page of text per order, customers being the documents."""
    both = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    text = F.concat(
        F.lit("Invoice "), F.col("o_orderkey").cast("string"), F.lit(". Bill to: "), F.col("c_name"), F.lit(". Issue date "),
        F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(". Total due USD "), F.col("o_totalprice").cast("decimal(14,2)").cast("string"), F.lit("."),
    )
    return both.select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("page"), text.alias("text"))


def _type_sql() -> str:
    rows = ", ".join(f"('{t}', {r}, '{p}', {w})" for r, (t, ps) in enumerate(D.TYPE_WORDS.items(), 1) for p, w in ps.items())
    return f"(VALUES {rows}) AS k(name, rank, phrase, weight)"


@query(f"""WITH {INVOICES_SQL}, s AS (SELECT page, name, rank, sum(CASE WHEN contains(lower(text), phrase) THEN weight ELSE 0 END) AS score
        FROM invoices, {_type_sql()} GROUP BY ALL),
    a AS (SELECT page, name, rank, score FROM s UNION ALL SELECT page, 'generic', 0, 1 FROM invoices)
    SELECT page AS order_id, arg_max(name, score * 100 - rank) AS document_type, max(score)::INTEGER AS type_score FROM a GROUP BY page""")
def doc_type_scores(spark, sf):
    """The type of every page made from an order."""
    return D.document_types(_invoices(spark, sf), "page", "text").withColumnRenamed("page", "order_id")


@query(f"""WITH {INVOICES_SQL},
    m AS (SELECT doc, page, 0 AS p, regexp_extract_all(text, '\\b\\d{{4}}-\\d{{2}}-\\d{{2}}\\b') AS found FROM invoices
          UNION ALL SELECT doc, page, 3, regexp_extract_all(text, '\\b(?:19|20)\\d{{2}}\\b') FROM invoices),
    f AS (SELECT doc, page, p, unnest(range(len(found))) AS i, unnest(found) AS value FROM m),
    o AS (SELECT doc, value, min(page * 1000 + p * 100 + i) AS first FROM f GROUP BY ALL)
    SELECT doc, value, place FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY first, value) AS place FROM o) WHERE place <= 12""")
def date_facts(spark, sf):
    """The first twelve dates of every customer's pages: the limit is the feature."""
    found = D.facts(_invoices(spark, sf), D.DATES, "doc", "page", "text")
    return found.select("doc", "value", F.col("place").cast("long"))


@query(f"""WITH {INVOICES_SQL},
    f AS (SELECT doc, page, unnest(regexp_extract_all(text, '\\bUSD\\s?\\d[\\d,]*(?:\\.\\d{{2}})?\\b')) AS value FROM invoices),
    o AS (SELECT doc, value, min(page) AS first FROM f GROUP BY ALL)
    SELECT doc, value, place FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY first, value) AS place FROM o) WHERE place <= 12""")
def amount_facts(spark, sf):
    """The first twelve amounts of every customer's pages: the limit is the feature."""
    return D.facts(_invoices(spark, sf), D.AMOUNTS, "doc", "page", "text").select("doc", "value", F.col("place").cast("long"))


@query(rf"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY {_collapsed_sql('lower(text)')} ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def exact_dup_text(spark, sf):
    """The first document of each text, case and blanks aside."""
    docs = table(spark, sf, "documents").select("doc_id", F.sha2(W.collapsed(F.lower("text")), 256).alias("h"))
    return docs.groupBy("h").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("SELECT doc_id, sha256(text) AS page_sha256 FROM documents")
def page_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", W.page_hash(F.col("text")).alias("page_sha256"))


@query(rf"""SELECT item_id, doc_id FROM documents d JOIN benchmark b
    ON contains({_collapsed_sql("lower(d.text)")}, {_collapsed_sql("lower(b.text)")})""")
def anchor_containment(spark, sf):
    """Documents that hold a benchmark text, blanks and case aside; found by the rarest of its inner words, if it has any."""
    docs = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", W.collapsed(F.lower("text")).alias("page"))
    items = table(spark, sf, "benchmark").where("text IS NOT NULL").select("item_id", W.collapsed(F.lower("text")).alias("quote"))
    postings = docs.select("doc_id", F.explode(W.word_set(F.col("page"))).alias("word"))
    # A quote's first and last word may be cut, so an inner word finds its pages.
    items = items.withColumn("inner", W.word_set(F.regexp_extract("quote", r"^\S+\s(.*)\s\S+$", 1)))
    inner = items.select("item_id", F.explode("inner").alias("word"))
    common = postings.join(inner.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.count("*").alias("df"))
    ranked = inner.join(common, "word", "left").na.fill(0, ["df"])
    rarest = ranked.groupBy("item_id").agg(F.min_by("word", F.struct("df", "word")).alias("word"))
    likely = postings.join(rarest, "word").select("item_id", "doc_id").distinct()
    worded = likely.join(docs, "doc_id").join(items.where(F.size("inner") > 0), "item_id").where(F.contains("page", "quote"))
    wordless = items.where(F.size("inner") == 0).withColumn("sign", F.left("quote", F.lit(2)))
    if wordless.isEmpty():
        return worded.select("item_id", "doc_id")
    # Quotes without an inner word are found by their first two signs, those of one by it, an empty one in every page.
    signs = F.split("page", "")
    pairs = F.zip_with(signs, F.slice(signs, 2, F.size(signs)), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    begun = docs.select("doc_id", "page", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), signs, pairs))).alias("sign"))
    likely = begun.join(wordless, "sign").where(F.contains("page", "quote"))
    return worded.select("item_id", "doc_id").union(likely.select("item_id", "doc_id"))


@query(f"""WITH pairs AS (SELECT a.conv_id, a.turn, a.text AS answer, u.text AS evidence FROM conversations a JOIN conversations u
        ON a.conv_id = u.conv_id AND u.turn = a.turn - 1 WHERE a.role = 'assistant' AND u.role = 'user'),
    said AS (SELECT conv_id, turn, answer, evidence, list_filter(list_transform(string_split_regex(trim(answer), '[.!?]\\s+'), lambda x: trim(x)), lambda x: x <> '') AS ss,
        list_filter(list_transform(string_split_regex(trim(evidence), '[.!?]\\s+'), lambda x: trim(x)), lambda x: x <> '') AS es FROM pairs),
    s AS (SELECT conv_id, turn, unnest(range(len(ss))) AS sentence_no, unnest(ss) AS sentence, es FROM said),
    e AS (SELECT conv_id, turn, sentence_no, {_verifier_sql("sentence")} AS sw, unnest(CASE WHEN len(es) = 0 THEN [''] ELSE es END) AS x FROM s),
    o AS (SELECT conv_id, turn, sentence_no, CASE WHEN len(sw) = 0 THEN 0.0 ELSE len(list_intersect(sw, {_verifier_sql("x")})) / len(sw)::DOUBLE END AS score FROM e)
    SELECT conv_id, turn, sentence_no::BIGINT AS sentence_no, max(score) AS score FROM o GROUP BY ALL""")
def sentence_support(spark, sf):
    """How much of each assistant sentence one sentence of the turn before holds."""
    talk = table(spark, sf, "conversations")
    said = talk.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer"))
    asked = talk.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("evidence"))
    pairs = said.join(asked, ["conv_id", "turn"])
    split = lambda c: V.sentences(F.col(c), V.SIMPLE_END)
    each = pairs.select("conv_id", "turn", F.posexplode(split("answer")).alias("sentence_no", "s"), split("evidence").alias("es"))
    words = each.select("conv_id", "turn", "sentence_no", W.verifier_words(F.col("s")).alias("sw"), F.transform("es", W.verifier_words).alias("ews"))
    best = F.array_max(F.transform("ews", lambda ew: W.overlap(F.col("sw"), ew)))
    return words.select("conv_id", "turn", F.col("sentence_no").cast("long"), F.coalesce(best, F.lit(0.0)).alias("score"))


@query(f"""WITH pairs AS (SELECT a.conv_id, a.turn, u.text AS expected, a.text AS given FROM conversations a JOIN conversations u
        ON a.conv_id = u.conv_id AND u.turn = a.turn - 1 WHERE a.role = 'assistant' AND u.role = 'user'),
    w AS (SELECT conv_id, turn, {T.grading_sql("expected")} AS e, {T.grading_sql("given")} AS g FROM pairs)
    SELECT conv_id, turn, len(list_intersect(e, g)) / len(e)::DOUBLE AS score,
        CASE WHEN len(list_intersect(e, g)) / len(e)::DOUBLE >= 0.75 THEN 'strong' WHEN len(list_intersect(e, g)) / len(e)::DOUBLE >= 0.4 THEN 'partial' ELSE 'needs work' END AS band
    FROM w WHERE len(e) > 0""")
def grade_answers(spark, sf):
    """Assistant turns graded by the words of the user turns before them."""
    talk = table(spark, sf, "conversations")
    given = talk.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("given"))
    expected = talk.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("expected"))
    graded = T.grade(given.join(expected, ["conv_id", "turn"]), "expected", "given")
    return graded.where("n_expected > 0").select("conv_id", "turn", "score", "band")


@query(f"""WITH w AS (SELECT item_id, {T.grading_sql("text")} AS w FROM benchmark)
    SELECT a.item_id AS first_id, b.item_id AS second_id, len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w)))::DOUBLE AS jaccard
    FROM w a JOIN w b ON a.item_id < b.item_id WHERE len(list_intersect(a.w, b.w)) > 0
      AND len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w)))::DOUBLE >= 0.2""")
def jaccard_dups(spark, sf):
    """Pairs of benchmark questions that share a fifth of their words."""
    return T.jaccard_pairs(table(spark, sf, "benchmark"), "item_id", "text", 0.2)


@query(f"""WITH {CHUNKS_SQL}, {LEXICAL_SQL},
    log AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, chunk_index) AS rank FROM scored),
    kept AS (SELECT item_id, rank FROM log JOIN labels USING (doc_id) WHERE rank <= 20 AND quality = 1),
    best AS (SELECT item_id, min(rank) AS best FROM kept GROUP BY item_id)
    SELECT coalesce(avg((best <= 5)::INT::DOUBLE), 0.0) AS hit_rate, round(coalesce(avg(1.0 / best), 0.0), 9) AS mrr FROM best""")
def retrieval_metrics(spark, sf):
    """Hit rate and reciprocal rank of the labelled documents of good quality."""
    good = table(spark, sf, "labels").where("quality = 1").select("doc_id")
    log = _lexical(spark, sf, 20).join(good, "doc_id", "left_semi")
    return E.stored_retrieval_metrics(log, "item_id", "rank").withColumn("mrr", F.round("mrr", 9))


@query("""SELECT lang, sum(quality)::BIGINT AS numerator, (count(*) - sum(toxic))::BIGINT AS denominator,
    sum(quality) / nullif(count(*) - sum(toxic), 0)::DOUBLE AS value FROM labels JOIN documents USING (doc_id) GROUP BY lang""")
def ratio_of_sums(spark, sf):
    """Labelled quality per language as a ratio of sums."""
    both = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    measured = both.withColumns({"numerator": F.col("quality").cast("long"), "denominator": (1 - F.col("toxic")).cast("long")})
    return E.ratios_of_sums(measured, ["lang"])


@query("""SELECT user_id, count(*) AS runs, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'purchase') AS purchases,
    count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id""")
def run_counters(spark, sf):
    """Conditional counts of a log."""
    kind = F.col("event_type")
    return table(spark, sf, "events").groupBy("user_id").agg(
        F.count("*").alias("runs"), F.count_if(kind == "click").alias("clicks"),
        F.count_if(kind == "purchase").alias("purchases"), F.countDistinct(kind).alias("kinds"),
    )


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def latest_per_key(spark, sf):
    """The latest event of every user."""
    return K.latest(table(spark, sf, "events").select("user_id", "ts", "event_id"), ["user_id"], "ts", "event_id").select("user_id", "event_id")


@query("""SELECT user_id, count(*) AS n, array_to_string(list_slice(list(event_id ORDER BY ts DESC, event_id DESC), 1, 3), ',') AS recent
    FROM events GROUP BY user_id""")
def recent_three(spark, sf):
    """How many events a user has, and the three latest: the limit is the feature."""
    found = K.recent(table(spark, sf, "events"), ["user_id"], "event_id", "ts", "event_id")
    return found.select("user_id", "n", F.array_join(F.transform("recent", lambda e: e.cast("string")), ",").alias("recent"))


@query("""SELECT conv_id, turn, coalesce(last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER
    (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), -1) AS heading_turn FROM conversations""")
def carry_forward_heading(spark, sf):
    """Every turn with the last user turn up to it, as chunks inherit their heading."""
    heading = K.carried(F.when(F.col("role") == "user", F.col("turn")), ["conv_id"], [F.col("turn")])
    return table(spark, sf, "conversations").select("conv_id", "turn", F.coalesce(heading, F.lit(-1).cast("long")).alias("heading_turn"))


@query(f"""WITH {CHUNKS_SQL}, {LEXICAL_SQL},
    m AS (SELECT *, max(score) OVER (PARTITION BY item_id) AS best FROM scored)
    SELECT item_id, doc_id, chunk_index::BIGINT AS chunk_index FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY doc_id, chunk_index) AS n FROM m WHERE score = best) WHERE n <= 3""")
def ties_with_best(spark, sf):
    """The first three chunks that share a question's best score: the limit is the feature."""
    scored = S.lexical_best(table(spark, sf, "benchmark"), _chunked(spark, sf), 1, "item_id", "text", ["doc_id", "chunk_index"], "chunk")
    found = K.ties_with_best(scored, ["item_id"], "score", [F.col("doc_id"), F.col("chunk_index")])
    return found.select("item_id", "doc_id", F.col("chunk_index").cast("long"))


@query(f"""WITH {CHUNKS_SQL}, {LEXICAL_SQL}, p AS (SELECT item_id, doc_id, chunk_index, round(score * n)::BIGINT AS points FROM
        (SELECT s.*, len({_search_sql("b.text")}) AS n FROM scored s JOIN benchmark b USING (item_id))),
    b AS (SELECT item_id, max(points) AS best FROM p GROUP BY item_id)
    SELECT item_id, doc_id, chunk_index::BIGINT AS chunk_index, points FROM p JOIN b USING (item_id) WHERE best <= 0 OR points >= greatest(1, best - 2)""")
def near_best(spark, sf):
    """All chunks that have at most two words less of a question than its best ones."""
    asked = table(spark, sf, "benchmark")
    scored = S.lexical_best(asked, _chunked(spark, sf), 1, "item_id", "text", ["doc_id", "chunk_index"], "chunk", slack=2)
    sizes = asked.select("item_id", F.size(W.search_words(F.col("text"))).alias("n"))
    points = scored.join(sizes, "item_id").withColumn("points", F.round(F.col("score") * F.col("n")).cast("long"))
    return K.near_best(points, ["item_id"], "points").select("item_id", "doc_id", F.col("chunk_index").cast("long"), "points")


@query("""SELECT doc_id, CASE WHEN vec_id IS NOT NULL THEN 'ready' WHEN quality IS NOT NULL THEN 'embed' ELSE 'chunk' END AS stage,
    CASE WHEN vec_id IS NOT NULL THEN 100 WHEN quality IS NOT NULL THEN 80 ELSE 60 END AS progress
    FROM documents LEFT JOIN embeddings ON doc_id = vec_id LEFT JOIN labels USING (doc_id)""")
def processing_status(spark, sf):
    """Stage and progress: embedded documents are ready, labelled ones have chunks."""
    docs = table(spark, sf, "documents").select("doc_id")
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(1).alias("embedded"))
    labels = table(spark, sf, "labels").select("doc_id", F.lit(1).alias("n_chunks"))
    both = docs.join(vectors, "doc_id", "left").join(labels, "doc_id", "left").na.fill(0, ["embedded", "n_chunks"])
    stated = both.select("doc_id", F.when(F.col("embedded") == 1, "indexed").otherwise("processing").alias("status"), F.lit(1).alias("n_pages"), "n_chunks")
    return C.processing_status(stated).select("doc_id", "stage", "progress")


@query(HYBRID_SQL + """ SELECT query_id, doc_id, CASE WHEN vector_score > 0 AND lexical_score > 0 THEN 'both' WHEN vector_score > 0 THEN 'vector'
    ELSE 'lexical' END AS found_by FROM best WHERE rank <= 5""")
def semi_anti_related(spark, sf):
    """Merged hits that either search found alone, by semi and anti joins."""
    hits = _hybrid(spark, sf)
    both = hits.where("vector_score > 0 and lexical_score > 0")
    alone = F.when(F.col("vector_score") > 0, "vector").otherwise("lexical")
    return K.split_cited(hits, both, ["query_id", "doc_id"]).select("query_id", "doc_id", F.when(F.col("role") == "answer", "both").otherwise(alone).alias("found_by"))


@query("""SELECT lang, source, doc_id FROM (SELECT lang, source, doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n = 1""")
def stratified_pick(spark, sf):
    """The longest document of every language and source."""
    best = K.first_rows(table(spark, sf, "documents").drop("text"), ["lang", "source"], [F.desc("n_chars"), F.col("doc_id")])
    return best.select("lang", "source", "doc_id")


@query("""WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '<h[1-6][^>]*>([^<]*)</h[1-6]>', 1)) AS heading FROM pages)
    SELECT page_id, trim(heading) AS heading, count(*) AS n FROM h GROUP BY ALL""")
def section_headings(spark, sf):
    """The headings of every web page, each once with its count."""
    found = F.explode(F.regexp_extract_all("html", F.lit("<h[1-6][^>]*>([^<]*)</h[1-6]>"), F.lit(1)))
    heads = table(spark, sf, "pages").select("page_id", found.alias("h"))
    return heads.groupBy("page_id", F.trim("h").alias("heading")).agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, sha256(array_to_string({_words_sql('text')}, ' ')) AS normalized_sha256 FROM documents")
def normalized_question(spark, sf):
    """Every text as questions are normalized, as a hash of the whole."""
    return table(spark, sf, "documents").select("doc_id", F.sha2(W.normalized(F.col("text")), 256).alias("normalized_sha256"))


@query()
def evidence_pack(spark, sf):
    """Chosen and refused evidence for every benchmark question; order-dependent, so without SQL."""
    hits = _hits(spark, sf, 20)
    texts = _hit_chunks(spark, sf, hits).select("doc_id", "chunk_index", "chunk", "word_start")
    full = hits.join(texts, ["doc_id", "chunk_index"]).select(
        F.col("item_id").alias("qid"), F.lit("whole").alias("part"), F.xxhash64("doc_id", "chunk_index").alias("chunk_id"),
        F.col("doc_id").alias("document_id"), F.col("chunk_index").cast("int").alias("page_number"), F.col("chunk").alias("text"),
        "score", F.col("score").alias("source_score"),
    )
    return V.evidence_packs(full)


@query("""SELECT l_orderkey AS order_id, count(*) AS n_rows, 3 * count(*) AS n_cells, sum(l_quantity)::BIGINT AS total
    FROM lineitem GROUP BY l_orderkey""")
def table_cells(spark, sf):
    """Cells found in tables of text made from the lines of orders."""
    line = F.concat_ws("\t", F.concat(F.lit("part number "), F.col("l_partkey").cast("string")), F.col("l_quantity").cast("long").cast("string"), F.date_format("l_shipdate", "yyyy"))
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_list(line), "\n").alias("body"))
    pages = lines.select("l_orderkey", F.concat(F.lit("Table 1 Parts\nPart\tQuantity\tYear\n"), F.col("body")).alias("text"))
    cells = B.table_cells(pages, ["l_orderkey"])
    number = F.when(F.col("column_label") == "Quantity", F.col("text").try_cast("long"))
    return cells.groupBy(F.col("l_orderkey").alias("order_id")).agg(
        (F.max("row_index").cast("long") + 1).alias("n_rows"), F.count("*").alias("n_cells"), F.sum(number).alias("total")
    )


@query(section_sql.chunks("SELECT doc_id, text AS t FROM documents", "doc_id"))
def section_chunks(spark, sf):
    """Section-aware windows of every document."""
    return P.section_chunks(table(spark, sf, "documents"), ["doc_id"])


#: A conversation as a page: what each role says stands under a heading line of its own kind.
ROLE_HEADINGS = {"system": "Scope:", "user": "BACKGROUND", "assistant": "3.1. Model design"}
CONVERSATION_PAGES_SQL = f"""SELECT conv_id, string_agg(CASE role {" ".join(f"WHEN '{r}' THEN '{h}'" for r, h in ROLE_HEADINGS.items())} ELSE 'NEXT STEPS' END
    || chr(10) || coalesce(text, ''), chr(10) ORDER BY turn, role) AS t FROM conversations GROUP BY conv_id"""


@query(section_sql.chunks(CONVERSATION_PAGES_SQL, "conv_id"))
def conversation_sections(spark, sf):
    """The sections of conversations, each a page whose headings are its roles."""
    heading = F.coalesce(*[F.when(F.col("role") == r, h) for r, h in ROLE_HEADINGS.items()], F.lit("NEXT STEPS"))
    said = F.struct("turn", "role", F.concat_ws("\n", heading, F.coalesce("text", F.lit(""))).alias("line"))
    pages = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(said)).alias("said"))
    texts = pages.select("conv_id", F.array_join(F.transform("said", lambda x: x["line"]), "\n").alias("text"))
    return P.section_chunks(texts, ["conv_id"])


@query()
def document_profiles(spark, sf):
    """Profiles of customers from the pages made of their orders; rule-based, so without SQL."""
    pages = _invoices(spark, sf).select("doc", F.concat(F.lit("customer"), F.col("doc"), F.lit(".pdf")).alias("filename"), "page", "text")
    return X.profiles(pages, "doc", "filename", "page")


def _packs(spark, sf) -> DataFrame:
    """Chosen evidence of every benchmark question with its text."""
    chosen = stored(evidence_pack(spark, sf).where("place is not null"), "chosen")
    texts = _hit_chunks(spark, sf, chosen.select(F.col("document_id").alias("doc_id"))).select(F.xxhash64("doc_id", "chunk_index").alias("chunk_id"), F.col("chunk").alias("text"))
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    full = chosen.join(texts, "chunk_id").join(asked, "qid")
    return full.select(
        "qid", "question", "place", "chunk_id", "text", "score", F.col("score").alias("source_score"), F.lit(None).cast("string").alias("section_heading")
    )


@query()
def extractive_answers(spark, sf):
    """Answers of every benchmark question from its evidence; gated sentence by sentence, so without SQL."""
    return A.answers(_packs(spark, sf), "qid", "question")


@query()
def verified_answers(spark, sf):
    """Answers whose every sentence the evidence supports, or abstentions; without SQL."""
    return A.verified_answers(_packs(spark, sf), "qid", "question")


def _source_sql(text: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({text}, '([A-Za-z])-\s+([A-Za-z])', '\1\2', 'g'), '\s+', ' ', 'g'))"


@query(rf"""WITH {CHUNKS_SQL}, {LEXICAL_SQL},
    hits AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, chunk_index) <= 20),
    h AS (SELECT item_id, doc_id, chunk_index, {_source_sql("b.text")} AS quote, {_source_sql("c.chunk")} AS one, {_source_sql("array_to_string(w[word_start + 1 : word_start + 1680], ' ')")} AS two, b.text
          FROM hits JOIN benchmark b USING (item_id) JOIN chunks c USING (doc_id, chunk_index) JOIN tokens USING (doc_id)),
    s AS (SELECT item_id, doc_id, chunk_index FROM h WHERE contains(one, quote)),
    n AS (SELECT a.item_id, a.doc_id, unnest([a.chunk_index, b.chunk_index]) AS chunk_index FROM h a JOIN h b ON a.item_id = b.item_id AND a.doc_id = b.doc_id AND b.chunk_index = a.chunk_index + 1
          WHERE contains(a.two, a.quote) AND NOT contains(a.one, a.quote) AND NOT contains(b.one, b.quote)),
    f AS (SELECT item_id, doc_id, list_sort(list(DISTINCT chunk_index)) AS l FROM (FROM s UNION FROM n) GROUP BY ALL)
    SELECT a.item_id, a.doc_id AS page_number, a.text AS quote, l IS NOT NULL AS covered, coalesce(array_to_string(l, ','), '') AS chunk_indexes
    FROM (SELECT DISTINCT item_id, doc_id, text FROM h) a LEFT JOIN f USING (item_id, doc_id)""")
def anchor_coverage(spark, sf):
    """Which retrieved chunks hold a benchmark text whole, alone or side by side."""
    items = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("quote"))
    found = _hits(spark, sf, 20)
    hits = found.join(_hit_chunks(spark, sf, found).select("doc_id", "chunk_index", "chunk"), ["doc_id", "chunk_index"])
    hits = stored(hits.select("item_id", F.col("doc_id").alias("page_number"), F.col("chunk_index").cast("int"), F.col("chunk").alias("text")), "hits")
    anchors = hits.select("item_id", "page_number").distinct().join(items, "item_id")
    found = Q.coverage(hits, anchors, ["item_id"])
    return found.withColumn("chunk_indexes", F.array_join(F.transform("chunk_indexes", lambda i: i.cast("string")), ","))


@query(rf"""WITH tokens AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL),
    q AS (SELECT item_id, {_source_sql("text")} AS quote FROM benchmark WHERE text IS NOT NULL),
    d AS (SELECT doc_id, w, {_source_sql("array_to_string(w, ' ')")} AS page FROM tokens),
    a AS MATERIALIZED (SELECT item_id, doc_id, quote, w FROM d JOIN q ON contains(page, quote)),
    r AS (SELECT item_id, doc_id, quote, w, unnest(range(0, len(w), 25)) AS pos FROM a),
    t AS (SELECT *, unnest(range(1, 9)) AS width FROM r),
    h AS (SELECT item_id, doc_id, pos // 25 AS first, width FROM t WHERE pos + 25 * (width - 1) < len(w) AND contains({_source_sql("array_to_string(w[pos + 1 : pos + 25 * (width - 1) + 30], ' ')")}, quote))
    SELECT item_id, doc_id, arg_min(first, width * 1000000 + first)::INTEGER AS first_chunk, min(width)::INTEGER AS n_chunks FROM h GROUP BY ALL""")
def anchor_runs(spark, sf):
    """The shortest run of short windows that holds each benchmark text, in every document that has it."""
    held = anchor_containment(spark, sf).join(table(spark, sf, "benchmark").select("item_id", F.col("text").alias("quote")), "item_id")
    anchors = held.select("item_id", F.col("doc_id").alias("document_id"), F.lit(1).alias("page_number"), "quote")
    short = C.windows(table(spark, sf, "documents"), size=30, overlap=5)
    chunks = short.select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page_number"), F.expr("word_start div 25").cast("int").alias("chunk_index"), F.col("chunk").alias("text"))
    found = Q.resolve(anchors, chunks).where(F.size("chunk_indexes") > 0)
    return found.select("item_id", F.col("document_id").alias("doc_id"), F.get("chunk_indexes", F.lit(0)).alias("first_chunk"), F.size("chunk_indexes").alias("n_chunks"))


@query()
def study_questions(spark, sf):
    """Three questions about every document; order-dependent, so without SQL."""
    return T.study_questions(table(spark, sf, "documents"), "doc_id", "text", 3)


@query(r"""SELECT doc_id, array_to_string(list_slice(list_filter(list_transform(string_split_regex(
        array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT regexp_matches(x, '^Page\s+[0-9]+')
            AND NOT contains(lower(x), 'table of contents') AND NOT regexp_matches(x, '\.{4,}')), ' '),
        '[.!?]\s+'), lambda s: trim(s)), lambda s: s <> ''), 1, 2), ' | ') AS summary FROM documents""")
def leading_sentences(spark, sf):
    """The first two sentences of every document's context, by the simple splitter."""
    said = V.sentences(T.context(F.col("text")), V.SIMPLE_END)
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.slice(said, 1, 2), " | ").alias("summary"))


@query("""SELECT d.doc_id, coalesce(l.quality = 1 AND d.n_chars >= 200, false) AS outcome, CASE WHEN l.doc_id IS NULL THEN 'draft' WHEN e.vec_id IS NULL THEN 'unavailable' ELSE 'ready' END AS readiness
    FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN embeddings e ON d.doc_id = e.vec_id""")
def case_readiness(spark, sf):
    """Cases that can be run: reviewed ones, being labelled, whose document is indexed, having a vector."""
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    labels = table(spark, sf, "labels").select("doc_id", "quality", F.lit(True).alias("reviewed"))
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("indexed"))
    both = docs.join(labels, "doc_id", "left").join(vectors, "doc_id", "left")
    outcome = (F.col("quality") == 1) & (F.col("n_chars") >= 200)
    return both.select("doc_id", F.coalesce(outcome, F.lit(False)).alias("outcome"), E.readiness(F.col("indexed"), F.col("reviewed")).alias("readiness"))
