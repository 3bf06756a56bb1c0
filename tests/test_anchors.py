"""Quotes of every shape, against the SQL of the query."""

import random

import duckdb

from lectern import catalog
from lectern.operators import anchors as A
from lectern.operators.evaluation import join_sources, source_text


def test_quotes_without_inner_words(spark, tmp_path):
    pages = ["One  two three four", "stone twofold", "привет большой мир и all", "日本 語 文字", "", None, "plain", "a -- b", "x a -- bc"]
    quotes = ["one", "one two", "ONE\ttwo three", "привет большой мир", "日本 語 文字", "a -- b", "", None, "absent", "no such thing", "two three"]
    spark.createDataFrame(list(enumerate(pages)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(quotes)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    duck = duckdb.connect()
    for name in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = sorted(duck.execute(catalog.ORACLE_SQL["anchor_containment"]).fetchall())
    got = sorted((r["item_id"], r["doc_id"]) for r in catalog.QUERIES["anchor_containment"](spark, str(tmp_path)).collect())
    assert got == want and {0, 1, 3, 4, 5} <= {i for i, _ in got}


def covering(quote, chunks):
    """Indexes of neighbouring groups that hold the quote and none too many, by joining and searching every group."""
    ordered, wanted = sorted(chunks), source_text(quote)
    holds = lambda group: wanted in join_sources(t for _, t in group)
    found = set()
    for start in range(len(ordered)):
        for end in range(start + 1, len(ordered) + 1):
            group = ordered[start:end]
            if group[-1][0] - group[0][0] != len(group) - 1:
                break
            if holds(group):
                if len(group) == 1 or not (holds(group[1:]) or holds(group[:-1])):
                    found.update(i for i, _ in group)
                break
    return sorted(found)


def shortest_run(quote, chunks):
    """The shortest run of chunks whose joined text holds the quote, by trying every width."""
    ordered, wanted = sorted(chunks), source_text(quote)
    for width in range(1, len(ordered) + 1):
        for start in range(len(ordered) - width + 1):
            if wanted in join_sources(t for _, t in ordered[start : start + width]):
                return [i for i, _ in ordered[start : start + width]]
    return []


def pages():
    rng = random.Random(6)
    for n in range(120):
        words = [rng.choice(["a", "b", "cc", "d-", "e"]) if n % 3 else f"w{rng.randrange(40)}" for _ in range(rng.randint(1, 40))]
        size, step = rng.choice([(4, 3), (5, 3), (6, 6), (3, 1)])
        chunks = [(i, " ".join(words[at : at + size])) for i, at in enumerate(range(0, len(words), step))]
        if n % 5 == 0:
            chunks = [(i + (i > 2), t) for i, t in chunks] + [(99, ""), (100, words[0])]
        quotes = {" ".join(words[at : at + k]) for at, k in ((rng.randrange(len(words)), rng.randint(1, 9)) for _ in range(6))}
        yield chunks, sorted(quotes | {"absent", "a  b", ""})


def test_runs_as_by_every_width(spark):
    every = list(pages())
    chunks = [(n, 1, i, t) for n, (c, _) in enumerate(every) for i, t in c]
    anchors = [(n, 1, q, f"{n}|{q}") for n, (_, qs) in enumerate(every) for q in qs] + [(500, 1, "no page", "x"), (0, 1, None, "y")]
    held = spark.createDataFrame(chunks, "document_id int, page_number int, chunk_index int, text string").repartition(5)
    asked = spark.createDataFrame(anchors, "document_id int, page_number int, quote string, mine string")
    got = {(r["document_id"], r["quote"]): r for r in A.resolve(asked, held).collect()}
    assert len(got) == len(anchors) and all(r["mine"] == f"{k[0]}|{k[1]}" for k, r in got.items() if r["mine"] not in "xy")
    for n, (c, qs) in enumerate(every):
        for q in qs:
            assert got[n, q]["chunk_indexes"] == shortest_run(q, c), (q, c)
    assert got[500, "no page"]["chunk_indexes"] == []
    hits = held.withColumnRenamed("document_id", "case")
    cases = asked.where("quote IS NOT NULL AND document_id < 500").withColumnRenamed("document_id", "case")
    for r in A.coverage(hits.union(hits), cases, ["case"]).collect():
        want = covering(r["quote"], every[r["case"]][0])
        assert (r["covered"], r["chunk_indexes"]) == (bool(want), want), (r["quote"], every[r["case"]][0])


def test_state_goes_over_the_edges_of_chunks():
    page = A.Page(["one two three four", "three four five", "four"])
    for i, text in enumerate(["zero one two", "two three", "three four", "five six"]):
        page.add(i, text)
    assert page.joined == "zero one two three four five six"
    assert A.shortest(page, "one two three four") == [0, 1, 2] and A.shortest(page, "three four five") == [2, 3] and A.shortest(page, "four") == [2]
    # What a chunk adds is read once.
    assert page.starts == [0, 9, 13, 24] and page.ends == [12, 18, 23, 32]


def test_no_page_is_listed(spark):
    rows = spark.createDataFrame([(1, 1, 0, "a b")], "document_id int, page_number int, chunk_index int, text string")
    plan = A.resolve(rows.select("document_id", "page_number", rows.text.alias("quote")), rows)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "NestedLoop" not in plan
