import hashlib
import random
import re

from lectern.llm import queries
from lectern.llm import secrets as S

ASSIGN = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
OTHERS = [("access", re.compile("AKIA[A-Z0-9]+"), 16), ("hex", re.compile("[0-9a-f]+"), 32)]


def brute(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text or "") if len(m[2]) >= 8]
    for order, (_, pattern, least) in enumerate(OTHERS, 1):
        found += [(m.start(), order, m.end()) for m in pattern.finditer(text or "") if len(m[0]) >= least]
    return sorted(found)


def texts():
    rng = random.Random(8)
    pieces = ["password", "Token", "api_key", "APIKEY", "secret", '"', "'", " ", " ", ":", "=", "AKIA", "ABCDEFGHIJKLMNOP", "0a1b2c3d" * 4, "x", "longvalue12", "é", "😀", "\n", "short"]
    fixed = [None, "", "token=secret:longvalue12", "token=token=abcdefgh", "AKIAAKIAAKIAAKIA", "f" * 31, "f" * 32, "g" + "0" * 40 + "G", 'passwd" : "hunter2hunter2"', "😀 é secret = abcdefgh9"]
    return fixed + ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 25))) for _ in range(300)] + ["word " * 30_000 + "token=abcdefgh1"]


def test_base_spans_against_brute_force(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(texts())] + [(3, "token=abcdefgh1"), (None, "token=abcdefgh1")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, secrets int")
    got = S.scan(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        spans = [(s["start"], s["order"], s["end"]) for s in r["secrets"]]
        assert [s for s in spans if s[1] < 3] == brute(r["text"]), r["text"]
    docs.drop("secrets").write.parquet(str(tmp_path / "documents.parquet"))
    for r in queries.op8_secret_scan(spark, str(tmp_path)).where("doc_id = 305").collect():
        line = ",".join(f"{('assign', 'access', 'hex')[o]}:{a}:{b}" for a, o, b in brute(rows[305][1]))
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
    assert S.scan(docs.limit(0)).count() == 0


def test_queries_of_expressions():
    assert S.trigram_query("AKIA[A-Z0-9]+") == [frozenset({"aki", "kia"})]
    assert S.trigram_query("[0-9a-f]+") is None and S.trigram_query("(abc|x)") is None
    assert S.trigram_query("ab?cde") == [frozenset({"abc", "bcd", "cde"}), frozenset({"acd", "cde"})]
    assert S.trigram_query("gh[ab]_x+y") == [frozenset({"gha", "ha_"}), frozenset({"ghb", "hb_"})]


def test_queries_hold_for_every_match():
    rng = random.Random(1)
    for rule in S.RULES:
        query = S.trigram_query(rule.pattern)
        for _ in range(200):
            text = "".join(rng.choice(["token", "Api_Key", "=", "AKIA", "Z9", "ghp_", "a1B2" * 10, "xoxb-", "://u:p@", "bearer ", "eyJ", "."]) for _ in range(8))
            for m in re.finditer(rule.pattern, text):
                low = m[0].lower()
                assert query is None or any(all(g in low for g in clause) for clause in query)


def test_more_rules_and_redaction(spark):
    text = "a ghp_" + "a1B2" * 9 + " b https://joe:pw@host/ c password=abcdefgh1 d"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "clean"), (4, "token=" + "0" * 40)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in S.redact(docs).collect()}
    assert got[1] == "a [secret] b [secret]host/ c [secret] d" and got[2] is None and got[3] == "clean" and got[4] == "[secret]"


def test_candidates_are_those_whose_postings_meet(spark):
    every = texts() + ["pass the word", "a secure tokyo", "bear with me"]
    docs = spark.createDataFrame(list(enumerate(every)), "doc_id long, text string")
    want = {}
    for i, text in enumerate(every):
        bits = 0
        for k, rule in enumerate(S.RULES):
            query = S.trigram_query(rule.pattern)
            bits |= (query is not None and any(all(g in (text or "").lower() for g in clause) for clause in query)) << k
        if bits:
            want[i] = bits
    got = S.candidates(docs, S.RULES, "text", "doc_id")
    assert sorted(map(tuple, got.collect())) == sorted(want.items())
    # Few of the texts with a posting are candidates, and all of those with a match of an indexed rule are among them.
    grams = sorted({g for r in S.RULES for clause in S.trigram_query(r.pattern) or () for g in clause})
    with_posting = S.postings(docs, grams, "text", "doc_id").select("key").distinct().count()
    assert len(want) < with_posting
    assert {i for i, t in enumerate(every) if any(s[1] < 2 for s in brute(t))} <= set(want)


def test_rules_run_on_candidates_alone(spark):
    docs = spark.createDataFrame([(1, "token=abcdefgh1")], "doc_id long, text string")
    plan = S.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "Python" not in plan


def test_very_many_secrets_in_one_text(spark):
    import time

    text = " ".join(f"token=abcdefgh{i:05d}" for i in range(20_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.perf_counter()
    got = S.scan(docs).first()["secrets"]
    assert [(s["start"], s["order"], s["end"]) for s in got] == brute(text)
    assert S.redact(docs).first()["text"] == " ".join(["[secret]"] * 20_000)
    assert time.perf_counter() - began < 60


def test_overlapping_spans_are_one_mask(spark):
    text = "x password=" + "ab12" * 10 + " y token=AKIA" + "ABCD" * 4 + "z"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    spans = brute(text)
    reach, want = 0, ""
    for a, _, b in spans:
        if a >= reach:
            want += text[reach:a] + "[secret]"
        reach = max(reach, b)
    assert len(spans) > 3 and S.redact(docs, S.BASE).first()["text"] == want + text[reach:]
