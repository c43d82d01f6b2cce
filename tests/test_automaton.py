import json
import random
import time

from pyspark.sql import functions as F

from foliant.functions import automaton, spans
from foliant.kb import KnowledgeBase
from foliant.operators import classify
from foliant.plans import batch
from foliant.sources import documents as S


def knowledge(n_types, per_type, r):
    """A knowledge base of invented phrases, short and long, some of them in several types."""
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(2, 6)))
    phrase = lambda: " ".join(word() for _ in range(r.randint(1, 3)))
    pool = [phrase() for _ in range(n_types * per_type)] + ["abc", "soa", "de", "(a)", "a.b", "line\nbreak"]
    pick = lambda n: [r.choice(pool) for _ in range(n)]
    docs = [{"id": f"t{k}", "name": f"T {k}", "category": "advice", "classifier_hints": {"title_patterns": pick(per_type), "reference_patterns": pick(1) + ["the abc"], "structural_signals": pick(per_type), "key_fields": pick(2), "negative_signals": pick(1)}} for k in range(n_types)]
    return KnowledgeBase({**KnowledgeBase.load().data, "documents": docs}), pool


def texts(r, pool, n):
    out = [None if k == 0 else "" for k in range(2)]
    for _ in range(n):
        bits = [r.choice([r.choice(pool), r.choice(pool).upper(), r.choice(pool).title(), "x", "ABC", "the abc", "SOA_", "filler words here"]) + r.choice([" ", "\n", "  ", ". ", "\n   "]) for _ in range(r.randint(1, 60))]
        out.append(("pad " * r.choice([0, 0, 90])) + "".join(bits))
    return out


def test_the_walk_is_the_expression(spark):
    r = random.Random(6)
    kb, pool = knowledge(9, 4, r)
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts(r, pool, 200))], "k int, text string")
    x = frame.select("k", classify.type_scores(F.coalesce("text", F.lit("")), kb).alias("a"), classify.walked_scores(F.coalesce("text", F.lit("")), kb).alias("b"))
    rows = x.collect()
    for row in rows:
        assert row.a == row.b, row.k
    assert sum(s.worn for row in rows for s in row.a) > 50 and sum(s.score > 0 and not s.worn for row in rows for s in row.a) > 50
    assert frame.select(classify.walked_scores(F.col("text"), kb).alias("b")).first().b is None


def test_matches_are_those_of_the_regular_expressions(spark):
    r = random.Random(7)
    _, pool = knowledge(5, 5, r)
    body = texts(r, pool, 60)[2:]
    frame = spark.createDataFrame([(t,) for t in body], "text string").coalesce(1)
    ps = sorted(set(pool))
    got = frame.select(*[spans.matches(F.col("text"), spans.phrase_regex(p)).alias(f"p{k}") for k, p in enumerate(ps)]).collect()
    found = automaton.Phrases(tuple((p, len(p) <= 4 and p.isalpha()) for p in ps))
    for text, row in zip(body, got):
        here = found.found(text)
        for k in range(len(ps)):
            assert [(m.s, m.e) for m in row[f"p{k}"]] == here.get(k, [])


def test_many_phrases_choose_the_walk_and_change_nothing(spark, fixtures, monkeypatch):
    samples = S.read_samples(spark, str(fixtures / "samples.json"))
    pick = lambda result: sorted((x.name, x.doc_type, x.confidence, x.evidence) for x in result.records.collect())
    want = pick(batch.run(samples))
    monkeypatch.setattr(classify, "WALK_FROM", 1)
    assert pick(batch.run(samples)) == want


def test_time_is_flat_in_phrases_and_linear_in_the_text():
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(9))
    words = [word() for _ in range(5000)]
    text = " ".join(r.choice(words[:50]) if r.random() < 0.1 else word() for _ in range(20_000))

    def took(n):
        found = automaton.Phrases(tuple((w, False) for w in words[:n]))
        best = []
        for _ in range(3):
            began = time.perf_counter()
            found.found(text)
            best.append(time.perf_counter() - began)
        return min(best)

    assert took(5000) < 4 * took(50) + 0.05
    # a title and a citation in every line, and all of it in one line
    w = KnowledgeBase.load().weights
    phrases = (("annual report", False), ("see the annual report", False), ("totals", False))
    uses = [("t", 0, [0], [1], [[2], [], []])]
    found = automaton.Phrases(phrases)
    for mark in ("\n", " "):
        began = time.perf_counter()
        got = classify._weighed("x " * 200 + mark.join(["as you see the annual report says"] * 20_000), found, uses, phrases, w, 300, 4)
        assert time.perf_counter() - began < 5 and not got[0]["worn"] and got[0]["score"] == w["title_mentioned_in_body"]
    assert json.dumps(got)


def test_edges_of_short_phrases_are_those_of_the_sql(spark, tmp_path):
    """Beside a letter that is not ASCII a short phrase is a whole word in the corpus's knowledge base, as in SQL, and is none by default; both forms say the same."""
    import duckdb

    from foliant.plans import bindings

    bodies = ["x POURÈANOIÉ", "ÉMIT", "MIT", "MITÉ MIT", "MIT_", "9MIT", "ßMITß", "POUR", "POURs", "字MIT字", "pad " * 100 + "ÀMIT\nlicenſed under", "MİT"]
    frame = spark.createDataFrame(list(enumerate(bodies)), "doc_id long, text string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    for name in ("q39_type_scores", "q52_scores_in_one_walk"):
        got = [tuple(r) for r in bindings.QUERIES[name](spark, str(tmp_path)).collect()]
        assert sorted(got) == sorted(con.execute(bindings.ORACLE_SQL[name]).fetchall())
    data = bindings.CORPUS.data
    plain = KnowledgeBase({**data, "scoring": {**data["scoring"], "short_pattern_rule": {"max_length": 4}}})
    x = frame.select("text", classify.type_scores(F.col("text"), plain).alias("a"), classify.walked_scores(F.col("text"), plain).alias("b")).collect()
    assert all(r.a == r.b for r in x)
    assert [r.text for r in x if r.a[0].score > 0] == ["MIT", "MITÉ MIT"]
