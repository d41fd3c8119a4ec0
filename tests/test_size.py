"""Shared steps are done once and stay as right as their slower forms."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from pairloom import plans
from pairloom.functions import spans as P
from pairloom.functions import text as X
from pairloom.operators import measures, sampling
from pairloom.plans import texts

#: Queries over marked pairs that rendered them more than once.
ONCE = ["verify_flagged_described", "verify_siblings", "verify_flags", "markers_masked_twins", "prune_arms", "verify_flag_concentration", "verify_verdict_rows"]


@pytest.mark.parametrize("name", ONCE)
def test_marked_pairs_are_made_once(spark, small, monkeypatch, name):
    made = []
    monkeypatch.setattr(texts, "marked_pairs", lambda *a, real=texts.marked_pairs: made.append(a) or real(*a))
    shown = plans.QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert len(made) == 1 and shown.count("Relation [doc_id") <= 1


def test_spans_of_plain_and_odd_texts(spark):
    rng = random.Random(3)
    bits = ["[E1]", "[/E1]", "[E2]", "[/E2]", "[", "[E3]", "]", "é", "a b", "\n", "𝒳"]
    rows = ["".join(rng.choices(bits, k=rng.randrange(12))) for _ in range(400)]
    for order in ("12", "21"):
        rows += ["".join(f"{rng.choice(bits[4:])}[E{k}]{rng.choice(['', *bits[4:]])}[/E{k}]" for k in order) + rng.choice(bits[4:]) for _ in range(100)]
    df = spark.createDataFrame([(t,) for t in [*rows, None, ""]], "t string")
    for r in df.select("t", P.marked_spans(F.col("t")).alias("a"), P._read_spans(F.col("t")).alias("b")).collect():
        assert r.a == r.b, r.t


def test_markers_of_all_spans(spark):
    text = "aé𝒳cdefg"
    rows = [(text, *(random.Random(k).choices(range(11), k=4))) for k in range(300)]
    df = spark.createDataFrame(rows, "t string, a int, b int, c int, d int")
    edit = lambda at, tag, n: P._edit(F.col(at), F.col(at), tag, n)
    slow = P._put(F.col("t"), F.array(edit("a", "[E1]", 0), edit("b", "[/E1]", 1), edit("c", "[E2]", 2), edit("d", "[/E2]", 3)))
    for r in df.select("*", P.marked(F.col("t"), *map(F.col, "abcd")).alias("x"), slow.alias("y")).collect():
        assert r.x == r.y, r


def test_masks_of_all_spans(spark):
    text = "aé𝒳cdefg"
    rows = [(text, *(random.Random(k).choices(range(11), k=4)), [(n, n + 2) for n in random.Random(k).choices(range(9), k=2)]) for k in range(400)]
    df = spark.createDataFrame(rows, "t string, a int, b int, c int, d int, o array<struct<begin: int, end: int>>")
    a, b, c, d = map(F.col, "abcd")
    edits = F.array(P._edit(a, b, "drug1", 0), P._edit(c, d, "drug2", 1))
    clear = lambda x: ((x["end"] <= a) | (x["begin"] >= b)) & ((x["end"] <= c) | (x["begin"] >= d))
    more = F.concat(edits, F.transform(F.filter("o", clear), lambda x: P._edit(x["begin"], x["end"], "drug0", 2)))
    slow = lambda e: F.when(~P.overlapping(e), P._put(F.col("t"), e))
    got = df.select("*", P.masked(F.col("t"), a, b, c, d).alias("x"), slow(edits).alias("y"), P.masked(F.col("t"), a, b, c, d, F.col("o")).alias("z"), slow(more).alias("w")).collect()
    assert any(r.x and r.z for r in got) and any(r.x is None for r in got)
    for r in got:
        assert (r.x, r.z) == (r.y, r.w), r


@pytest.mark.parametrize("name", ["instances_markers", "instances_masked", "instances_masked_all"])
def test_instances_are_rendered_once(spark, small, name):
    shown = plans.QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Filter" in line and ("drug1" in line or "[E1]" in line) for line in shown.splitlines())


def test_draws_rank_only_what_is_near(spark):
    ids = [str(k) for k in range(5000)]
    inst = spark.createDataFrame([(i, k) for i in ids for k in range(2)], "sent_id string, k int")
    d = sampling.stability_draws(inst, [7, 300, 6000], 3, 5)
    got = {}
    for r in d.collect():
        got.setdefault((r.budget, r.draw), []).append(r.sent_id)
    rank = lambda n, k: sorted(sorted(ids, key=lambda i: (hashlib.md5(f"5:{n}:{k}:{i}".encode()).hexdigest(), i))[:n] * 2)
    assert {k: sorted(v) for k, v in got.items()} == {(n, k): rank(n, k) for n in (7, 300) for k in range(3)}
    lines = d._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(i for i, x in enumerate(lines) if "Window [row_number" in x)
    assert any("Join Inner" in x and "b#" in x for x in lines[at : at + 4])


@pytest.mark.parametrize("name", ["text_repeated_ngrams", "text_measures_by_language", "text_top_ngrams"])
def test_runs_of_words_without_a_function_each(spark, small, name):
    assert "lambda" not in plans.QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()


def test_words_and_runs_of_odd_texts(spark):
    rng = random.Random(1)
    rows = ["".join(rng.choices(["a", "Éb", " ", "\t", "\n ", "\x0b", "\u00a0", "-"], k=rng.randrange(14))) for _ in range(300)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*rows, "", None])], "k int, t string")
    clean = F.trim(F.regexp_replace("t", r"\s+", " "))
    old = F.when(clean == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(clean, " "))
    for r in df.select("t", clean.alias("a"), X.squeezed(F.col("t")).alias("b"), old.alias("c"), X.words(F.col("t")).alias("d")).collect():
        assert (r.a, r.c) == (r.b, r.d), r.t
    want = df.select("k", F.explode(X.ngrams(old, 3)).alias("g")).collect()
    assert sorted(want) == sorted(measures.gram_rows(df, X.words(F.col("t")), 3, "k").collect()) and want
