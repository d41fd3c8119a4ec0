"""Queries do the whole job: no row, text or feature is left out to make them smaller."""

import inspect
import json
import re
from itertools import combinations

import duckdb
from pyspark.sql import functions as F

from pairloom import plans
from pairloom.functions import text as X
from pairloom.operators import measures, pairs, resolve, specs
from pairloom.operators.probe import probe
from pairloom.plans import logs
from pairloom.sources import store
from pairloom.streaming import ingest

MIDDLE = "/root/testdata/sf0.01"


def test_pairs_of_large_sentences(spark):
    m = spark.createDataFrame([("d", 0, f"n{i}", 2 * i, 2 * i + 1, i + 1) for i in range(25)], "doc_id string, s int, name string, begin int, end int, ord int")
    assert {(r.ord1, r.ord2) for r in pairs.mention_pairs(m).collect()} == set(combinations(range(1, 26), 2))
    assert pairs.mention_pairs(m, monster=300).isEmpty() and pairs.mention_pairs(m, monster=301).count() == 300


def test_pair_queries_have_every_pair(spark):
    at = {}
    for r in plans.QUERIES["mentions"](spark, MIDDLE).collect():
        at.setdefault((r.doc_id, r.s), []).append((r.ord, r.name))
    assert max(map(len, at.values())) >= 20
    want = sorted((*k, a[0], b[0]) for k, v in at.items() for a, b in combinations(sorted(v), 2))
    for name in ("pairs_of_mentions", "pairs_labelled"):
        got = plans.QUERIES[name](spark, MIDDLE).select("doc_id", "s", F.col("ord1"), F.col("ord2")).collect()
        assert sorted(map(tuple, got)) == want, name
    first = {k: {n for _, n in v} for k, v in at.items()}
    assert plans.QUERIES["pairs_labelled_by_name"](spark, MIDDLE).count() == sum(len(v) * (len(v) - 1) // 2 for v in first.values())


def test_flags_see_whole_texts(spark, small):
    sql = plans.ORACLES["names_flags"].replace("substr(text, 1, 28)", "text")
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{small}/documents.parquet'")
    cols = ("doc_id", "bad", "bad_group", "bad_drug", "unusable")
    want = sorted(c.execute(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall())
    assert sorted(map(tuple, plans.QUERIES["names_flags"](spark, small).select(*cols).collect())) == want


def test_probe_has_the_default_features(spark, small, monkeypatch):
    asked = []
    monkeypatch.setattr(logs, "probe", lambda *a, **k: asked.append(inspect.signature(probe).bind(*a, **k)) or {"lift": 0, "f1": 0, "baseline": 0})
    plans.QUERIES["probe_shortcut"](spark, small)
    asked[0].apply_defaults()
    assert asked[0].arguments["max_features"] >= 5000


def test_requests_use_all_their_draws(spark):
    rows = [("drug", f"n{'x' * k}", k) for k in range(60)] + [("drug", f"other{k}z", 60 + k) for k in range(4)]  # names of the first kind contain each other
    vocab = spark.createDataFrame(rows, "kind string, name string, pos int")
    full = {t: {r.spec_index for r in specs.specs(spark, 300, vocab, 1, tries=t).where("complete").select("spec_index").collect()} for t in (16, 32, 200)}
    assert full[16] < full[32] < full[200]
    left = specs.exhausted(specs.specs(spark, 300, vocab, 1, tries=16))
    assert {r.spec_index for r in left.collect()} == set(range(300)) - full[16] and left.first().reason
    assert specs.specs(spark, 20, vocab, 1, tries=0).where("complete").isEmpty()


def test_lineage_goes_to_the_end(spark):
    m = spark.createDataFrame([(f"d{k}", f"d{k - 1}" if k else None) for k in range(14)] + [("a", "b"), ("b", "a")], "dataset_id string, parent_id string")
    got = {(r.dataset_id, r.ancestor): r.depth for r in store.lineage(m).collect()}
    assert {k: v for k, v in got.items() if k[0][0] == "d"} == {(f"d{a}", f"d{b}"): a - b for a in range(14) for b in range(a)}
    assert got["a", "b"] == 1 and ("a", "a") in got and len([k for k in got if k[0] in "ab"]) == 4


def test_reports_are_whole(spark):
    text = store.report_text("T", {"t": spark.range(250)})
    assert text.count("\n| ") == 251 and "there are more" in store.report_text("T", {"t": spark.range(250)}, limit=10)


def test_empty_errors_are_successes(spark):
    log = spark.createDataFrame([(0, "{}", None, ""), (1, "{}", "x", "bad"), (2, "{}", "x", None)], "spec_index long, spec string, sample string, error string")
    assert sorted(r.spec_index for r in ingest.succeeded(log).collect()) == [0, 2]
    rows, seen = ingest.observed(log, "t")
    rows.write.format("noop").mode("overwrite").save()
    assert seen.get == {"ok": 2, "err": 1}


def test_passages_are_brought_to_compatibility_form(spark):
    say = {"sentences": [{"text": "Ｆoo with ﬁbrin.", "relations": [{"arg1": "Foo", "arg2": "fibrin", "label": "INT"}]}], "entities": [{"text": "Foo"}, {"text": "fibrin"}]}
    raw = spark.createDataFrame([(0, None, json.dumps(say), None)], "spec_index long, spec string, sample string, error string")
    inst, rejects = resolve.resolved(raw, "g", "passage")
    assert [(r.text, r.label) for r in inst.collect()] == [("[E1]Foo[/E1] with [E2]fibrin[/E2].", "INT")] and rejects.isEmpty()


def test_occurrences_keep_the_nth_rule():
    assert resolve.occurrences("aspirin Aspirin", ["aspirin"], strict=True) == [(0, 7, "aspirin")]
    assert resolve.occurrences("aspirin and aspirin x warfarin", ["aspirin", "warfarin"]) == [(0, 7, "aspirin"), (12, 19, "aspirin"), (22, 30, "warfarin")]
    assert resolve.occurrences("aspirin Aspirin", ["aspirin"]) == [(0, 7, "aspirin"), (8, 15, "aspirin")]


def test_build_in_one_call(spark, tmp_path):
    spec = json.dumps({"register": "R", "entities": [{"key": "A", "surface": "foo", "type": "DRUG"}, {"key": "B", "surface": "bar", "type": "DRUG"}], "positives": [{"between": ["A", "B"], "label": "INT"}]})
    raw = spark.createDataFrame([(0, spec, '{"sentence": "foo with bar"}', None), (1, spec, '{"sentence": "foo alone"}', None), (2, spec, None, "Timeout")], "spec_index long, spec string, sample string, error string")
    for mode, text in (("markers", "[E1]foo[/E1] with [E2]bar[/E2]"), ("mask_targets", "drug1 with drug2")):
        made, n = resolve.build(raw, "g", f"file://{tmp_path}", mode=mode)
        assert n.first().asDict() == {"built": 1, "rejected": 1, "attempts": 3, "errors": 1}
        assert [r.text for r in store.load_dataset(spark, f"file://{tmp_path}", made).collect()] == [text]
        assert [r.reason for r in store.read_rejects(spark, f"file://{tmp_path}/rejects/{made}").collect()] == ["drug not in sentence: bar"]
    assert store.read_rejects(spark, f"file://{tmp_path}/nothing").isEmpty()


def test_offsets_of_very_many_sentences(spark):
    text = "".join(f"Sentence {k} is here. " for k in range(5000))
    got = spark.createDataFrame([(text,), ("",), (None,), ("one",)], "t string").select(X.sentences(F.col("t")).alias("s")).collect()
    assert [(p.begin, p.end) for p in got[0].s] == [(m.start(), m.end()) for m in re.finditer(X.SENTENCE, text)] and "".join(p.piece for p in got[0].s) == text
    assert got[1].s == [] and got[2].s is None and [tuple(p) for p in got[3].s] == [("one", 0, 3)]


def test_small_operators(spark):
    rel = spark.createDataFrame([("a", "b", "INT", 1), ("c", "c", "INT", 2)], "name1 string, name2 string, label string, no int")
    p = spark.createDataFrame([("a", "b"), ("b", "a"), ("x", "y")], "name1 string, name2 string")
    assert sorted((r.name1, r.label) for r in pairs.labelled_pairs(p, rel, one_way=True).collect()) == [("a", "INT"), ("b", "NONE"), ("x", "NONE")]
    assert pairs.self_binds(rel).first().n == 1
    texts = spark.createDataFrame([("CYP 3A4 and cyp3a4, CYP2D6",), (None,)], "text string")
    assert [tuple(r) for r in measures.enzyme_counts(texts).collect()] == [("CYP3A4", 2), ("CYP2D6", 1)]
    assert specs.fingerprint({"a": ["2", "1"], "b": []}) == specs.fingerprint({"b": [], "a": ["1", "2"]}) != specs.fingerprint({"a": ["1"], "b": ["2"]})
