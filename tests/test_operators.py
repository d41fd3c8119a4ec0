"""Small cases worked out by hand, and properties that hold whatever the data."""

import json

import pytest
from pyspark.sql import functions as F

from pairloom.functions import spans as P
from pairloom.functions import text as X
from pairloom.functions.stats import index_quantiles
from pairloom.operators import frames, lexicon, measures, mixing_arms, pairs, resolve, sampling, scoring, specs, verify
from pairloom.operators.divergence import mixing_curve
from pairloom.sources import brat, store
from pairloom.streaming import ingest

ROWS = [("s1", 0, "MECHANISM", "D"), ("s2", 0, "NONE", "D"), ("s2", 1, "EFFECT", "D"), ("s2", 2, "NONE", "D"), ("s3", 0, "NONE", "M"), ("s4", 0, "NONE", "M"), ("s4", 1, "NONE", "M"), ("s4", 2, "NONE", "M")]


@pytest.fixture(scope="module")
def inst(spark):
    return spark.createDataFrame(ROWS, "sent_id string, pair_no int, label string, source string")


def one(df):
    return df.first().asDict()


def test_label_measures(spark, inst):
    m = one(measures.label_measures(inst))
    assert m == {"n": 8, "n_sentences": 4, "positive_rate": 0.25, "pairs_per_sentence": 2.0, "hard_negative_rate": 2 / 6, "count_rule_f1": 0.5}
    empty = one(measures.label_measures(inst.where("false")))
    assert set(empty.values()) == {0}
    c = {r.bucket: (r.pos, r.none) for r in measures.crosstab(inst).collect()}
    assert c == {"1": (1, 1), "2-3": (1, 5)}
    g = measures.gates(measures.label_measures(inst))
    assert measures.failed_gates(g) == ["count_rule_f1", "hard_negative_rate"]
    with pytest.raises(AssertionError, match="count_rule_f1"):
        measures.assert_gates(g)


def render(spark, text, a, b, others=None):
    c = [F.lit(x) for x in (*a, *b)]
    o = F.array(*(F.struct(F.lit(x).alias("begin"), F.lit(y).alias("end")) for x, y in others)) if others else None
    return tuple(spark.range(1).select(P.marked(F.lit(text), *c), P.masked(F.lit(text), *c), P.masked(F.lit(text), *c, o) if others else F.lit("")).first())


def test_rendering(spark):
    t = "aspirin raises warfarin levels"
    assert render(spark, t, (0, 7), (15, 23))[:2] == ("[E1]aspirin[/E1] raises [E2]warfarin[/E2] levels", "drug1 raises drug2 levels")
    assert render(spark, "ab", (0, 1), (1, 2))[:2] == ("[E1]a[E2][/E1]b[/E2]", "drug1drug2")
    assert render(spark, "warfarin sodium", (0, 15), (0, 8))[:2] == ("[E2][E1]warfarin[/E2] sodium[/E1]", None)
    assert render(spark, "a b c", (0, 1), (2, 3), [(0, 1), (2, 3), (4, 5)])[2] == "drug1 drug2 drug0"


def test_markers_read_back(spark):
    texts = ["[E1]aspirin[/E1] raises [E2]warfarin[/E2]", "[E1]a[E2][/E1]b[/E2]", "no tags", ""]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(P.stripped(F.col("t")), P.marked_spans(F.col("t")), P.maskable(F.col("t")), P.masked_text(F.col("t"))).collect()
    assert got[0][0] == "aspirin raises warfarin" and [tuple(s) for s in got[0][1]] == [(0, 7), (15, 23)] and got[0][2] and got[0][3] == "drug1 raises drug2"
    assert got[1][0] == "ab" and not got[1][2] and got[1][3] is None and got[2][1] == []
    n = spark.range(1).select(P.numbered(F.lit("aspirin raises warfarin"), F.expr("array(named_struct('begin', 0, 'end', 7), named_struct('begin', 15, 'end', 23))"))).first()[0]
    assert n == "aspirin[1] raises warfarin[2]"


def documents(spark):
    rows = [("d1", "R", "Aa bb cc. Dd ee.", [("T1", "drug", 0, 2, "Aa"), ("T2", "drug", 3, 5, "bb"), ("T3", "group", 6, 8, "cc"), ("T4", "drug", 7, 12, "x")], [("R1", "EFFECT", "T3", "T1"), ("R2", "INT", "T1", "T2"), ("R3", "ADVISE", "T1", "T2"), ("R4", "INT", "T1", "T4")])]
    from pairloom.schema import DOCUMENT

    return spark.createDataFrame(rows, DOCUMENT)


def test_sentences_and_pairs(spark):
    s = pairs.sentence_documents(documents(spark)).orderBy("sent_id").collect()
    assert [r.sent_id for r in s] == ["human:R:d1:s0", "human:R:d1:s1"] and "".join(r.text for r in s) == "Aa bb cc. Dd ee."
    assert [e.id for e in s[0].entities] == ["T1", "T2", "T3"] and [r.id for r in s[0].relations] == ["R1", "R2", "R3"] and s[1].entities == []
    for mode in ("markers", "mask_targets", "mask_all"):
        got, skipped = pairs.pair_instances(pairs.sentence_documents(documents(spark)), mode)
        assert [(r.pair_no, r.label) for r in got.orderBy("pair_no").collect()] == [(0, "ADVISE"), (1, "EFFECT"), (2, "NONE")] and skipped.count() == 0
    assert pairs.pair_instances(pairs.sentence_documents(documents(spark)), monster=3)[0].count() == 0
    ids = spark.createDataFrame([("human:R:d:x:s3",)], "sent_id string")
    assert tuple(pairs.parsed_ids(ids).first())[1:] == ("human", "R", "d:x", "s3")


def test_brat(spark, tmp_path):
    d = tmp_path / "train" / "Reg"
    d.mkdir(parents=True)
    (d / "a.txt").write_text("Aa bb.\ncc")
    (d / "a.ann").write_text("T1\tdrug 0 2\tAa\nT2\tgroup 3 5;7 9\tbb cc\nR1\tINT Arg1:T1 Arg2:T2\n#1\tNote T1\tx\n")
    (d / "b.txt").write_text("none")
    got = {r.doc_id: r for r in brat.read_brat(spark, str(tmp_path), "train").collect()}
    assert got["a"].text == "Aa bb.\ncc" and got["a"].register == "Reg"
    assert [tuple(e) for e in got["a"].entities] == [("T1", "drug", 0, 2, "Aa"), ("T2", "group", 3, 9, "bb cc")]
    assert [tuple(r) for r in got["a"].relations] == [("R1", "INT", "T1", "T2")] and got["b"].entities is None


def raw(spark, cases):
    return spark.createDataFrame([(i, json.dumps(s) if s is not None else None, json.dumps(x) if x is not None else None, e) for i, (s, x, e) in enumerate(cases)], "spec_index long, spec string, sample string, error string")


def spec(*names, positives=(), key="positives"):
    return {"register": "R", "entities": [{"key": chr(65 + i), "surface": n, "type": "DRUG"} for i, n in enumerate(names)], key: [{"between": list(p[:2]), "label": p[2]} for p in positives]}


def test_resolver(spark):
    cases = [
        (None, {"sentence": "x"}, None),
        (spec("a", "b"), ["list"], None),
        (spec("a", "b"), {"sentence": " "}, None),
        (spec("a", "b"), {"sentence": "w " * 121}, None),
        (spec("a", "b"), {"sentence": "same " * 20}, None),
        (spec("aspirin", "warfarin"), {"sentence": "Only aspirin here"}, None),
        (spec("aspirin", "aspirin plus"), {"sentence": "aspirin plus more"}, None),
        (spec("aspirin", "warfarin"), {"sentence": "Aspirin and aspirin with warfarin"}, None),
        (spec("aspirin"), {"sentence": "aspirin alone"}, None),
        (spec("aspirin", "warfarin", positives=[("A", "B", "EFFECT")]), {"sentence": "Aspirin **raises** warfarin‑like warfarin"}, None),
        (spec("aspirin", "warfarin", "heparin", positives=[("C", "A", "INT")], key="asserts"), {"sentence": "aspirin, warfarin and heparin"}, None),
        (spec("a", "b"), None, "Timeout: x"),
    ]
    inst, rejects = resolve.resolved(raw(spark, cases), "g")
    why = {r.spec_index: r.reason for r in rejects.collect()}
    assert why[0] == "the resolver needs the spec" and why[1] == "no sample returned" and why[2] == "empty sentence" and why[3] == "sentence too long (121 words)"
    assert why[4] == "degenerate repetition" and why[5] == "drug not in sentence: warfarin" and why[6].startswith("overlapping") and why[7].startswith("overlapping") and why[8] == "no pairs produced"
    got = inst.orderBy("sent_id", "pair_no").collect()
    assert [r.label for r in got if r.sent_id == "synth:g:10"] == ["NONE", "INT", "NONE"]
    assert [(r.text, r.label) for r in got if r.sent_id == "synth:g:9"] == [("[E1]Aspirin[/E1] raises [E2]warfarin[/E2]-like warfarin", "EFFECT")]
    assert {r.reason: r.n for r in resolve.reason_counts(rejects).collect()}["drug not in sentence"] == 1


def test_passages(spark):
    say = lambda t, *rels: {"text": t, "relations": [{"arg1": a, "arg2": b, "label": x} for a, b, x in rels]}
    names = [{"text": "Foo", "type": "drug"}, {"text": "bar", "type": "drug"}]
    cases = [
        ({"register": "R"}, {"sentences": [say("Foo with bar.", ("foo", "BAR", "INT")), say("Foo or bar.")], "entities": names}, None),
        (None, {"sentences": [], "entities": names}, None),
        (None, {"sentences": [say("x")], "entities": names[:1]}, None),
        (None, {"sentences": [say("Foo bar", ("foo", "foo", "INT"))], "entities": names}, None),
        (None, {"sentences": [say("Foo", ("foo", "bar", "INT"))], "entities": names}, None),
    ]
    inst, rejects = resolve.resolved(raw(spark, cases), "g", "passage")
    assert [(r.sent_id, r.label) for r in inst.orderBy("sent_id").collect()] == [("synth:g:0:s0", "INT"), ("synth:g:0:s1", "NONE")]
    assert [r.reason for r in rejects.orderBy("spec_index").collect()] == ["no sentences", "need two entities, got 1", "self-relation", "relation outside its sentence: foo~bar"]


def test_generation_records(spark):
    p = resolve.parsed_sentences(raw(spark, [(spec("aa", "bb", "cc", "dd", positives=[("A", "C", "INT")]), {"sentence": "aa then bb then cc and dd"}, None)]), "g")
    roles = spark.createDataFrame([(0, "after", {"B": "r1", "D": "r2"})], "spec_index long, role_pos string, roles map<string,string>")
    r = resolve.generation_records(p, roles)
    x = one(r)
    assert x["positive_span"] == 8.0 and x["sep_achieved"] == 1 and sorted(x["role_spans"]) == [8, 23] and x["n_entities"] == 4
    assert {(a.role_pos_requested, a.achieved): a.n for a in resolve.role_positions(r).collect()} == {("after", "after"): 2}
    assert one(resolve.role_position_skew(r))["role_position_skew"] == 1.0 and one(resolve.separations(r)) == {"sep_achieved": 1, "n": 1, "share": 1.0}


def test_resume_log(spark, tmp_path):
    log = spark.createDataFrame([(0, "{}", "a", None), (1, "{}", None, "Timeout: x"), (1, "{}", "b", None), (2, "{}", None, "ValueError: y")], "spec_index long, spec string, sample string, error string")
    want = spark.createDataFrame([(k, "{}") for k in range(4)], "spec_index long, spec string")
    assert sorted(r.spec_index for r in ingest.todo(want, log).collect()) == [2, 3]
    assert one(ingest.log_counts(log)) == {"attempts": 4, "errors": 2, "indices": 3, "succeeded": 2}
    assert {r.spec_index: r.error for r in ingest.effective(log).collect()} == {0: None, 1: None, 2: "ValueError: y"}

    def call(text):
        if json.loads(text)["n"] == 3:
            raise ValueError("three")
        return '{"sentence": "ok"}'

    reqs = spark.createDataFrame([(k, json.dumps({"n": k})) for k in range(10)], "spec_index long, spec string")
    path = str(tmp_path / "raw")
    out = ingest.generate(reqs, call, path, attempts=3, enough=0.95)
    assert one(ingest.log_counts(out)) == {"attempts": 12, "errors": 3, "indices": 10, "succeeded": 9}
    again = ingest.generate(reqs, call, path, attempts=3, enough=0.9)
    assert again.count() == 12


def test_stream_is_idempotent(spark, tmp_path):
    rows = [(k % 7, "{}", f"s{k}" if k % 3 else None, None if k % 3 else "e") for k in range(30)]
    df = spark.createDataFrame(rows, "spec_index long, spec string, sample string, error string")
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    df.repartition(3).write.parquet(src)
    for _ in range(2):
        ingest.stream_successes(spark, src, df.schema, lambda d: d, out, cp).awaitTermination()
    assert sorted(r.spec_index for r in spark.read.parquet(out).collect()) == list(range(7))
    ingest.stream_log(spark, src, df.schema, lambda d: d, str(tmp_path / "bronze"), str(tmp_path / "cp2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "bronze")).count() == 30


def marked(spark):
    rows = [("[E1]aa[/E1] x [E2]bb[/E2] y cc", "NONE", "s", 0), ("[E1]aa[/E1] x bb y [E2]cc[/E2]", "EFFECT", "s", 1), ("aa x [E1]bb[/E1] y [E2]cc[/E2]", "NONE", "s", 2), ("only [E1]one[/E1]", "NONE", "t", 0)]
    return spark.createDataFrame(rows, "text string, label string, sent_id string, pair_no int")


def test_verifier(spark):
    b = verify.verify_batches(marked(spark)).collect()
    assert len(b) == 1 and b[0].text == "aa[1] x bb[2] y cc[3]" and b[0].pairs == [[1, 2], [1, 3], [2, 3]] and b[0].names == [["aa", "bb"], ["aa", "cc"], ["bb", "cc"]] and b[0].n_mentions == 3
    assert verify.verify_batches(marked(spark), max_pairs=2).count() == 0
    raws = spark.createDataFrame([("s", json.dumps({"verdicts": [{"pair": p, "annotated": a} for p, a in v]}), None) for v in ([(0, True), (1, True), (5, True)],)], "sent_id string, sample string, error string")
    v = verify.verdict_rows(raws, verify.verify_batches(marked(spark)))
    assert [(r.m1, r.m2, r.flagged, r.gold_pos) for r in v.orderBy("m1", "m2").collect()] == [(1, 2, True, False), (1, 3, True, True), (2, 3, False, False)]
    short = raws.withColumn("sample", F.lit('{"verdicts": [{"pair": 0, "annotated": true}, {"pair": 0, "annotated": true}, {"pair": 1, "annotated": true}]}'))
    assert verify.verdict_rows(short, verify.verify_batches(marked(spark))).count() == 0
    al = verify.aligned(marked(spark), v)
    assert sorted((r.pair_no, r.judged, r.flagged) for r in al.where("sent_id = 's'").collect()) == [(0, True, True), (1, True, False), (2, True, False)]
    n = {r.arm: r["count"] for r in verify.pruning_arms(al, 1, "sent_id", "pair_no").groupBy("arm").count().collect()}
    assert n == {"judged": 3, "judged-pruned": 2, "judged-randprune": 2}
    assert spark.range(1).select(verify.same_name(F.lit("Statins"), F.lit("statin"))).first()[0]


def test_calibration(spark):
    rows = [(False, False)] * 92 + [(False, True)] * 8 + [(True, False)] * 3 + [(True, True)] * 7
    c = one(scoring.calibration(spark.createDataFrame(rows, "gold_pos boolean, flagged boolean")))
    assert (c["none_recall"], c["pos_recall"], c["accuracy"]) == (0.92, 0.7, 99 / 110) and round(c["flag_precision"], 4) == 0.2130
    d = spark.range(1).select(scoring.corrected_drift(F.lit(0.074), F.lit(0.08), F.lit(0.7))).first()[0]
    assert d == 0.0


def test_sampling(spark, inst):
    rows = spark.createDataFrame([(k, "EFFECT" if k < 3 else "NONE") for k in range(13)], "key int, label string")
    assert sampling.downsample_negatives(rows, 2, 1, "key").count() == 9 and sampling.downsample_negatives(rows, None, 1, "key").count() == 13
    assert sampling.match_positive_rate(rows, 0.25, 1, "key").count() == 12
    assert sampling.none_needed(3, 0.5) == 3
    groups = spark.createDataFrame([(f"g{k // 3}", k) for k in range(9)], "sent_id string, k int")
    got = sampling.sample_to_rows(groups, 4, 1)
    assert got.count() == 6 and all(r["count"] == 3 for r in got.groupBy("sent_id").count().collect())
    assert sampling.sample_groups(groups, None, 1).count() == 9 == sampling.sample_groups(groups, 99, 1).count()
    big = spark.range(5000).withColumnRenamed("id", "k")
    for n in (0, 1, 777, 5000, 9000):
        t = sampling.take(big, n, 3, "k", digits=2)
        want = sorted(range(5000), key=lambda k: (__import__("hashlib").md5(f"3:{k}".encode()).hexdigest(), k))[:n]
        assert sorted(r.k for r in t.collect()) == sorted(want)
    parts = {r.split: r["count"] for r in sampling.split_by_hash(big, 1, "k", parts={"train": 0.7, "dev": 0.15, "val": 0.15}).groupBy("split").count().collect()}
    assert set(parts) == {"train", "dev", "val"} and abs(parts["train"] / 5000 - 0.7) < 0.03
    assert all(r["count"] == 3 for r in sampling.match_composition(groups, 3.0, 6, 1).groupBy("sent_id").count().collect())


def test_text(spark):
    t = lambda c: spark.range(1).select(c).first()[0]
    assert t(X.ngrams(X.words(F.lit("a b c d e")), 4)) == ["a b c d", "b c d e"] and t(X.ngrams(X.words(F.lit("a b")), 4)) == [] and t(X.n_words(F.lit("  "))) == 0
    assert t(X.normalised(F.lit("**CH₃**–x  ​ y"))) == "CH3-x y"
    assert t(X.degenerate(F.lit("same " * 20))) and not t(X.degenerate(F.lit("same " * 14))) and not t(X.degenerate(F.lit(" ".join(map(str, range(20))))))
    opens = spark.createDataFrame([("x a b",), ("x a b",), ("y a b",), ("y a b",)], "plain string")
    assert one(measures.text_measures(opens))["opening_entropy"] == 1.0
    lens = spark.createDataFrame([(4,), (6,)], "w int")
    assert one(index_quantiles(lens, "w", {"median": 0.5, "most": 1.0})) == {"median": 6, "most": 6}
    assert one(measures.text_measures(spark.createDataFrame([("a b c",)], "plain string")))["distinct_4"] == 0.0


def test_vocabulary(spark):
    cases = {"aspirin": (1, 1), "interferon alfa-2a": (0, 0), "B12X9": (0, 0), "other analgesics": (0, 0), "honey": (0, 1), "nebivolol and amlodipine": (1, 1), "a b c d": (1, 0), "": (0, 0), "x, y": (0, 0)}
    got = spark.createDataFrame([(n,) for n in cases], "n string").select("n", ~lexicon.bad_drug(F.col("n")), ~lexicon.bad_group(F.col("n"))).collect()
    assert {r[0]: (int(r[1]), int(r[2])) for r in got} == cases
    atc = spark.createDataFrame([("N02BA01", "aspirin"), ("N02BA", "SALICYLIC ACID"), ("N02", "analgesics"), ("N02BAX", "six"), (None, None)], "atc_code string, atc_name string")
    assert sorted(tuple(r) for r in lexicon.classified_names(atc).collect()) == [("drug", "aspirin"), ("group", "Salicylic Acid")]
    db = spark.createDataFrame([("aspirin", None), ("B12X9", "other|good name|later"), ("honey", None)], "Common_Name_of_Drug string, Synonym string")
    assert sorted(r.name for r in lexicon.drug_names(db).collect()) == ["aspirin", "good name"]
    b = spark.createDataFrame([(0, "drug", ["x", "y", "z"]), (1, "drug", ["q"])], "batch int, kind string, values array<string>")
    a = spark.createDataFrame([(0, [1, 9], None), (1, [0], "e")], "batch int, rejected array<int>, error string")
    kept, gone = lexicon.judged_names(b, a)
    assert sorted(r.name for r in kept.collect()) == ["x", "z"] and [r.name for r in gone.collect()] == ["y"]
    with pytest.raises(ValueError, match="nothing is written"):
        lexicon.frozen(b, "/nowhere", 100)


def test_specs(spark):
    vocab = lexicon.vocabulary(spark.createDataFrame([(f"drug{chr(97 + k)}{chr(97 + k * 7 % 26)}q",) for k in range(26)], "name string"), spark.createDataFrame([("zzgroup",), ("yygroup",)], "name string"))
    a = {r.spec_index: r for r in specs.specs(spark, 60, vocab, 5).collect()}
    assert {k: a[k] for k in range(20)} == {r.spec_index: r for r in specs.specs(spark, 20, vocab, 5).collect()}
    for r in a.values():
        names = [e.surface.lower() for e in r.entities]
        assert len(set(names)) == len(names) and (not r.complete or len(names) >= specs.FRAMES[r.frame][1])
        assert len(r.matrix) == len(names) * (len(names) - 1) // 2 and len(r.roles) <= 2 and len(r.axes) <= 2
        if r.complete:
            assert sum(v != "NONE" for v in r.matrix.values()) == len(specs.FRAMES[r.frame][3])
    assert not any(r.frame == "study_only" for r in a.values())
    p = specs.prompts(specs.specs(spark, 5, vocab, 5), F.lit("label prose"), F.expr("array(named_struct('k', 'about', 'v', '{A} and {B}'))")).collect()
    assert all("drug names, use all" in r.prompt and "{A}" not in r.prompt and r.prompt == r.prompt.rstrip() for r in p)
    w = specs.redistributed({"a": 0.5, "b": 0.5}, "b", {"a": 1.0})
    assert w == {"a": 1.0, "b": 0.0}


def test_frames(spark):
    rows = spark.createDataFrame([(0, "denial", "This has no effect."), (1, "denial", "It does."), (2, "effect", "The level rises."), (3, "int", "x")], "spec_index int, frame string, sentence string")
    r = {x.frame: x for x in frames.frame_report(rows).collect()}
    assert r["denial"].has_marker == 0.5 and r["denial"].breaks_avoid is None and r["effect"].breaks_avoid == 1.0 and r["int"].has_marker is None
    assert [x.frame for x in frames.breaches(frames.frame_report(rows)).collect()] == ["effect"]
    got = frames.expected_positives(spark.createDataFrame([("s1", 1), ("s9", 1)], "sent_id string, n_positive int"), spark.createDataFrame(ROWS, "sent_id string, pair_no int, label string, source string"))
    assert one(got) == {"n": 2, "matched": 1, "share": 0.5, "median_got": 1.0}


def test_store(spark, tmp_path):
    rows = spark.createDataFrame([("[E1]a[/E1] [E2]b[/E2]", "NONE", "R", "s", 0), ("[E1]a[E2][/E1]b[/E2]", "INT", "R", "s", 1)], "text string, label string, source string, sent_id string, pair_no int")
    root = str(tmp_path / "d")
    i = store.write_dataset(rows, root, "human", render_mode="markers", seed=1)
    assert store.load_dataset(spark, root, i).count() == 2
    m = one(store.manifests(spark, root))
    assert m["size"].n_instances == 2 and m["size"].n_sentences == 1 and m["label_distribution"] == {"NONE": 1, "INT": 1}
    a, b, dropped = store.write_masked_twins(rows, root, i)
    assert store.load_dataset(spark, root, b).first().text == "drug1 drug2" and one(dropped) == {"label": "INT", "n": 1}
    assert {(r.dataset_id, r.ancestor) for r in store.lineage(store.manifests(spark, root)).collect()} == {(a, i), (b, i)}
    rows.limit(1).write.mode("append").parquet(f"{root}/instances/{i}")
    with pytest.raises(ValueError, match="digest"):
        store.load_dataset(spark, root, i)
    ms = {r.dataset_id: r for r in store.manifests(spark, root).collect()}
    man = lambda k: store.manifests(spark, root).where(F.col("dataset_id") == k)
    store.guard_evaluation(man(i), man(i))
    with pytest.raises(ValueError, match="by people"):
        store.guard_evaluation(man(i), man(a))
    assert ms[a].parent_id == i
    store.log_run(spark, root, {"lr": 2e-5, "train_id": "t"}, {"f1": 0.5})
    store.log_run(spark, root, {"epochs": 3}, {"f1": 0.7, "p": 0.1})
    runs = store.load_runs(spark, f"{root}/runs").orderBy("`m.f1`").collect()
    assert runs[0]["cfg.lr"] == "2.0E-5" or float(runs[0]["cfg.lr"]) == 2e-5
    assert runs[0].train_id == "t" and runs[1]["m.p"] == 0.1 and runs[0]["m.p"] is None
    (tmp_path / "terms.json").write_text('{"chemical": {"aspirin": 1, "b": 2}, "gene": ["x"]}')
    assert sorted(tuple(r) for r in store.read_terms(spark, str(tmp_path / "terms.json")).collect()) == [("chemical", "aspirin"), ("chemical", "b"), ("gene", "x")]
    (tmp_path / "raw.jsonl").write_text('{"spec_index": 1, "spec": {"a": 1}, "sample": {"sentence": "x"}, "error": null}\n\n{"spec_index": 2, "spec": {}, "sample": null, "error": "E"}\n')
    assert [r.spec_index for r in resolve.successes(store.read_raw(spark, str(tmp_path / "raw.jsonl"))).collect()] == [1]
    assert not store.write_rejects(rows.where("false"), str(tmp_path / "rej")) and "| label |" in store.report_text("t", {"x": rows.select("label")})


def test_mixing(spark, inst):
    human = inst.withColumn("text", F.lit("x"))
    synth = human.withColumn("sent_id", F.concat(F.lit("g"), "sent_id"))
    rows = mixing_curve(human, synth, [2, None], lambda b: [0, 1] if b else [0], lambda d: float(d.count()), ("sent_id", "pair_no"))
    assert len(rows) == 6 and {r["arm"] for r in rows} == {"human", "mixed"}
    assert mixing_arms.budget_seeds(100) == [0, 1, 2, 3, 4] and mixing_arms.budget_seeds(None) == [0, 1, 2]
    curve = spark.createDataFrame([(100, "human", 0.5), (100, "human", 0.7), (100, "mixed", 0.8), (100, "mixed", 0.6)], "n_sentences int, arm string, f1 double")
    c = one(scoring.curve_summary(curve, "human", "mixed"))
    assert round(c["delta"], 9) == 0.1 and round(c["pooled_sd"], 9) == 0.2
