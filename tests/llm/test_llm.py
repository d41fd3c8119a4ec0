"""Each operator against a brute-force version, a round trip or known cases, and on odd input."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from pairloom.llm import chat, common, decontaminate, langid, licenses, neighbours, packing, queries, simhash, token_binary, token_counts, url_filters
from pairloom.llm import components as component_steps
from pairloom.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, k int, __cut int"


def docs_of(spark, rows):
    """rows of (doc_id, text[, lang]) with columns whose names the operators use inside."""
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None if r[1] is None else len(r[1]), "x", 1, 7) for r in rows], DOCS)


def prose(seed, n, words=("river", "stone", "amber", "quiet", "north", "paper", "signal", "garden", "copper", "window", "basket", "engine", "harbor", "meadow", "pencil", "rocket")):
    r = random.Random(seed)
    return " ".join(r.choice(words) + r.choice(["", "s", "ing", "ly", "ed", str(r.randrange(50))]) for _ in range(n))


def dicts(df):
    return [r.asDict() for r in df.collect()]


# ---- 1


def visited(conv, enc):
    """Brute force of one conversation: rows (turn, role, parts)."""
    out, said, listed = [], [], []
    for turn, role, parts in sorted(conv, key=lambda m: (m[0] is not None, m[0] or 0)):
        mark = (chat.ROLE.get(role, f"<|role:{role}|>") if role else "<|unknown|>") + "\n"
        out.append(mark), said.append(mark)
        for p in parts or []:
            if p is None or (p["type"] == "text" and not p.get("text")):
                continue
            if p["type"] == "text":
                words = p["text"].replace("<|", "<\\|")
                words = "\\" + words if words.startswith("|") else words
                out.append(words), said.append(words)
                continue
            kind = p["type"] if p["type"] in ("image", "audio", "document") else "document"
            if kind == "image":
                side = lambda x: max(1, math.ceil(max(p.get(x) or 1, 1) / chat.TILE))  # noqa: E731,B023
                tokens = (side("width") * side("height") + 1) * chat.TILE_TOKENS
            elif kind == "audio":
                tokens = max(1, math.ceil(max(p.get("seconds") or 0, 0) * chat.AUDIO_TOKENS_A_SECOND))
            else:
                tokens = max(1, p.get("pages") or 1) * chat.PAGE_TOKENS
            listed.append((len(listed) + 1, turn, kind, p.get("ref"), tokens))
            out.append(f"<|{kind}_{len(listed)}|>")
        out.append(chat.END + "\n"), said.append(chat.END + "\n")
    n = enc.length("".join(said))
    return "".join(out), listed, n, n + sum(x[4] for x in listed)


def test_chat_against_brute_force(spark):
    image = {"type": "image", "ref": "a.png", "width": 1000, "height": 500}
    convs = {
        1: [(0, "system", [{"type": "text", "text": "be kind"}]), (1, "user", [image, {"type": "text", "text": "what is this?"}, {"type": "audio", "ref": "b.wav", "seconds": 2.5}]), (2, "assistant", [{"type": "text", "text": "a cat " * 3000}])],
        2: [(0, "user", [{"type": "document", "ref": "c.pdf", "pages": 3}, None, {"type": "text", "text": ""}, {"type": "text", "text": None}])],
        3: [(0, "tool", [{"type": "video", "ref": "d", "pages": None}]), (None, None, None)],
        5: [(0, "user", [{"type": None, "ref": "kept"}, {"type": "text", "text": "<|image_1|> <|end|>"}, {"type": "image", "width": 9000, "height": 10}, {"type": "text", "text": "ends in <"}, {"type": "text", "text": "|end|> so"}])],
        6: [(0, "user", [{"type": "text", "text": "long " * 60_000}] + [image] * 500)],
        4: [(5, "user", [image, image, {"type": "image", "width": None, "height": -4}, {"type": "audio"}])],
    }
    rows = [(c, t, r, p, "clash") for c, ms in convs.items() for t, r, p in ms]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PARTS}, items string")
    df = df.unionByName(spark.createDataFrame([(None, 0, "user", None, "x")], df.schema))
    got = {r.conv_id: r for r in chat.formatted(df).collect()}
    enc = common.Encoder()
    assert set(got) == set(convs)
    for c, ms in convs.items():
        prompt, listed, n, total = visited(ms, enc)
        assert got[c].prompt == prompt
        assert [tuple(a) for a in got[c].attachments] == listed
        assert (got[c].text_tokens, got[c].expanded_tokens, got[c].n_messages) == (n, total, len(ms))
    assert got[5].attachments[0].ref == "kept" and got[5].attachments[1].tokens == (21 * 1 + 1) * chat.TILE_TOKENS
    assert got[5].prompt.count("<|end|>") == 1 and "<|image_1|>" not in got[5].prompt and len(got[6].attachments) == 500


def test_chat_repeats_json_and_empty(spark):
    df = spark.createDataFrame([(1, 0, "user", '[{"type":"image","ref":"x","width":10,"height":10},{"type":"text","text":"hi"}]'), (1, 1, "user", "[plain"), (1, 1, "user", "[plain"), (1, 2, "user", None)], "conv_id long, turn long, role string, text string")
    r = chat.formatted(df.withColumn("parts", chat.json_parts(F.col("text")))).first()
    assert r.prompt.count("[plain") == 2 and "<|image_1|>hi" in r.prompt and r.n_messages == 4
    assert chat.formatted(df.where("false").withColumn("parts", chat.text_parts(F.col("text")))).count() == 0


def test_op1_matches_brute_force_on_table(spark, small):
    got = {r.conv_id: r for r in queries.QUERIES["op1_chat_format"](spark, small).collect()}
    convs = defaultdict(list)
    for r in chat.with_attachments(common.table(spark, small, "conversations")).collect():
        convs[r.conv_id].append((r.turn, r.role, [p.asDict() for p in r.parts]))
    enc = common.Encoder()
    assert set(got) == set(convs)
    for c, ms in convs.items():
        prompt, listed, n, total = visited(ms, enc)
        assert (got[c].prompt, got[c].text_tokens, got[c].expanded_tokens) == (prompt, n, total)
        assert [tuple(a) for a in got[c].attachments] == listed
    assert any(r.attachments for r in got.values())


# ---- 2


def edited(text, seed, share):
    r, w = random.Random(seed), text.split()
    for _ in range(max(1, int(len(w) * share))):
        w[r.randrange(len(w))] = "changed" + str(r.randrange(9))
    return " ".join(w)


def grouped(df):
    out = {}
    for r in df.collect():
        out[r.doc_id] = r.duplicate_of
    return out


def brute_groups(rows, distance=simhash.DISTANCE):
    """All pairs compared whole."""
    make, parent = simhash.Fingerprints(), {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keep = [(i, t, make.of(t)) for i, t in rows if i is not None and t is not None]
    for i, _, _ in keep:
        parent[i] = i
    bits = lambda f: np.unpackbits(f.view(np.uint8))
    for a in range(len(keep)):
        for b in range(a):
            (i, s, f), (j, t, g) = keep[a], keep[b]
            same = s == t
            if not same and f is not None and g is not None:
                same = int((bits(f) ^ bits(g)).sum()) <= distance
            if same:
                a_, b_ = find(i), find(j)
                parent[max(a_, b_)] = min(a_, b_)
    return {i: find(i) for i in parent if find(i) != i}


def test_near_duplicates_against_brute_force(spark):
    rows = []
    for g in range(6):
        base = prose(g, 120)
        rows += [(g * 100, base), (g * 100 + 1, base)] + [(g * 100 + 2 + k, edited(base, k, 0.03)) for k in range(g * 4)]
    rows += [(1000 + k, prose(500 + k, 60)) for k in range(40)]
    rows += [(2000, ""), (2001, ""), (2002, "!!!"), (2003, "!!!"), (2004, "???"), (2005, None), (2006, None), (None, "alone"), (2007, prose(0, 120)), (2007, prose(0, 120)), (2008, prose(77, 60_000)), (2009, edited(prose(77, 60_000), 1, 0.01)), (2010, "word"), (2011, "word")]
    got = grouped(simhash.near_duplicates(docs_of(spark, rows)))
    assert got == brute_groups(rows)
    assert got[2001] == 2000 and got[2003] == 2002 and 2004 not in got and 2005 not in got and got[2009] == 2008 and got[2007] == 0 and got[2011] == 2010
    clean = set(range(1000, 1040))
    assert not clean & (set(got) | set(got.values()))


def all_pairs(rows, distance=simhash.DISTANCE):
    """Pairs of different texts within the distance, by all comparisons."""
    make, texts = simhash.Fingerprints(), {}
    for i, t in rows:
        texts.setdefault(t, i)
    some = [(i, f) for t, i in texts.items() if t is not None and (f := make.of(t)) is not None]
    fps, out = np.stack([f for _, f in some]), []
    for a in range(len(some)):
        d = np.bitwise_count(fps[a + 1 :] ^ fps[a]).sum(1).astype(int)
        out += [(some[a][0], some[a + 1 + b][0], d[b]) for b in np.flatnonzero(d <= distance)]
    return out


def test_op2_query_against_all_pairs(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in common.table(spark, d, "documents").select("doc_id", "text").collect()]
    got = grouped(queries.QUERIES["op2_simhash_near_dedup"](spark, d))
    want = brute_components(rows)
    assert set(got) <= set(want)
    assert len(got) >= 0.99 * len(want)
    pairs = all_pairs(rows)
    root = lambda i: got.get(i, i)
    assert sum(root(a) == root(b) for a, b, _ in pairs) >= 0.98 * len(pairs)
    exact = {}
    for i, t in sorted(rows):
        assert t is None or root(exact.setdefault(t, i)) == root(i)


def brute_components(rows):
    parent = {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    first = {}
    links = []
    for i, t in rows:
        if i is not None and t is not None:
            parent[i] = i
            links.append((first.setdefault(t, i), i))
    for a, b, *_ in [*links, *all_pairs(rows)]:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in parent if find(i) != i}


def test_large_sets_are_walked_in_parts(spark):
    rows = [(g * 1000 + k, edited(prose(g, 200), k, 0.02) if k else prose(g, 200)) for g in range(2) for k in range(60)]
    docs = docs_of(spark, rows)
    whole = grouped(simhash.near_duplicates(docs))
    assert whole == grouped(simhash.near_duplicates(docs, together=4)) == brute_components(rows)


def test_all_pairs_up_to_the_distance_are_linked(spark):
    """Pairs of 60 to 68 bits, each alone: nothing else connects them."""
    make, rows = simhash.Fingerprints(), []
    for g in range(200):
        base = prose(3000 + g, 60)
        f = make.of(base)
        far = [(t, int(np.bitwise_count(f ^ make.of(t)).sum())) for k in range(40) for t in [edited(base, k, 0.1 + k / 400)]]
        rows += [(g * 10, base)] + [(g * 10 + 1, t) for t, d in far if 60 <= d <= simhash.DISTANCE][:1]
    want = brute_components(rows)
    assert len(want) >= 100
    assert grouped(simhash.near_duplicates(docs_of(spark, rows))) == want


@pytest.mark.parametrize("kind", ["spread", "alike", "few bits"])
def test_links_by_blocks_against_all_pairs(monkeypatch, kind):
    r = np.random.default_rng(5)
    fps = r.integers(0, 2**64, (700, 8), dtype=np.uint64)
    if kind == "few bits":  # large buckets
        fps &= r.integers(0, 2**64, (1, 8), dtype=np.uint64) & r.integers(0, 2**64, (1, 8), dtype=np.uint64) & r.integers(0, 2**64, (1, 8), dtype=np.uint64)
    for k in range(300):
        of = k // 6 if kind == "alike" else k
        bits = np.unpackbits(fps[of].view(np.uint8))
        if kind == "spread":  # as even over all bits as can be
            bits[(np.arange(68) * 512 // 68 + k) % 512] ^= 1
        else:
            bits[r.choice(512, int(r.integers(20, 72)), replace=False)] ^= 1
        fps[350 + k] = np.packbits(bits).view(np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None]).sum(2).astype(int) <= 68

    def comps(pairs):
        p = list(range(len(fps)))

        def find(x):
            while p[x] != x:
                x = p[x]
            return x

        for a, b in pairs:
            a, b = find(a), find(b)
            p[max(a, b)] = min(a, b)
        return [find(x) for x in p]

    for few, tile in ((0, 1 << 16), (0, 64), (1 << 21, 1 << 16)):
        monkeypatch.setattr(simhash, "_FEW", few)
        monkeypatch.setattr(simhash, "_TILE", tile)
        got = simhash.near_links(fps, len(fps), 68)
        assert all(near[a, b] for a, b in got)
        assert comps(got) == comps(np.argwhere(near).tolist())
        parts = [x for k in range(3) for x in simhash.near_links(fps, 300, 68, range(k, 9, 3))]
        assert all(a < 300 <= b for a, b in parts)
        assert comps(parts) == comps([(a, b) for a, b in np.argwhere(near).tolist() if a < 300 <= b])


@pytest.mark.parametrize("n,together,rows", [(40, 100, 1), (2000, 5000, 9), (2000, 1500, 9)])
def test_each_pair_of_texts_meets_once_a_group_of_blocks(spark, n, together, rows):
    """A text is a few rows, and every pair is compared for all blocks in one task of each group."""
    texts = spark.range(n).select(F.col("id").alias("n"), *(F.col("id").alias(f"f{i}") for i in range(8)))
    tasks, groups = simhash._tasks(texts, n, together)
    held = defaultdict(lambda: ([], []))
    for r in tasks.select("k", "side", "n").collect():
        held[r.k][r.side].append(r.n)
    assert sum(len(a) + len(b) for a, b in held.values()) == rows * n
    met = np.zeros((groups, n, n), dtype=int)
    for k, (a, b) in held.items():
        for x, y in [(a, b), (b, a)] if b else [(a, a)]:
            met[k % groups][np.ix_(x, y)] += 1
    assert (met == 1).all()


def test_copies_with_text_ids_and_maps(spark):
    base = prose(4, 90)
    df = spark.createDataFrame([("b", base, {"x": 1}), ("a", base, {"x": 2}), ("c", prose(8, 90), {"x": 1, "y": 2}), ("c", prose(8, 90), {"x": 1, "y": 2}), ("d", None, None)], "doc_id string, text string, more map<string,int>")
    assert grouped(simhash.near_duplicates(df)) == {"b": "a"}
    assert sorted((r.doc_id, r.more) for r in simhash.without_copies(df).collect() if r.doc_id != "d") == [("a", {"x": 2}), ("c", {"x": 1, "y": 2})]


def test_near_copies_are_found(spark):
    rows = [(g * 1000 + k, edited(prose(g, 200), k, 0.02) if k else prose(g, 200)) for g in range(5) for k in range(60)]
    got = grouped(simhash.near_duplicates(docs_of(spark, rows)))
    assert sum(got.get(g * 1000 + k) == g * 1000 for g in range(5) for k in range(1, 60)) >= 0.95 * 5 * 59


def test_without_copies_keeps_one_row_and_columns(spark):
    base = prose(3, 80)
    df = docs_of(spark, [(1, base), (2, base), (3, edited(base, 1, 0.02)), (4, prose(9, 80)), (4, prose(9, 80)), (5, None), (None, base)])
    out = simhash.without_copies(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id or 0) for r in out.collect()) == [0, 1, 4, 5]
    assert simhash.near_duplicates(df.where("false")).count() == 0 and simhash.without_copies(df.where("false")).count() == 0


def test_walk_connects_what_all_pairs_connect():
    r = np.random.default_rng(1)
    for _ in range(30):
        n = int(r.integers(1, 40))
        fps = (r.integers(0, 2, (n, 8), dtype=np.uint64) << np.uint64(3)) | r.integers(0, 4, (n, 8), dtype=np.uint64)
        links = simhash.walk(np.arange(n), fps, 6)
        near = np.bitwise_count(fps[:, None] ^ fps[None]).sum(2) <= 6
        assert all(near[a, b] for a, b in links)

        def comps(pairs, n=n):
            p = list(range(n))
            for _ in range(n):
                for a, b in pairs:
                    p[a] = p[b] = min(p[a], p[b])
            return p

        assert comps(links) == comps([(a, b) for a in range(n) for b in range(n) if near[a, b]])


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1080)] + [(5000, k) for k in range(5001, 5200)] + [(9, 9), (7000, 7000), (None, 3), (1, 2), (2, 1)]
    p = {}
    find = lambda x: x if p[x] == x else find(p[x])
    for a, b in edges:
        if a is not None:
            p.setdefault(a, a), p.setdefault(b, b)
            a, b = find(a), find(b)
            p[max(a, b)] = min(a, b)
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in p}
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


@pytest.mark.parametrize("kind", ["long", "int", "string"])
def test_few_edges_are_labelled_in_one_task(spark, monkeypatch, kind):
    """A chain, which took a table of many files for each step, and a star whose centre is its greatest node; both ways alike."""
    edges = [(k, k + 1) for k in range(1000, 1300)] + [(5000, k) for k in range(4000, 4100)] + [(-7, -7), (3, -9), (None, 3), (3, None), (-9, 3)]
    want = {k: 1000 for k in range(1000, 1301)} | {k: 4000 for k in [*range(4000, 4100), 5000]} | {-7: -7, 3: -9, -9: -9}
    df = spark.createDataFrame(edges, "a long, b long")
    if kind == "string":  # of equal length, so that their order is that of the numbers
        df = df.select(*(F.format_string("%05d", F.col(c) + 10_000).alias(c) for c in ("a", "b")))
        df = df.where("a NOT LIKE '%null%' AND b NOT LIKE '%null%'")
        want = {f"{k + 10_000:05d}": f"{x + 10_000:05d}" for k, x in want.items()}
    else:
        df = df.select(*(F.col(c).cast(kind) for c in ("a", "b")))
    steps, write = [], component_steps.written
    monkeypatch.setattr(component_steps, "written", lambda rows, path: steps.append(path) or write(rows, path))
    out = components(df)
    assert {x.node: x.component for x in out.collect()} == want and out.dtypes == [("node", df.dtypes[0][1]), ("component", df.dtypes[0][1])]
    assert kind == "string" or not steps
    steps.clear()
    assert {x.node: x.component for x in components(df, together=10).collect()} == want
    assert len(steps) > 3


def test_links_hold_few_bytes_a_text():
    """A task of a million texts leaves a worker room beside another and an executor's heap."""
    import tracemalloc

    n = 100_000
    fps, even = np.zeros((n, 8), dtype=np.uint64), np.arange(0, n, 2)
    tracemalloc.start()
    try:
        found = simhash._Links(fps, 0)
        found.add(even, even + 1)
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert len(found.links) == n // 2 and held < 50 * n
    found.add(even[:-1], even[1:])
    assert len(found.links) == n - 1 and len(np.unique(found.label)) == 1


# ---- 3


def cut_by_hand(text, items, n, share):
    spans = [m.span() for m in re.finditer(r"\w+", text.lower())]
    w = [text.lower()[a:b] for a, b in spans]
    grams = set()
    for it in items:
        t = re.findall(r"\w+", (it or "").lower())
        grams |= {tuple(t[k : k + n]) for k in range(max(1, len(t) - n + 1))} if t else set()
    bad = set()
    for g in grams:
        for k in range(len(w) - len(g) + 1):
            if tuple(w[k : k + len(g)]) == g:
                bad |= set(range(k, k + len(g)))
    return len(bad), len(w)


def test_decontamination(spark):
    items = [prose(50, 30), "Short item here.", None, "", "...", prose(50, 30)]
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(items)], "item_id long, text string")
    clean = prose(1, 200)
    noisy = items[0].upper().replace(" ", ",  ")
    rows = [(1, clean), (2, clean + " " + noisy + ". " + prose(2, 100)), (3, items[0]), (4, None), (5, ""), (6, "nothing. Short ITEM here! " + prose(3, 50)), (7, " ".join(items[0].split()[:7])), (8, prose(4, 50_000) + " " + items[0] + " " + prose(5, 10)), (2, clean), (9, "İstanbul " + items[0] + " x" * 90), (10, items[0] + " " + items[0] + " " + prose(6, 300))]
    df = docs_of(spark, rows)
    for held in (10**6, 60):  # in one pass, and in several
        hits = {(r.doc_id): (r.n_hit, r.n_tokens, r.drop_document) for r in decontaminate.contaminated(df, bench, held=held).collect()}
        want = {i: (*c, c[0] >= 0.5 * c[1]) for i, t in rows if t and (c := cut_by_hand(t, items, decontaminate.N, 0.5))[0]}
        want[9] = hits[9] if hits[9][0] == 30 else None
        assert hits == want and set(hits) == {2, 3, 6, 8, 9, 10}
    out = decontaminate.decontaminated(df, bench)
    assert out.columns == df.columns
    left = defaultdict(list)
    for r in out.collect():
        left[r.doc_id].append(r)
    assert 3 not in left and left[4][0].text is None and left[5][0].text == "" and left[1][0].text == clean and left[7][0].text == rows[6][1]
    assert sorted(r.text for r in left[2]) == sorted([clean, clean + " " + prose(2, 100)])
    assert left[6][0].text == "nothing. " + prose(3, 50) and left[10][0].text == prose(6, 300)
    assert all(r.n_chars == len(r.text) for rs in left.values() for r in rs if r.text is not None)
    for r in left[8] + left[9]:
        assert cut_by_hand(r.text, items, decontaminate.N, 0.5)[0] == 0
    assert decontaminate.contaminated(df, bench.where("false")).count() == 0 and decontaminate.decontaminated(df, bench.where("false")).count() == len(rows)
    assert decontaminate.contaminated(df.where("false"), bench).count() == 0


def test_op3_on_table(spark, small):
    items = [r.text for r in common.table(spark, small, "benchmark").collect()]
    want = {}
    for r in common.table(spark, small, "documents").collect():
        n, total = cut_by_hand(r.text, items, decontaminate.N, 0.5)
        if n:
            want[r.doc_id] = (n, total)
    assert {r.doc_id: (r.n_hit, r.n_tokens) for r in queries.QUERIES["op3_benchmark_decontamination"](spark, small).collect()} == want


# ---- 4


def test_token_counts(spark):
    rows = [(k, prose(k, k % 7 * 5)) for k in range(40)] + [(50, None), (51, ""), (52, "<|endoftext|> é  x  y"), (53, "a" * 20_000), (54, prose(1, 5)), (54, prose(1, 5))]
    enc = common.Encoder()
    lens = [enc.length(t) for _, t in rows if t is not None]
    h = dicts(token_counts.token_histogram(docs_of(spark, rows)))
    assert {x["length"]: x["n_docs"] for x in h} == Counter(lens)
    for x in h:
        n = x["length"]
        assert x["docs_from"] == sum(v >= n for v in lens) and x["tokens_from"] == sum(v for v in lens if v >= n)
        assert x["truncated"] == sum(min(v, n) for v in lens) and x["docs_total"] == len(lens) and x["tokens_total"] == sum(lens)
    hist = token_counts.token_histogram(docs_of(spark, rows))
    limits = [-1, 0, 1, 7, 64, 10**9]
    got = {r["limit"]: (r.truncated, r.docs_cut) for r in token_counts.truncated_total(hist, spark.createDataFrame([(x,) for x in [*limits, None, 7]], "limit long")).collect()}
    assert got == {max(x, 0): (sum(min(v, max(x, 0)) for v in lens), sum(v > max(x, 0) for v in lens)) for x in limits}
    q = {r.share: r.length for r in token_counts.quantiles(hist, [0.0, 0.5, 0.9, 1.0]).collect()}
    assert all(sum(v <= q[s] for v in lens) >= s * len(lens) and (s == 0 or sum(v < q[s] for v in lens) < s * len(lens)) for s in q)
    empty = token_counts.token_histogram(docs_of(spark, rows).where("false"))
    assert empty.count() == 0 and token_counts.truncated_total(empty, spark.createDataFrame([(5,)], "limit long")).first().truncated == 0


def test_op4_on_table(spark, small):
    enc = common.Encoder()
    lens = [enc.length(r.text) for r in common.table(spark, small, "documents").collect()]
    assert {r.length: r.n_docs for r in queries.QUERIES["op4_token_counts"](spark, small).collect()} == Counter(lens)


# ---- 5


def recall(spark, x, k=10, **kw):
    df = spark.createDataFrame([(i, v.tolist(), "x", 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, near string, list int")
    got = neighbours.neighbours(df, k, **kw).collect()
    d = ((x[:, None].astype(np.float64) - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    bound = np.sort(d, axis=1)[:, k - 1]
    by = defaultdict(list)
    for r in got:
        by[r.vec_id].append(r)
        assert r.neighbour != r.vec_id and abs(r.distance**2 - d[r.vec_id, r.neighbour]) < 1e-5
    for rs in by.values():
        rs.sort(key=lambda r: r.rank)
        assert [r.rank for r in rs] == list(range(1, len(rs) + 1)) and all((a.distance, a.neighbour) < (b.distance, b.neighbour) for a, b in zip(rs, rs[1:], strict=False))
    return sum(d[r.vec_id, r.neighbour] <= bound[r.vec_id] + 1e-9 for r in got) / (len(x) * k)


def test_neighbours_recall(spark):
    r = np.random.default_rng(0)
    clustered = (r.normal(size=(20, 1, 16)) * 4 + r.normal(size=(20, 60, 16))).reshape(-1, 16).astype(np.float32)
    assert recall(spark, clustered, per_list=64) >= 0.9
    flat = r.normal(size=(900, 24)).astype(np.float32)
    assert recall(spark, flat, per_list=64) >= 0.9
    skewed = np.concatenate([r.normal(size=(700, 8)) * 0.01, r.normal(size=(100, 8)) * 5]).astype(np.float32)
    assert recall(spark, skewed, per_list=50) >= 0.9


def test_neighbours_odd_input(spark):
    kind = "vec_id long, embedding array<float>"
    v = [[1.0, 0.0], [1.0, 0.0], [0.0, 1.0], [3.0, 3.0]]
    rows = [(k, x) for k, x in enumerate(v)] + [(3, [3.0, 3.0]), (9, None), (None, [1.0, 1.0]), (10, [1.0, None]), (11, [float("nan"), 1.0]), (12, [1.0, 2.0, 3.0]), (13, []), (14, [float("inf"), 0.0])]
    got = dicts(neighbours.neighbours(spark.createDataFrame(rows, kind), 10))
    assert {r["vec_id"] for r in got} == {0, 1, 2, 3} and all(r["neighbour"] in {0, 1, 2, 3} for r in got)
    assert next(r for r in got if r["vec_id"] == 0 and r["rank"] == 1) == {"vec_id": 0, "rank": 1, "neighbour": 1, "distance": 0.0}
    assert max(Counter(r["vec_id"] for r in got).values()) == 3
    same = [(k, [1.0, 2.0]) for k in range(300)]
    got = dicts(neighbours.neighbours(spark.createDataFrame(same, kind), 5, per_list=32))
    assert len(got) == 1500 and all(r["distance"] == 0 for r in got)
    for few in ([], [(1, [1.0])], [(1, None)]):
        assert neighbours.neighbours(spark.createDataFrame(few, kind)).count() == 0


def test_op5_on_table(spark, small):
    x = np.array([r.embedding for r in common.table(spark, small, "embeddings").orderBy("vec_id").collect()], dtype=np.float32)
    assert recall(spark, x, per_list=64) >= 0.9


# ---- 6


def test_language_sample_is_bounded_and_the_first_by_hash(spark):
    rows = [(k % 7 if k % 3 else None, f"text number {k} " * 3, "en" if k % 2 else "de") for k in range(3000)] + [(5, "same text", "fr")] * 2000 + [(6, "other text", "fr"), (None, "", "en"), (1, None, "de"), (2, "x", None)]
    got = langid.dictionaries(docs_of(spark, rows), docs=20)
    first = lambda lang: sorted({(hashlib.md5((t if i is None else str(i)).encode()).hexdigest(), t) for i, t, n in rows if n == lang and t})
    assert sorted(got) == ["de", "en", "fr"] and got["fr"].decode().split("\n") in (["same text", "other text"], ["other text", "same text"])
    for lang in ("de", "en"):
        parts = got[lang].decode().split("\n")
        cut = first(lang)[19][0]
        assert len(parts) == 20 and all(hashlib.md5(t.encode()).hexdigest() <= cut or any(hashlib.md5(str(i).encode()).hexdigest() <= cut for i in range(7)) for t in parts)


def test_op6_query_against_plain_sizes(spark, small):
    docs = common.table(spark, small, "documents").collect()
    dicts_ = langid.dictionaries(common.table(spark, small, "documents"))
    import zstandard as z

    params = z.ZstdCompressionParameters(window_log=18, chain_log=17, hash_log=17, search_log=8, min_match=4, target_length=32, strategy=z.STRATEGY_GREEDY, format=z.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_dict_id=False)

    def size(name, text):
        raw, total = text.lower().encode(), 0
        c = z.ZstdCompressor(dict_data=z.ZstdCompressionDict(dicts_[name], dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=params)
        while raw:
            total, raw = total + len(c.compress(raw[: langid.PIECE] + b" " * 256)), raw[langid.PIECE :]
        return total

    got = {r.doc_id: r for r in queries.QUERIES["op6_language_id"](spark, small).collect()}
    assert set(got) == {r.doc_id for r in docs}
    for r in docs[::7]:
        best = sorted((size(n, r.text), n) for n in dicts_)
        assert got[r.doc_id].language == best[0][1]
        assert got[r.doc_id].language_accepted == ((best[1][0] - best[0][0]) / best[0][0] > langid.MARGIN)


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = docs.where("doc_id % 2 = 1").where("n_chars > 40").where(~F.col("text").rlike(r"(\S+ )\1\1\1|!! "))
    got = langid.identified(held, langid.dictionaries(docs.where("doc_id % 2 = 0"))).collect()
    right = sum(r.language == r.lang for r in got) / len(got)
    assert right >= 0.97
    assert sum(r.language_accepted for r in got) >= 0.99 * len(got)


def test_language_against_plain_loop_and_odd_input(spark):
    rows = [(1, "the river and the stone are in the garden", "en"), (2, "la rivière et la pierre sont dans le jardin", "fr"), (3, "the and of in it", "en"), (4, "la et de les une", "fr"), (5, None, "en"), (6, "", "fr"), (7, "the and", None), (8, "zzzz", "en"), (8, "zzzz", "en"), (9, "the and of " * 30_000, None), (10, "\U0001f600 é", "en")]
    df = docs_of(spark, rows)
    d = langid.dictionaries(df, docs=3)
    assert sorted(d) == ["en", "fr"]
    sizes = langid.Sizes(d)
    got = langid.identified(df, d).collect()
    assert len(got) == len(rows) and set(df.columns) < set(got[0].asDict())
    for r in got:
        assert (r.language, r.language_margin, r.language_accepted) == sizes.language(r.text)
    by = {r.doc_id: r for r in got}
    assert not by[5].language_accepted and by[6].language is None and by[9].language == "en"
    tie = langid.identified(df, {"aa": b"same words", "bb": b"same words"}).collect()
    assert not any(r.language_accepted for r in tie) and {r.language for r in tie if r.text} == {"aa"}
    assert langid.dictionaries(df.where("false")) == {} and not any(r.language_accepted for r in langid.identified(df, {}).collect())
    assert langid.identified(df.where("false"), d).count() == 0


def test_dictionary_sample_is_bounded(spark):
    df = docs_of(spark, [(k, prose(k, 400), "en") for k in range(30)])
    d = langid.dictionaries(df, docs=5, doc_bytes=100)
    assert len(d["en"]) <= 5 * 101 and d == langid.dictionaries(df.repartition(3), docs=5, doc_bytes=100)


# ---- 7


@pytest.mark.parametrize("high", [2, 255, 256, 50_257, 2**24, 2**32 - 1])
def test_codes_round_trip(high):
    r = np.random.default_rng(high)
    for n in (0, 1, 7, 8, 9, 511, 512, 513, 1500):
        ids = r.integers(0, high, n, endpoint=True).astype(np.uint32)
        levels = token_binary.encoded(ids)
        assert (token_binary.decoded(levels) == ids).all()
        assert [token_binary.token_at(levels, i) for i in range(n)] == ids.tolist()
        for i in (-1, n):
            with pytest.raises(IndexError):
                token_binary.token_at(levels, i)


def test_token_codes(spark):
    rows = [(1, prose(1, 300)), (2, ""), (3, None), (4, "héllo \U0001f600\n\n  x"), (5, prose(2, 40_000)), (1, "again"), (None, "no id")]
    enc = common.Encoder()
    out = token_binary.token_codes(docs_of(spark, rows))
    got = sorted(((r.doc_id or 0, r.n_tokens, None if r.levels is None else token_binary.decoded(r.levels).tolist()) for r in out.collect()), key=str)
    want = sorted(((i or 0, None if t is None else len(e := enc.ids(t)), None if t is None else e) for i, t in rows), key=str)
    assert got == want
    at = dict(out.select("doc_id", token_binary.tokens_at(F.col("levels"), F.lit(1)).alias("t")).where("doc_id in (2, 3, 5)").collect())
    assert at == {2: None, 3: None, 5: enc.ids(rows[4][1])[1]}
    assert token_binary.token_codes(docs_of(spark, rows).where("false")).count() == 0


def test_op7_query_round_trip(spark, small):
    enc = common.Encoder()
    got = {r.doc_id: r for r in queries.QUERIES["op7_token_binary"](spark, small).collect()}
    docs = common.table(spark, small, "documents").collect()
    assert len(got) == len(docs)
    for r in docs:
        assert token_binary.decoded(got[r.doc_id].levels).tolist() == enc.ids(r.text) and got[r.doc_id].n_tokens == len(enc.ids(r.text))


# ---- 8


def form(text):
    t = re.sub(licenses.COPYRIGHT, "", text.lower())
    meant = {said: m.split() for said, m in licenses.SPELLINGS}
    return " ".join(w for x in regex.findall(r"[\p{L}\p{N}\p{M}]+", t) for w in meant.get(x, [x]))


def test_licenses(spark):
    mit = licenses.KNOWN[0][1]
    rows = [(1, mit), (2, "Copyright (c) 2020 Someone\n\n" + mit.upper().replace(",", " ;")), (3, mit + " and more"), (4, "some text\nReleased under the MIT LICENCE!\nmore text"), (5, None), (6, ""), (7, "...\n\n---"), (8, "Licensed under CC-BY-NC 4.0"), (8, "Licensed under CC-BY-NC 4.0"), (9, prose(1, 50_000) + "\n" + "licenced under the Apache Licence, version 2.0"), (None, "Released under the MIT License.")]
    got = sorted((r.doc_id or 0, r.unit, r.line, r.license) for r in licenses.licensed(docs_of(spark, rows), licenses.digests(spark)).collect())
    known = {(form(t), name) for name, t in licenses.KNOWN if form(t)}
    want = []
    for i, t in rows:
        if t is not None:
            units = [("text", 0, t)] + [("line", k, x) for k, x in enumerate(t.split("\n"), 1)]
            want += [(i or 0, u, k, name) for u, k, x in units for f, name in known if f == form(x)]
    assert got == sorted(want)
    assert (2, "text", 0, "MIT") in got and (4, "line", 2, "MIT") in got and not any(g[0] == 3 for g in got) and any(g[0] == 9 for g in got)
    assert licenses.licensed(docs_of(spark, rows).where("false"), licenses.digests(spark)).count() == 0


def test_licence_forms_keep_letters_and_neighbours(spark):
    rows = [(1, "Этот код не Released under the MIT License"), (2, "released, under THE the licences"), (3, "Licence licence LICENCE v2 the the v3")]
    got = {r.doc_id: r.f for r in docs_of(spark, rows).select("doc_id", licenses.whole(licenses.canonical_lines(F.col("text"))).alias("f")).collect()}
    assert got == {1: "этот код не released under mit license", 2: "released under licenses", 3: "license license license version 2 version 3"}
    assert licenses.licensed(docs_of(spark, rows), licenses.digests(spark)).count() == 0


def test_whole_long_licence_is_found(spark):
    at = Path("/usr/share/common-licenses/GPL-3")
    if not at.exists():
        pytest.skip("no licence texts here")
    text = at.read_text(encoding="utf-8")
    docs = docs_of(spark, [(1, text), (2, text.upper().replace("\n", " \n\n")), (3, text + " more")])
    got = licenses.licensed(docs, licenses.digests(spark)).where("unit = 'text'").collect()
    assert sorted((r.doc_id, r.line, r.license) for r in got) == [(1, 0, "GPL-3.0"), (2, 0, "GPL-3.0")]


def test_op8_query_against_plain_loop(spark, small):
    known = [(form(t), name) for name, t in licenses.KNOWN]
    want = []
    for r in common.table(spark, small, "documents").collect():
        for k, x in enumerate([r.text, *r.text.split("\n")]):
            want += [(r.doc_id, "line" if k else "text", k, name) for name in {n for f, n in known if f == form(x)} if form(x)]
    assert sorted(map(tuple, queries.QUERIES["op8_license_scan"](spark, small).collect())) == sorted(want)


# ---- 9


def test_packing(spark):
    r = random.Random(4)
    rows = [(k, r.choice([1, 3, 40, 99, 100, 101, 250, 33, 34, 50, 51])) for k in range(400)] + [(7, 50), (7, 50), (1000, None), (1001, 0), (1002, -3), (None, 20), (1003, 12_345)]
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], "doc_id long, n_tokens long, class string, bin int")
    got = packing.packed(df, capacity=100, classes=8, shard=64).collect()
    pieces = Counter((a, k * 100, min(100, b - k * 100)) for a, b in rows if a is not None and b and b > 0 for k in range(-(-b // 100)))
    assert Counter((x.doc_id, x.start, x.length) for x in got) == pieces
    bins = defaultdict(list)
    for x in got:
        bins[(x["class"], x.shard, x.bin)].append(x)
        assert x["class"] == min(8, 100 // x.length)
    shards = {x.shard for x in got}
    assert len(shards) > 1
    last = {(c, s): max(b for c2, s2, b in bins if (c2, s2) == (c, s)) for c, s, _ in bins}
    for (c, s, b), xs in bins.items():
        assert sum(x.length for x in xs) <= 100 and sorted(x.slot for x in xs) == list(range(len(xs)))
        assert len(xs) == c or b == last[(c, s)]
    assert packing.packed(df.where("false")).count() == 0
    one = packing.packed(df.where("doc_id = 5"), capacity=100).collect()
    assert len(one) == -(-rows[5][1] // 100)


def test_packed_texts(spark):
    enc = common.Encoder()
    rows = [(1, prose(1, 30)), (2, None), (3, ""), (4, prose(2, 5000))]
    got = packing.packed_texts(docs_of(spark, rows)).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in got} == {i: enc.length(t) for i, t in rows if t}


def test_op9_query_against_plain_loop(spark, small):
    enc = common.Encoder()
    rows = queries.QUERIES["op9_harmonic_packing"](spark, small).collect()
    c, k = packing.CAPACITY, packing.CLASSES
    want = sorted((r.doc_id, at // c, at, min(c, n - at)) for r in common.table(spark, small, "documents").collect() for n in [enc.length(r.text)] for at in range(0, n, c))
    assert sorted((r.doc_id, r.piece, r.start, r.length) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        assert r["class"] == min(c // r.length, k) and 0 <= r.slot < r["class"]
        bins[r["class"], r.shard, r.bin].append(r)
    assert all(sum(x.length for x in b) <= c and len({x.slot for x in b}) == len(b) <= key[0] for key, b in bins.items())
    for key in {k_[:2] for k_ in bins}:  # all bins of a class and shard but the last are full
        assert all(len(bins[*key, n]) == key[0] for n in range(max(x[2] for x in bins if x[:2] == key)))


# ---- 10


def test_url_filters(spark):
    link = '<html><LINK rel="canonical" href="{}">'.format
    refresh = "<meta http-equiv='Refresh' content='0; url={}'>".format
    pages = [
        (1, "http://www.a.com/x/", link("https://good.com/y")),
        (2, "https://good.com/y?utm_source=q#top", ""),
        (3, "https://b.org/1.html", refresh("/2")),
        (4, "http://m.b.org/2", refresh("http://evil.net/land")),
        (5, "https://sub.evil.net/p", ""),
        (6, "https://evil.net/fine/page", None),
        (7, None, link("https://evil.net")),
        (8, "", "x"),
        (9, "https://c.com/a/b", link("rel")),
        (9, "https://c.com/a/b", link("rel")),
        (10, "https://c.com/a/rel", ""),
        (11, "https://notevil.net/p", ""),
        (12, "https://evil.net.org/", link("https://evil.net.org/")),
    ]
    df = spark.createDataFrame([(*p, "x", True) for p in pages], "page_id long, url string, html string, component string, allowed boolean")
    rules = spark.createDataFrame([("block", "evil.net"), ("allow", "evil.net/fine"), ("block", "evil.net"), ("allow", None), ("block", "c.com/a/rel")], "decision string, rule string")
    got = {r.page_id: (r.canonical, r.component, r.decision, r.by) for r in url_filters.filtered(df, rules).collect()}
    assert got[1][:3] == ("a.com/x", "a.com/x", "none") and got[2] == ("good.com/y", "a.com/x", "none", None)
    assert got[3] == ("b.org/1", "b.org/1", "block", "alias") and got[4][2:] == ("block", "alias")
    assert got[5] == ("sub.evil.net/p", "sub.evil.net/p", "block", "rule") and got[6][2:] == ("allow", "rule")
    assert got[7] == (None, None, "none", None) and got[8] == (None, None, "none", None)
    assert got[9][2:] == ("block", "alias") and got[10][2:] == ("block", "rule") and got[11][2] == "none" and got[12][2] == "none"
    assert url_filters.filtered(df, rules).count() == len(pages)
    moved = spark.createDataFrame([("http://notevil.net/p", "https://evil.net/q"), (None, "x.com")], "src string, dst string")
    assert {r.page_id: r.decision for r in url_filters.filtered(df, rules, moved).collect()}[11] == "block"
    assert url_filters.filtered(df.where("false"), rules).count() == 0


def test_url_components_against_union_find(spark):
    for seed in range(2):
        r = random.Random(seed)
        urls = [f"https://h{r.randrange(12)}.org/p{k}" for k in range(160)]
        link = lambda k: r.choice(["", f'<link rel="canonical" href="{urls[k]}">', f'<meta http-equiv="refresh" content="0;url={urls[k]}">'])  # noqa: B023,E731
        pages = [(k, urls[k], link(r.randrange(160))) for k in range(160)]
        moved = [(r.choice(urls), r.choice(urls)) for _ in range(20)]
        rules = [("block", f"h{r.randrange(12)}.org/p{r.randrange(160)}") for _ in range(60)] + [("block", "h3.org"), ("allow", "h3.org/p9")]
        bare = lambda u: u.split("//")[1]
        p = {bare(u): bare(u) for u in urls}
        find = lambda x: x if p[x] == x else find(p[x])  # noqa: B023,E731
        for k, u, html in pages:
            to = re.search(r'(?:href="|url=)([^"]+)', html)
            for a, b in [(u, to.group(1))] if to else []:
                a, b = find(bare(a)), find(bare(b))
                p[max(a, b)] = min(a, b)
        for a, b in moved:
            a, b = find(bare(a)), find(bare(b))
            p[max(a, b)] = min(a, b)
        named = lambda u, d: any(x == d and (bare(u) == y or bare(u).startswith(y + "/")) for x, y in rules)  # noqa: B023,E731
        bad = {find(bare(u)) for u in urls if named(u, "block")}
        want = {k: (find(bare(u)), *(("allow", "rule") if named(u, "allow") else ("block", "rule") if named(u, "block") else ("block", "alias") if find(bare(u)) in bad else ("none", None))) for k, u, _ in pages}
        df = spark.createDataFrame(pages, "page_id long, url string, html string")
        got = url_filters.filtered(df, spark.createDataFrame(rules, "decision string, rule string"), spark.createDataFrame(moved, "src string, dst string"))
        assert {x.page_id: (x.component, x.decision, x.by) for x in got.collect()} == want
        assert any(w[2] == "alias" for w in want.values())


def test_url_filters_long_page(spark):
    df = spark.createDataFrame([(1, "https://a.org/x", "<p>" + "word " * 200_000 + '<link rel="canonical" href="/y">'), (2, "https://a.org/y", "")], "page_id long, url string, html string")
    got = url_filters.filtered(df, spark.createDataFrame([("block", "a.org/y")], "decision string, rule string"))
    assert {r.page_id: r.by for r in got.collect()} == {1: "alias", 2: "rule"}


# ---- SQL, pipeline


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_says_the_same(spark, small, name):
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    df = queries.QUERIES[name](spark, small)
    r = c.execute(queries.ORACLES[name])
    cols = [x[0] for x in r.description]
    assert sorted(cols) == sorted(df.columns)
    assert Counter(tuple(x[c] for c in cols) for x in df.collect()) == Counter(r.fetchall())


def test_pipeline_against_brute_force(spark, small):
    docs = common.table(spark, small, "documents")
    rows = docs.collect()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "packing"]
    sizes = langid.Sizes(langid.dictionaries(docs))
    rows = [r for r in rows if sizes.language(r.text)[2]]
    gone = brute_groups([(r.doc_id, r.text) for r in rows])
    rows = [r for r in rows if r.doc_id not in gone]
    items = [r.text for r in common.table(spark, small, "benchmark").collect()]
    enc, want, now = common.Encoder(), {}, {}
    now = {r.doc_id: r.text for r in decontaminate.decontaminated(spark.createDataFrame(rows), common.table(spark, small, "benchmark")).collect()}
    for r in rows:
        n, total = cut_by_hand(r.text, items, decontaminate.N, 0.5)
        if n == 0:
            assert now[r.doc_id] == r.text
        assert (r.doc_id in now) == (n == 0 or n < 0.5 * total)
        if r.doc_id in now:
            assert cut_by_hand(now[r.doc_id], items, decontaminate.N, 0.5)[0] == 0
            want[r.doc_id] = enc.length(now[r.doc_id])
    got = corpus_pipeline.run(spark, small).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in got} == want


def test_stages_on_odd_input(spark, small):
    cols = "doc_id long, text string, lang string, source string, n_chars long"
    odd = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "the stone", "en", None, 9), (3, prose(1, 30_000), "en", "s", 1), (3, prose(1, 30_000), "en", "s", 1), (4, prose(2, 40), None, "s", None), (5, prose(2, 40), "de", "s", None)]
    for rows in (odd, []):
        df = spark.createDataFrame(rows, cols).withColumn("id", F.lit(1)).withColumn("h", F.lit("x"))
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, small)
            n = out.count()
            assert n <= max(len(rows), 0) or name == "packing"
            if name != "packing":
                assert out.columns == df.columns


def test_shared_folder(spark):
    assert common.shared_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir"))


def test_words_keep_offsets():
    t = "İX ǅ Straße"
    assert len(common.lowered(t)) == len(t)
    assert hashlib.md5(b"1").hexdigest()[:4] == "c4ca"
