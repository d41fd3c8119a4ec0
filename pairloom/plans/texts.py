"""Queries over texts: sentences, words, mentions, pairs, markers, verification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import spans as P
from ..functions import text as X
from ..functions.stats import index_quantiles
from ..operators import frames as FR
from ..operators import measures as M
from ..operators import pairs as J
from ..operators import shape as C
from ..operators import verify as V
from ..schema import LABELS, POSITIVE
from ..sources.store import scratch, written
from .views import DOCUMENTS, MARKED, MENTIONS, SENTENCES, SQUEEZE, digit, documents, marked_pairs, mentions_in, pieces, sentences, sql_digit, table

FRAME_NAMES = ("regimen", "denial", "incompatible", "sequential", "effect_pd", "effect_protect", "appositive", "contradictory", "title", "int")


def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents")


def text_measures(s: SparkSession, d: str) -> DataFrame:
    m = M.text_measures(documents(s, d).select("source", F.col("text").alias("plain")), ["source"])
    return m.select("source", "median_length", F.round("distinct_4", 9).alias("distinct_4"), F.round("opening_entropy", 6).alias("opening_entropy"))


def lexicon(s: SparkSession, d: str) -> DataFrame:
    """ASCII words of at least six letters of the benchmark: the names that mentions are made of."""
    w = table(s, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("w"))
    return w.where("length(w) >= 6").select(F.lower("w").alias("name")).distinct()


def mentions(s: SparkSession, d: str) -> DataFrame:
    en = pieces(s, d).where("lang = 'en'").select("doc_id", "s", F.regexp_replace("piece", r"\s", " ").alias("piece"))
    return J.token_mentions(en, lexicon(s, d))


def relations(pairs: DataFrame) -> DataFrame:
    """Relations, either way round, of the different names that stand together: those whose hash says so."""
    once = pairs.where("name1 <> name2").select("name1", "name2").distinct()
    both = once.unionByName(once.select(F.col("name2").alias("name1"), F.col("name1").alias("name2"))).distinct()
    h = digit(F.concat_ws("~", "name1", "name2"))
    return both.withColumn("no", h).where(h % 3 == 0).withColumn("label", F.element_at(F.array(*map(F.lit, POSITIVE)), (F.floor(h / 3) % 4 + 1).cast("int")))


def kept_mentions(s: SparkSession, d: str) -> DataFrame:
    """The mentions, written once where a query pairs them more than once."""
    return written(mentions(s, d), scratch(s))


def labelled(pairs: DataFrame, **how) -> DataFrame:
    return J.labelled_pairs(pairs, relations(pairs), **how)


def annotated(s: SparkSession, d: str) -> DataFrame:
    """The sentences of ``marked_pairs`` as annotated ones: its three mentions are entities, its labels relations, the second one's the other way round."""
    m = mentions_in(s, d)
    ent = F.transform("spans", lambda x, i: F.struct(F.concat(F.lit("T"), i.cast("string")).alias("id"), x["begin"].alias("begin"), x["end"].alias("end")))
    kind = lambda n: digit(F.concat_ws(":", "sent_id", F.lit(n))) % 10
    rel = lambda n, a, b: F.struct(F.lit(f"T{a}").alias("arg1"), F.lit(f"T{b}").alias("arg2"), F.when(kind(n) >= 6, F.element_at(F.array(*map(F.lit, LABELS)), F.greatest(kind(n) - 4, F.lit(1)).cast("int"))).alias("type"))
    rels = F.filter(F.array(rel(0, 0, 1), rel(1, 2, 0), rel(2, 1, 2)), lambda r: r["type"].isNotNull())
    return m.select("sent_id", F.lit("en").alias("register"), F.col("t").alias("text"), ent.alias("entities"), rels.alias("relations"))


def annotated_documents(s: SparkSession, d: str) -> DataFrame:
    """Documents with twelve entities of five characters each, where a rule of the id says, and relations of neighbours."""
    place = lambda k: (F.col("doc_id") * 7 + k * 31) % F.greatest(F.length("text") - 5, F.lit(1))
    ents = F.array(*(F.struct(F.lit(f"T{k}").alias("id"), place(k).cast("int").alias("begin"), (place(k) + 5).cast("int").alias("end")) for k in range(12)))
    rels = F.array(*(F.struct(F.lit(f"T{k}").alias("arg1"), F.lit(f"T{k + 1}").alias("arg2"), F.lit("INT").alias("type")) for k in range(11)))
    return _docs(s, d).select(F.col("doc_id").cast("string").alias("doc_id"), F.col("lang").alias("register"), "text", ents.alias("entities"), rels.alias("relations"))


def cut(s: SparkSession, d: str) -> DataFrame:
    sents = J.sentence_documents(annotated_documents(s, d))
    begins = F.aggregate("entities", F.lit(0), lambda acc, e: acc + e["begin"] * 1000 + e["end"])
    return sents.select("sent_id", "register", F.size("entities").alias("entities"), begins.alias("places"), F.size("relations").alias("relations")).where("entities > 0")


def judged(s: SparkSession, d: str) -> DataFrame:
    """Batches that came back, four in five of them whole, as rows."""
    b = written(V.verify_batches(marked_pairs(s, d)), scratch(s))
    last = F.size("pairs") - F.when(digit(F.concat(F.lit("w:"), "sent_id")) % 5 == 0, 2).otherwise(1)
    said = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("pair"), (digit(F.concat_ws(":", F.lit("x"), "sent_id", i.cast("string"))) % 3 == 0).alias("annotated")))
    raw = b.select("sent_id", F.to_json(F.struct(said.alias("verdicts"))).alias("sample"), F.lit(None).cast("string").alias("error"))
    return V.verdict_rows(raw, b).select("sent_id", "m1", "m2", "gold", "gold_pos", "flagged")


def closest(s: SparkSession, d: str) -> DataFrame:
    m = mentions(s, d)
    names = m.select("doc_id", "s", "name").distinct()
    rel = names.join(names.withColumnRenamed("name", "name2"), ["doc_id", "s"]).where("name < name2").select("doc_id", "s", F.lit(0).alias("no"), F.col("name").alias("name1"), "name2")
    return J.closest_mentions(rel, m)


def twins(s: SparkSession, d: str) -> DataFrame:
    """Rows and characters of the rows that can be masked, of the same masked, and of the rest, in one pass."""
    m = J.with_masked(marked_pairs(s, d)).select("label", F.length("text").alias("t"), F.length("masked").alias("m"))
    ok = F.col("m").isNotNull()
    parts = {"kept": (ok, "t"), "masked": (ok, "m"), "dropped": (~ok, "t")}
    sums = m.groupBy("label").agg(*(c.alias(f"{k}_{x}") for k, (which, what) in parts.items() for x, c in (("n", F.count_if(which)), ("chars", F.sum(F.when(which, F.col(what)))))))
    rows = sums.select("label", F.explode(F.array(*(F.struct(F.col(f"{k}_n").alias("n"), F.col(f"{k}_chars").alias("chars"), F.lit(k).alias("part")) for k in parts))).alias("p"))
    return rows.select("label", "p.*").where("n > 0")


def masked_all(s: SparkSession, d: str) -> DataFrame:
    m = mentions_in(s, d)
    a, b = F.col("spans")[0], F.col("spans")[2]
    text = P.masked(F.col("t"), a["begin"], a["end"], b["begin"], b["end"], F.col("spans"))
    return m.select("sent_id", F.md5(text).alias("digest"))


def verdicts(keyed: DataFrame) -> DataFrame:
    """A pair's verdict by hash, where there is one."""
    h = digit(F.concat_ws(":", F.lit("v"), "sent_id", "pair_no"))
    return keyed.where(h % 10 > 0).select("sent_id", "m1", "m2", (h % 4 == 0).alias("flagged"))


def aligned(s: SparkSession, d: str, words: bool = False) -> DataFrame:
    """The marked pairs with their verdicts: keys, labels and, where asked for, numbers of words, written once for both sides; texts stay behind."""
    more = {"words": V.text_length(F.col("text"))} if words else {}
    k = V.keyed(marked_pairs(s, d).withColumns(more)).select("sent_id", "pair_no", "label", *more, "m1", "m2")
    k = written(k, scratch(s))
    return V.with_verdicts(k, verdicts(k)).drop("m1", "m2")


def pruned(s: SparkSession, d: str) -> DataFrame:
    arms = V.pruning_arms(aligned(s, d), 9, "sent_id", "pair_no")
    return arms.groupBy("arm", "label").agg(F.count("*").alias("n"), F.sum("pair_no").cast("long").alias("pair_nos"))


def framed(s: SparkSession, d: str) -> DataFrame:
    """English sentences given to frames by hash."""
    en = pieces(s, d).where("lang = 'en'")
    key = F.concat_ws(":", "doc_id", "s")
    return en.select(key.alias("spec_index"), F.element_at(F.array(*map(F.lit, FRAME_NAMES)), (digit(key) % 10 + 1).cast("int")).alias("frame"), F.col("piece").alias("sentence"))


def shapes(s: SparkSession, d: str) -> DataFrame:
    """Sentences of all documents with as many entities as they have capitals, and positives by hash."""
    p = pieces(s, d)
    n = F.length(F.regexp_replace("piece", "[^A-Z]", ""))
    return p.select(F.concat_ws(":", "doc_id", "s").alias("sent_id"), F.col("lang").alias("register"), F.col("piece").alias("text"), n.alias("n_entities"), F.when(n >= 2, digit(F.concat_ws(":", "doc_id", "s")) % 2).otherwise(0).alias("n_positive"))


def structure(s: SparkSession, d: str) -> DataFrame:
    m = mentions_in(s, d)
    a, b = F.col("spans")[0], F.col("spans")[1]
    h = digit(F.col("sent_id"))
    p = m.select(P.between(F.col("t"), a["begin"], a["end"], b["begin"], b["end"]).alias("gap"), (h % 5 == 0).alias("group1"), (h % 7 == 0).alias("group2"), (h % 4).alias("degree1"), (h % 3).alias("degree2"), F.lit("NONE").alias("label"))
    return C.pair_structure(p)


def leaks(s: SparkSession, d: str, n: int = 8) -> DataFrame:
    """(doc_id, grams): distinct n-grams of a document's lower-case words that a benchmark item has too."""
    g = lambda df, *k: df.select(*k, F.explode(F.array_distinct(X.ngrams(X.words(F.lower("text")), n))).alias("g"))
    hit = g(_docs(s, d), "doc_id").join(g(table(s, d, "benchmark")).distinct(), "g", "left_semi")
    return hit.groupBy("doc_id").agg(F.count("*").alias("grams"))


def conversations_before(s: SparkSession, d: str) -> DataFrame:
    """Turns whose role's length class differs from that role's turn before in the conversation."""
    c = table(s, d, "conversations").select("conv_id", "turn", F.col("role").alias("name1"), F.col("role").alias("name2"), F.when(F.length("text") > 200, "long").otherwise("short").alias("label"))
    return J.conflicting_pairs(c, ("conv_id",), "turn").select("conv_id", "turn", "label", "before")


def first_turns(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "conversations")
    r = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return c.withColumn("r", r).where("r <= 2").select("conv_id", "turn", "role", "r")


QUERIES = {
    "text_measures_by_language": text_measures,
    "text_repeated_ngrams": lambda s, d: M.repeated_ngrams(_docs(s, d)),
    "text_top_ngrams": lambda s, d: M.top_values(M.gram_rows(_docs(s, d), X.words(F.lower("text")), 4), F.col("g"), 12),
    "text_top_openings": lambda s, d: M.top_values(_docs(s, d), X.opening(X.words(F.lower("text"))), 12),
    "text_degenerate": lambda s, d: _docs(s, d).where(X.degenerate(F.col("text"))).select("doc_id"),
    "text_normalised": lambda s, d: _docs(s, d).select("doc_id", F.md5(X.normalised(F.col("text"), unicode=False)).alias("digest")),
    "text_length_quantiles": lambda s, d: index_quantiles(_docs(s, d).select("lang", X.n_words(F.col("text")).alias("words")), "words", {"median": 0.5, "p90": 0.9, "most": 1.0}, ["lang"]),
    "text_length_by_label": lambda s, d: documents(s, d).groupBy("label").agg(F.median(X.n_words(F.col("text"))).alias("median_words"), F.count("*").alias("n")),
    "text_pattern_profile": lambda s, d: M.pattern_profile(_docs(s, d).where("lang = 'en'"), {"role": X.ROLE, "contrast": X.CONTRAST, "kinetics": X.KINETICS, "asserting": X.ASSERTING, "joint": X.JOINT, "the": X.any_of("the", "of")}),
    "text_joint_rate": lambda s, d: M.joint_rate(documents(s, d).where("source = 'en'")),
    "text_benchmark_ngrams": leaks,
    "sentences_with_offsets": lambda s, d: sentences(s, d).select("doc_id", "s", "begin", "end", F.md5("piece").alias("digest")),
    "mentions": mentions,
    "mentions_first": lambda s, d: J.first_mentions(mentions(s, d)).select("doc_id", "s", "name", "begin"),
    "mention_overlaps": lambda s, d: mentions(s, d).withColumn("before", F.lag("end").over(Window.partitionBy("doc_id", "s").orderBy("begin"))).where("before > begin").select("doc_id", "s", "begin"),
    "pairs_of_mentions": lambda s, d: J.mention_pairs(mentions(s, d)),
    "pairs_labelled": lambda s, d: labelled(J.mention_pairs(kept_mentions(s, d))).select("doc_id", "s", "ord1", "ord2", "label"),
    "pairs_one_way": lambda s, d: labelled(J.mention_pairs(kept_mentions(s, d)), one_way=True).groupBy("doc_id", "label").agg(F.count("*").alias("n"), F.sum("ord1").alias("ords")),
    "pairs_labelled_by_name": lambda s, d: labelled(J.mention_pairs(J.first_mentions(kept_mentions(s, d))), directed=False).where("name1 <> name2").select("doc_id", "s", "name1", "name2", "label"),
    "pairs_self_binds": lambda s, d: J.self_binds(J.mention_pairs(mentions(s, d))),
    "instances_markers": lambda s, d: J.pair_instances(annotated(s, d))[0].select("sent_id", "pair_no", "label", F.md5("text").alias("digest")),
    "instances_masked": lambda s, d: J.pair_instances(annotated(s, d), "mask_targets")[0].select("sent_id", "pair_no", "label", F.md5("text").alias("digest")),
    "instances_masked_all": lambda s, d: J.pair_instances(annotated(s, d), "mask_all")[0].select("sent_id", "pair_no", "label", F.md5("text").alias("digest")),
    "documents_cut": cut,
    "documents_cut_positive": lambda s, d: J.multi_entity(J.sentence_documents(annotated_documents(s, d)), 2, True).groupBy("register").agg(F.count("*").alias("n")),
    "documents_restricted": lambda s, d: J.restricted(_docs(s, d), table(s, d, "labels").where("quality = 1"), "doc_id").select("doc_id", "source"),
    "text_mechanism_profile": lambda s, d: M.pattern_profile(_docs(s, d), M.MECHANISM),
    "verify_verdict_rows": judged,
    "verify_siblings": lambda s, d: V.siblings(aligned(s, d)).groupBy("label", "flagged").agg(F.count("*").alias("n"), F.sum("no").cast("long").alias("nos")),
    "verify_flagged_described": lambda s, d: V.described(aligned(s, d, words=True).where("flagged")),
    "pairs_ordered": lambda s, d: J.ordered_pairs(mentions(s, d)).groupBy("doc_id").agg(F.count("*").alias("n")),
    "pairs_closest": closest,
    "pairs_conflicting": conversations_before,
    "first_rows_per_group": first_turns,
    "markers_rendered": lambda s, d: marked_pairs(s, d).select("sent_id", "pair_no", "label", F.md5("text").alias("digest")),
    "markers_masked_twins": twins,
    "markers_masked_all": masked_all,
    "markers_spans": lambda s, d: V.keyed(marked_pairs(s, d)).select("sent_id", "pair_no", F.col("spans")[0]["begin"].alias("b1"), F.col("spans")[0]["end"].alias("e1"), F.col("spans")[1]["begin"].alias("b2"), F.col("spans")[1]["end"].alias("e2"), "m1", "m2"),
    "role_adjacency": lambda s, d: M.role_adjacency(marked_pairs(s, d).withColumn("text", F.regexp_replace("text", r"\bthe\b", "later"))),
    "verify_batches": lambda s, d: V.verify_batches(marked_pairs(s, d)).select("sent_id", F.md5("text").alias("digest"), F.array_join(F.flatten("names"), " ").alias("names"), F.array_join("gold", " ").alias("gold"), "n_mentions"),
    "verify_prompts": lambda s, d: V.rendered(V.verify_batches(marked_pairs(s, d))).select("sent_id", F.md5("prompt").alias("digest")),
    "verify_flags": lambda s, d: V.flag_summary(aligned(s, d)),
    "verify_flag_concentration": lambda s, d: V.flag_concentration(aligned(s, d)),
    "prune_arms": pruned,
    "frames_report": lambda s, d: FR.frame_report(framed(s, d)).select("frame", "n", F.round("has_marker", 9).alias("has_marker"), F.round("breaks_avoid", 9).alias("breaks_avoid")),
    "shape_by_register": lambda s, d: C.sentence_shape(shapes(s, d)).drop("anaphora", "aforementioned"),
    "shape_entity_distribution": lambda s, d: C.entity_distribution(shapes(s, d), 2),
    "shape_largest_sentences": lambda s, d: C.largest_sentences(shapes(s, d)).select("sent_id", "n_entities", F.md5("text").alias("digest")),
    "shape_pair_structure": structure,
}

_LOW = SQUEEZE.format("lower(text)")
_WORDS = f"string_split({_LOW}, ' ')"
_GRAMS = "list_transform(range(1, len(w) - {k}), lambda i: array_to_string(w[i:i + {m}], ' '))"
_G4 = _GRAMS.format(k=2, m=3)
_LEX = "lex AS (SELECT DISTINCT lower(x) AS name FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+', 0)) AS x FROM benchmark) WHERE length(x) >= 6)"
_MENT = (
    SENTENCES
    + ", "
    + _LEX
    + r""", toks AS (SELECT doc_id, s, t[i] AS w, CASE WHEN i > 1 THEN list_sum(list_transform(t[1:i - 1], lambda x: length(x) + 1)) ELSE 0 END AS start
  FROM (SELECT doc_id, s, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT doc_id, s, string_split(regexp_replace(piece, '\s', ' ', 'g'), ' ') AS t FROM pieces WHERE lang = 'en'))),
found AS (SELECT doc_id, s, lower(regexp_extract(w, '[A-Za-z]+', 0)) AS name, CAST(start + instr(w, regexp_extract(w, '[A-Za-z]+', 0)) - 1 AS INTEGER) AS begin FROM toks WHERE regexp_extract(w, '[A-Za-z]+', 0) <> ''),
ment AS (SELECT doc_id, s, name, begin, CAST(begin + length(name) AS INTEGER) AS "end", CAST(row_number() OVER (PARTITION BY doc_id, s ORDER BY begin) AS INTEGER) AS ord FROM found WHERE name IN (SELECT name FROM lex))"""
)
_HASH = lambda a, b: sql_digit(f"{a} || '~' || {b}")
_KIND = lambda h: f"['ADVISE', 'EFFECT', 'INT', 'MECHANISM'][CAST({h} // 3 % 4 + 1 AS INTEGER)]"
_REL = lambda a, b: f"CASE WHEN {a} <> {b} AND {_HASH(a, b)} % 3 = 0 THEN {_KIND(_HASH(a, b))} END"
_PAIRS = 'pairs AS (SELECT doc_id, s, a.name AS name1, a.begin AS begin1, a."end" AS end1, a.ord AS ord1, b.name AS name2, b.begin AS begin2, b."end" AS end2, b.ord AS ord2 FROM {t} AS a JOIN {t} AS b USING (doc_id, s) WHERE a.ord < b.ord)'
_FIRST = "firsts AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, s, name ORDER BY begin) AS r FROM ment) WHERE r = 1)"
_POS = "CAST(length(list_aggregate(w[1:{k} - 1], 'string_agg', ' ')) + 1 AS INTEGER)"
_VERDICT = sql_digit("'v:' || sent_id || ':' || CAST(pair_no AS VARCHAR)")
_ALIGNED = MARKED + f", al AS (SELECT *, {_VERDICT} % 10 > 0 AS judged, ({_VERDICT} % 10 > 0 AND {_VERDICT} % 4 = 0 AND label = 'NONE') AS flagged FROM inst)"
_NUM = "array_to_string(list_transform(range(1, len(w) + 1), lambda i: w[i] || CASE WHEN i = 2 THEN '[1]' WHEN i = 4 THEN '[2]' WHEN i = 5 THEN '[3]' ELSE '' END), ' ')"
_GOLD = "gold AS (SELECT sent_id, string_agg(label, ' ' ORDER BY pair_no) AS gold FROM inst GROUP BY sent_id)"
_SHAPE = SENTENCES + f""", sh AS (SELECT *, CASE WHEN n_entities >= 2 THEN {sql_digit("sent_id")} % 2 ELSE 0 END AS n_positive FROM (SELECT CAST(doc_id AS VARCHAR) || ':' || CAST(s AS VARCHAR) AS sent_id, lang AS register, piece AS text, CAST(length(regexp_replace(piece, '[^A-Z]', '', 'g')) AS INTEGER) AS n_entities FROM pieces))"""


_CUT = (
    SENTENCES
    + """, ents AS (SELECT doc_id, k, (doc_id * 7 + k * 31) % greatest(length(text) - 5, 1) AS b FROM documents, (SELECT unnest(range(12)) AS k)),
ins AS (SELECT CAST('human:' || p.lang || ':' || CAST(p.doc_id AS VARCHAR) || ':s' || CAST(s AS VARCHAR) AS VARCHAR) AS sent_id, p.lang, k, b - (e - length(piece)) AS b, b + 5 - (e - length(piece)) AS z FROM pieces AS p JOIN ents USING (doc_id) WHERE b >= e - length(piece) AND b + 5 <= e),
cut AS (SELECT sent_id, lang, count(*) AS n, sum(b * 1000 + z) AS places, (SELECT count(*) FROM ins AS x JOIN ins AS y ON x.sent_id = y.sent_id AND y.k = x.k + 1 WHERE x.sent_id = i.sent_id) AS rels FROM ins AS i GROUP BY sent_id, lang)"""
)


def _q(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


def _frame_case(patterns: dict[str, str]) -> str:
    return "CASE frame " + " ".join(f"WHEN {_q(k)} THEN CASE WHEN regexp_matches(sentence, {_q(p)}) THEN 1.0::DOUBLE ELSE 0 END" for k, p in patterns.items()) + " END"


ORACLES = {
    "text_measures_by_language": f"""WITH {DOCUMENTS}, t AS (SELECT source, CASE WHEN {_LOW} = '' THEN [] ELSE {_WORDS} END AS w FROM docs),
l AS (SELECT source, median(len(w)) AS median_length FROM t GROUP BY source),
g AS (SELECT source, CAST(count(DISTINCT x) AS DOUBLE) / count(*) AS d4 FROM (SELECT source, unnest({_G4}) AS x FROM t) GROUP BY source),
o AS (SELECT source, -sum(p * log2(p)) AS e FROM (SELECT source, CAST(c AS DOUBLE) / sum(c) OVER (PARTITION BY source) AS p FROM (SELECT source, array_to_string(w[1:3], ' ') AS x, count(*) AS c FROM t GROUP BY 1, 2)) GROUP BY source)
SELECT source, median_length, round(coalesce(d4, 0), 9) AS distinct_4, abs(round(e, 6)) AS opening_entropy FROM l LEFT JOIN g USING (source) JOIN o USING (source)""",
    "text_repeated_ngrams": f"WITH t AS (SELECT {_WORDS} AS w FROM documents), c AS (SELECT x, count(*) AS c FROM (SELECT unnest({_G4}) AS x FROM t) GROUP BY x) SELECT CAST(count(*) AS DOUBLE) / sum(c) AS distinct_n, CAST(sum(CASE WHEN c > 1 THEN c ELSE 0 END) AS DOUBLE) / sum(c) AS repeated_mass FROM c",
    "text_top_ngrams": f"WITH t AS (SELECT {_WORDS} AS w FROM documents) SELECT x AS value, count(*) AS n FROM (SELECT unnest({_G4}) AS x FROM t) GROUP BY x ORDER BY n DESC, x LIMIT 12",
    "text_top_openings": f"SELECT array_to_string({_WORDS}[1:3], ' ') AS value, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, value LIMIT 12",
    "text_degenerate": f"""WITH t AS (SELECT doc_id, {_WORDS} AS w FROM documents), x AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM t WHERE len(w) >= 15),
runs AS (SELECT doc_id, max(c) AS m FROM (SELECT doc_id, count(*) AS c FROM (SELECT doc_id, w[i] AS v, i - row_number() OVER (PARTITION BY doc_id, w[i] ORDER BY i) AS g FROM x) GROUP BY doc_id, v, g) GROUP BY doc_id)
SELECT doc_id FROM t JOIN runs USING (doc_id) WHERE m > 6 OR CAST(len(list_distinct(w)) AS DOUBLE) / len(w) < 0.3""",
    "text_normalised": "SELECT doc_id, md5(trim(regexp_replace(replace(replace(translate(text, chr(8208) || chr(8209) || chr(8210) || chr(8211) || chr(8212) || chr(8216) || chr(8217) || chr(8220) || chr(8221) || chr(160) || chr(8201) || chr(8239) || chr(8203), '-----''''\"\"   '), '**', ''), '__', ''), '\\s+', ' ', 'g'))) AS digest FROM documents",
    "text_length_quantiles": f"WITH t AS (SELECT lang, CAST(CASE WHEN {SQUEEZE.format('text')} = '' THEN 0 ELSE len(string_split({SQUEEZE.format('text')}, ' ')) END AS INTEGER) AS n FROM documents), s AS (SELECT lang, list_sort(list(n)) AS l FROM t GROUP BY lang) SELECT lang, l[1 + least(len(l) - 1, CAST(floor(len(l) * 0.5::DOUBLE) AS BIGINT))] AS median, l[1 + least(len(l) - 1, CAST(floor(len(l) * 0.9::DOUBLE) AS BIGINT))] AS p90, l[len(l)] AS most FROM s",
    "text_length_by_label": f"WITH {DOCUMENTS} SELECT label, median(CASE WHEN {SQUEEZE.format('text')} = '' THEN 0 ELSE len(string_split({SQUEEZE.format('text')}, ' ')) END) AS median_words, count(*) AS n FROM docs GROUP BY label",
    "text_pattern_profile": "SELECT count(*) AS n, " + ", ".join(f"avg(CASE WHEN regexp_matches(text, {_q(p)}) THEN 1.0::DOUBLE ELSE 0 END) AS {k}" for k, p in {"role": X.ROLE, "contrast": X.CONTRAST, "kinetics": X.KINETICS, "asserting": X.ASSERTING, "joint": X.JOINT, "the": X.any_of("the", "of")}.items()) + " FROM documents WHERE lang = 'en'",
    "text_joint_rate": f"WITH {DOCUMENTS} SELECT count(*) AS n, coalesce(avg(CASE WHEN regexp_matches(text, {_q(X.JOINT)}) THEN 1.0::DOUBLE ELSE 0 END), 0) AS joint_rate FROM docs WHERE source = 'en' AND label = 'NONE'",
    "text_benchmark_ngrams": f"WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT {_WORDS} AS w FROM benchmark), g AS (SELECT DISTINCT doc_id, unnest({_GRAMS.format(k=6, m=7)}) AS x FROM d) SELECT doc_id, count(*) AS grams FROM g WHERE x IN (SELECT unnest({_GRAMS.format(k=6, m=7)}) FROM b) GROUP BY doc_id",
    "sentences_with_offsets": f'WITH {SENTENCES} SELECT doc_id, CAST(s AS INTEGER) AS s, CAST(e - length(piece) AS INTEGER) AS begin, CAST(e AS INTEGER) AS "end", md5(piece) AS digest FROM pieces',
    "mentions": f'WITH {_MENT} SELECT doc_id, CAST(s AS INTEGER) AS s, name, begin, "end", ord FROM ment',
    "mentions_first": f"WITH {_MENT}, {_FIRST} SELECT doc_id, CAST(s AS INTEGER) AS s, name, begin FROM firsts",
    "mention_overlaps": f'WITH {_MENT} SELECT doc_id, CAST(s AS INTEGER) AS s, begin FROM (SELECT *, lag("end") OVER (PARTITION BY doc_id, s ORDER BY begin) AS before FROM ment) WHERE before > begin',
    "pairs_of_mentions": f"WITH {_MENT}, {_PAIRS.format(t='ment')} SELECT doc_id, CAST(s AS INTEGER) AS s, name1, begin1, end1, ord1, name2, begin2, end2, ord2 FROM pairs",
    "pairs_labelled": f"WITH {_MENT}, {_PAIRS.format(t='ment')} SELECT doc_id, CAST(s AS INTEGER) AS s, ord1, ord2, coalesce({_REL('name1', 'name2')}, {_REL('name2', 'name1')}, 'NONE') AS label FROM pairs",
    "pairs_one_way": f"WITH {_MENT}, {_PAIRS.format(t='ment')} SELECT doc_id, coalesce({_REL('name1', 'name2')}, 'NONE') AS label, count(*) AS n, CAST(sum(ord1) AS BIGINT) AS ords FROM pairs GROUP BY 1, 2",
    "pairs_labelled_by_name": f"""WITH {_MENT}, {_FIRST}, {_PAIRS.format(t='firsts')}, h AS (SELECT *, {_HASH('name1', 'name2')} AS f, {_HASH('name2', 'name1')} AS b FROM pairs)
SELECT doc_id, CAST(s AS INTEGER) AS s, name1, name2, CASE WHEN f % 3 = 0 AND (b % 3 <> 0 OR f > b) THEN {_KIND('f')} WHEN b % 3 = 0 THEN {_KIND('b')} ELSE 'NONE' END AS label FROM h WHERE name1 <> name2""",
    "pairs_self_binds": f"WITH {_MENT}, {_PAIRS.format(t='ment')} SELECT count(*) AS n FROM pairs WHERE name1 = name2",
    "instances_markers": f"WITH {MARKED} SELECT sent_id, CAST(pair_no AS INTEGER) AS pair_no, label, md5(text) AS digest FROM inst",
    "instances_masked": f"""WITH {MARKED} SELECT sent_id, CAST(pair_no AS INTEGER) AS pair_no, label, md5(regexp_replace(regexp_replace(text, '(?s)\\[E1\\].*?\\[/E1\\]', 'drug1', 'g'), '(?s)\\[E2\\].*?\\[/E2\\]', 'drug2', 'g')) AS digest FROM inst""",
    "instances_masked_all": f"WITH {MARKED} SELECT inst.sent_id, CAST(inst.pair_no AS INTEGER) AS pair_no, label, md5(array_to_string(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN i = a THEN 'drug1' WHEN i = b THEN 'drug2' WHEN i IN (2, 4, 5) THEN 'drug0' ELSE w[i] END), ' ')) AS digest FROM inst JOIN ments ON inst.sent_id = ments.sent_id JOIN (VALUES (0, 2, 4), (1, 2, 5), (2, 4, 5)) AS v(n, a, b) ON inst.pair_no = v.n",
    "documents_cut": f"WITH {_CUT} SELECT sent_id, lang AS register, CAST(n AS INTEGER) AS entities, CAST(places AS INTEGER) AS places, CAST(rels AS INTEGER) AS relations FROM cut",
    "documents_cut_positive": f"WITH {_CUT} SELECT lang AS register, count(*) AS n FROM cut WHERE n >= 2 AND rels > 0 GROUP BY lang",
    "documents_restricted": "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "text_mechanism_profile": "SELECT count(*) AS n, " + ", ".join(f"avg(CASE WHEN regexp_matches(text, {_q(x)}) THEN 1.0::DOUBLE ELSE 0 END) AS {k}" for k, x in M.MECHANISM.items()) + " FROM documents",
    "verify_verdict_rows": f"""WITH {MARKED} SELECT sent_id, CAST(x AS INTEGER) AS m1, CAST(y AS INTEGER) AS m2, label AS gold, label <> 'NONE' AS gold_pos, {sql_digit("'x:' || sent_id || ':' || CAST(pair_no AS VARCHAR)")} % 3 = 0 AS flagged
FROM inst JOIN (VALUES (0, 1, 2), (1, 1, 3), (2, 2, 3)) AS v(n, x, y) ON pair_no = n WHERE {sql_digit("'w:' || sent_id")} % 5 <> 0""",
    "verify_siblings": f"WITH {_ALIGNED} SELECT b.label, b.flagged, count(*) AS n, CAST(sum(b.pair_no) AS BIGINT) AS nos FROM al AS a JOIN al AS b USING (sent_id) WHERE a.flagged AND b.judged GROUP BY 1, 2",
    "verify_flagged_described": f"WITH {_ALIGNED}, f AS (SELECT al.sent_id, len(w) AS n FROM al JOIN ments ON al.sent_id = ments.sent_id WHERE flagged), l AS (SELECT list_sort(list(n)) AS l, count(*) AS n, count(DISTINCT sent_id) AS sentences FROM f) SELECT n, sentences, CAST(l[1 + n // 2] AS INTEGER) AS median_length, CAST(n AS DOUBLE) / sentences AS per_sentence FROM l",
    "pairs_ordered": f"WITH {_MENT} SELECT doc_id, count(*) AS n FROM ment AS a JOIN ment AS b USING (doc_id, s) WHERE a.ord <> b.ord GROUP BY doc_id",
    "pairs_closest": f"WITH {_MENT}, both_m AS (SELECT doc_id, s, a.name AS name1, b.name AS name2, a.begin AS begin1, b.begin AS begin2, row_number() OVER (PARTITION BY doc_id, s, a.name, b.name ORDER BY abs(a.begin - b.begin), a.ord, b.ord) AS r FROM ment AS a JOIN ment AS b USING (doc_id, s) WHERE a.name < b.name) SELECT doc_id, CAST(s AS INTEGER) AS s, CAST(0 AS INTEGER) AS no, name1, name2, begin1, begin2 FROM both_m WHERE r = 1",
    "pairs_conflicting": "WITH c AS (SELECT conv_id, turn, role, CASE WHEN length(text) > 200 THEN 'long' ELSE 'short' END AS label FROM conversations) SELECT conv_id, turn, label, before FROM (SELECT *, lag(label) OVER (PARTITION BY conv_id, role ORDER BY turn) AS before FROM c) WHERE before <> label",
    "first_rows_per_group": "SELECT conv_id, turn, role, CAST(r AS INTEGER) AS r FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) WHERE r <= 2",
    "markers_rendered": f"WITH {MARKED} SELECT sent_id, CAST(pair_no AS INTEGER) AS pair_no, label, md5(text) AS digest FROM inst",
    "markers_masked_twins": f"""WITH {MARKED}, m AS (SELECT label, text, regexp_replace(regexp_replace(text, '(?s)\\[E1\\].*?\\[/E1\\]', 'drug1', 'g'), '(?s)\\[E2\\].*?\\[/E2\\]', 'drug2', 'g') AS masked FROM inst)
SELECT label, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, 'kept' AS part FROM m GROUP BY label UNION ALL SELECT label, count(*), CAST(sum(length(masked)) AS BIGINT), 'masked' FROM m GROUP BY label""",
    "markers_masked_all": f"WITH {MENTIONS} SELECT sent_id, md5(array_to_string(list_transform(range(1, len(w) + 1), lambda i: CASE i WHEN 2 THEN 'drug1' WHEN 5 THEN 'drug2' WHEN 4 THEN 'drug0' ELSE w[i] END), ' ')) AS digest FROM ments",
    "markers_spans": f"""WITH {MARKED}, p AS (SELECT sent_id, n AS pair_no, {_POS.format(k="a")} AS b1, CAST({_POS.format(k="a")} + length(w[a]) AS INTEGER) AS e1, {_POS.format(k="b")} AS b2, CAST({_POS.format(k="b")} + length(w[b]) AS INTEGER) AS e2, x AS m1, y AS m2 FROM ments, (VALUES (0, 2, 4, 1, 2), (1, 2, 5, 1, 3), (2, 4, 5, 2, 3)) AS v(n, a, b, x, y))
SELECT sent_id, CAST(pair_no AS INTEGER) AS pair_no, b1, e1, b2, e2, CAST(m1 AS INTEGER) AS m1, CAST(m2 AS INTEGER) AS m2 FROM p""",
    "role_adjacency": f"""WITH {MARKED}, t AS (SELECT label <> 'NONE' AS pos, regexp_replace(text, '\\bthe\\b', 'later', 'g') AS text FROM inst),
n AS (SELECT pos, text[greatest(1, instr(text, '[E1]') - 60):instr(text, '[/E1]') + 4 + 60] || ' ' || text[greatest(1, instr(text, '[E2]') - 60):instr(text, '[/E2]') + 4 + 60] AS near FROM t),
c AS (SELECT count(*) FILTER (pos) AS n_pos, count(*) FILTER (NOT pos) AS n_none, count(*) FILTER (pos AND regexp_matches(near, {_q(X.ROLE)})) AS pos_hits, count(*) FILTER (NOT pos AND regexp_matches(near, {_q(X.ROLE)})) AS none_hits FROM n),
r AS (SELECT *, CAST(pos_hits AS DOUBLE) / n_pos AS pos_rate, CAST(none_hits AS DOUBLE) / n_none AS none_rate FROM c)
SELECT *, none_rate - pos_rate AS gap, CASE WHEN pos_rate > 0 THEN none_rate / pos_rate END AS ratio FROM r""",
    "verify_batches": f"WITH {MARKED}, {_GOLD} SELECT sent_id, md5({_NUM}) AS digest, concat_ws(' ', w[2], w[4], w[2], w[5], w[4], w[5]) AS names, gold, CAST(3 AS INTEGER) AS n_mentions FROM ments JOIN gold USING (sent_id)",
    "verify_prompts": f"WITH {MENTIONS} SELECT sent_id, md5({_NUM} || chr(10) || chr(10) || 'pairs:' || chr(10) || '  0. mention 1 (' || w[2] || ')  and  mention 2 (' || w[4] || ')' || chr(10) || '  1. mention 1 (' || w[2] || ')  and  mention 3 (' || w[5] || ')' || chr(10) || '  2. mention 2 (' || w[4] || ')  and  mention 3 (' || w[5] || ')') AS digest FROM ments",
    "verify_flags": f"WITH {_ALIGNED} SELECT count(*) AS n, count(*) FILTER (judged) AS judged, count(*) FILTER (NOT judged) AS unjudged, count(*) FILTER (flagged) AS flagged, CAST(count(*) FILTER (flagged) AS DOUBLE) / greatest(count(*) FILTER (judged AND label = 'NONE'), 1) AS flag_rate FROM al",
    "verify_flag_concentration": f"WITH {_ALIGNED}, g AS (SELECT sent_id, count(*) FILTER (flagged) AS f, count(*) FILTER (label = 'NONE') AS n FROM al WHERE judged GROUP BY sent_id) SELECT count(*) AS sentences, median(CAST(f AS DOUBLE) / n) AS median_share, count(*) FILTER (f = n) AS all_flagged FROM g WHERE f > 0",
    "prune_arms": f"""WITH {_ALIGNED}, rnd AS (SELECT sent_id, pair_no, row_number() OVER (ORDER BY md5('9:' || sent_id || ':' || pair_no), sent_id, pair_no) AS r FROM al WHERE judged AND label = 'NONE'),
gone AS (SELECT sent_id, pair_no FROM rnd WHERE r <= (SELECT count(*) FROM al WHERE flagged)),
arms AS (SELECT 'judged' AS arm, label, pair_no FROM al WHERE judged UNION ALL SELECT 'judged-pruned', label, pair_no FROM al WHERE judged AND NOT flagged UNION ALL SELECT 'judged-randprune', label, pair_no FROM al ANTI JOIN gone USING (sent_id, pair_no) WHERE judged)
SELECT arm, label, count(*) AS n, CAST(sum(pair_no) AS BIGINT) AS pair_nos FROM arms GROUP BY arm, label""",
    "frames_report": f"""WITH {SENTENCES}, f AS (SELECT [{', '.join(map(_q, FRAME_NAMES))}][CAST({sql_digit("CAST(doc_id AS VARCHAR) || ':' || CAST(s AS VARCHAR)")} % 10 + 1 AS INTEGER)] AS frame, piece AS sentence FROM pieces WHERE lang = 'en')
SELECT frame, count(*) AS n, round(avg({_frame_case(X.MUST)}), 9) AS has_marker, round(avg({_frame_case(X.MUST_NOT)}), 9) AS breaks_avoid FROM f GROUP BY frame""",
    "shape_by_register": f"""WITH {_SHAPE}, c AS (SELECT register, count(*) AS sentences, CAST(sum(n_entities * (n_entities - 1) // 2) AS BIGINT) AS pairs, CAST(sum(n_positive) AS BIGINT) AS positives, count(*) FILTER (n_entities >= 2) AS multi, count(*) FILTER (n_entities >= 2 AND n_positive = 0) AS multi_without_positive FROM sh GROUP BY register)
SELECT *, CASE WHEN pairs > 0 THEN CAST(positives AS DOUBLE) / pairs ELSE 0 END AS positive_rate, CASE WHEN multi > 0 THEN CAST(pairs AS DOUBLE) / multi ELSE 0 END AS pairs_per_multi_sentence FROM c""",
    "shape_entity_distribution": f"WITH {_SHAPE}, c AS (SELECT n_entities, count(*) AS sentences FROM sh WHERE n_entities >= 2 GROUP BY n_entities) SELECT n_entities, sentences, CAST(sentences AS DOUBLE) / sum(sentences) OVER () AS share FROM c",
    "shape_largest_sentences": f"WITH {_SHAPE} SELECT sent_id, n_entities, md5(left(text, 400)) AS digest FROM sh ORDER BY n_entities DESC, sent_id LIMIT 40",
    "shape_pair_structure": f"""WITH {MENTIONS}, g AS (SELECT {sql_digit("sent_id")} AS h, ' ' || w[3] || ' ' AS gap FROM ments),
f AS (SELECT CASE WHEN h % 4 >= 2 OR h % 3 >= 2 THEN 'hub' WHEN (h % 5 = 0) <> (h % 7 = 0) THEN 'group_member' WHEN regexp_matches(trim(gap), {_q(X.COORDINATION)}) THEN 'coordination' WHEN regexp_matches(gap, {_q(X.CONTRAST)}) THEN 'contrast' ELSE 'incidental' END AS "primary" FROM g)
SELECT "primary", 'NONE' AS label, count(*) AS n, CAST(1 AS DOUBLE) AS median_gap FROM f GROUP BY 1""",
}
