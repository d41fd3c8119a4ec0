"""Queries over logs, vocabularies and generation requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lexicon as L
from ..operators import resolve as G
from ..operators import specs as S
from ..operators.frames import error_count
from ..operators.pairs import batches, listing
from ..operators.probe import probe
from ..sources.store import load_dataset, manifests, read_rejects, scratch, write_dataset, write_rejects
from ..streaming import ingest as I
from .views import DOCUMENTS, digit, documents, sql_digit, table


def raw(s: SparkSession, d: str) -> DataFrame:
    """The events as a raw log: each user has requests, some attempts are errors."""
    return to_raw(table(s, d, "events"))


def to_raw(e: DataFrame) -> DataFrame:
    bad = F.col("event_id") % 5 == 0
    reason = F.concat(F.lit("drug not found in text "), (F.col("event_id") % 3).cast("string"), F.lit(": "), F.col("event_type"))
    return e.select(F.col("user_id").alias("spec_index"), F.lit("{}").alias("spec"), F.when(~bad, F.col("props")).alias("sample"), F.when(bad, reason).alias("error"))


RAW = "raw AS (SELECT user_id AS spec_index, CASE WHEN event_id % 5 <> 0 THEN props END AS sample, CASE WHEN event_id % 5 = 0 THEN 'drug not found in text ' || (event_id % 3) || ': ' || event_type END AS error FROM events)"


def streamed(s: SparkSession, d: str) -> DataFrame:
    """The events followed as a stream of files into successes, once each."""
    at = scratch(s)
    schema = table(s, d, "events").schema
    I.stream_successes(s, f"{d}/events*.parquet", schema, to_raw, f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return s.read.parquet(f"{at}/out").select("spec_index").distinct()


def names(s: SparkSession, d: str) -> DataFrame:
    """Names of parts and customers with a code: a vocabulary's raw form."""
    p = table(s, d, "part").select(F.concat(F.lit("A"), F.lpad(F.col("p_size").cast("string"), 6, "0")).alias("atc_code"), F.col("p_name").alias("atc_name"))
    q = table(s, d, "part").select(F.substring(F.upper("p_brand"), 1, 5).alias("atc_code"), F.upper(F.regexp_replace("p_type", "[0-9]", "")).alias("atc_name"))
    return p.unionByName(q)


def vocabulary(s: SparkSession, d: str) -> DataFrame:
    c = L.classified_names(names(s, d), unicode=False)
    return L.vocabulary(c.where("kind = 'drug'").select("name"), c.where("kind = 'group'").select("name"))


def plain_vocabulary(s: SparkSession, d: str) -> DataFrame:
    """Benchmark words as names: long ones drugs, short ones groups."""
    w = table(s, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("name")).where("length(name) >= 4")
    return L.vocabulary(w.where("length(name) >= 7").select(F.lower("name").alias("name")), w.where("length(name) < 7").select(F.upper("name").alias("name")))


def flags(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "documents").where("lang = 'en'").select("doc_id", L.clean_name(F.col("text"), unicode=False).alias("name"))
    return n.select("doc_id", L.bad_name(F.col("name")).alias("bad"), L.bad_group(F.col("name")).alias("bad_group"), L.bad_drug(F.col("name")).alias("bad_drug"), L.unusable(F.col("name")).alias("unusable"))


def made_specs(s: SparkSession, d: str) -> DataFrame:
    return S.specs(s, 400, plain_vocabulary(s, d), 3)


def probed(s: SparkSession, d: str) -> DataFrame:
    """The probe on English documents: label given away by words?"""
    p = probe(documents(s, d).where("source = 'en'"))
    return s.createDataFrame([(float(p["lift"]), float(p["f1"]), float(p["baseline"]))], "lift double, f1 double, baseline double")


def resolved(s: SparkSession, d: str) -> DataFrame:
    """Generated sentences made from requests, resolved to instances, counted by label."""
    specs = made_specs(s, d).where("complete")
    sentence = F.concat(F.lit("Study of "), F.array_join(F.transform("entities", lambda e: e["surface"]), " with "), F.lit("."))
    rows = specs.select("spec_index", F.to_json(F.struct("register", "entities", "positives")).alias("spec"), F.to_json(F.struct(sentence.alias("sentence"))).alias("sample"), F.lit(None).cast("string").alias("error"))
    inst, rejects = G.resolved(rows, "g")
    return inst.groupBy("label").agg(F.count("*").alias("n")).unionByName(G.reason_counts(rejects).select(F.concat(F.lit("rejected: "), "reason").alias("label"), "n"))


def rejects_read(s: SparkSession, d: str) -> DataFrame:
    """The log's errors as rejects, written and read again."""
    at = scratch(s)
    write_rejects(raw(s, d).where("error IS NOT NULL").select("spec_index", F.lit("s").alias("sent_id"), F.col("error").alias("reason")), at)
    return read_rejects(s, at).groupBy("spec_index").agg(F.count("*").alias("n"), F.max("reason").alias("reason"))


def round_trip(s: SparkSession, d: str) -> DataFrame:
    """Documents as a dataset, written with its manifest and loaded by its id with the digest verified."""
    root = scratch(s)
    made = write_dataset(documents(s, d).select("text", "label", "source", "sent_id", F.col("pair_no").cast("int").alias("pair_no")), root, "human")
    m = manifests(s, root).select(F.col("size.n_instances").alias("n_instances"), F.col("size.n_sentences").alias("n_sentences"))
    return load_dataset(s, root, made).groupBy("label").agg(F.count("*").alias("n")).crossJoin(m)


_HEAD = "spec_index AS i FROM range(2000) AS t(spec_index)"


def _u(what: str, i: str = "CAST(spec_index AS VARCHAR)") -> str:
    return f"{sql_digit(chr(39) + '3:' + what + ':' + chr(39) + ' || ' + i)} / 4294967296.0::DOUBLE"


def _pick(dist: dict[str, float], u: str) -> str:
    import math

    total, at, out = math.fsum(dist.values()), 0.0, "CASE"
    for k, w in dist.items():
        at += w / total
        out += f" WHEN {u} < {at!r}::DOUBLE THEN '{k}'"
    return out + f" ELSE '{list(dist)[-1]}' END"


QUERIES = {
    "log_counts": lambda s, d: I.log_counts(raw(s, d)),
    "log_todo": lambda s, d: I.todo(table(s, d, "customer").select(F.col("c_custkey").alias("spec_index")), raw(s, d)),
    "log_effective": lambda s, d: I.effective(raw(s, d)).select("spec_index", F.col("error").isNull().alias("ok")),
    "log_successes": lambda s, d: G.successes(raw(s, d)).select("spec_index", "sample"),
    "log_reason_counts": lambda s, d: G.reason_counts(raw(s, d).where("error IS NOT NULL").withColumnRenamed("error", "reason")),
    "log_streamed_successes": streamed,
    "names_flags": flags,
    "names_classified": lambda s, d: L.classified_names(names(s, d), unicode=False).groupBy("kind", "name").agg(F.count("*").alias("n")),
    "names_vocabulary": plain_vocabulary,
    "names_fingerprint": lambda s, d: L.fingerprint(plain_vocabulary(s, d), ["a", "b"], 0.3),
    "names_drawn": lambda s, d: L.drawn_names(table(s, d, "orders").select("o_orderkey"), plain_vocabulary(s, d), 5, 0.3, "o_orderkey"),
    "names_batched": lambda s, d: batches(plain_vocabulary(s, d).where("kind = 'drug'"), F.col("name"), 100, "name").select("batch", F.array_join("values", "|").alias("names")),
    "names_listed": lambda s, d: batches(plain_vocabulary(s, d).where("kind = 'drug'"), F.col("name"), 100, "name").select("batch", listing(F.col("values")).alias("names")),
    "log_error_count": lambda s, d: error_count(raw(s, d)),
    "log_rejects_read": rejects_read,
    "dataset_round_trip": round_trip,
    "specs_heads": lambda s, d: S.spec_heads(s, 2000, 3).select("spec_index", "register", "frame", "kind", "k", "has_scene", "n_axes"),
    "specs_whole": made_specs,
    "resolve_generated": resolved,
    "probe_shortcut": probed,
}

_BW = "regexp_extract_all(text, '[A-Za-z]+', 0)"
_VOC = f"""w AS (SELECT unnest({_BW}) AS name FROM benchmark), v AS (SELECT DISTINCT * FROM (SELECT 'drug' AS kind, lower(name) AS name FROM w WHERE length(name) >= 7 UNION ALL SELECT 'group', upper(name) FROM w WHERE length(name) BETWEEN 4 AND 6)),
voc AS (SELECT kind, name, CAST(row_number() OVER (PARTITION BY kind ORDER BY name) - 1 AS INTEGER) AS pos FROM v)"""
_NQ = lambda p: "'" + p.replace("'", "''") + "'"
_CLEAN = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
_WC = "len(string_split({n}, ' '))"
_BAD = "(lower(trim({n})) IN ('', 'combinations', 'combinations, other', 'na', 'other', 'various') OR {w} > 6 OR (length(regexp_replace({n}, '[^0-9]', '', 'g')) > 0 AND regexp_matches({n}, '[-/]')) OR length(regexp_replace({n}, '[^0-9]', '', 'g')) >= 2 OR length(regexp_replace({n}, '[^-]', '', 'g')) >= 3)"


def _bad(n: str) -> str:
    return _BAD.format(n=n, w=_WC.format(n=n))


def _bad_group(n: str) -> str:
    return f"({_bad(n)} OR {_WC.format(n=n)} > 3 OR contains({n}, ',') OR regexp_matches({n}, {_NQ(L.ADMIN)}))"


def _bad_drug(n: str) -> str:
    return f"({_bad(n)} OR {_WC.format(n=n)} > 4 OR contains({n}, ',') OR regexp_matches({n}, {_NQ(L.ADMIN)}) OR regexp_matches({n}, {_NQ(L.NOT_DRUG)}))"


ORACLES = {
    "log_counts": f"WITH {RAW} SELECT count(*) AS attempts, count(*) FILTER (NOT (error IS NULL OR error = '')) AS errors, count(DISTINCT spec_index) AS indices, count(DISTINCT spec_index) FILTER (error IS NULL OR error = '') AS succeeded FROM raw",
    "log_todo": f"WITH {RAW} SELECT c_custkey AS spec_index FROM customer WHERE c_custkey NOT IN (SELECT spec_index FROM raw WHERE error IS NULL OR error = '')",
    "log_effective": f"WITH {RAW} SELECT spec_index, bool_or(error IS NULL OR error = '') AS ok FROM raw GROUP BY spec_index",
    "log_successes": f"WITH {RAW} SELECT spec_index, sample FROM raw WHERE (error IS NULL OR error = '') AND sample IS NOT NULL AND sample NOT IN ('', '{{}}', 'null')",
    "log_reason_counts": f"WITH {RAW} SELECT left(string_split(string_split(error, ':')[1], ' not found')[1], 60) AS reason, count(*) AS n FROM raw WHERE error IS NOT NULL GROUP BY 1",
    "log_streamed_successes": f"WITH {RAW} SELECT DISTINCT spec_index FROM raw WHERE error IS NULL OR error = ''",
    "names_flags": f"WITH n AS (SELECT doc_id, {_CLEAN.format('text')} AS name FROM documents WHERE lang = 'en') SELECT doc_id, {_bad('name')} AS bad, {_bad_group('name')} AS bad_group, {_bad_drug('name')} AS bad_drug, (contains(lower(name), ' and ') OR contains(name, '/')) AS unusable FROM n",
    "names_classified": f"""WITH n AS (SELECT 7 AS k, {_CLEAN.format('p_name')} AS name FROM part UNION ALL SELECT length(substr(upper(p_brand), 1, 5)), {_CLEAN.format("upper(regexp_replace(p_type, '[0-9]', '', 'g'))")} FROM part),
t AS (SELECT k, CASE WHEN k >= 7 OR upper(name) <> name OR lower(name) = name THEN name ELSE array_to_string(list_transform(string_split(lower(name), ' '), lambda x: upper(x[1:1]) || x[2:]), ' ') END AS name FROM n)
SELECT CASE WHEN k >= 7 THEN 'drug' ELSE 'group' END AS kind, name, count(*) AS n FROM t WHERE (k >= 7 AND NOT {_bad_drug("name")}) OR (k IN (4, 5) AND NOT {_bad_group("name")}) GROUP BY 1, 2""",
    "names_vocabulary": f"WITH {_VOC} SELECT kind, name, pos FROM voc",
    "names_fingerprint": f"WITH {_VOC} SELECT count(*) FILTER (kind = 'drug') AS n_drugs, count(*) FILTER (kind = 'group') AS n_groups, left(sha256('a|bp_group=0.3' || string_agg(name, chr(10) ORDER BY name) FILTER (kind = 'drug') || string_agg(name, chr(10) ORDER BY name) FILTER (kind = 'group')), 12) AS sha256 FROM voc",
    "names_drawn": f"""WITH {_VOC}, s AS (SELECT o_orderkey, CASE WHEN {sql_digit("'5:kind:' || CAST(o_orderkey AS VARCHAR)")} / 4294967296.0::DOUBLE < 0.3 THEN 'group' ELSE 'drug' END AS kind, {sql_digit("'5:name:' || CAST(o_orderkey AS VARCHAR)")} / 4294967296.0::DOUBLE AS u FROM orders),
p AS (SELECT o_orderkey, kind, CAST(floor(u * (SELECT count(*) FROM voc WHERE voc.kind = s.kind)) AS INTEGER) AS pos FROM s) SELECT o_orderkey, kind, name FROM p LEFT JOIN voc USING (kind, pos)""",
    "names_batched": f"WITH {_VOC}, b AS (SELECT name, (row_number() OVER (ORDER BY name) - 1) // 100 AS batch FROM voc WHERE kind = 'drug') SELECT batch, string_agg(name, '|' ORDER BY name) AS names FROM b GROUP BY batch",
    "names_listed": f"WITH {_VOC}, b AS (SELECT name, (row_number() OVER (ORDER BY name) - 1) AS i FROM voc WHERE kind = 'drug') SELECT i // 100 AS batch, string_agg(CAST(i % 100 AS VARCHAR) || '. ' || name, chr(10) ORDER BY name) AS names FROM b GROUP BY 1",
    "log_error_count": f"WITH {RAW} SELECT count(*) AS n, count(*) FILTER (coalesce(error, '') <> '' OR coalesce(sample, '') IN ('', '{{}}', 'null')) AS errors FROM raw",
    "log_rejects_read": f"WITH {RAW} SELECT spec_index, count(*) AS n, max(error) AS reason FROM raw WHERE error IS NOT NULL GROUP BY spec_index",
    "dataset_round_trip": f"WITH {DOCUMENTS} SELECT label, count(*) AS n, (SELECT count(*) FROM docs) AS n_instances, (SELECT count(DISTINCT sent_id) FROM docs) AS n_sentences FROM docs GROUP BY label",
    "specs_heads": f"""WITH h AS (SELECT range AS spec_index, {_pick(S.REGISTERS, _u("register", "CAST(range AS VARCHAR)"))} AS register, {_pick({k: f[2] for k, f in S.FRAMES.items()}, _u("frame", "CAST(range AS VARCHAR)"))} AS frame, CAST({_pick(S.SIZES, _u("k", "CAST(range AS VARCHAR)"))} AS INTEGER) AS drawn, {_u("scene", "CAST(range AS VARCHAR)")} < 0.6 AS has_scene, CAST({_pick(S.N_AXES, _u("axes", "CAST(range AS VARCHAR)"))} AS INTEGER) AS n_axes FROM range(2000)),
f AS (SELECT * FROM (VALUES {", ".join(f"('{k}', '{v[0]}', {v[1]})" for k, v in S.FRAMES.items())}) AS f(frame, kind, least_n))
SELECT spec_index, register, frame, kind, greatest(least_n, drawn) AS k, has_scene, n_axes FROM h JOIN f USING (frame)""",
}
