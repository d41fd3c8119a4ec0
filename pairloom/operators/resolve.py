"""Generated samples to instances; what can't be resolved keeps its reason.

One row of the raw log becomes many instances or one reject.  Finding names follows the
nth exact match and falls back to the nth match without case, occurrence by occurrence,
which Spark's own functions can't say, so one Arrow function does it for whole batches.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import NONE, SAMPLE_PASSAGE, SAMPLE_SENTENCE, SPEC

MAX_SENTENCE, MAX_PASSAGE, MAX_NAME = 120, 200, 12
OUT = "spec_index long, sent_id string, register string, pair_no int, text string, label string, reason string"


class _Bad(Exception):
    pass


def occurrences(text: str, names: list[str], strict: bool = False) -> list[tuple[int, int, str]]:
    """(begin, end, lower-case name) of all names, by position; overlapping ones are an error.

    The k-th occurrence is the k-th exact one, or without that the k-th regardless of case
    (not with ``strict``), so mixed spellings can give one place twice, which overlaps.
    """

    def every(hay: str, needle: str) -> list[int]:
        at, out = hay.find(needle), []
        while at >= 0:
            out.append(at)
            at = hay.find(needle, at + 1)
        return out

    low, found = text.lower(), []
    for name in dict.fromkeys(names):
        exact = every(text, name)
        places = exact if strict else exact + every(low, name.lower())[len(exact) :]
        found += [(at, at + len(name), name.lower()) for at in places]
    found.sort(key=lambda f: f[0])
    if any(b[0] < a[1] for a, b in zip(found, found[1:], strict=False)):
        raise _Bad("overlapping entity spans")
    return found


def _render(text: str, a: tuple, b: tuple) -> str:
    (b1, e1, _), (b2, e2, _) = a, b
    return f"{text[:b1]}[E1]{text[b1:e1]}[/E1]{text[e1:b2]}[E2]{text[b2:e2]}[/E2]{text[e2:]}"


def _instances(text: str, found: list, relations: list[tuple[str, str, str]]) -> list[tuple[str, str]]:
    """(marked text, label) of all pairs of names at their first mentions."""
    label = {frozenset((a, b)): kind for a, b, kind in relations if a != b}
    first: dict[str, tuple] = {}
    for f in found:
        first.setdefault(f[2], f)
    return [(_render(text, a, b), label.get(frozenset((a[2], b[2])), NONE)) for a, b in combinations(first.values(), 2)]


def _clean(text: str | None) -> str:
    """What ``functions.text.normalised`` does, for texts inside lists, which its Python step can't reach."""
    t = (text or "").translate(X.TYPOGRAPHIC).replace("**", "").replace("__", "")
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", t), flags=re.ASCII).strip(" ")


def _long(text: str) -> int:
    return len(text.split())


def _looping(text: str) -> bool:
    w = text.lower().split()
    if len(w) < 15:
        return False
    run = most = 1
    for a, b in zip(w, w[1:], strict=False):
        run = run + 1 if a == b else 1
        most = max(most, run)
    return most > 6 or len(set(w)) / len(w) < 0.3


def _sentence(r) -> list[tuple[str, str, str]]:
    if r.entities is None:
        raise _Bad("the resolver needs the spec")
    if not r.has_sample:
        raise _Bad("no sample returned")
    text = r.sentence or ""
    if not text:
        raise _Bad("empty sentence")
    if _long(text) > MAX_SENTENCE:
        raise _Bad(f"sentence too long ({_long(text)} words)")
    if _looping(text):
        raise _Bad("degenerate repetition")
    names = dict((ent["key"], ent["surface"]) for ent in r.entities)
    found = occurrences(text, list(names.values()))
    there = {f[2] for f in found}
    for s in names.values():
        if s.lower() not in there:
            raise _Bad(f"drug not in sentence: {s}")
    rels = [(names[a["between"][0]].lower(), names[a["between"][1]].lower(), a["label"]) for a in r.asserted if a is not None]
    out = [(r.sent_id, *x) for x in _instances(text, found, rels)]
    if not out:
        raise _Bad("no pairs produced")
    return out


def _passage(r) -> list[tuple[str, str, str]]:
    if not r.has_sample:
        raise _Bad("no sample returned")
    if r.sentences is None or not len(r.sentences):
        raise _Bad("no sentences")
    names = []
    for e in map(_clean, r.names if r.names is not None else ()):
        if not e:
            raise _Bad("empty entity text")
        if _long(e) > MAX_NAME:
            raise _Bad("entity text looks like a sentence")
        names.append(e)
    if len(names) < 2:
        raise _Bad(f"need two entities, got {len(names)}")
    known = {n.lower() for n in names}
    texts = [_clean(s["text"]) for s in r.sentences]
    whole = " ".join(texts)
    if _long(whole) > MAX_PASSAGE:
        raise _Bad(f"passage too long ({_long(whole)} words)")
    if _looping(whole):
        raise _Bad("degenerate repetition in passage")
    out = []
    for i, s in enumerate(r.sentences):
        text = texts[i]
        if not text:
            continue
        found = occurrences(text, names)
        there, rels = {f[2] for f in found}, []
        for rel in s["relations"] if s["relations"] is not None else ():
            a, b = (_clean(rel[k]).lower() for k in ("arg1", "arg2"))
            if a not in known or b not in known:
                continue
            if a == b:
                raise _Bad("self-relation")
            if a not in there or b not in there:
                raise _Bad("relation outside its sentence: " + f"{a}~{b}")
            rels.append((a, b, rel["label"]))
        out += [(f"{r.sent_id}:s{i}", *x) for x in _instances(text, found, rels)]
    if not out:
        raise _Bad("no instances produced")
    return out


def _rows(form):
    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            out = []
            for r in pdf.itertuples(index=False):
                try:
                    at: dict[str, int] = {}
                    for sid, text, label in form(r):
                        at[sid] = at.get(sid, -1) + 1
                        out.append((r.spec_index, sid, r.register, at[sid], text, label, None))
                except _Bad as e:
                    out.append((r.spec_index, r.sent_id, r.register, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")]).astype({"pair_no": "Int32"})

    return run


def parsed_sentences(raw: DataFrame, gen_id: str) -> DataFrame:
    """The successful rows of a raw log with spec and normalised sentence; positives or asserts, whichever a spec has."""
    spec, sample = F.from_json("spec", SPEC), F.from_json("sample", SAMPLE_SENTENCE)
    p = raw.select("spec_index", spec.alias("spec"), sample.alias("s"), (F.col("sample").isNotNull() & F.col("sample").startswith("{")).alias("has_sample"))
    sid = F.concat(F.lit(f"synth:{gen_id}:"), F.col("spec_index").cast("string"))
    asserted = F.coalesce("spec.asserts", "spec.positives", F.expr("cast(array() as array<struct<between:array<string>,label:string>>)"))
    return p.select("spec_index", sid.alias("sent_id"), F.coalesce("spec.register", F.lit("synthetic")).alias("register"), F.col("spec.entities").alias("entities"), asserted.alias("asserted"), "has_sample", X.normalised(F.col("s.sentence")).alias("sentence"))


def parsed_passages(raw: DataFrame, gen_id: str) -> DataFrame:
    sample = F.from_json("sample", SAMPLE_PASSAGE)
    p = raw.select("spec_index", F.from_json("spec", SPEC).alias("spec"), sample.alias("s"), (F.col("sample").isNotNull() & F.col("sample").startswith("{")).alias("has_sample"))
    sid = F.concat(F.lit(f"synth:{gen_id}:"), F.col("spec_index").cast("string"))
    sents = F.transform("s.sentences", lambda x: F.struct(x["text"].alias("text"), F.transform(x["relations"], lambda r: F.struct(r["arg1"].alias("arg1"), r["arg2"].alias("arg2"), r["label"].alias("label"))).alias("relations")))
    return p.select("spec_index", sid.alias("sent_id"), F.coalesce("spec.register", F.lit("synthetic")).alias("register"), "has_sample", F.transform("s.entities", lambda e: e["text"]).alias("names"), sents.alias("sentences"))


def successes(raw: DataFrame) -> DataFrame:
    """Rows of a raw log without error and with a sample that says something."""
    return raw.where("(error IS NULL OR error = '') AND sample IS NOT NULL AND sample NOT IN ('', '{}', 'null')")


def resolved(raw: DataFrame, gen_id: str, form: str = "sentence") -> tuple[DataFrame, DataFrame]:
    """(instances, rejects) of a raw log: instances by spec and pair, rejects with their reason."""
    good = raw.where("error IS NULL OR error = ''")
    rows = parsed_sentences(good, gen_id).mapInPandas(_rows(_sentence), OUT) if form == "sentence" else parsed_passages(good, gen_id).mapInPandas(_rows(_passage), OUT)
    inst = rows.where("reason IS NULL").select("text", "label", F.col("register").alias("source"), "sent_id", "pair_no")
    return inst, rows.where("reason IS NOT NULL").select("spec_index", "sent_id", "reason")


def build(raw: DataFrame, gen_id: str, root: str, form: str = "sentence", mode: str = "markers", **more) -> tuple[str, DataFrame]:
    """A dataset from a raw log in one call: (its id, one row of ``built``, ``rejected``, ``attempts`` and ``errors``).

    The log is resolved once into a scratch table; instances are rendered in the mode and
    written with their manifest, rejects beside them.  Pairs that the mode can't render
    are rejects too.
    """
    from ..sources import store
    from .pairs import masked_twins

    spark = raw.sparkSession
    at = store.scratch(spark)
    inst, rejects = resolved(raw, gen_id, form)
    both = inst.select(F.struct("*").alias("i"), F.lit(None).cast("struct<spec_index:bigint,sent_id:string,reason:string>").alias("r")).unionByName(rejects.select(F.struct("*").alias("r")), allowMissingColumns=True)
    rows = store.written(both, at)
    inst, rejects = rows.where("i IS NOT NULL").select("i.*"), rows.where("r IS NOT NULL").select("r.*")
    if mode != "markers":
        _, masked, dropped = masked_twins(inst)
        inst, rejects = masked, rejects.unionByName(dropped.select(F.lit(None).cast("long").alias("spec_index"), "sent_id", F.lit("overlapping spans").alias("reason")))
    dataset_id = store.write_dataset(inst, root, "generated", generator=gen_id, render_mode=mode, **more)
    store.write_rejects(rejects, f"{root}/rejects/{dataset_id}")
    log = raw.agg(F.count("*").alias("attempts"), F.count_if(F.coalesce(F.col("error"), F.lit("")) != "").alias("errors"))
    n = inst.agg(F.count("*").alias("built")).crossJoin(rejects.agg(F.count("*").alias("rejected"))).crossJoin(log)
    return dataset_id, n


def reason_counts(rejects: DataFrame) -> DataFrame:
    """Reasons up to their first colon and ' not found', 60 characters at most."""
    r = F.left(F.substring_index(F.substring_index("reason", ":", 1), " not found", 1), F.lit(60))
    return rejects.groupBy(r.alias("reason")).agg(F.count("*").alias("n"))


def generation_records(parsed: DataFrame, roles: DataFrame) -> DataFrame:
    """Where names stand in each sentence: the asserted pair's middle, role names, names strictly between the pair.

    ``roles`` has spec_index, role_pos and roles (a map from key to role).
    """
    low = F.lower("sentence")
    pos = F.map_from_entries(F.transform("entities", lambda e: F.struct(e["key"], F.instr(low, F.lower(e["surface"])) - 1)))
    r = parsed.where("sentence <> '' AND entities IS NOT NULL").join(roles, "spec_index", "left").withColumn("pos", pos)
    first = F.try_element_at("asserted", F.lit(1))
    r = r.withColumn("pa", F.try_element_at("pos", first["between"][0])).withColumn("pb", F.try_element_at("pos", first["between"][1]))
    both = (F.col("pa") >= 0) & (F.col("pb") >= 0)
    lo, hi = F.least("pa", "pb"), F.greatest("pa", "pb")
    inner = F.size(F.filter(F.map_values("pos"), lambda p: (p > lo) & (p < hi)))
    spots = F.filter(F.transform(F.map_keys("roles"), lambda k: F.try_element_at("pos", k)), lambda p: p >= 0)
    return r.select("sentence", "register", F.coalesce(first["label"], F.lit(NONE)).alias("label"), F.size("entities").alias("n_entities"), F.col("role_pos").alias("role_pos_requested"), F.when(both, (lo + hi) / 2).alias("positive_span"), F.when(both, inner).alias("sep_achieved"), F.coalesce(spots, F.expr("cast(array() as array<int>)")).alias("role_spans"))


def role_positions(records: DataFrame) -> DataFrame:
    """(role_pos_requested, achieved, n, share): equal positions count as after."""
    r = records.where("role_pos_requested IS NOT NULL AND positive_span IS NOT NULL").select("role_pos_requested", "positive_span", F.explode("role_spans").alias("at"))
    c = r.groupBy("role_pos_requested", F.when(F.col("at") < F.col("positive_span"), "before").otherwise("after").alias("achieved")).agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("role_pos_requested")))


def role_position_skew(records: DataFrame) -> DataFrame:
    """The larger of the before and after shares of role names; 0 without any."""
    r = records.where("positive_span IS NOT NULL").select("positive_span", F.explode("role_spans").alias("at"))
    b, n = F.count_if(F.col("at") < F.col("positive_span")), F.count("*")
    return r.agg(F.when(n > 0, F.greatest(b, n - b) / n).otherwise(0.0).alias("role_position_skew"))


def separations(records: DataFrame) -> DataFrame:
    c = records.where("sep_achieved IS NOT NULL").groupBy("sep_achieved").agg(F.count("*").alias("n"))
    total = c.agg(F.sum("n").alias("total"))
    return c.crossJoin(F.broadcast(total)).select("sep_achieved", "n", (F.col("n") / F.col("total")).alias("share"))
