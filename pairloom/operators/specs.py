"""Generation requests: each is a function of its index and the seed, so any range of them can be made anywhere."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lexicon import unusable
from .sampling import hashed, pick, uniform

#: frame: (kind, least entities, weight, positive pairs by key with their label, number of keys in focus)
FRAMES: dict[str, tuple[str, int, float, list[tuple[str, str, str]], int]] = {
    "regimen": ("none_plain", 2, 0.16, [], 0),
    "denial": ("none_pair", 2, 0.11, [], 2),
    "study_only": ("none_pair", 2, 0.00, [], 2),
    "incompatible": ("none_pair", 2, 0.03, [], 2),
    "enzyme_only": ("none_single", 2, 0.05, [], 1),
    "out_of_scope": ("none_single", 2, 0.03, [], 1),
    "sequential": ("none_pair", 2, 0.05, [], 2),
    "mechanism": ("positive", 2, 0.13, [("A", "B", "MECHANISM")], 2),
    "mechanism_mixed": ("positive", 2, 0.06, [("A", "B", "MECHANISM")], 2),
    "effect": ("positive", 2, 0.10, [("A", "B", "EFFECT")], 2),
    "effect_pd": ("positive", 2, 0.04, [("A", "B", "EFFECT")], 2),
    "effect_protect": ("positive", 2, 0.02, [("A", "B", "EFFECT")], 2),
    "effect_failure": ("positive", 2, 0.04, [("A", "B", "EFFECT")], 2),
    "advise": ("positive", 2, 0.07, [("A", "B", "ADVISE")], 2),
    "advise_reason": ("positive", 2, 0.04, [("A", "B", "ADVISE")], 2),
    "int": ("positive", 2, 0.03, [("A", "B", "INT")], 2),
    "contradictory": ("positive", 2, 0.02, [("A", "B", "ADVISE")], 2),
    "title": ("structural", 3, 0.02, [("A", "B", "MECHANISM")], 2),
    "coordinate": ("structural", 3, 0.03, [("A", "C", "EFFECT"), ("B", "C", "EFFECT")], 3),
    "appositive": ("structural", 4, 0.02, [("A", "C", "EFFECT"), ("A", "D", "EFFECT"), ("B", "C", "EFFECT"), ("B", "D", "EFFECT")], 4),
}
REGISTERS = dict(zip(("DrugBank", "MedLine"), (0.85, 0.15), strict=True))
SIZES = {str(k): w for k, w in enumerate((0.41, 0.27, 0.14, 0.10, 0.08), 2)}
_FREE = ["certainty", "detail", "grammar", "length", "opening"]
_OF_PAIRS = sorted([*_FREE, "orientation", "separation"])
AXES = {"none_plain": _FREE, "none_single": _FREE, "none_pair": _OF_PAIRS, "positive": _OF_PAIRS, "structural": [a for a in _FREE if a not in ("grammar", "opening")]}
N_AXES = {"0": 0.15, "1": 0.45, "2": 0.40}
SCENE, ROLE, ROLES = 0.6, 0.55, ("r1", "r2", "r3", "r4", "r5")


def redistributed(weights: dict[str, float], drop: str, to: dict[str, float]) -> dict[str, float]:
    """Weights without one frame, its weight shared out."""
    freed = weights[drop]
    return {k: 0.0 if k == drop else w + freed * to.get(k, 0.0) for k, w in weights.items()}


def _u(seed: int, what: str, *more: Column) -> Column:
    return uniform(hashed(f"{seed}:{what}", F.col("spec_index"), *more))


def spec_heads(spark: SparkSession, n: int, seed: int = 0, weights: dict[str, float] | None = None, start: int = 0) -> DataFrame:
    """(spec_index, register, frame, kind, k, has_scene, n_axes) of n requests from an index on."""
    weights = weights or {k: f[2] for k, f in FRAMES.items()}
    ids = spark.range(start, start + n).select(F.col("id").alias("spec_index"))
    h = ids.withColumn("register", pick(REGISTERS, _u(seed, "register"))).withColumn("frame", pick(weights, _u(seed, "frame")))
    table = F.create_map(*(x for k, f in FRAMES.items() for x in (F.lit(k), F.lit(f[1]))))
    kinds = F.create_map(*(x for k, f in FRAMES.items() for x in (F.lit(k), F.lit(f[0]))))
    return h.withColumn("kind", kinds[F.col("frame")]).withColumn("k", F.greatest(table[F.col("frame")], pick(SIZES, _u(seed, "k")).cast("int"))).withColumn("has_scene", _u(seed, "scene") < SCENE).withColumn("n_axes", pick(N_AXES, _u(seed, "axes")).cast("int"))


def specs(spark: SparkSession, n: int, vocab: DataFrame, seed: int = 0, p_group: float = 0.3, tries: int = 200, start: int = 0, weights: dict[str, float] | None = None) -> DataFrame:
    """Whole requests: names that don't contain each other, roles of spare names, axes, and the label of every pair.

    Each request draws ``tries`` candidate names by hash and keeps the first k usable ones
    of which none contains another; one that ends with fewer is left with ``complete`` false
    and is a row of ``exhausted``.  The first k requests of n are the k requests of the same seed.
    """
    heads = spec_heads(spark, n, seed, weights, start)
    sizes = {r.kind: r.n for r in vocab.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    drugs, groups = sizes.get("drug", 0), sizes.get("group", 0)
    # a few candidates go far, as names rarely collide; only requests that are short after 16 draw the rest
    short = heads.withColumn("got", F.expr("cast(array() as array<struct<name:string,kind:string>>)"))
    for first, end in ((0, min(16, tries)), (16, tries)):
        if first >= end:
            continue
        t = F.explode(F.sequence(F.lit(first), F.lit(end - 1))).alias("t")
        slot = short.where(F.size("got") < F.col("k")).select("spec_index", t)
        kind = F.when((_u(seed, "kind", F.col("t")) < p_group) & F.lit(groups > 0), "group").otherwise("drug")
        pos = F.floor(_u(seed, "name", F.col("t")) * F.when(F.col("kind") == "group", groups).otherwise(drugs)).cast("int")
        cand = slot.withColumn("kind", kind).withColumn("pos", pos).join(vocab, ["kind", "pos"]).where(~unusable(F.col("name")))
        lists = cand.groupBy("spec_index").agg(F.array_sort(F.collect_list(F.struct("t", "name", "kind"))).alias("cand"))
        clash = lambda acc, x: F.exists(acc, lambda g: F.contains(F.lower(g["name"]), F.lower(x["name"])) | F.contains(F.lower(x["name"]), F.lower(g["name"])))
        add = lambda acc, x: F.when(clash(acc, x), acc).otherwise(F.concat(acc, F.array(F.struct(x["name"].alias("name"), x["kind"].alias("kind")))))
        short = short.join(lists, "spec_index", "left").withColumn("got", F.aggregate(F.coalesce("cand", F.expr("cast(array() as array<struct<t:int,name:string,kind:string>>)")), F.col("got"), add)).drop("cand")
    keys = F.transform(F.slice("got", F.lit(1), F.col("k")), lambda x, i: F.struct(F.char(F.lit(65) + i).alias("key"), x["name"].alias("surface"), F.when(x["kind"] == "group", "GROUP").otherwise("DRUG").alias("type")))
    s = short.withColumn("entities", keys).withColumn("complete", F.size("got") >= F.col("k"))
    pos_of = F.create_map(*(x for k, f in FRAMES.items() for x in (F.lit(k), F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(lab).alias("label")) for a, b, lab in f[3])) if f[3] else F.expr("cast(array() as array<struct<a:string,b:string,label:string>>)"))))
    focus = F.create_map(*(x for k, f in FRAMES.items() for x in (F.lit(k), F.lit(f[4]))))
    s = s.withColumn("__pos", pos_of[F.col("frame")]).withColumn("names", F.transform("entities", lambda e: e["key"]))
    spare = F.slice("names", focus[F.col("frame")] + 1, F.size("names"))
    roled = F.slice(F.filter(spare, lambda x: uniform(hashed(f"{seed}:role", F.col("spec_index"), x)) < ROLE), 1, 2)
    first = F.floor(_u(seed, "which") * len(ROLES)).cast("int")
    all_roles = F.array(*map(F.lit, ROLES))
    roles = F.map_from_entries(F.transform(roled, lambda x, i: F.struct(x, F.element_at(all_roles, (first + i) % len(ROLES) + 1))))
    pairs = F.flatten(F.transform("names", lambda a: F.transform(F.filter("names", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    label = lambda p: F.coalesce(F.try_element_at(F.filter("__pos", lambda q: (F.least(q["a"], q["b"]) == p["a"]) & (F.greatest(q["a"], q["b"]) == p["b"])), F.lit(1))["label"], F.lit("NONE"))
    matrix = F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.concat(p["a"], F.lit("|"), p["b"]), label(p))))
    pool = F.create_map(*(x for k, v in AXES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    ranked = F.array_sort(F.transform(pool[F.col("kind")], lambda a: F.struct(hashed(f"{seed}:axis", F.col("spec_index"), a).alias("h"), a.alias("a"))))
    axes = F.transform(F.slice(ranked, F.lit(1), F.col("n_axes")), lambda x: x["a"])
    out = F.transform("__pos", lambda p: F.struct(F.array(p["a"], p["b"]).alias("between"), p["label"].alias("label")))
    return s.select("spec_index", "frame", "kind", "register", "entities", out.alias("positives"), roles.alias("roles"), "has_scene", axes.alias("axes"), matrix.alias("matrix"), "complete")


def exhausted(rows: DataFrame) -> DataFrame:
    """(spec_index, reason) of requests for which the draws found too few names."""
    return rows.where(~F.col("complete")).select("spec_index", F.lit("too few names that don't contain each other").alias("reason"))


def fingerprint(pools: dict[str, list[str]], head: str = "") -> str:
    """Twelve digits over what requests are written from: a head and the pools by name, each sorted."""
    parts = [head, *(x for name in sorted(pools) for x in (name, *sorted(pools[name])))]
    return hashlib.sha256("|".join(parts).encode()).hexdigest()[:12]


def prompts(rows: DataFrame, register_line: Column, says: Column | None = None) -> DataFrame:
    """(spec_index, prompt): blocks of rows of nouns; ``{A}`` stands for the name with key A.  says: array<struct<k, v>>."""
    names = F.map_from_entries(F.transform("entities", lambda e: F.struct(e["key"], e["surface"])))
    sub = lambda t: F.aggregate(F.col("entities"), t, lambda acc, e: F.replace(acc, F.concat(F.lit("{"), e["key"], F.lit("}")), e["surface"]))
    block = lambda title, lines: F.when(F.size(lines) > 0, F.concat(F.lit(title + "\n  "), F.array_join(lines, "\n  "), F.lit("\n\n"))).otherwise("")
    head = F.concat(register_line, F.lit("\n\n"), F.lit("drug names, use all "), F.size("entities").cast("string"), F.lit("\n  "), F.array_join(F.transform("entities", lambda e: e["surface"]), "\n  "), F.lit("\n\n"))
    parts = [head]
    if says is not None:
        width = F.aggregate(says, F.lit(0), lambda acc, x: F.greatest(acc, F.length(x["k"])))
        parts.append(block("says", F.transform(says, lambda x: F.concat(F.rpad(x["k"], width, F.lit(" ")), F.lit("  "), sub(x["v"])))))
    parts.append(block("the remaining drugs", F.transform(F.map_entries("roles"), lambda r: F.concat(F.element_at(names, r["key"]), F.lit("  "), r["value"]))))
    parts.append(block("how to write it", F.col("axes")))
    return rows.select("spec_index", F.rtrim(F.concat(*parts)).alias("prompt")).withColumn("prompt", F.regexp_replace("prompt", r"\s+$", ""))
