"""Sentences, mentions and pairs: the joins that make instances of annotated text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import spans as P
from ..functions import text as X
from ..schema import NONE

#: Pairs of a sentence from which on ``below_cap`` leaves it out.
MONSTER = 190


def sentence_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, keep, s, piece, begin, end): one row a sentence, offsets in the document."""
    cut = docs.select(id_col, *keep, F.posexplode(X.sentences(F.col(text_col))).alias("s", "p"))
    return cut.select(id_col, *keep, "s", "p.piece", "p.begin", "p.end")


def sentence_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, keep, s, piece): the sentences of ``sentence_rows`` where nobody asks for their offsets, which take longer than the cut."""
    return docs.select(id_col, *keep, F.posexplode(F.regexp_extract_all(F.col(text_col), F.lit(X.SENTENCE), F.lit(0))).alias("s", "piece"))


def sentence_documents(docs: DataFrame) -> DataFrame:
    """Annotated documents cut into sentences: an entity stays if it lies wholly in one, a relation if all its arguments do."""
    rows = docs.select("doc_id", "register", "entities", "relations", F.posexplode(X.sentences(F.col("text"))).alias("s", "p")).select("doc_id", "register", "entities", "relations", "s", "p.*")
    inside = F.filter("entities", lambda e: (e["begin"] >= F.col("begin")) & (e["end"] <= F.col("end")))
    moved = F.transform(inside, lambda e: e.withField("begin", e["begin"] - F.col("begin")).withField("end", e["end"] - F.col("begin")))
    ids = F.transform(inside, lambda e: e["id"])
    rels = F.filter("relations", lambda r: F.array_contains(F.col("ids"), r["arg1"]) & F.array_contains(F.col("ids"), r["arg2"]))
    sid = F.concat(F.lit("human:"), "register", F.lit(":"), "doc_id", F.lit(":s"), F.col("s").cast("string"))
    return rows.withColumn("ids", ids).select(sid.alias("sent_id"), "register", F.col("piece").alias("text"), moved.alias("entities"), rels.alias("relations"))


def pair_instances(sents: DataFrame, mode: str = "markers", monster: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(instances, skipped): all pairs of each sentence's entities by position, labelled and rendered.

    A relation in the order of the pair comes before one the other way; of several the
    last counts.  Pairs whose spans can't be rendered in the mode are in ``skipped``
    with a reason.  Sentences with ``monster`` pairs or more are left out first.
    """
    n = F.size("entities")
    if monster is not None:
        sents = sents.where(n * (n - 1) / 2 < monster)
    e = sents.withColumn("ents", F.array_sort("entities", lambda a, b: a["begin"] - b["begin"]))
    ranked = e.withColumn("n", F.size("ents")).where("n > 1")
    i = ranked.select("sent_id", "register", "text", "ents", "relations", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 2)).alias("i"))
    both = i.select("*", F.explode(F.sequence(F.col("i") + 1, F.col("n") - 1)).alias("j")).withColumn("a", F.col("ents")[F.col("i")]).withColumn("b", F.col("ents")[F.col("j")])
    last = lambda x, y: F.try_element_at(F.transform(F.filter("relations", lambda r: (r["arg1"] == F.col(x)["id"]) & (r["arg2"] == F.col(y)["id"])), lambda r: r["type"]), F.lit(-1))
    args = [F.col("a.begin"), F.col("a.end"), F.col("b.begin"), F.col("b.end")]
    text = P.marked(F.col("text"), *args) if mode == "markers" else P.masked(F.col("text"), *args, F.col("ents") if mode == "mask_all" else None)
    no = F.expr("i * (2 * n - i - 1) div 2 + j - i - 1").cast("int")
    made = F.struct(text.alias("text"), F.coalesce(last("a", "b"), last("b", "a"), F.lit(NONE)).alias("label"), F.col("register").alias("source"), "sent_id", no.alias("pair_no"))
    out = both.select(F.explode(F.array(made)).alias("x")).select("x.*")  # behind an explode the filters below don't render each text again
    return out.where("text IS NOT NULL"), out.where("text IS NULL").select("sent_id", "pair_no", "label", F.lit("overlapping spans").alias("reason"))


def token_mentions(sents: DataFrame, lexicon: DataFrame, keys: tuple[str, ...] = ("doc_id", "s"), text_col: str = "piece") -> DataFrame:
    """(keys, name, begin, end, ord): where single-word names of a lexicon stand in sentences, numbered by position.

    Words are runs of ASCII letters; the join is on the lower-case word, so it costs one
    shuffle of words at most whatever the lexicon's size.
    """
    parts = sents.select(*keys, F.posexplode(F.split(text_col, " ")).alias("p", "w"))
    start = F.coalesce(F.sum(F.length("w") + 1).over(Window.partitionBy(*keys).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    name = F.regexp_extract("w", "[A-Za-z]+", 0)
    at = parts.withColumn("start", start).withColumn("name", F.lower(name)).where("name <> ''").withColumn("begin", (F.col("start") + F.instr("w", name) - 1).cast("int"))
    found = at.join(lexicon.select("name").distinct(), "name")
    order = F.row_number().over(Window.partitionBy(*keys).orderBy("begin"))
    return found.select(*keys, "name", "begin", (F.col("begin") + F.length("name")).cast("int").alias("end"), order.alias("ord"))


def first_mentions(mentions: DataFrame, keys: tuple[str, ...] = ("doc_id", "s")) -> DataFrame:
    """One row a name and sentence: its first mention."""
    r = F.row_number().over(Window.partitionBy(*keys, "name").orderBy("begin"))
    return mentions.withColumn("__r", r).where("__r = 1").drop("__r")


def mention_pairs(mentions: DataFrame, keys: tuple[str, ...] = ("doc_id", "s"), monster: int | None = None) -> DataFrame:
    """(keys, name1, begin1, end1, ord1, name2, ...): pairs in position order; sentences with ``monster`` pairs or more are left out first."""
    kept = mentions
    if monster is not None:
        n = F.count("*").over(Window.partitionBy(*keys))
        kept = mentions.withColumn("__n", n).where(F.col("__n") * (F.col("__n") - 1) / 2 < monster)
    one = lambda k: kept.select(*keys, *(F.col(c).alias(f"{c}{k}") for c in ("name", "begin", "end", "ord")))
    return one(1).join(one(2), list(keys)).where("ord1 < ord2")


def labelled_pairs(pairs: DataFrame, relations: DataFrame, directed: bool = True, one_way: bool = False) -> DataFrame:
    """pairs with the label of (name1, name2), else of (name2, name1) unless ``one_way``, else NONE; of repeated relations the last by ``no``."""
    if one_way:
        r = relations.groupBy("name1", "name2").agg(F.max_by("label", "no").alias("label"))
        return pairs.join(r, ["name1", "name2"], "left").withColumn("label", F.coalesce("label", F.lit(NONE)))
    if directed:
        r = relations.groupBy("name1", "name2").agg(F.max_by("label", "no").alias("label"))
        back = r.select(F.col("name1").alias("name2"), F.col("name2").alias("name1"), F.col("label").alias("back"))
        return pairs.join(r, ["name1", "name2"], "left").join(back, ["name1", "name2"], "left").withColumn("label", F.coalesce("label", "back", F.lit(NONE))).drop("back")
    key = lambda d: d.withColumn("lo", F.least("name1", "name2")).withColumn("hi", F.greatest("name1", "name2"))
    r = key(relations).groupBy("lo", "hi").agg(F.max_by("label", "no").alias("label"))
    return key(pairs).join(r, ["lo", "hi"], "left").withColumn("label", F.coalesce("label", F.lit(NONE))).drop("lo", "hi")


def self_binds(relations: DataFrame) -> DataFrame:
    """(n): relations of a name with itself, which bind no pair."""
    return relations.where("name1 = name2").agg(F.count("*").alias("n"))


def restricted(docs: DataFrame, keys: DataFrame, *by: str) -> DataFrame:
    """Documents whose key is among the keys; a null key is among none."""
    return docs.join(keys.select(*by), list(by), "left_semi")


def multi_entity(sents: DataFrame, least: int = 2, require_positive: bool = False) -> DataFrame:
    """Sentences with at least so many entities and, where asked for, a relation."""
    out = sents.where(F.size("entities") >= least)
    return out.where(F.size("relations") > 0) if require_positive else out


def ordered_pairs(mentions: DataFrame, keys: tuple[str, ...] = ("doc_id", "s")) -> DataFrame:
    """Every ordered pair of different mentions of a sentence."""
    one = lambda k: mentions.select(*keys, *(F.col(c).alias(f"{c}{k}") for c in ("name", "begin", "ord")))
    return one(1).join(one(2), list(keys)).where("ord1 <> ord2")


def closest_mentions(relations: DataFrame, mentions: DataFrame, keys: tuple[str, ...] = ("doc_id", "s")) -> DataFrame:
    """Each relation (keys, no, name1, name2) with the pair of mentions least apart; of equally close ones the first by position."""
    one = lambda k: mentions.select(*keys, *(F.col(c).alias(f"{c}{k}") for c in ("name", "begin", "ord")))
    both = relations.join(one(1), [*keys, "name1"]).join(one(2), [*keys, "name2"])
    best = F.min_by(F.struct("begin1", "begin2"), F.struct(F.abs(F.col("begin1") - F.col("begin2")), "ord1", "ord2"))
    return both.groupBy(*keys, "no", "name1", "name2").agg(best.alias("at")).select(*keys, "no", "name1", "name2", "at.*")


def conflicting_pairs(pairs: DataFrame, keys: tuple[str, ...] = ("sent_id",), order: str = "pair_no") -> DataFrame:
    """Rows whose names' label differs from the one before with the same names in the sentence."""
    before = F.lag("label").over(Window.partitionBy(*keys, F.least("name1", "name2"), F.greatest("name1", "name2")).orderBy(order))
    return pairs.withColumn("before", before).where("before IS NOT NULL AND before <> label")


def below_cap(inst: DataFrame, cap: int = MONSTER) -> DataFrame:
    """Rows of sentences with fewer pairs than the cap."""
    return inst.withColumn("__n", F.count("*").over(Window.partitionBy("sent_id"))).where(F.col("__n") < cap).drop("__n")


def parsed_ids(inst: DataFrame) -> DataFrame:
    """sent_id as kind, register, document and sentence part: cut at the first two colons, then at the last."""
    rest = F.expr("substring(sent_id, length(substring_index(sent_id, ':', 2)) + 2)")
    return inst.withColumn("kind", F.substring_index("sent_id", ":", 1)).withColumn("register", F.element_at(F.split("sent_id", ":"), 2)).withColumn("document", F.regexp_replace(rest, ":[^:]*$", "")).withColumn("part", F.substring_index(rest, ":", -1))


def with_masked(inst: DataFrame, name: str = "masked") -> DataFrame:
    """inst with its masked text, null where the tags don't allow it: one pass for what ``masked_twins`` gives as three frames."""
    return inst.withColumn(name, P.masked_text(F.col("text")))


def masked_twins(inst: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept, masked, dropped): rows that can be masked, the same rows masked, and the rest."""
    m = with_masked(inst, "__m")
    ok = m.where("__m IS NOT NULL")
    return ok.drop("__m"), ok.withColumn("text", F.col("__m")).drop("__m"), m.where("__m IS NULL").drop("__m")


def listing(values: Column) -> Column:
    """A numbered line for each value, from 0."""
    return F.array_join(F.transform(values, lambda x, i: F.concat(i.cast("string"), F.lit(". "), x)), "\n")


def batches(rows: DataFrame, value: Column, size: int, *order: str) -> DataFrame:
    """(batch, values): values in order, so many a batch."""
    n = F.row_number().over(Window.orderBy(*order)) - 1
    numbered = rows.select(value.alias("value"), n.alias("n"))
    return numbered.groupBy(F.expr(f"n div {size}").alias("batch")).agg(F.array_sort(F.collect_list(F.struct("n", "value"))).alias("v")).select("batch", F.transform("v", lambda x: x["value"]).alias("values"))
