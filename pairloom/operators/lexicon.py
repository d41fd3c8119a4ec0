"""Vocabulary: which names of a drug list and of a classification are usable, and draws from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import any_of, bound, n_words, nfkc, plain_quotes, squeezed
from .sampling import hashed, uniform

_JUNK = ("", "combinations", "combinations, other", "na", "other", "various")
ADMIN = any_of("agents,", "chemicals?", "combinations?", "devices?", "diagnostic", "disinfectants?", "equipment", r"excl\.?", r"incl\.?", "non-therapeutic", "others?", "palliation", "preparations?", "products?", "reagents?", "solutions?", "substances", "technical", "various")
NOT_DRUG = any_of("adenovirus", "crab", "extract", "herbarum", "honey", "lecithin", "pollen", "serotype", r"spp\.?", "starch", "vaccine")


def clean_name(name: Column, unicode: bool = True) -> Column:
    t = plain_quotes(F.coalesce(name, F.lit("")))
    return squeezed(nfkc(t) if unicode else t)


def _bad(n: Column) -> Column:
    digits = F.length(F.regexp_replace(n, "[^0-9]", ""))
    return F.lower(F.trim(n)).isin(*_JUNK) | (n_words(n) > 6) | ((digits > 0) & n.rlike("[-/]")) | (digits >= 2) | (F.length(F.regexp_replace(n, "[^-]", "")) >= 3)


def bad_name(n: Column) -> Column:
    """Codes, formulae and cells that hold no name."""
    return bound(n, _bad)


def bad_group(n: Column) -> Column:
    return bound(n, lambda x: _bad(x) | (n_words(x) > 3) | F.contains(x, F.lit(",")) | x.rlike(ADMIN))


def bad_drug(n: Column) -> Column:
    return bound(n, lambda x: _bad(x) | (n_words(x) > 4) | F.contains(x, F.lit(",")) | x.rlike(ADMIN) | x.rlike(NOT_DRUG))


def unusable(n: Column) -> Column:
    """Names that read as two."""
    return F.contains(F.lower(n), F.lit(" and ")) | F.contains(n, F.lit("/"))


def drug_names(rows: DataFrame, name: str = "Common_Name_of_Drug", synonyms: str = "Synonym", unicode: bool = True) -> DataFrame:
    """(name): each row's own name if it is usable, else its first usable synonym."""
    clean = lambda c: clean_name(c, unicode)
    own = rows.select(clean(F.col(name)).alias("own"), F.split(F.coalesce(synonyms, F.lit("")), r"\|").alias("syn"), F.monotonically_increasing_id().alias("__id"))
    each = own.select("__id", "own", F.posexplode("syn").alias("p", "s")).withColumn("s", clean(F.col("s")))
    ok = F.when((F.col("s") != "") & ~bad_drug(F.col("s")), F.col("s"))
    first = each.groupBy("__id", "own").agg(F.min_by(ok, F.when(ok.isNotNull(), F.col("p"))).alias("s"))
    return first.select(F.when(~bad_drug(F.col("own")), F.col("own")).otherwise(F.col("s")).alias("name")).dropna()


def classified_names(rows: DataFrame, code: str = "atc_code", name: str = "atc_name", unicode: bool = True) -> DataFrame:
    """(kind, name): codes of seven or more characters name drugs, of four or five groups; others are left out."""
    c = rows.select(F.length(F.trim(F.coalesce(code, F.lit("")))).alias("n"), clean_name(F.col(name), unicode).alias("name"))
    title = bound(F.col("name"), lambda n: F.when((F.upper(n) == n) & (F.lower(n) != n), F.initcap(F.lower(n))).otherwise(n))
    drugs = c.where("n >= 7").where(~bad_drug(F.col("name"))).select(F.lit("drug").alias("kind"), "name")
    groups = c.where("n IN (4, 5)").select(F.lit("group").alias("kind"), title.alias("name")).where(~bad_group(F.col("name")))
    return drugs.unionByName(groups)


def vocabulary(drugs: DataFrame, groups: DataFrame) -> DataFrame:
    """(kind, name, pos): each name once a kind, numbered from 0 in order."""
    both = drugs.select(F.lit("drug").alias("kind"), "name").unionByName(groups.select(F.lit("group").alias("kind"), "name")).distinct()
    return both.withColumn("pos", F.row_number().over(Window.partitionBy("kind").orderBy("name")) - 1)


def fingerprint(vocab: DataFrame, sources: list[str], p_group: float) -> DataFrame:
    """(n_drugs, n_groups, sha256): twelve digits over sources, share and names."""
    names = lambda k: F.array_join(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("name")))), "\n")
    text = F.concat(F.lit("|".join(sources) + f"p_group={p_group}"), names("drug"), names("group"))
    return vocab.agg(F.count_if(F.col("kind") == "drug").alias("n_drugs"), F.count_if(F.col("kind") == "group").alias("n_groups"), F.left(F.sha2(text, 256), F.lit(12)).alias("sha256"))


def drawn_names(slots: DataFrame, vocab: DataFrame, seed: int, p_group: float = 0.3, *key: str) -> DataFrame:
    """slots with kind and name: a group by chance p_group, if there are groups, then any name of the kind, with replacement."""
    sizes = {r.kind: r.n for r in vocab.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    p = p_group if sizes.get("group") else 0.0
    kind = F.when(uniform(hashed(f"{seed}:kind", *key)) < p, "group").otherwise("drug")
    n = F.when(F.col("kind") == "group", sizes.get("group", 0)).otherwise(sizes.get("drug", 0))
    at = F.floor(uniform(hashed(f"{seed}:name", *key)) * n).cast("int")
    return slots.withColumn("kind", kind).withColumn("pos", at).join(vocab, ["kind", "pos"], "left").drop("pos")


def judged_names(batches: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected) names by kind of batches that came back; answers name rejected positions, those out of range count for nothing.

    batches: batch, kind, values; answers: batch, rejected (positions from 0), error.
    """
    ok = batches.join(answers.where("error IS NULL").select("batch", "rejected"), "batch")
    each = ok.select("kind", "rejected", F.posexplode("values").alias("i", "name"))
    gone = F.array_contains("rejected", F.col("i"))
    return each.where(~gone).select("kind", "name"), each.where(gone).select("kind", "name")


def frozen(vocab: DataFrame, path: str, before: int, least: float = 0.2) -> None:
    """Write a filtered vocabulary, unless so little of it is left that the filter must be wrong."""
    n = vocab.count()
    if n < least * before:
        raise ValueError(f"only {n} of {before} names are left: nothing is written")
    vocab.write.mode("overwrite").json(path)
