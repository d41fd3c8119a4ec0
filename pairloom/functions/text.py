"""Text expressions: clean-up, words, n-grams, sentences and word lists as patterns."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FROM = "‐‑‒–—‘’“”   ​"
_TO = "-----''\"\"   "
#: The same for Python: characters without a counterpart go.
TYPOGRAPHIC = {ord(c): _TO[i] if i < len(_TO) else None for i, c in enumerate(_FROM)}


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode compatibility form; Spark has no built-in for it."""
    return s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once: an expression named several times would be computed as often."""
    return F.transform(F.array(value), use)[0]


#: Runs of white space but single spaces, which stay as they are: most texts have hardly any, and only those cost a replacement.
_RUNS = r" \s+|[^\S ]\s*"


def squeezed(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, _RUNS, " "))


def plain_quotes(text: Column) -> Column:
    """Typographic dashes, quotes and spaces as ASCII; zero-width spaces go."""
    return F.translate(text, _FROM, _TO)


def normalised(text: Column, unicode: bool = True) -> Column:
    """What generated text is brought to before names are looked for in it."""
    t = F.replace(F.replace(plain_quotes(text), F.lit("**"), F.lit("")), F.lit("__"), F.lit(""))
    return squeezed(nfkc(t) if unicode else t)


def words(text: Column) -> Column:
    """White-space separated words; none of an empty text."""
    return F.array_remove(F.split(text, r"\s+"), "")


def n_words(text: Column) -> Column:
    clean = squeezed(text)
    return F.when(clean == "", 0).otherwise(F.length(clean) - F.length(F.replace(clean, F.lit(" "), F.lit(""))) + 1)


def ngrams(tokens: Column, n: int) -> Column:
    """All runs of n words; none where there are fewer.

    The words are bound once: named in the inner function they would be split anew for
    every run.
    """

    def runs(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) >= n, grams).otherwise(F.expr("cast(array() as array<string>)"))

    return bound(tokens, runs)


def opening(tokens: Column, n: int = 3) -> Column:
    return F.array_join(F.slice(tokens, 1, n), " ")


def longest_run(tokens: Column) -> Column:
    """Length of the longest run of equal neighbours."""
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most"))

    def step(acc: Column, w: Column) -> Column:
        run = F.when(acc["last"] == w, acc["run"] + 1).otherwise(1)
        return F.struct(w.alias("last"), run.alias("run"), F.greatest(acc["most"], run).alias("most"))

    return F.aggregate(tokens, start, step, lambda acc: acc["most"])


def degenerate(text: Column, max_run: int = 6, min_unique: float = 0.3, min_words: int = 15) -> Column:
    """Decoding loops: a long run of one word, or few different words."""
    w = words(F.lower(text))
    return (F.size(w) >= min_words) & ((longest_run(w) > max_run) | (F.size(F.array_distinct(w)) / F.size(w) < min_unique))


SENTENCE = r"[^.!?]+[.!?]*\s*|[.!?]+\s*"


def sentences(text: Column) -> Column:
    """array<struct<piece, begin, end>>: a lossless cut after final marks; offsets count characters from 0."""
    pieces = F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))
    return F.when(text.isNotNull(), bound(pieces, _offsets))


#: Pieces whose offsets are summed up in one list; a sum over lists costs the square of their length.
_RUN = 64


def _offsets(pieces: Column) -> Column:
    """Pieces with their offsets: within runs of pieces, then over runs, so that a long text isn't a square of its sentences."""
    none = F.expr("cast(array() as array<struct<piece:string,begin:int,end:int>>)")
    ends = F.expr("cast(array() as array<int>)")
    last = lambda acc: F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0))
    sums = lambda lengths: F.aggregate(lengths, ends, lambda acc, n: F.concat(acc, F.array(last(acc) + n)))

    def run(start: Column, p: Column) -> Column:
        lengths = F.transform(F.slice(p, start, _RUN), lambda x: F.length(x))
        return F.struct(start.alias("start"), sums(lengths).alias("ends"))

    def joined(runs: Column, p: Column) -> Column:
        total = sums(F.transform(runs, lambda r: last(r["ends"])))
        return bound(total, lambda t: F.flatten(F.transform(runs, lambda r, k: F.transform(F.slice(p, r["start"], _RUN), lambda x, i: piece(x, r["ends"][i] + F.when(k > 0, t[F.greatest(k - 1, F.lit(0))]).otherwise(0))))))

    piece = lambda x, end: F.struct(x.alias("piece"), (end - F.length(x)).alias("begin"), end.alias("end"))
    starts = lambda p: F.sequence(F.lit(1), F.size(p), F.lit(_RUN))
    return F.when(F.size(pieces) > 0, bound(F.transform(starts(pieces), lambda a: run(a, pieces)), lambda runs: joined(runs, pieces))).otherwise(none)


def any_of(*alternatives: str, flags: str = "(?i)") -> str:
    """A pattern for whole words or phrases."""
    return flags + r"\b(?:" + "|".join(alternatives) + r")\b"


#: Words by which generated text gives a third name a role beside the pair.
ROLE = any_of("after the other[a-z]*", "alternative", "comparator", "comparison", "discontinu[a-z]+", "earlier", "excluded", "first choice", "instead", "later", "not (?:administered|given|permitted)", "previous(?:ly)?", "separately", "stopped", "subsequent(?:ly)?", "thereafter", "unsuitable", "withdraw[a-z]+", "withheld")
CONTRAST = any_of("although", "conversely", "however", "in contrast", "unlike", "whereas", "while")
COORDINATION = r"(?i)^(?:,?\s*(?:and/or|and|or|,)\s*)+$"
ANAPHORA = r"(?i)^\s*(?:as (?:described|mentioned|noted)|both|either|it|such|that|the (?:above|agent|combination|drug|former|latter)|these|they|this|those)\b"
AFOREMENTIONED = any_of("aforementioned", "as (?:described|mentioned|noted) above", "the former", "the latter")
KINETICS = any_of("AUC", "Cmax", "absor(?:b[a-z]+|ption)", "bioavailab[a-z]+", "clearance", "concentration", "exposure", "half-?life", "level", "metaboli[a-z]+", "protein binding")
ASSERTING = any_of("antagonis[a-z]+", "caus[a-z]+", "decreas[a-z]+", "increas[a-z]+", "induc[a-z]+", "inhibit[a-z]+", "interact[a-z]+", "led to", "lower[a-z]+", "potentiat[a-z]+", "rais[a-z]+", "reduc[a-z]+", "result[a-z]+ in")
JOINT = r"(?i)\b(?:together|regimen|combination|combined)\b[^.]{0,80}\b(?:additive|benefit[a-z]*|effective|efficac[a-z]+|improv[a-z]+|outcome[a-z]*|response|safe[a-z]*|tolerat[a-z]+)\b|\b(?:appear|indicat|observ|suggest)[a-z]+\b[^.]{0,60}\b(?:additive|benefit[a-z]*|efficac[a-z]+|improv[a-z]+)\b"
#: What a frame's sentences have to contain, and what they must not.
MUST = {
    "appositive": any_of("including", "such as"),
    "contradictory": any_of("although", "despite", "even though", "however", "nevertheless", "not been reported"),
    "denial": any_of("neither", "no", "not", "unaffected", "unchanged", "without"),
    "effect_pd": any_of("additive", "antagoni[a-z]+", "blunt[a-z]+", "enhanc[a-z]+", "oppos[a-z]+", "potentiat[a-z]+", "synerg[a-z]+"),
    "effect_protect": any_of("attenuat[a-z]+", "less", "lower", "protect[a-z]+", "reduc[a-z]+"),
    "enzyme_only": any_of("CYP[a-z0-9]*", "OATP[a-z0-9]*", "P-?glycoprotein", "UGT[a-z0-9]*"),
    "incompatible": any_of("cloud[a-z]+", "infusion", "instability", "mix[a-z]+", "precipitat[a-z]+", "solution", "syringe", "unstable"),
    "out_of_scope": any_of("ginkgo", "juice", "liquorice", "meal", "milk", "smoking", "tea", "wort"),
    "sequential": any_of("after", "before", "discontinu[a-z]+", "previously", "stopp[a-z]+", "subsequent[a-z]*", "washout", "withdraw[a-z]+"),
    "title": r"^[^.]{0,60}:",
}
MUST_NOT = {"regimen": ASSERTING, "incompatible": any_of("absorption", "clearance", "in the body", "metaboli[a-z]+", "plasma", "serum", "systemic")} | dict.fromkeys(("effect", "effect_pd", "effect_protect", "effect_failure", "advise", "advise_reason", "coordinate", "appositive"), KINETICS)
