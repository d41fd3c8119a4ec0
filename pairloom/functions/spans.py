"""Entity spans in text: rendering, masking, reading markers back, numbering, pair structure."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import AFOREMENTIONED, ANAPHORA, CONTRAST, COORDINATION  # noqa: F401

MARKER = r"\[/?E[12]\]"
SPANS = "array<struct<begin:int,end:int>>"


def _span(k: str) -> str:
    """A pattern for the k-th marked span with its tags."""
    opening, closing = (rf"\[{slash}E{k}\]" for slash in ("", "/"))
    return f"(?s){opening}.*?{closing}"


def _put(text: Column, edits: Column) -> Column:
    """Edits (begin, end, with, ord) from right to left; at one place the first listed comes first and so ends up last."""
    order = F.array_sort(edits, lambda a, b: F.when(a["begin"] != b["begin"], b["begin"] - a["begin"]).otherwise(a["ord"] - b["ord"]))
    return F.aggregate(order, text, lambda acc, e: F.concat(F.substring(acc, F.lit(1), e["begin"]), e["with"], F.substring(acc, e["end"] + 1, F.length(acc))))


def _plain(text: Column, b1: Column, e1: Column, b2: Column, e2: Column, around: tuple[str, str, str, str], keep: bool, other: Column) -> Column:
    """Text with the first span, then the second, between what stands around them; other where they are empty, touch or stand otherwise.

    Nearly all pairs are of this kind, and here no function runs for each edit.
    """
    one = lambda a, b, first, second: F.concat(
        F.substring(text, F.lit(1), a[0]), F.lit(first[0]), *([F.substring(text, a[0] + 1, a[1] - a[0])] if keep else []), F.lit(first[1]),
        F.substring(text, a[1] + 1, b[0] - a[1]), F.lit(second[0]), *([F.substring(text, b[0] + 1, b[1] - b[0])] if keep else []), F.lit(second[1]), F.substring(text, b[1] + 1, F.length(text)),
    )
    first, second = around[:2], around[2:]
    apart = lambda a, b: (F.lit(0) <= a[0]) & (a[0] < a[1]) & (a[1] < b[0]) & (b[0] < b[1]) & (b[1] <= F.length(text))
    return F.when(apart((b1, e1), (b2, e2)), one((b1, e1), (b2, e2), first, second)).when(apart((b2, e2), (b1, e1)), one((b2, e2), (b1, e1), second, first)).otherwise(other)


def _edit(begin: Column, end: Column, put: str, at: int) -> Column:
    return F.struct(begin.cast("int").alias("begin"), end.cast("int").alias("end"), F.lit(put).alias("with"), F.lit(at).alias("ord"))


def marked(text: Column, b1: Column, e1: Column, b2: Column, e2: Column) -> Column:
    """Both spans between their tags; nested and touching spans are fine."""
    b1, e1, b2, e2 = (c.cast("int") for c in (b1, e1, b2, e2))
    any_order = _put(text, F.array(_edit(b1, b1, "[E1]", 0), _edit(e1, e1, "[/E1]", 1), _edit(b2, b2, "[E2]", 2), _edit(e2, e2, "[/E2]", 3)))
    return _plain(text, b1, e1, b2, e2, ("[E1]", "[/E1]", "[E2]", "[/E2]"), True, any_order)


def masked(text: Column, b1: Column, e1: Column, b2: Column, e2: Column, others: Column | None = None) -> Column:
    """drug1 and drug2 in place of the spans, drug0 of the others clear of both; null where spans overlap."""
    b1, e1, b2, e2 = (c.cast("int") for c in (b1, e1, b2, e2))
    edits = F.array(_edit(b1, e1, "drug1", 0), _edit(b2, e2, "drug2", 1))
    if others is None:
        return _plain(text, b1, e1, b2, e2, ("drug1", "", "drug2", ""), False, F.when(~overlapping(edits), _put(text, edits)))
    clear = lambda x: ((x["end"] <= b1) | (x["begin"] >= e1)) & ((x["end"] <= b2) | (x["begin"] >= e2))
    rest = F.transform(F.filter(others, clear), lambda x: F.struct(x["begin"].cast("int").alias("begin"), x["end"].cast("int").alias("end"), F.lit("drug0").alias("with"), F.lit(2).alias("ord")))
    edits = F.concat(edits, rest)
    return F.coalesce(_replaced(text, edits), F.when(~overlapping(edits), _put(text, edits)))


def _replaced(text: Column, edits: Column) -> Column:
    """Edits that replace something and stand clear of each other, in one pass from left to right; null where any doesn't."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, e: Column) -> Column:
        fine = (e["begin"] >= acc["at"]) & (e["begin"] < e["end"])
        return F.when(fine, F.struct(e["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, e["begin"] - acc["at"]), e["with"]).alias("out")))

    return F.aggregate(F.sort_array(edits), start, step, lambda acc: F.when(acc["at"] <= F.length(text), F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))))


def overlapping(spans: Column) -> Column:
    """Whether, by begin, any span starts before the one before it ends."""
    start = F.struct(F.lit(-1).alias("end"), F.lit(False).alias("bad"))
    order = F.array_sort(spans, lambda a, b: a["begin"] - b["begin"])
    return F.aggregate(order, start, lambda acc, s: F.struct(s["end"].alias("end"), (acc["bad"] | (s["begin"] < acc["end"])).alias("bad")), lambda acc: acc["bad"])


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, MARKER, "")


def tags(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(MARKER), F.lit(0))


def maskable(text: Column) -> Column:
    """Whether the tags stand as two spans, one after the other."""
    order = F.array_join(tags(text), "")
    return order.isin("[E1][/E1][E2][/E2]", "[E2][/E2][E1][/E1]")


def masked_text(text: Column) -> Column:
    """Marked spans replaced by drug1 and drug2; null where the tags don't allow it."""
    out = text
    for k in "12":
        out = F.regexp_replace(out, _span(k), f"drug{k}")
    return F.when(text.rlike(_in_order("1", "2")) | text.rlike(_in_order("2", "1")), out)


def marked_spans(text: Column) -> Column:
    """array<struct<begin, end>> of the marked spans in the stripped text, sorted.

    A closing tag ends what was opened last, whichever number it has, as the tags are read
    from left to right.  Where the tags are one span after the other, which one pass of a
    pattern says, their places alone tell the spans.
    """
    at = lambda tag: F.instr(text, tag) - 1
    two = lambda a, b: F.array(*(F.struct((at(f"[E{k}]") - less).cast("int").alias("begin"), (at(f"[/E{k}]") - less - 4).cast("int").alias("end")) for k, less in ((a, 0), (b, 9))))
    return F.when(text.rlike(_in_order("1", "2")), two("1", "2")).when(text.rlike(_in_order("2", "1")), two("2", "1")).otherwise(_read_spans(text))


def _in_order(*ks: str) -> str:
    """A pattern for whole texts whose tags are those of the spans ks, one after the other."""
    no_tag = r"[^\[]*+(?:\[(?!/?E[12]\])[^\[]*+)*+"
    return r"\A" + no_tag + "".join(rf"\[E{k}\]{no_tag}\[/E{k}\]{no_tag}" for k in ks) + r"\z"


def _read_spans(text: Column) -> Column:
    """Spans by reading the tags one by one."""
    pieces = F.split(text, MARKER)
    found = tags(text)
    start = F.expr(f"named_struct('at', 0, 'open', cast(null as int), 'out', cast(array() as {SPANS}))")
    both = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, lambda p, t: F.struct(F.length(p).alias("n"), t.alias("t")))

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + x["n"]
        closing = x["t"].startswith("[/")
        return F.struct(at.alias("at"), F.when(closing, acc["open"]).otherwise(at).alias("open"), F.when(closing, F.concat(acc["out"], F.array(F.struct(acc["open"].alias("begin"), at.alias("end"))))).otherwise(acc["out"]).alias("out"))

    return F.array_sort(F.aggregate(both, start, step, lambda acc: acc["out"]))


def numbered(text: Column, spans: Column) -> Column:
    """[i] after the i-th span, from 1; spans are sorted."""
    order = F.reverse(F.transform(spans, lambda s, i: F.struct(s["end"].alias("end"), (i + 1).alias("i"))))
    return F.aggregate(order, text, lambda acc, s: F.concat(F.substring(acc, F.lit(1), s["end"]), F.lit("["), s["i"].cast("string"), F.lit("]"), F.substring(acc, s["end"] + 1, F.length(acc))))


def near_marker(text: Column, chars: int = 60) -> Column:
    """Text up to so many characters on each side of either marked span, tags counted, the two joined by a space."""

    def window(k: int) -> Column:
        found = F.regexp_extract(text, _span(str(k)), 0)
        at = F.instr(text, f"[E{k}]")
        first = F.greatest(F.lit(1), at - chars)
        return F.when(found != "", F.substring(text, first, at - first + F.length(found) + chars))

    return F.concat_ws(" ", window(1), window(2))


def between(text: Column, b1: Column, e1: Column, b2: Column, e2: Column) -> Column:
    """Text strictly between two spans, whichever comes first; empty where they touch or overlap."""
    first_end, second = F.when(b1 <= b2, e1).otherwise(e2), F.greatest(b1, b2)
    return F.when(second > first_end, F.substring(text, first_end + 1, second - first_end)).otherwise("")


def pair_flags(gap: Column, group1: Column, group2: Column, degree1: Column, degree2: Column) -> Column:
    """array of coordination, group_member, contrast and hub, or incidental alone."""
    flag = lambda cond, name: F.when(cond, F.lit(name))
    found = F.array_compact(F.array(flag(F.trim(gap).rlike(COORDINATION), "coordination"), flag(group1 != group2, "group_member"), flag(gap.rlike(CONTRAST), "contrast"), flag((degree1 >= 2) | (degree2 >= 2), "hub")))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("incidental")))


def primary_flag(flags: Column) -> Column:
    out = F.lit("incidental")
    for name in ("contrast", "coordination", "group_member", "hub"):
        out = F.when(F.array_contains(flags, name), name).otherwise(out)
    return out


def entity_bucket(n: Column) -> Column:
    names = [(2, 2, "2-2"), (3, 3, "3-3"), (4, 5, "4-5"), (6, 9, "6-9"), (10, 19, "10-19")]
    out = F.when(n >= 20, "20+").otherwise("other")
    for lo, hi, name in names:
        out = F.when(n.between(lo, hi), name).otherwise(out)
    return out


def pair_bucket(n: Column) -> Column:
    return F.when(n == 1, "1").when(n <= 3, "2-3").when(n <= 9, "4-9").otherwise("10+")
