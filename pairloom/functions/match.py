"""Filters, sets, vectors and labels of matching as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels from the lowest to the highest.
LABELS = ("unqualified", "minimally_qualified", "overqualified", "potentially_qualified", "clearly_qualified")
TOP_LABEL, LOW_LABELS = "clearly_qualified", ("unqualified", "minimally_qualified")


def _open(values: Column) -> Column:
    return values.isNull() | (F.size(values) == 0)


def p_location(places: Column, location: Column) -> Column:
    """No places, no location, or one contains the other, in any case."""
    low = F.lower(location)
    return _open(places) | location.isNull() | F.exists(places, lambda v: F.contains(low, F.lower(v)) | F.contains(F.lower(v), low))


def p_comp(floor: Column, comp_min: Column) -> Column:
    return floor.isNull() | comp_min.isNull() | (comp_min >= floor)


def p_arrangement(wanted: Column, given: Column) -> Column:
    return _open(wanted) | given.isNull() | F.array_contains(wanted, given)


def p_title(families: Column, title: Column) -> Column:
    """The first token of a family (a slash is a blank) stands in the title; % and _ in it are wildcards."""
    def first(v: Column) -> Column:
        return F.split_part(F.replace(v, F.lit("/"), F.lit(" ")), F.lit(" "), F.lit(1))

    return _open(families) | title.isNull() | F.exists(families, lambda v: _ilike(title, F.concat(F.lit("%"), first(v), F.lit("%"))))


def _ilike(text: Column, pattern: Column) -> Column:
    return F.call_function("ilike", text, pattern)


def p_seniority(band: Column, seniority: Column) -> Column:
    return band.isNull() | (band == "") | seniority.isNull() | F.array_contains(F.split(F.lower(band), ","), F.lower(seniority))


def p_live(expires: Column, as_of: Column) -> Column:
    return expires.isNull() | (expires > as_of)


def p_since(since: Column, ingested: Column, extracted: Column) -> Column:
    return since.isNull() | (ingested > since) | F.coalesce(extracted > since, F.lit(False))


def overlap(a: Column, b: Column) -> Column:
    """Bag semantics: equal pairs of elements."""
    return F.coalesce(F.aggregate(a, F.lit(0), lambda s, x: s + F.size(F.filter(b, lambda y: y == x))), F.lit(0)).cast("long")


def jaccard(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    n = F.size(F.array_union(a, b))
    return F.when(n == 0, F.lit(both_empty)).otherwise(F.size(F.array_intersect(a, b)) / n)


def token_jaccard(a: Column, b: Column) -> Column:
    """Of the blank-separated tokens of normalised texts; both empty 1, one empty 0."""
    tokens = [F.array_distinct(F.filter(F.split(x, " "), lambda v: v != "")) for x in (a, b)]
    return jaccard(*tokens, both_empty=1.0)


def dot(a: Column, b: Column) -> Column:
    """Inner product; vectors of different lengths are an error."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of different lengths"))).otherwise(total)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2(a: Column) -> Column:
    """Unit length; a zero vector stays."""
    n = norm(a)
    return F.when(n == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def link_decision(best: Column, second: Column, high: float, threshold: float, margin: float) -> Column:
    """Best at least ``high``, or at least ``threshold`` and ``margin`` ahead of the second; no second is far behind."""
    return (best >= high) | ((best >= threshold) & (best - F.coalesce(second, F.lit(float("-inf"))) >= margin))


def combined_score(similarity: Column, skills: Column) -> Column:
    return 0.7 * F.coalesce(similarity, F.lit(0.0)) + 0.3 * skills


def label_rank(label: Column) -> Column:
    out = F.when(label == LABELS[0], 0)
    for k, name in enumerate(LABELS[1:], 1):
        out = out.when(label == name, k)
    return out


def canon_label(text: Column) -> Column:
    """Trimmed, lower case, blanks and hyphens to underscores; null unless one of the labels."""
    label = F.regexp_replace(F.lower(F.trim(text)), "[ -]", "_")
    return F.when(label.isin(*LABELS), label)


def remap_label(old: Column) -> Column:
    return F.when(old == "pass", "potentially_qualified").when(old == "reject", "unqualified").otherwise(old)


def unmap_label(label: Column) -> Column:
    """The lossy way back: the upper two labels pass, other labels reject."""
    return F.when(label.isin("potentially_qualified", "clearly_qualified"), "pass").when(label.isin(*LABELS), "reject").otherwise(label)


def p_disagree(score: Column, label: Column, high: float = 0.7, low: float = 0.3) -> Column:
    return F.coalesce(((score >= high) & label.isin(*LOW_LABELS)) | ((score <= low) & (label == TOP_LABEL)), F.lit(False))


def texts_match(a: Column, b: Column, threshold: float) -> Column:
    """Normalised texts: both null; equal, one within the other, or tokens similar enough."""
    return F.when(a.isNull() & b.isNull(), True).when(a.isNull() | b.isNull(), False).otherwise(
        (a == b) | F.contains(a, b) | F.contains(b, a) | (token_jaccard(a, b) >= threshold)
    )


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)
