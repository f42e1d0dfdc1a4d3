"""Personal data: pattern spans plus terms that give protected entities away, in DataFrame functions only.

*Patterns.* Emails, IP addresses, card and phone numbers are found leftmost and non-overlapping per kind. Positions come
from the text's pieces between matches, so everything stays inside expressions. Texts without the kind's telltale
characters skip its pattern; the patterns are possessive, so long runs of digits or letters cost linear time. Beside the four base
kinds there are secrets: runs of 20 and more letters, digits and ``+_=-`` with some of both whose letters carry at least 64 bits
(length times the entropy of its own letter counts), which words of a language don't.

*Disclosure.* Protected entities are each value found (normalised), and each kind as a whole. Words (runs of letters) within
``near`` words of a mention co-occur with the value and with its kind; copies of a mention (equal context) count once. For a term t
that supports an entity e in at least ``support`` contexts, the corpus gives p(e | t) = documents with t near e / documents with t,
and the information log2(p(e | t) / p(e)). All of these count documents (distinct pairs of id and text), copies on both sides.
Terms with p >= ``threshold`` (for a kind, ``kind_threshold``) and at least ``bits`` bits of information reveal the entity
wherever they stand: all their occurrences become spans of kind ``term``, to be generalised or removed like the rest.

Only mentions, their context words and per-term counts are shuffled; the corpus is scanned again for the document
counts of candidate terms, and once more for the places of revealing ones, each only if there are any.

Defined results: null texts count as empty; documents that share an id are told apart by their text, rows equal in both
give a row each; null ids stay; overlapping kinds are all reported; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import saved, small

KINDS = ("email", "ip", "card", "phone")
FOUND = (*KINDS, "secret")
#: kind -> (cheap sign that a text may hold one, pattern). \G continues right after the match before.
PATTERNS = {
    "email": ("@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    "card": (r"[0-9](?:[\x20-]?[0-9]){12}", r"[0-9](?:[\x20-]?[0-9]){12,}+"),
    "phone": (r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
    "secret": (r"(?<![A-Za-z0-9+_=-])[A-Za-z0-9+_=-]{20}", r"(?<![A-Za-z0-9+_=-])[A-Za-z0-9+_=-]{20,}+"),
}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
MOST_BROADCAST = 200_000
SECRET_BITS = 64
SPANS = "array<struct<s:int,e:int,v:string>>"


def luhn(digits: Column) -> Column:
    """True if the digit string passes the Luhn check."""

    def add(total: Column, k: Column) -> Column:
        d = F.substring(digits, F.length(digits) - k, F.lit(1)).cast("int") * F.when(k % 2 == 1, F.lit(2)).otherwise(F.lit(1))
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def own_bits(value: Column) -> Column:
    """Length times the entropy of the string's letter counts."""
    letters = F.filter(F.split(value, "", -1), lambda c: c != "")
    counts = F.transform(F.array_distinct(letters), lambda c: F.size(F.filter(letters, lambda v: v == c)).cast("double"))
    n = F.size(letters).cast("double")
    return n * F.log2(n) - F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * F.log2(c))


def holds(kind: str, value: Column) -> Column:
    if kind == "secret":
        return value.rlike("(?:[0-9][^0-9]*){3}") & value.rlike("(?:[A-Za-z][^A-Za-z]*){3}") & (own_bits(value) >= SECRET_BITS)
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return F.length(digits).between(13, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def found(text: Column, pattern: Column) -> Column:
    """Spans (s, e in code points, v) of all matches: the lengths of pieces and matches, added up."""
    values = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))

    def step(acc: Column, v: Column) -> Column:
        s = acc["at"] + v["gap"]
        e = s + F.length(v["v"])
        return F.struct(e.alias("at"), F.array_append(acc["out"], F.struct(s.alias("s"), e.alias("e"), v["v"].alias("v"))).alias("out"))

    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(values)), values, lambda g, v: F.struct(g.alias("gap"), v.alias("v")))
    return F.aggregate(pairs, start, step)["out"]


def base_spans(kind: str, text: Column) -> Column:
    sign, pattern = PATTERNS[kind]
    may = F.contains(text, F.lit(sign)) if kind == "email" else text.rlike(sign)
    return F.when(may, F.filter(found(text, F.lit(pattern)), lambda v: holds(kind, v["v"]))).otherwise(F.array().cast(SPANS))


def words(text: Column) -> Column:
    return F.split(F.lower(text), r"\P{L}+", -1)


def _each(kind: str, f) -> Column:
    """``f(kind, span)`` for each span of the kind's column."""
    return F.transform(kind, lambda v: f(kind, v))


def mentions(spotted: DataFrame, near: int) -> DataFrame:
    """d, x, entity, kind, context (hash), terms: one row per span of ``spotted`` (d, x, t and a span array per kind)."""
    each = spotted.select(
        "d", "x", "t", F.explode_outer(F.concat(*[_each(k, lambda kind, v: F.struct(F.lit(kind).alias("kind"), v["s"].alias("s"), v["e"].alias("e"), v["v"].alias("v"))) for k in FOUND])).alias("m")
    ).where("m is not null")
    room = 24 * near
    from_ = F.greatest(F.col("m.s") - room, F.lit(0))
    left = words(F.substring("t", from_ + 1, F.col("m.s") - from_))
    right = words(F.substring("t", F.col("m.e") + 1, F.lit(room)))
    left = F.slice(left, F.greatest(F.size(left) - near, F.lit(1)), F.lit(near + 1))  # the last piece is empty or joins the span
    context = F.filter(F.concat(left, F.slice(right, 1, near + 1)), lambda w: F.length(w) >= 3)
    value = F.when(F.col("m.kind") == "email", F.lower("m.v")).when(F.col("m.kind") == "secret", F.col("m.v")).otherwise(F.regexp_replace("m.v", "[^0-9.+]", ""))
    return each.select("d", "x", F.concat(F.col("m.kind"), F.lit(":"), value).alias("entity"), F.col("m.kind").alias("kind"), F.array_distinct(context).alias("terms"), F.xxhash64(context).alias("context"))


def revealing_terms(docs: DataFrame, spotted: DataFrame, *, near: int = 5, support: int = 3, threshold: float = 0.5, kind_threshold: float = 0.8, bits: float = 3.0) -> DataFrame:
    """term, entity, p, information: the terms over the disclosure thresholds. ``docs``: d, x, t."""
    spark = docs.sparkSession
    one = F.struct("d", "x")  # never null, so documents without an id count too
    said = mentions(spotted, near).withColumn("entity", F.explode_outer(F.array("entity", "kind"))).drop("kind")
    limit = F.when(F.contains("entity", F.lit(":")), threshold).otherwise(kind_threshold)
    each = said.select("d", "x", "entity", "context", F.explode_outer("terms").alias("term")).where("term is not null")
    pairs = each.groupBy("entity", "term").agg(F.countDistinct("context").alias("contexts"), F.countDistinct(one).alias("n")).where(F.col("contexts") >= support).drop("contexts")
    # a term stands in at least the documents where it stands near any entity: those that can't reach the threshold go now
    least = each.groupBy("term").agg(F.countDistinct(one).alias("least"))
    pairs = saved(pairs.join(least, "term").where(F.col("n") >= F.col("least") * limit).drop("least"), "pairs")
    if pairs.isEmpty():
        return spark.createDataFrame([], "term string, entity string, p double, information double")
    terms = saved(pairs.select("term").distinct(), "terms")
    seen = docs.select("d", "x", F.explode_outer(F.array_distinct(words(F.col("t")))).alias("term"))
    counts = seen.join(small(terms, MOST_BROADCAST), "term").groupBy("term").agg(F.countDistinct(one).alias("df"))
    mentioned = said.groupBy("entity").agg(F.countDistinct(one).alias("ne"))
    total = docs.agg(F.countDistinct(one)).first()[0]
    p = F.col("n") / F.col("df")
    scored = pairs.join(counts, "term").join(mentioned, "entity").select("term", "entity", p.alias("p"), F.log2(p * total / F.col("ne")).alias("information"))
    return scored.where((F.col("p") >= limit) & (F.col("information") >= bits))


def detect(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """One row per row of ``docs``: d (id), t (text), one array of spans (s, e, v) per kind, and ``term``."""
    rows = docs.select(F.col(id_col).alias("d"), F.xxhash64(text_col).alias("x"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    spotted = rows.select("d", "x", "t", *[base_spans(k, F.col("t")).alias(k) for k in FOUND])
    some = spotted.where(F.greatest(*[F.size(k) for k in FOUND]) > 0)
    terms = saved(revealing_terms(rows, some, **limits).groupBy("term").agg(F.max("information").alias("information")), "revealing")
    if terms.isEmpty():
        return spotted.withColumn("term", F.array().cast(SPANS))
    words_of = rows.select("d", "x", F.explode_outer(F.array_distinct(words(F.col("t")))).alias("term"))
    having = words_of.join(small(terms.select("term"), MOST_BROADCAST), "term").groupBy("d", "x").agg(F.sort_array(F.collect_set("term")).alias("terms"))
    having = small(saved(having.withColumnsRenamed({"d": "hd", "x": "hx"}), "having"), MOST_BROADCAST)
    joined = spotted.join(having, F.col("d").eqNullSafe(F.col("hd")) & (F.col("x") == F.col("hx")), "left")
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join("terms", "|"), F.lit(r")(?!\p{L})"))
    spans = F.when(F.col("terms").isNotNull(), found(F.col("t"), pattern)).otherwise(F.array().cast(SPANS))
    return joined.withColumn("term", spans).drop("hd", "hx", "terms")


def listed(kinds: tuple[str, ...]) -> Column:
    parts = [_each(k, lambda kind, v: F.concat(F.lit(kind + ":"), v["s"].cast("string"), F.lit(":"), v["e"].cast("string"))) for k in kinds]
    return F.array_join(F.concat(*parts), ",")


def report(docs: DataFrame, *, id_col: str = "doc_id", **names) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_secret, n_term, n_spans, base_sha256, spans."""
    sizes = {k: F.size(k).cast("long") for k in (*FOUND, "term")}
    return detect(docs, id_col=id_col, **names).select(
        F.col("d").alias(id_col), *[n.alias(f"n_{k}") for k, n in sizes.items()], sum(sizes.values(), F.lit(0)).cast("long").alias("n_spans"),
        F.sha2(listed(KINDS), 256).alias("base_sha256"), listed((*FOUND, "term")).alias("spans"),
    )


def sanitise(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """``id_col`` and ``text_col`` with every span generalised to its kind in brackets; of overlapping spans the first counts."""
    marked = F.concat(*[_each(k, lambda kind, v: F.struct(v["s"].alias("s"), v["e"].alias("e"), F.lit(f"[{kind.upper()}]").alias("v"))) for k in (*FOUND, "term")])
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, v: Column) -> Column:
        new = F.struct(v["e"].alias("at"), F.concat(acc["out"], F.array(F.substring(F.col("t"), acc["at"] + 1, v["s"] - acc["at"]), v["v"])).alias("out"))
        return F.when(v["s"] >= acc["at"], new).otherwise(acc)

    done = F.aggregate(F.array_sort(marked), start, step)
    clean = F.concat(F.array_join(done["out"], ""), F.substring(F.col("t"), done["at"] + 1, F.length("t")))
    return detect(docs, id_col=id_col, text_col=text_col, **limits).select(F.col("d").alias(id_col), clean.alias(text_col))
