"""Text columns of postings and profiles as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Needles of a posting's title, first hit wins.
SENIORITY = (
    ("principal", "principal"), ("staff", "staff"), ("executive", "executive"), ("intern", "intern"), ("junior", "junior"),
    ("senior", "senior"), ("mid-level", "mid"), ("mid level", "mid"), ("mid", "mid"),
)
# Needles of a profile's titles.
PROFILE_SENIORITY = ("principal", "staff", "senior", "lead", "junior", "intern")
# Aliases of seniority.
SENIORITY_ALIASES = {
    "intern": "intern", "internship": "intern", "junior": "junior", "jr": "junior", "entry": "junior", "entry-level": "junior",
    "mid": "mid", "mid-level": "mid", "middle": "mid", "intermediate": "mid", "senior": "senior", "sr": "senior", "staff": "staff",
    "principal": "principal", "lead": "lead", "manager": "lead", "director": "lead",
}
# Title families, first hit wins.
FAMILIES = (
    ("machine learning", "Machine Learning"), ("data scien", "Data Science"), ("data engineer", "Data Engineering"),
    ("backend", "Backend Engineering"), ("frontend", "Frontend Engineering"), ("front-end", "Frontend Engineering"),
    ("full stack", "Full Stack"), ("fullstack", "Full Stack"), ("full-stack", "Full Stack"), ("ios", "Mobile"), ("android", "Mobile"),
    ("mobile", "Mobile"), ("devops", "Platform/SRE"), ("sre", "Platform/SRE"), ("platform", "Platform/SRE"), ("security", "Security"),
    ("product manager", "Product Management"), ("manager", "Engineering Management"), ("director", "Engineering Management"),
    ("engineer", "Software Engineering"), ("developer", "Software Engineering"),
)
# Bands that a seniority widens to.
BANDS = {
    "intern": "intern,junior", "junior": "junior,mid", "mid": "mid,senior", "senior": "mid,senior,staff",
    "staff": "senior,staff,principal", "principal": "staff,principal", "lead": "senior,lead",
}
# Whole lines that say nothing about a posting.
BOILERPLATE = r"(?i)^(?:apply now|submit application|powered by (?:greenhouse|lever|ashby)|equal opportunity employer\.?)\s*$"
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
#: What numeric entities of the C1 range stand for: the characters of Windows-1252 (as browsers read them).
C1 = "".join(bytes([c]).decode("cp1252", "ignore") or chr(c) for c in range(0x80, 0xA0))


def first_needle(text: Column, needles, default: Column | None = None) -> Column:
    """The value of the first needle that the text contains."""
    out = None
    for needle, value in needles:
        hit = F.contains(text, F.lit(needle))
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return out.otherwise(default) if default is not None else out


def lookup(key: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no trailing slashes (the root keeps one), query kept, fragment dropped."""
    url = F.trim(url)
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.rtrim(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.lit("/"))
    query = F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)
    query = F.when(query == "?", "").otherwise(query)
    return F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), query)


def url_hash(url: Column) -> Column:
    return F.sha2(canonical_url(url), 256)


def board_job_id(url: Column) -> Column:
    """Struct (token, job) of a posting's page: an API address, a hosted board, or a list's posting; null elsewhere."""
    hosted = r"(?:/v1/boards/|(?:job-)?boards\.[a-z]+\.io/)/*([^/]+)/jobs/([^/?]+)"
    listed = r"jobs\.[a-z]+\.co/(?:.*/)?([^/]+)/([^/]+?)/*$"
    return F.when(url.rlike(hosted), F.struct(F.regexp_extract(url, hosted, 1).alias("token"), F.regexp_extract(url, hosted, 2).alias("job"))).when(
        url.rlike(listed), F.struct(F.regexp_extract(url, listed, 1).alias("token"), F.regexp_extract(url, listed, 2).alias("job"))
    )


def unescape(text: Column) -> Column:
    """HTML entities decoded once: numeric ones, and the standard's named ones with or, where the standard allows it, without semicolon."""
    import html.entities
    import json

    names = F.from_json(F.lit(json.dumps(html.entities.html5)), "map<string,string>")  # a literal after planning
    parts = F.split(text, "&", -1)

    def letter(code: Column) -> Column:
        wide = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        odd = (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
        void = code.between(1, 8) | code.between(0xE, 0x1F) | code.between(0x7F, 0x9F) | (code == 0xB) | code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
        return F.when(code.isNull() | odd, "\ufffd").when(code == 13, "\r").when(code.between(0x80, 0x9F), F.substring(F.lit(C1), (code - 127).cast("int"), F.lit(1))).when(void, "").otherwise(wide)

    def number(digits: Column, base: int) -> Column:  # more than nine digits are beyond every character
        plain = F.regexp_replace(digits, "^0+(?=.)", "")
        return F.when(F.length(plain) > 9, F.lit(0x110000).cast("long")).otherwise(F.conv(plain, base, 10).cast("long"))

    def one(part: Column) -> Column:
        hexa, deci = r"^(#[xX]([0-9a-fA-F]+);?)", r"^(#([0-9]+);?)"
        name = F.regexp_extract(part, r"^([^\t\n\f <&#;]{1,32};?)", 1)
        found = F.try_element_at(names, name)
        named = F.when(found.isNotNull(), F.concat(found, F.substring(part, F.length(name) + 1, F.length(part))))
        for size in (6, 5, 4, 3, 2):  # names that need no semicolon, the longest first
            short = F.substring(part, 1, size)
            value = F.when(F.length(name) > size, F.try_element_at(names, short))
            named = named.when(value.isNotNull(), F.concat(value, F.substring(part, F.lit(size + 1), F.length(part))))
        rest = [F.substring(part, F.length(F.regexp_extract(part, p, 1)) + 1, F.length(part)) for p in (hexa, deci)]
        return (
            F.when(part.rlike(hexa), F.concat(letter(number(F.regexp_extract(part, hexa, 2), 16)), rest[0]))
            .when(part.rlike(deci), F.concat(letter(number(F.regexp_extract(part, deci, 2), 10)), rest[1]))
            .when(name != "", F.coalesce(named, F.concat(F.lit("&"), part))).otherwise(F.concat(F.lit("&"), part))
        )

    done = F.concat(F.array(F.get(parts, F.lit(0))), F.transform(F.slice(parts, F.lit(2), F.size(parts)), one))
    return F.when(F.contains(text, F.lit("&")), F.array_join(done, "")).otherwise(text)


def drop_boilerplate(lines: Column) -> Column:
    return F.filter(lines, lambda v: ~v.rlike(BOILERPLATE))


def clean_html(html: Column) -> Column:
    """Text of a page: entities decoded, scripts and styles dropped, a new line at block tags, blanks collapsed, no empty
    or boilerplate lines; null for nothing."""
    text = unescape(F.trim(html))
    tagged = F.contains(text, F.lit("<")) & F.contains(text, F.lit(">"))
    bare = F.regexp_replace(text, r"(?is)<(script|style|noscript)\b[^>]*>.*?</\1\s*>", "")
    bare = F.regexp_replace(bare, r"(?i)<(?:p|div|br|li|tr|h[1-6])(?:\s[^>]*)?/?>|</(?:p|div|li|tr)\s*>", "\n")
    bare = unescape(F.regexp_replace(F.regexp_replace(bare, r"(?s)<!--.*?-->", ""), r"<[A-Za-z/!][^>]*>", ""))
    lines = F.split(F.when(tagged, bare).otherwise(text), r"\r\n|[\n\r\x0b\x0c\u0085\u2028\u2029]", -1)
    lines = F.transform(lines, lambda v: F.trim(F.regexp_replace(v, r"[ \t\f\x0b]+", " ")))
    return F.nullif(F.array_join(drop_boilerplate(F.filter(lines, lambda v: v != "")), "\n"), F.lit(""))


def comp_bounds(text: Column) -> Column:
    """Struct (low, high) of a range like "$120k - $150k"; thousands where the text has a k and the number is under 1000."""
    plain = F.replace(text, F.lit(","), F.lit(""))
    pattern = r"\$?\s*(\d+(?:\.\d+)?)\s*[kK]?\s*(?:-|–|—|to)\s*\$?\s*(\d+(?:\.\d+)?)"

    def bound(k: int) -> Column:
        amount = F.nullif(F.regexp_extract(plain, pattern, k), F.lit("")).cast("double")
        return F.floor(F.when(F.contains(F.lower(text), F.lit("k")) & (amount < 1000), amount * 1000).otherwise(amount)).cast("long")

    return F.struct(bound(1).alias("low"), bound(2).alias("high"))


def comp_of(value: Column) -> Column:
    """Struct (low, high) of a variant: a text's range, a number as both, of an object min, minValue or low and max, maxValue or high.

    Of an object's names the first counts that holds something (not null, zero, false or empty). Amounts are cut to whole ones; what is no number gives null.
    """

    def at(x: Column, path: str, kind: str) -> Column:
        return F.try_variant_get(x, path, kind)

    def holds(x: Column) -> Column:
        kind = F.schema_of_variant(x)
        return x.isNotNull() & (kind != "VOID") & (at(x, "$", "string") != "") & ((kind == "STRING") | F.coalesce(at(x, "$", "double") != 0, F.lit(True)))

    def amount(*names: str) -> Column:
        first = F.get(F.filter(F.array(*[at(value, f"$.{n}", "variant") for n in names]), holds), F.lit(0))
        return at(first, "$", "string").try_cast("double").try_cast("long")

    kind = F.schema_of_variant(value)
    text = comp_bounds(at(value, "$", "string"))
    number = at(value, "$", "double").try_cast("long")
    none = F.lit(None).cast("long")

    def end(name: str, *names: str) -> Column:
        return F.when(kind.startswith("OBJECT"), amount(*names)).when(kind == "STRING", text[name]).when(kind.startswith("ARRAY"), none).otherwise(number).alias(name)

    return F.struct(end("low", "min", "minValue", "low"), end("high", "max", "maxValue", "high"))


def title_families(titles: Column) -> Column:
    """The distinct families of an array of titles, in the order they first come; null titles and those without a family have none."""
    return F.array_distinct(F.filter(F.transform(titles, title_family), lambda v: v.isNotNull()))


ARRANGEMENTS = ("remote", "hybrid", "onsite")


def default_filters(titles: Column, families: Column, locations: Column, arrangements: Column, seniority: Column, comp_floor: Column) -> Column:
    """Struct of a profile's first filters: the families given or else those of the titles, places, floor, the band that the seniority widens to,
    and the arrangements given or else all. Empty lists of families and places are null, an empty seniority gives no band."""
    some = lambda c: F.when(F.size(c) > 0, c)
    every = F.array(*map(F.lit, ARRANGEMENTS))
    return F.struct(
        F.coalesce(some(families), some(title_families(titles))).alias("title_families"), some(locations).alias("locations"), comp_floor.alias("comp_floor"),
        F.when(seniority != "", seniority_band(seniority)).alias("seniority_band"), F.coalesce(some(arrangements), every).alias("work_arrangement"),
    )


def parse_ts(text: Column) -> Column:
    """ISO text with Z, an offset or none (then UTC), or epoch milliseconds; null if neither. The session's zone is UTC."""
    millis = F.when(text.rlike(r"^\d{11,}$"), F.timestamp_millis(F.try_to_number(text, F.lit("9" * 18)).cast("long")))
    zoned = F.when(text.rlike(r"(?:[zZ]|[+-]\d{2}:?\d{2})$"), text).otherwise(F.concat(text, F.lit("Z")))
    return F.coalesce(millis, F.try_to_timestamp(zoned))


def normalize_label(text: Column) -> Column:
    """Lower case, anything but letters, digits, _, + and # to a blank, blanks collapsed. Composed letters only: NFKC is
    done where text enters (see operators.linking.nfkc)."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.lower(text)), r"[^\p{L}\p{N}_\s+#]", " "), r"\s+", " "))


def est_tokens(text: Column) -> Column:
    return F.coalesce(F.ceil(F.length(text) / 4), F.lit(0)).cast("long")


def skill_text(label: Column, alts: Column, description: Column) -> Column:
    return F.array_join(F.filter(F.concat(F.array(label), F.coalesce(alts, F.array().cast("array<string>")), F.array(description)), lambda v: F.trim(v) != ""), " | ")


def seniority(title: Column) -> Column:
    return first_needle(F.lower(title), SENIORITY)


def profile_seniority(titles: Column) -> Column:
    blob = F.lower(F.array_join(titles, " "))
    return F.when(F.size(titles) > 0, first_needle(blob, [(n, n) for n in PROFILE_SENIORITY], F.lit("mid")))


def canon_seniority(text: Column) -> Column:
    token = F.lower(F.trim(text))
    return F.nullif(F.coalesce(lookup(token, SENIORITY_ALIASES), token), F.lit(""))


def arrangement(text: Column) -> Column:
    low = F.lower(text)
    hybrid = F.contains(low, F.lit("hybrid"))
    onsite = F.contains(low, F.lit("onsite")) | F.contains(low, F.lit("on-site")) | F.contains(low, F.lit("in office"))
    return F.when(low.rlike(r"\bremote\b"), F.when(hybrid, "hybrid").otherwise("remote")).when(hybrid, "hybrid").when(onsite, "onsite")


def canon_arrangements(values: Column) -> Column:
    table = {"remote": "remote", "hybrid": "hybrid", "onsite": "onsite", "on-site": "onsite"}
    return F.array_distinct(F.array_compact(F.transform(values, lambda v: lookup(F.lower(F.trim(v)), table))))


def title_family(title: Column) -> Column:
    return first_needle(F.lower(title), FAMILIES)


def seniority_band(level: Column) -> Column:
    return F.coalesce(lookup(level, BANDS), level)


def norm_month(text: Column) -> Column:
    """YYYY-MM of "2020-3", "2020", "Mar 2020"; null for now and its like; anything else as it is."""
    raw = F.trim(text)
    names = {m: f"{k:02d}" for k, m in enumerate(MONTHS, 1)} | {m[:3]: f"{k:02d}" for k, m in enumerate(MONTHS, 1)} | {"sept": "09"}
    word = r"^([A-Za-z]{3,9})\.?\s+(\d{4})$"
    month = lookup(F.lower(F.regexp_extract(raw, word, 1)), names)
    iso = r"^(\d{4})[-/](\d{1,2})$"
    return (
        F.when((raw == "") | F.lower(raw).isin("present", "current", "now", "today"), F.lit(None).cast("string"))
        .when(raw.rlike(iso), F.concat(F.regexp_extract(raw, iso, 1), F.lit("-"), F.lpad(F.ltrim(F.regexp_extract(raw, iso, 2), F.lit("0")), 2, "0")))
        .when(raw.rlike(r"^\d{4}$"), F.concat(raw, F.lit("-01")))
        .when(raw.rlike(word) & month.isNotNull(), F.concat(F.regexp_extract(raw, word, 2), F.lit("-"), month))
        .otherwise(raw)
    )


def clip(text: Column, n: int, tail: str = "...") -> Column:
    """Trimmed, at most n characters, the last of them ``tail`` where it was cut."""
    text = F.trim(text)
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - len(tail)), F.lit(tail))).otherwise(text)


def fallback_label(ident: Column) -> Column:
    """"prefix:slug-name" reads "slug name"; other ids stay."""
    return F.when(F.contains(ident, F.lit(":")), F.replace(F.regexp_extract(ident, r"^[^:]*:(.*)$", 1), F.lit("-"), F.lit(" "))).otherwise(ident)


def numbers(text: Column) -> Column:
    """Distinct number tokens without list markers and span ids; commas, dollar and per cent signs removed."""
    # Patterns of span ids, list markers and number tokens.
    bare = F.regexp_replace(F.regexp_replace(text, r"wh:\d+(?::b:\d+)?", " "), r"(?m)^\s*\d+\.\s+", " ")
    found = F.regexp_extract_all(bare, F.lit(r"(?<![\w.])((?:\$\s*)?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?(?:%|[kKmMbB])?)(?![\w.])"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda v: F.lower(F.regexp_replace(v, r"[\s,$%]", ""))))


def comp_range_or_single(text: Column) -> Column:
    """Struct (low, high) of a text: the first range "$120k - $150k" or "$120,000 to 150,000", else the first "$120k" as low.

    An amount under 1000 is in thousands if a k stands within the range's first characters (two before its sign, 24 from it).
    """
    # Patterns of a range and of a single amount.
    span, single = r"\$\s*([\d,]+)\s*[kK]?\s*[–—\-to]+\s*\$?\s*([\d,]+)\s*[kK]?", r"\$\s*([\d,]+)\s*[kK]"

    def money(pattern: str, k: int) -> Column:
        amount = F.nullif(F.replace(F.regexp_extract(text, pattern, k), F.lit(","), F.lit("")), F.lit("")).cast("long")
        at = F.length(F.regexp_extract(text, rf"(?s)^(.*?){pattern}", 1))
        near = F.substring(text, F.greatest(at - 2, F.lit(0)) + 1, at + 24 - F.greatest(at - 2, F.lit(0)))
        return F.when((amount < 1000) & near.rlike("[kK]"), amount * 1000).otherwise(amount)

    is_span = text.rlike(span)
    return F.struct(F.when(is_span, money(span, 1)).otherwise(money(single, 1)).alias("low"), F.when(is_span, money(span, 2)).alias("high"))


def location_line(text: Column) -> Column:
    """The value of the first "Location:" line, without parentheses."""
    raw = F.trim(F.regexp_extract(text, r"(?im)^location\s*:\s*(.+)$", 1))
    bare = F.trim(F.regexp_replace(raw, r"\([^)]*\)", ""))
    return F.nullif(F.coalesce(F.nullif(F.regexp_replace(bare, r"^[ ,]+|[ ,]+$", ""), F.lit("")), raw), F.lit(""))


def title_line(text: Column) -> Column:
    """The first line that isn't blank and doesn't start with "location", up to a dash or bar between blanks."""
    lines = F.filter(F.transform(F.split(text, "\n", -1), lambda v: F.trim(v)), lambda v: (v != "") & ~F.startswith(F.lower(v), F.lit("location")))
    return F.trim(F.get(F.split(F.get(lines, F.lit(0)), r" [—–|-] ", 2), F.lit(0)))


def route_extract(text: Column, done: Column, least: int = 40) -> Column:
    """skipped (extracted before), unparseable (under ``least`` characters once trimmed), else extract."""
    return F.when(F.coalesce(done, F.lit(False)), "skipped").when(F.coalesce(F.length(F.trim(text)), F.lit(0)) < least, "unparseable").otherwise("extract")


def usable(parseable: Column, seniority: Column, low: Column, high: Column, *lists: Column) -> Column:
    """An extraction that could be read and says something: a known seniority, an amount, or an item in any of the lists."""
    some = F.coalesce((F.trim(seniority) != "") & (seniority != "unknown"), F.lit(False)) | low.isNotNull() | high.isNotNull()
    for values in lists:
        some = some | F.coalesce(F.size(values) > 0, F.lit(False))
    return F.coalesce(parseable, F.lit(True)) & some


def route_postings() -> Column:
    """unparseable (no url, blank text), expired (flag or status), else ok, in that order; of columns url, raw_jd, expired, status."""
    blank = F.col("url").isNull() | (F.trim(F.coalesce("raw_jd", F.lit(""))) == "")
    gone = F.coalesce("expired", F.lit(False)) | F.coalesce(F.lower("status").isin("expired", "closed", "archived"), F.lit(False))
    return F.when(blank, "unparseable").when(gone, "expired").otherwise("ok")
