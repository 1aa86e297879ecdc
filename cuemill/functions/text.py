"""Text functions on columns.  Lengths are code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BREAK = "\\N"


def trim_blanks(c: Column) -> Column:
    """Without Unicode blanks (no newlines) at both ends."""
    return F.regexp_replace(c, r"^[\t\p{Zs}]+|[\t\p{Zs}]+$", "")


def trim_all(c: Column) -> Column:
    """Without Unicode white space and newlines at both ends."""
    return F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def unix_newlines(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def to_breaks(c: Column) -> Column:
    return F.replace(c, F.lit("\n"), F.lit(BREAK))


def from_breaks(c: Column) -> Column:
    return F.replace(c, F.lit(BREAK), F.lit("\n"))


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance over the longer length, as float; 0 if equal, 1 if either is empty."""
    ratio = (F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))).cast("float")
    return F.when(a == b, F.lit(0.0).cast("float")).when((F.length(a) == 0) | (F.length(b) == 0), F.lit(1.0).cast("float")).otherwise(ratio)


def wrap_cjk(c: Column, limit: int) -> Column:
    return F.concat(F.substring(c, 1, limit), F.lit("\n"), F.substring(c, limit + 1, 1 << 30))


def wrap_spaced(c: Column, limit: int) -> Column:
    """One break at the blank nearest the middle, of those that leave both sides within limit if any; the first wins ties."""
    n = F.length(c)
    middle = (n / F.lit(2)).cast("int")
    places = F.filter(F.sequence(F.lit(0), n - 1), lambda o: F.substring(c, o + 1, F.lit(1)) == " ")
    fits = F.filter(places, lambda o: (o <= limit) & (n - o - 1 <= limit))
    pool = F.when(F.size(fits) > 0, fits).otherwise(places)
    at = F.array_min(F.transform(pool, lambda o: F.struct(F.abs(o - middle).alias("d"), o.alias("o"))))["o"]
    # no break of a longer text leaves both sides within limit, so only the blanks next to its middle count
    left = F.substring(c, F.lit(1), middle + 1)
    before = F.length(left) - F.length(F.substring_index(left, " ", -1)) - 1
    after = F.call_function("locate", F.lit(" "), c, middle + 1) - 1
    nearest = F.when((before >= 0) & ((after < 0) | (middle - before <= after - middle)), before).when(after >= 0, after)
    at = F.when(n > 2 * limit + 1, nearest).otherwise(at)
    hard = F.concat(F.substring(c, 1, limit), F.lit("\n"), F.substring(c, limit + 1, 1 << 30))
    soft = F.concat(F.substring(c, F.lit(1), at), F.lit("\n"), F.substring(c, at + 2, n))
    return F.when(at.isNull(), hard).otherwise(soft)


def wrap(c: Column, limit: int, separator: str) -> Column:
    return F.when(F.length(c) <= limit, c).otherwise(wrap_cjk(c, limit) if not separator else wrap_spaced(c, limit))


def decode_entities(c: Column) -> Column:
    """CDATA verbatim when the raw text is wrapped in it, else the five named references, ampersands last."""
    inner = F.substring(c, F.lit(10), F.length(c) - 12)
    out = c
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.when(c.startswith("<![CDATA[") & c.endswith("]]>"), inner).otherwise(out)


def let(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _last_wins(pairs: Column) -> Column:
    """Pairs by key; of those with one key the last."""
    numbered = F.transform(pairs, lambda x, i: F.struct(x["k"].alias("k"), i.alias("i"), x["v"].alias("v")))
    kept = lambda got: F.filter(got, lambda x, i: F.coalesce(F.get(got, i + 1)["k"] != x["k"], F.lit(True)))
    return F.transform(let(F.array_sort(numbered), kept), lambda x: F.struct(x["k"].alias("k"), x["v"].alias("v")))


def _extract(c: Column, pattern: str, value) -> Column:
    """Key and value of each match; the whole matches are found once, and each is taken apart by itself."""
    whole = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    pair = lambda m: F.struct(F.regexp_extract(m, pattern, 1).cast("int").alias("k"), value(F.regexp_extract(m, pattern, 2)).alias("v"))
    return _last_wins(F.transform(whole, pair))


# The formats of an item and of a numbered line.
ITEM = r'<item\s+index="(\d+)">([\s\S]*?)</item>'
NUMBERED = r"(?m)^\s*(\d+)\s*[:\-]\s*(.+)$"


def parse_items(c: Column) -> Column:
    """Index and text of <item index="n">…</item> elements by index; a later one of an index wins."""
    return _extract(c, ITEM, lambda v: trim_all(decode_entities(v)))


def parse_numbered(c: Column) -> Column:
    """Index and text of lines such as "0: text" or "1 - text"."""
    return _extract(c, NUMBERED, trim_all)


def strip_fence(c: Column) -> Column:
    """Trimmed; a text that starts with a fence loses its first and last line, unless nothing would be left."""
    t = trim_all(c)
    lines = F.split(t, "\n", -1)
    inner = F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 2, F.lit(0))), "\n")
    return F.when(t.startswith("```") & (F.size(lines) > 2) & (trim_all(inner) != ""), inner).otherwise(t)


def parse_response(c: Column) -> Column:
    """Items, else numbered lines, else null, as an array of (k, v).  Lines are looked for only where there are no items."""

    def parse(t):
        lines = let(parse_numbered(t), lambda x: F.when(F.size(x) > 0, x))
        return let(parse_items(t), lambda x: F.when(F.size(x) > 0, x).otherwise(lines))

    return let(strip_fence(c), parse)


def parse_response_strictly(c: Column) -> Column:
    """parse_response, with an error for a reply that holds neither items nor numbered lines."""
    fail = F.raise_error(F.lit("the reply holds neither items nor numbered lines"))
    return let(parse_response(c), lambda got: F.when(got.isNotNull(), got).otherwise(fail))


def strip_number(c: Column) -> Column:
    """Without a leading number, full stop or bracket, and blank."""
    return F.regexp_replace(c, r"^\p{N}+[.)] ", "")


# Openings that mark a line as commentary of a model.
COMMENTARY = ("here", "sure", "translation", "translations", "output", "note:", "```")


def is_commentary(c: Column) -> Column:
    low = F.lower(c)
    out = F.lit(False)
    for word in COMMENTARY:
        out = out | low.startswith(word)
    return out


def clean_lines(c: Column, expected: Column) -> Column:
    """Lines of a model's reply, brought down to the expected number, or null if there are fewer.

    Blank lines, a fence, commentary at the front and then at the back, and numbers go; of what is
    still too many the last ones stay."""
    lines = F.filter(F.transform(F.split(trim_all(unix_newlines(c)), "\n", -1), trim_all), lambda x: x != "")
    n = F.size(lines)
    fenced = (n >= 3) & F.get(lines, F.lit(0)).startswith("```") & F.get(lines, n - 1).startswith("```")
    lines = F.when(fenced, F.slice(lines, F.lit(2), F.greatest(n - 2, F.lit(0)))).otherwise(lines)

    def drop(acc, x):
        skip = (acc["left"] > expected) & ~acc["met"] & is_commentary(x)
        return F.struct((acc["left"] - skip.cast("int")).alias("left"), (acc["met"] | ~skip).alias("met"), F.when(skip, acc["out"]).otherwise(F.concat(acc["out"], F.array(x))).alias("out"))

    def front(arr):
        zero = F.struct(F.size(arr).alias("left"), F.lit(False).alias("met"), F.array().cast("array<string>").alias("out"))
        return F.aggregate(arr, zero, drop, lambda acc: acc["out"])

    lines = front(F.transform(lines, strip_number))
    lines = F.reverse(front(F.reverse(lines)))
    n = F.size(lines)
    return F.when(n >= expected, F.slice(lines, F.greatest(n - expected, F.lit(0)) + 1, expected))


def batch_line(c: Column, limit: int = 4000) -> Column:
    """One line for a batch: capped, newlines as slashes."""
    return trim_all(F.replace(unix_newlines(F.left(c, F.lit(limit))), F.lit("\n"), F.lit(" / ")))


def numbered_message(lines: Column) -> Column:
    return F.array_join(F.transform(lines, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


# Headings of the message sections.
BEFORE = "[Previous lines — context only, do not translate]"
THIS = "[Translate this line]"
AFTER = "[Following lines — context only, do not translate]"


def context_message(text: Column, before: Column, after: Column, limit: int = 4000) -> Column:
    """The capped text alone, or under a heading between its context lines."""
    capped = F.left(text, F.lit(limit))
    head = F.when(F.size(before) > 0, F.concat(F.lit(BEFORE + "\n"), F.array_join(before, "\n")))
    tail = F.when(F.size(after) > 0, F.concat(F.lit(AFTER + "\n"), F.array_join(after, "\n")))
    full = F.concat_ws("\n\n", head, F.concat(F.lit(THIS + "\n"), capped), tail)
    return F.when((F.size(before) == 0) & (F.size(after) == 0), capped).otherwise(full)


def single_message(text: Column, before: Column, after: Column, limit: int = 4000) -> Column:
    """The prompt for one text: optional context blocks around it, parted by blank lines."""
    head = F.when(F.size(before) > 0, F.concat(F.lit("Context before:\n\n"), F.array_join(before, "\n")))
    tail = F.when(F.size(after) > 0, F.concat(F.lit("Context after:\n\n"), F.array_join(after, "\n")))
    return F.concat_ws("\n\n", head, F.concat(F.lit("Text:\n\n"), F.left(text, F.lit(limit))), tail)


def drop_controls(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def join_url(base: Column, path: Column) -> Column:
    return F.concat(F.regexp_replace(base, "/+$", ""), F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)))


def content_key(*parts: Column) -> Column:
    """Lower-case SHA-256 of the parts joined by a bar."""
    return F.sha2(F.concat_ws("|", *parts).cast("binary"), 256)


# Characters a line, characters a cue and the separator of words, by language.
LOCALES = {"ko": (18, 36, " "), "zh": (18, 36, ""), "ja": (18, 36, ""), "ar": (40, 52, " ")}
DEFAULT_LOCALE = (36, 52, " ")


def locale_limits(locale: str) -> tuple[int, int, str]:
    low = locale.lower()
    return next((v for k, v in LOCALES.items() if low == k or low.startswith((f"{k}-", f"{k}_"))), DEFAULT_LOCALE)
