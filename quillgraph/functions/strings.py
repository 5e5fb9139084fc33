"""String functions on columns: normal forms, tokens, markers, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[a-z0-9]+"


def fact_text_key(text: Column) -> Column:
    """Lower case, anything but letters and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def name_key(name: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(name, r"\s+", " ")))


def token_key(name: Column) -> Column:
    """Tokens joined by a space, with & as and: equal for names that differ in punctuation only."""
    return F.array_join(tokens(F.regexp_replace(name, "&", " and ")), " ")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def approx_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def stem(word: Column) -> Column:
    """The word less one common suffix, if four letters or more stay."""
    out = word
    for suffix in ("s", "es", "ed", "ing", "ation", "ations"):  # the last that fits wins: longer ones come later
        cut = F.substring(word, 1, F.length(word) - len(suffix))
        out = F.when(word.endswith(suffix) & (F.length(word) - len(suffix) >= 4), cut).otherwise(out)
    return out


def expand_marker_lists(text: Column) -> Column:
    """`[1, 2]` as `[1] [2]`, for lists of up to any length."""
    spaced = F.regexp_replace(text, r"\[(\d+(?:\s*,\s*\d+)+)\]", "[$1]")
    return F.regexp_replace(spaced, r"(?<=\d)\s*,\s*(?=\d+(?:\s*,\s*\d+)*\])", "] [")


def markers(text: Column) -> Column:
    """Numbers of citation markers, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("int"))


def community_id(level: Column, members: Column) -> Column:
    """16 hex digits of a hash over level and sorted members."""
    return F.substring(F.sha1(F.concat(level.cast("string"), F.lit(":"), F.array_join(F.array_sort(members), ","))), 1, 16)


def hash_fraction(key: Column) -> Column:
    """A fixed number from 0 to 1 for each key: the first 32 bits of its SHA-256."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double") / 4294967295.0


def cursor_seq(cursor: Column) -> Column:
    """The sequence number in an opaque feed cursor (base64 of JSON)."""
    return F.get_json_object(F.unbase64(cursor).cast("string"), "$.seq").cast("long")


def strip_tags(html: Column) -> Column:
    """Text of a page: no scripts, styles or comments, tags as spaces, white space as one space."""
    bare = F.regexp_replace(html, r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "<[^>]*>", " "), r"[ \t\r\n]+", " "))


def page_title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1)


def backoff(attempts: Column, base: float = 30.0, cap: float = 3600.0) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempts - 1), F.lit(cap))


def strip_markers(text: Column, keep: Column) -> Column:
    """The text without the markers `[N]` whose N is not in `keep`, and with its spacing repaired. A dash that joined a
    marker to one that went goes with it; line breaks and indentation stay."""
    bare = F.regexp_replace(text, "\x01", "")
    parts, marks = F.split(bare, r"\[[0-9]+\]", -1), F.regexp_extract_all(bare, F.lit(r"\[([0-9]+)\]"), F.lit(1))
    mark = lambda m: F.when(m.isNull(), "").when(F.array_contains(keep, m.cast("int")), F.concat(F.lit("["), m, F.lit("]"))).otherwise("\x01")
    out = F.array_join(F.zip_with(parts, marks, lambda p, m: F.concat(p, mark(m))), "")  # the last part has no mark
    out = F.regexp_replace(out, "\x01[ \t]*[-–—][ \t]*(?=\\[[0-9]+\\]|\x01)", "\x01")
    out = F.regexp_replace(out, "(\\[[0-9]+\\])[ \t]*[-–—][ \t]*(?=\x01)", "$1")
    out = F.regexp_replace(out, "[ \t]*\x01[ \t]*", " ")
    out = F.regexp_replace(out, r"(?<=\S)[ \t]{2,}", " ")
    out = F.regexp_replace(out, r"[ \t]+([.,;:!?])", "$1")
    return F.trim(F.regexp_replace(out, r"[ \t]+\n", "\n"))


def hmac_sha256(key: str, body: Column) -> Column:
    """Hexadecimal HMAC of a text under a key of up to 64 bytes."""
    raw = key.encode()
    if len(raw) > 64:
        raise ValueError("keys have 64 bytes at most")
    padded = raw.ljust(64, b"\0")
    inner, outer = (bytes(b ^ x for b in padded) for x in (0x36, 0x5C))
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), body.cast("binary")), 256))), 256)


def json_object(text: Column) -> Column:
    """What stands from the first brace to the last one: a JSON object within prose, or null."""
    found = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(found != "", found)


def iso_time(text: Column) -> Column:
    """An ISO 8601 date or time (Z or no zone: UTC), or null for anything else."""
    bare = F.regexp_replace(F.regexp_replace(text, "Z$", ""), "T", " ")
    return F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2})?Z?)?$"), bare.try_cast("timestamp_ntz"))


def common_suffix(a: Column, b: Column) -> Column:
    """The longest ending that two texts share."""
    x, y = (F.split(F.reverse(F.coalesce(c, F.lit(""))), "", -1) for c in (a, b))
    same = F.zip_with(x, y, lambda p, q: p.eqNullSafe(q) & (p != "") & q.isNotNull())
    n = F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, e: F.struct((s["n"] + (s["on"] & e).cast("int")).alias("n"), (s["on"] & e).alias("on")), lambda s: s["n"])
    return F.when(n > 0, F.right(a, n)).otherwise("")
