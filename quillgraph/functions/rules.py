"""Rules over names, titles and questions: noise, navigation, regions, limitations, list and cross-vendor wording, time.

Texts are taken as words, and most rules are tables of phrases. In a phrase `a/b` stands for either word, `_` for any
word, `#` for a word that begins with a digit, and `a*` for words that begin with a. Tables are parameters: each function
takes another in place of its own.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[a-z0-9][a-z0-9'-]*"

# Wording of limitations, of questions across vendors, of time, of comparison, and titles of navigation.
LIMITATION = [
    "not supported/available", "unsupported", "is/are/do/does not", "doesn't/don't/can't/cannot", "can not", "only available/supported", "only for/when/if/with/on/in",
]
CROSS_VENDOR = [
    "vendors", "which/what/any/other/different/competing vendor", "across vendors/providers/clouds/platforms/products/solutions", "across _ vendors/providers/clouds/platforms/products/solutions",
    "third-party vendor/vendors/tools/products/solutions/backup", "third party vendor/vendors/tools/products/solutions/backup", "all/other/alternative/competing products/solutions/vendors",
    "all/other/alternative/competing backup products/solutions/vendors",
]
TEMPORAL = ["change/changed/changes/changing", "history", "used to", "since #", "over time", "evolv*", "deprecat*", "no longer", "when did", "previously"]
COMPARING = ["compare/comparison", "across vendors", "all/every/which vendors/vendor"]
NAVIGATION = ["blog/blogs video/videos", "and other resources", "release notes", "what's new", "whats new"]
# What may follow a plural in a question for a list, what makes a question one for a single answer, and
# plurals that name no items.
HELPERS = "does do did can could are were will would should must may might support supports".split()
SINGLE_ANSWER = "is was should does do did can".split()
NO_ITEMS = "advantages benefits considerations differences disadvantages implications reasons steps".split()
# Kinds of names that are noise are told by these words.
RESOURCE_PREFIXES = "ami eni i sg snap subnet vol vpc".split()
ORGANISATION_PREFIXES = "o ou r".split()
COMMANDS = "aws az gcloud kubectl".split()
COMMAND_VERBS = "Add Disable Enable Export Get Import Install New Remove Set Uninstall".split()
FIELD_ENDINGS = "Arn Error Exception Failed Id Name RequestId".split()
TITLE_ENDINGS = ["Administration Guide", "Administrator Guide", "Developer Guide", "Getting Started Guide", "Reference Guide", "User Guide", "API Reference", "Documentation"]
ID_ENDINGS = ["ID", "Identifier"]
#: Proper names that end so.
NOT_IDS = ["OpenID", "WebID"]
#: Words that names of regions begin with beside the region.
CLOUD_WORDS = "aws amazon azure microsoft google gcp oracle oci ibm alibaba".split()
# Words that say nothing about what a question asks for.
STOPWORDS = (
    "a an the and or not of for to in on at by with from into via as is are was were be been can could do does did will would should must may might shall "
    "i you we they it its my our your me us which what where when how who whom whose why list all any every each some there their this that these those "
    "than then also about between other support supports supported supporting provide provides offer offers use uses using allow allows enable enables available possible"
).split()
MODES = ["local", "global", "drift", "timeline"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is computed once."""
    return F.transform(F.array(value), body)[0]


def _plain(text: Column) -> Column:
    return F.translate(F.lower(F.coalesce(text, F.lit(""))), "’", "'")


def words(text: Column) -> Column:
    """Lower-case words; hyphens and apostrophes within them stay. Null has none."""
    return F.regexp_extract_all(_plain(text), F.lit(WORD), F.lit(0))


def _pattern(step: str) -> str:
    if step == "_":
        return "[^ ]+"
    if step == "#":
        return "[0-9][^ ]*"
    return re.escape(step[:-1]) + "[^ ]*" if step.endswith("*") else "(?:" + "|".join(map(re.escape, step.split("/"))) + ")"


def has_phrase(text: Column, phrases: list[str]) -> Column:
    """The text has one of the phrases: one regular expression over its words (as words() has them), each between blanks,
    which none of them holds."""
    if not phrases:
        return F.lit(False)
    found = "|".join(" ".join(map(_pattern, p.split())) for p in phrases)
    return F.concat(F.regexp_replace(_plain(text), "(?:^|[^a-z0-9'-])[^a-z0-9]*", " "), F.lit(" ")).rlike(f" (?:{found}) ")


# Names and titles ----------------------------------------------------------------------------------------------------


def _one_word(n: Column) -> Column:
    return n.rlike("^[A-Z][A-Za-z0-9]*$")


def _ends_in(n: Column, endings: list[str], before: str) -> Column:
    """The name ends in one of them, and what stands before fits the pattern."""
    out = F.lit(False)
    for e in endings:
        out = out | (n.endswith(e) & F.substring(n, F.lit(1), F.length(n) - len(e)).rlike(before))
    return out


def _prefixed(n: Column, prefixes: list[str], rest: str) -> Column:
    """A prefix, a hyphen and a rest that fits the pattern."""
    head = F.substring_index(n, "-", 1)
    return F.lower(head).isin(prefixes) & F.substring(n, F.length(head) + 2, F.length(n)).rlike(rest)


def _is_command(n: Column) -> Column:
    def has(w: Column) -> Column:
        shell = F.exists(F.transform(w, lambda x, i: x.isin(COMMANDS) & F.coalesce(F.get(w, i + 1), F.lit("")).rlike("^[a-z]")), lambda x: x)
        script = F.exists(w, lambda x: F.substring_index(x, "-", 1).isin(COMMAND_VERBS) & F.split_part(x, F.lit("-"), F.lit(2)).rlike("^[A-Z]"))
        option = F.exists(w, lambda x: x.rlike("^--[a-z]"))
        return shell | script | option

    return let(F.split(n, r"\s+"), has) | n.rlike("[$][A-Za-z_]") | F.contains(n, F.lit("`"))


def _is_action(n: Column) -> Column:
    """service:action"""
    service, action = F.split_part(n, F.lit(":"), F.lit(1)), F.split_part(n, F.lit(":"), F.lit(2))
    return (F.size(F.split(n, ":")) == 2) & service.rlike("^[a-z][a-z0-9]{1,20}$") & action.rlike("^[A-Za-z][A-Za-z0-9-]*$")


#: Kinds of names that are noise, in the order in which they are tried; each is told by a function of the trimmed name.
NOISE: list[tuple[str, Callable[[Column], Column]]] = [
    ("blank", lambda n: n == ""),
    ("arn", lambda n: F.lower(n).startswith("arn:")),
    ("resource_id", lambda n: _prefixed(n, RESOURCE_PREFIXES, "^[A-Za-z0-9]{6,}$")),
    ("org_id", lambda n: _prefixed(n, ORGANISATION_PREFIXES, "^[A-Za-z0-9-]+$") & n.rlike("[0-9]")),
    ("number", lambda n: n.rlike("^[0-9]{6,}$")),
    ("invalid_code", lambda n: n.startswith("Invalid") & _one_word(n) & F.substring(n, 8, 1).rlike("[A-Z]")),
    ("command", _is_command),
    ("region", lambda n: F.lower(F.substring_index(n, " ", -1)).isin("region", "regions")),
    ("service_action", _is_action),
    ("api_field", lambda n: _one_word(n) & _ends_in(n, FIELD_ENDINGS, ".")),
    ("document_title", lambda n: _ends_in(n, TITLE_ENDINGS, r"^$|\W$")),
    ("api_id", lambda n: _one_word(n) & _ends_in(n, ID_ENDINGS, "[a-z]$") & ~n.isin(NOT_IDS)),
]


def noise(name: Column) -> Column:
    """The kind of noise that a name is, or null for names to keep."""
    n = F.trim(name)
    kind = F.when(F.lit(False), F.lit(""))
    for rule, fits in NOISE:
        kind = kind.when(fits(n), rule)
    return kind


def is_navigation(title: Column, phrases: list[str] = NAVIGATION) -> Column:
    return has_phrase(title, phrases)


def region_key(name: Column, cloud_words: list[str] = CLOUD_WORDS) -> Column:
    """Lower case, blanks as one, less a leading word of a cloud and a trailing "region", where a word is left."""

    def bare(w: Column) -> Column:
        first = F.when((F.size(w) > 1) & F.get(w, F.lit(0)).isin(cloud_words), 2).otherwise(1)
        return let(F.slice(w, first, F.size(w)), lambda v: F.slice(v, F.lit(1), F.size(v) - ((F.size(v) > 1) & F.get(v, F.size(v) - 1).isin("region", "regions")).cast("int")))

    return F.array_join(let(F.filter(F.split(F.lower(name), r"\s+"), lambda x: x != ""), bare), " ")


def is_limitation(text: Column, phrases: list[str] = LIMITATION) -> Column:
    return has_phrase(text, phrases)


# Questions -----------------------------------------------------------------------------------------------------------


def is_plural(word: Column) -> Column:
    """By its ending; auxiliary verbs are none."""
    return F.coalesce(word.rlike("[^suia]s$") & (F.length(word) > 3) & ~word.isin(HELPERS), F.lit(False)) | F.coalesce(word.rlike("[a-z]{2}as$"), F.lit(False))


def is_list_question(q: Column) -> Column:
    """Asks for items: "which ... plurals do", "what are the plurals", "where can I", "list", "supported plurals"; but not
    "what is", "what should" and the like."""

    def asks(w: Column) -> Column:
        at = lambda k: F.coalesce(F.get(w, F.lit(k)), F.lit(""))
        which = at(0).isin("which", "what")
        followed = F.lit(False)
        for k in range(1, 5):  # up to three words before the plural
            followed = followed | (is_plural(at(k)) & (at(k + 1).isin(HELPERS) | ((at(k + 1) == "is") & (at(k + 2) == "supported"))))
        the = (at(0) == "what") & (at(1) == "are") & (at(2) == "the")
        item = lambda k: is_plural(at(k)) & ~at(k).isin(NO_ITEMS)
        wanted = (which & followed) | (the & (item(3) | item(4)) & ~at(3).isin(NO_ITEMS)) | ((at(0) == "where") & (at(1) == "can") & at(2).isin("i", "you", "we")) | (at(0) == "list") | ((at(0) == "supported") & is_plural(at(1)))
        return wanted & ~(which & at(1).isin(SINGLE_ANSWER))

    return let(words(q), asks)


def is_cross_vendor(q: Column, phrases: list[str] = CROSS_VENDOR) -> Column:
    return has_phrase(q, phrases)


def opens_subject(before: Column) -> Column:
    """Whether what stands before a name in a question makes it the subject of what vendors do: "which vendors does",
    with up to two words between."""

    def opens(w: Column) -> Column:
        last = lambda k: F.coalesce(F.get(w, F.size(w) - k), F.lit(""))
        asks = last(3).isin("which", "what") | last(4).isin("which", "what") | last(5).isin("which", "what")
        return (last(1).isin("is", "was", "has", "have", *HELPERS)) & last(2).isin("vendor", "vendors") & asks

    return let(words(before), opens)


def mode(q: Column, override: Column, classified: Column, default: str = "drift") -> Column:
    """The retrieval mode of a question: an override that names a mode, wording of time, wording of comparison, what a
    classifier said (a seam: any column of text, null if it said nothing), else the default."""
    said = F.lower(F.trim(classified))
    first = F.when(F.lit(False), F.lit(""))
    for m in MODES:
        first = first.when(F.contains(said, F.lit(m)), m)
    return F.when(override.isin(MODES), override).when(has_phrase(q, TEMPORAL), "timeline").when(has_phrase(q, COMPARING), "global").otherwise(F.coalesce(first, F.lit(default)))


def question_terms(q: Column, drop: Column) -> Column:
    """The question's distinctive words, each once and in order: no stopwords, none of `drop` (an array: words of the
    scope's names)."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(q), F.lit(r"[a-z0-9][a-z0-9_-]*"), F.lit(0)))
    return F.filter(found, lambda w: ~w.isin(STOPWORDS) & ~F.array_contains(drop, w))


# Suffixes that a stem lacks, in the order in which they are tried.
SUFFIXES = ["ility", "ations", "ation", "ions", "ion", "ings", "ing", "ies", "es", "ed", "er", "s", "e", "y"]


def stem_of(word: Column) -> Column:
    """The word less the first suffix that leaves four letters or more (-ies as -y)."""
    out = word
    for suffix in reversed(SUFFIXES):
        bare = F.concat(F.substring(word, F.lit(1), F.length(word) - len(suffix)), F.lit("y" if suffix == "ies" else ""))
        out = F.when(word.endswith(suffix) & (F.length(bare) >= 4), bare).otherwise(out)
    return out


def word_forms(word: Column) -> Column:
    """The word, its plural or, if it ends in s and is longer than four letters, its singular, and -ed and -ing of the
    stem where that is shorter."""
    single = word.endswith("s") & (F.length(word) > 4)
    plural = F.concat(word, F.when(word.rlike("(s|x|z|ch|sh)$"), "es").otherwise("s"))
    base = F.when(single, F.substring(word, F.lit(1), F.length(word) - 1)).otherwise(word)
    bare = stem_of(base)
    verbs = F.when(bare != base, F.array(F.concat(bare, F.lit("ed")), F.concat(bare, F.lit("ing")))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(word, F.when(single, base).otherwise(plural)), verbs))


# Markers of citations, as [3] or [1, 2] ------------------------------------------------------------------------------


def single_markers(text: Column) -> Column:
    """Lists of markers as single ones: `[1, 2]` as `[1] [2]`, `[ 9 ]` as `[9]`."""
    inner = F.regexp_replace(text, r"\[\s*([0-9]+(?:\s*,\s*[0-9]+)*)\s*\]", "[$1]")
    return F.regexp_replace(inner, r"(?<=[0-9])\s*,\s*(?=[0-9]+(?:\s*,\s*[0-9]+)*\])", "] [")


def marker_numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"\[([0-9]+)\]"), F.lit(1)), lambda x: x.cast("int"))


def markers_per_sentence(text: Column) -> Column:
    """Markers of each sentence that has any, in order; markers that begin a sentence count for the one before."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+|\n+", -1), F.trim), lambda s: s != "")
    count = lambda s: F.size(F.regexp_extract_all(s, F.lit(r"\[([0-9]+)\]"), F.lit(1)))
    counts = F.transform(parts, lambda s: F.struct(count(s).alias("n"), count(F.regexp_extract(s, r"^((?:\[[0-9]+\]\s*)+)", 1)).alias("lead")))
    # A part that is all markers gives them to the one before.
    moved = lambda c: F.transform(c, lambda x, i: x["n"] - F.when(i > 0, x["lead"]).otherwise(0) + F.coalesce(F.get(c, i + 1)["lead"], F.lit(0)))
    return F.filter(let(counts, moved), lambda x: x > 0)


def bag_share(text: Column, bag: int = 8) -> Column:
    """The share of markers in sentences that have `bag` or more; null without markers."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    return let(markers_per_sentence(text), lambda n: F.try_divide(total(F.filter(n, lambda x: x >= bag)).cast("double"), total(n)))
