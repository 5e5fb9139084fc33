"""License scans: normalised segments of a text compared to license templates by Dice coefficient of word bigrams.

Segments are sentences, paragraphs and the whole text. Templates are notices, headers, whole license texts (the files
of `license_texts`), and each paragraph of the short ones, so that a license within a longer text is found by its parts.
Size bounds prune first: a Dice coefficient of t or more needs
bigram counts within t / (2 - t) of each other, whichever is larger. Before texts are cut up at all, screens look for
words, then bigrams, of which every match must hold one: a match shares at least t / (2 - t) of a template's bigrams,
so that it can't lack all of any larger rest.

Native expressions within each row: one pass with no shuffle and no join.
"""

from __future__ import annotations

import functools
import math
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Notices and headers as their licenses suggest them, or as they are commonly given.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "reserved": "All rights reserved.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Apache-2.0-header-warranty": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
for _k, _v in _CC.items():
    TEMPLATES["CC-BY-NC-4.0-work" if _k == "BY-NC" else f"CC-{_k}-4.0"] = f"This work is licensed under a Creative Commons {_v} 4.0 International License."
    TEMPLATES["CC-BY-NC-4.0" if _k == "BY-NC" else f"CC-{_k}-4.0-name"] = f"Licensed under CC {_k} 4.0."
    TEMPLATES[f"CC-{_k}-4.0-notice"] = f"This work is licensed under the Creative Commons {_v} 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/{_k.lower()}/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA."
_GNU = {"GPL-2.0": ("", "2"), "GPL-3.0": ("", "3"), "LGPL-2.1": ("Lesser ", "2.1"), "LGPL-3.0": ("Lesser ", "3"), "AGPL-3.0": ("Affero ", "3")}
for _k, (_kind, _n) in _GNU.items():
    TEMPLATES[f"{_k}-header"] = f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {_kind}General Public License as published by the Free Software Foundation, either version {_n} of the License, or (at your option) any later version."
    TEMPLATES[f"{_k[:-4]}-header-warranty"] = f"This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {_kind}General Public License for more details."
    TEMPLATES[f"{_k}-header-whole"] = f"{TEMPLATES[f'{_k}-header']} {TEMPLATES[f'{_k[:-4]}-header-warranty']} You should have received a copy of the GNU {_kind}General Public License along with this program. If not, see https://www.gnu.org/licenses/."
TEMPLATES["Apache-2.0-header-whole"] = f"{TEMPLATES['Apache-2.0-header']} {TEMPLATES['Apache-2.0-header-warranty']}"

SENTENCE_END = r"[.!?][ \t\r]+|\n+"
PARAGRAPH_END = r"\n[ \t\r]*\n"
MOST_SCREEN_WORDS = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", text.translate(str.maketrans(_UPPER, _LOWER))).strip()


def _bigrams(text: str) -> list[str]:
    w = _words(text).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:], strict=False)))


def _whole_texts() -> dict[str, str]:
    """Whole licenses, and paragraphs and numbered clauses of those of up to 300 words; as words, parted by blanks. A
    part that several licenses have is named after all of them."""
    out: dict[str, str] = {}
    parts: dict[str, list[str]] = {}
    for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
        text = path.read_text(encoding="utf-8")
        out[path.stem] = _words(text)
        if len(text.split()) <= 300:
            for p in dict.fromkeys(map(_words, [*re.split(PARAGRAPH_END, text), *re.split(PARAGRAPH_END + r"|\n(?=[0-9]\. )", text)])):
                if len(_bigrams(p)) >= 10:
                    parts.setdefault(p, []).append(path.stem.removesuffix("-text"))
    count: dict[str, int] = {}
    for p, stems in parts.items():
        name = " or ".join(stems)
        count[name] = count.get(name, 0) + 1
        out[f"{name}-part-{count[name]}"] = p
    return out


TEMPLATES |= _whole_texts()


def _any_of(words: set[str]) -> str:
    """A pattern for any of the words that looks at each character once."""
    heads: dict[str, set[str]] = {}
    for w in words - {""}:
        heads.setdefault(w[0], set()).add(w[1:])
    parts = [re.escape(c) + (_any_of(rest) if rest != {""} else "") for c, rest in sorted(heads.items())]
    return ("(?:" + "|".join(parts) + ")" if len(parts) > 1 else "".join(parts)) if "" not in words else "(?:" + "|".join([*parts, ""]) + ")"


def _screening(templates: dict[str, list[str]], least: float) -> set[str]:
    """Any match of a template holds one of these bigrams: of each template those that were taken already, then the
    longest, one more than it can lack."""
    out: set[str] = set()
    for grams in sorted(templates.values(), key=len):
        needed = len(grams) - math.ceil(least / (2 - least) * len(grams) - 1e-9) + 1
        out.update(sorted(grams, key=lambda g: (g not in out, -len(g), g))[:needed])
    return out


def _screen_words(bigrams: set[str]) -> list[str]:
    """Strings of which every text with one of the bigrams has one: their longer words, less those that hold another."""
    longer = {max(g.split(" "), key=len) for g in bigrams}
    return sorted(w for w in longer if not any(o != w and o in w for o in longer))


def _screen(bigrams: set[str]) -> str:
    """A pattern for the bigrams (in lower case, words apart by anything but letters and digits)."""
    some: dict[str, set[str]] = {}
    for g in sorted(bigrams):
        first, second = g.split(" ")
        some.setdefault(first, set()).add(second)
    # First words by their letter, so that most positions fail at once.
    by_letter: dict[str, list[str]] = {}
    for first, seconds in sorted(some.items()):
        by_letter.setdefault(first[0], []).append(first[1:] + "[^a-z0-9]+" + _any_of(seconds))
    return "(?<![a-z0-9])(?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in sorted(by_letter.items())) + ")(?![a-z0-9])"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(text, _UPPER, _LOWER), "[^a-z0-9]+", " "))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, least: float = 0.8) -> DataFrame:
    """One row per row of docs: id and matches: array of segment (normalised), license and dice, for each different
    segment that has a Dice coefficient of `least` or more with a template; the best one, of equals the first by name.

    Null, empty and one-word texts have no matches; templates of one word can't match. Repeated rows are scanned each;
    other columns are ignored and may have any names. Letters other than A-Z and digits part words.
    """
    grams = {k: g for k, v in sorted((templates or TEMPLATES).items()) if (g := _bigrams(v))}
    empty = F.array().cast("array<struct<segment:string,license:string,dice:double>>")
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    if not grams:
        return rows.select(F.col("_id").alias(id_col), empty.alias("matches"))
    bound = least / (2 - least)
    low, high = min(len(g) for g in grams.values()) * bound, max(len(g) for g in grams.values()) / bound
    text = F.col("_text")
    segments = F.array_distinct(F.transform(F.concat(F.split(text, SENTENCE_END, -1), F.split(text, PARAGRAPH_END, -1), F.array(text)), normalised))

    def of(w: Column) -> Column:
        pairs = F.transform(F.slice(w, 2, F.size(w) - 1), lambda b, i: F.concat_ws(" ", F.get(w, i), b))
        return F.struct(F.array_join(w, " ").alias("segment"), F.array_distinct(pairs).alias("grams"))

    # Words are split once, as the variable of a lambda is evaluated once. Repeats only make sets smaller, so that few
    # words are a bound; many words are none.
    split = F.filter(F.transform(segments, lambda s: F.split(s, " ")), lambda w: F.size(w) - 1 >= low - 1e-9)
    cut = F.filter(F.transform(split, of), lambda s: (F.size(s["grams"]) >= low - 1e-9) & (F.size(s["grams"]) <= high + 1e-9))
    rows = rows.select("*", F.lower(text).alias("_low"))
    screening = _screening(grams, least)
    passes = F.col("_low").rlike(_screen(screening))
    if len(words := _screen_words(screening)) <= MOST_SCREEN_WORDS:  # with more, the pattern alone is faster
        passes = functools.reduce(lambda a, b: a | b, [F.contains(F.col("_low"), F.lit(w)) for w in words]) & passes
    rows = rows.select("_id", F.when(passes, cut).alias("_cut"))

    def best(s: Column) -> Column:
        n = F.size(s["grams"])
        options = [
            F.when(
                (n >= len(g) * bound - 1e-9) & (n <= len(g) / bound + 1e-9),
                F.struct((F.size(F.array_intersect(s["grams"], F.split(F.lit("\n".join(g)), "\n"))) * 2.0 / (n + len(g))).alias("dice"), F.lit(-i).alias("order")),
            )
            for i, g in enumerate(grams.values())
        ]
        top = F.greatest(*options) if len(options) > 1 else options[0]
        names = F.array(*map(F.lit, grams))
        return F.struct(s["segment"].alias("segment"), F.element_at(names, 1 - top["order"]).alias("license"), top["dice"].alias("dice"))

    matches = F.filter(F.transform("_cut", best), lambda m: m["dice"] >= least - 1e-9)
    return rows.select(F.col("_id").alias(id_col), F.coalesce(matches, empty).alias("matches"))
