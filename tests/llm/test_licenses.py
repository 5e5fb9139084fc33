import random
import re

from quillgraph.llm.licenses import TEMPLATES, scan_licenses


def grams(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    w = re.sub(r"[^a-z0-9]+", " ", low).split()
    return {(a, b) for a, b in zip(w, w[1:], strict=False)}, " ".join(w)


def brute(text, templates, least=0.8):
    """All segments against all templates."""
    text = text or ""
    segments = {grams(s)[1]: grams(s)[0] for part in (re.split(r"[.!?][ \t\r]+|\n+", text), re.split(r"\n[ \t\r]*\n", text), [text]) for s in part}
    out = []
    for name, s in segments.items():
        best = None
        for k in sorted(templates):
            t = grams(templates[k])[0]
            if s and t:
                dice = 2 * len(s & t) / (len(s) + len(t))
                if dice >= least - 1e-9 and (best is None or dice > best[1] + 1e-12):
                    best = (k, dice)
        if best:
            out.append((name, best[0], round(best[1], 6)))
    return sorted(out)


def test_matches_are_those_of_all_pairs(documents):
    rng = random.Random(6)
    rows = []
    for i in range(150):
        parts = []
        for _ in range(rng.randint(0, 4)):
            w = rng.choice(list(TEMPLATES.values())).split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                w[rng.randrange(len(w))] = rng.choice(["the", "LICENSE", "foo"])
            parts.append(" ".join(w))
            parts.append(rng.choice(["Some prose here.", "x", "under the mit of it"]))
        rows.append((i, rng.choice(["\n", "\n\n", " ", ". "]).join(parts)))
    found = {r.doc_id: sorted((m.segment, m.license, round(m.dice, 6)) for m in r.matches) for r in scan_licenses(documents(rows)).collect()}
    hits = 0
    for i, text in rows:
        assert found[i] == brute(text, TEMPLATES), text
        hits += len(found[i])
    assert hits > 100


def test_odd_rows_and_templates(documents, odd):
    rows = [*odd, (40, "MIT license"), (41, "All  Rights\tReserved")]
    got = {r.doc_id: len(r.matches) for r in scan_licenses(documents(rows, extra="matches")).collect()}
    assert got[41] == 1 and sum(got.values()) == 1
    assert scan_licenses(documents([])).count() == 0
    assert scan_licenses(documents(rows), templates={"one": "word"}).count() == len(rows)  # one word: no bigrams, no matches
    assert {r.doc_id: len(r.matches) for r in scan_licenses(documents(rows), templates={"mit": "mit license"}).collect()}[40] == 1


MIT_FILE = '''MIT License

Copyright (c) 2018 Jane Doe and contributors

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
'''
BSD_CLAUSES = '''Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:
1. Redistributions of source code must retain the above copyright
   notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright
   notice, this list of conditions and the following disclaimer in the
   documentation and/or other materials provided with the distribution.
3. Neither the name of the University nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission.
'''
LGPL_HEADER = '''# This program is distributed in the hope that it will be useful, but WITHOUT
# ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS
# FOR A PARTICULAR PURPOSE.  See the GNU Lesser General Public License for more
# details.
'''


def test_unedited_licenses_alone_and_within_prose(documents):
    from pathlib import Path

    from quillgraph.llm import licenses

    prose = "\n\n" + " ".join(f"word{i}" for i in range(400)) + "\n\n"
    files = {p.stem: p.read_text() for p in sorted((Path(licenses.__file__).parent / "license_texts").glob("*.txt"))}
    rows = [(1, MIT_FILE), (2, prose + MIT_FILE + prose), (3, prose + BSD_CLAUSES + prose), (4, prose + LGPL_HEADER + prose), (5, prose), (6, "Licensed under CC BY-SA 4.0.")]
    rows += [(100 + i, "Copyright (c) 2020 Someone\n\n" + text) for i, text in enumerate(files.values())]
    found = {r.doc_id: {m.license for m in r.matches} for r in scan_licenses(documents(rows)).collect()}
    assert "MIT-text" in found[1] and {f"MIT-part-{i}" for i in (1, 2, 3)} <= found[2]
    assert "BSD-3-Clause-part-1" in found[3] and found[4] == {"LGPL-header-warranty"} and found[5] == set()
    assert found[6] == {"CC-BY-SA-4.0-name"}
    assert all(name in found[100 + i] for i, name in enumerate(files)) and len(files) == 12
