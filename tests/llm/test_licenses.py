import math
import random
import re
import textwrap
from collections import Counter
from pathlib import Path

import pytest

from plotmark.llm.licenses import TEMPLATES, _listed, license_scan


def test_notices_and_inheritance(spark):
    prose = "the quick work of this world is under all the rest and version of the public " * 8
    rows = [
        (1, "a/LICENSE", "Released under the MIT License.", "l"),
        (2, "a/b/c/x.py", prose, None),
        (3, "a/b/LICENSE.txt", f"{prose}\nlicensed under the apache license, version 2.0!", None),
        (4, "a/y.py", f"{prose}\n# Licensed under CC BY-NC 4.0.\n", None),
        (5, "z/y.py", prose, None),
        (6, None, None, None),
        (7, "top.txt", "", None),
        (8, "ab/y.py", None, None),
        (8, "ab/y.py", None, None),
    ]
    got = license_scan(spark.createDataFrame(rows, "doc_id long, path string, text string, license string")).collect()
    assert sorted((r.doc_id, r.effective_license, r.how, r.inherited_from) for r in got) == [
        (1, "MIT", "own", None),
        (2, "Apache-2.0", "inherited", "a/b"),
        (3, "Apache-2.0", "own", None),
        (4, "CC-BY-NC-4.0", "own", None),
        (5, None, "none", None),
        (6, None, "none", None),
        (7, None, "none", None),
        (8, None, "none", None),
        (8, None, "none", None),
    ]
    assert {r.doc_id: r.line for r in got}[4] == 1


def test_a_license_at_the_root_reaches_all(spark):
    rows = [(1, "LICENSE", "All rights reserved."), (2, "a/b/x", "nothing")]
    got = license_scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()
    assert {(r.doc_id, r.effective_license, r.inherited_from) for r in got} == {(1, "Proprietary", None), (2, "Proprietary", "")}


def test_no_files(spark):
    assert license_scan(spark.createDataFrame([], "doc_id long, path string, text string")).count() == 0


def test_license_files_headers_and_tags(spark):
    prose = "a little program that counts the boats in every harbour of the northern coast and prints their names " * 6
    wrapped = lambda text, mark="": "\n".join(mark + x for x in textwrap.wrap(text, 70))
    mit = TEMPLATES["MIT"][1].replace("MIT License Copyright (c) ", "MIT License\n\nCopyright (c) 2021 Some Harbour Trust\n\n").replace("conditions: The", "conditions:\n\nThe").replace("Software. THE", "Software.\n\nTHE")
    rows = [
        (1, "m/LICENSE", "\n\n".join(wrapped(b) for b in mit.split("\n\n"))),
        (2, "m/src/a.py", prose),
        (3, "b3/LICENSE", wrapped(TEMPLATES["BSD-3-Clause"][1])),
        (4, "b2/LICENSE", wrapped(TEMPLATES["BSD-2-Clause"][1])),
        (5, "g/a.c", f"/*\n{wrapped(TEMPLATES['GPL-3.0'][1], ' * ')}\n */\n\nint boats; {prose}"),
        (6, "l/a.c", f"{wrapped(TEMPLATES['LGPL-3.0'][1], '// ')}\n\n{prose}"),
        (7, "s/a.rs", f"// SPDX-License-Identifier: Apache-2.0\n{prose}"),
        (8, "g2/COPYING", f"GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991\n\n{prose}"),
        (9, "n/a.py", prose),
        (10, "long/a.py", prose * 2000),
    ]
    rows += [(20 + i, f"p{i}/x", f"{prose} {i}\n\n{prose}") for i in range(30)]
    got = {r.doc_id: r for r in license_scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert {i: got[i].effective_license for i in range(1, 11)} == {1: "MIT", 2: "MIT", 3: "BSD-3-Clause", 4: "BSD-2-Clause", 5: "GPL-3.0", 6: "LGPL-3.0", 7: "Apache-2.0", 8: "GPL-2.0", 9: None, 10: None}
    assert (got[1].scope, got[2].how, got[3].scope, got[5].scope, got[7].scope, got[7].line, got[8].scope) == ("file", "inherited", "block", "block", "line", 0, "block")
    assert not any(got[20 + i].effective_license for i in range(30))


def test_ties_and_unlike_texts_under_one_id(spark):
    rows = [(1, "a/x", "All rights reserved.\nReleased under the MIT License.\nAll rights reserved."), (2, "b/x", "nothing of note"), (2, "b/x", "Released under the MIT License.")]
    got = license_scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()
    assert sorted((r.doc_id, r.license, r.line) for r in got) == [(1, "Proprietary", 0), (2, "MIT", 0), (2, "MIT", 0)]


def _brute(texts: dict, threshold: float = 0.7) -> dict:
    """Best (license, score) of each text by the cosine of every line, block and whole text to every template, without any bound."""
    terms = lambda t: Counter(re.findall("[a-z0-9]+", t.lower()))
    templates = [(name, terms(t)) for name, _, t in _listed(TEMPLATES)]
    vocabulary = {t for _, c in templates for t in c}
    seen = Counter(t for text in texts.values() for t in set(terms(text)) & vocabulary)
    weight = lambda t: math.log((1 + len(texts)) / (1 + seen[t])) + 1
    vector = lambda c: {t: n * weight(t) for t, n in c.items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    templates = [(name, vector(c)) for name, c in templates]
    best = {}
    for key, text in texts.items():
        blocks = re.split(r"\n[^A-Za-z0-9\n]*\n", text)
        found = []
        for unit in [*text.split("\n"), *(b for b in blocks if "\n" in b), text]:
            if v := vector(terms(unit)):
                found += [(-round(sum(v.get(t, 0) * x for t, x in w.items()) / norm(v) / norm(w), 6), name) for name, w in templates]
        score, name = min(found, default=(0, None))
        best[key] = (name, -score) if -score >= threshold else (None, None)
    return best


def test_scores_equal_brute_force_with_repeated_and_mixed_texts(spark):
    rnd = random.Random(5)
    words = sorted({w for v in TEMPLATES.values() for t in v for w in t.split()})
    names = lambda n: " ".join(f"holder{rnd.randrange(10**6)}" for _ in range(n))
    listed = [t for _, _, t in _listed(TEMPLATES)]
    texts = [f"{chr(10).join([TEMPLATES['MIT'][1]] * 6)}\n{names(140)}", "the " * 50 + TEMPLATES["MIT"][0], "a b", "", "license " * 400]
    for i in range(150):
        body = rnd.choice(listed).split()
        kept = [w for w in body if rnd.random() < rnd.choice((0.5, 0.8, 1.0))] * rnd.choice((1, 1, 3))
        mixed = kept + rnd.choices(words, k=rnd.choice((0, 3, 30))) + names(rnd.choice((0, 2, 12, 60))).split()
        rnd.shuffle(mixed)
        breaks = rnd.choice((0.0, 0.1, 0.3))
        texts.append("".join(w + ("\n\n" if rnd.random() < breaks / 3 else "\n" if rnd.random() < breaks else " ") for w in mixed))
    texts = dict(enumerate(texts))
    rows = [(i, f"d{i}/x", t) for i, t in texts.items()]
    got = {r.doc_id: (r.license, r.score) for r in license_scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    want = _brute(texts)
    assert 40 < sum(v[0] is not None for v in want.values()) < 150 and want[0] == got[0] and got[0][0] == "MIT"
    for i in texts:
        assert got[i][0] == want[i][0] and (want[i][1] is None or abs(got[i][1] - want[i][1]) <= 2e-6), i


@pytest.mark.parametrize("name, spdx", [("Apache-2.0", "Apache-2.0"), ("MPL-2.0", "MPL-2.0"), ("GPL-2", "GPL-2.0"), ("GPL-3", "GPL-3.0"), ("LGPL-3", "LGPL-3.0"), ("CC0-1.0", "CC0-1.0")])
def test_long_bodies_without_title_and_appendix(spark, name, spdx):
    path = Path("/usr/share/common-licenses") / name
    if not path.exists():
        pytest.skip("no license texts on this machine")
    body = path.read_text().split("END OF TERMS AND CONDITIONS")[0].split("Exhibit A -")[0].split("\n")
    rows = [(1, "LICENSE", "\n".join(body[8:] if name not in ("MPL-2.0",) else body[2:])), (2, "a.py", "nothing of note")]
    got = {r.doc_id: r.effective_license for r in license_scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got == {1: spdx, 2: spdx}


def test_a_very_long_line(spark):
    line = " ".join(f"w{i}" for i in range(300_000))
    rows = [(1, "a", f"{line} released under the mit license {line}"), (2, "b", f"{line}\nReleased under the MIT License.\n{line}")]
    got = {r.doc_id: (r.license, r.line) for r in license_scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got == {1: (None, None), 2: ("MIT", 1)}
