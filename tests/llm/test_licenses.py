import random
import time

import numpy as np
import pyarrow as pa
import pytest

from panelforge.llm import license_scan
from panelforge.llm.licenses import CLAUSES, TEMPLATES

from .helpers import documents

INDEX = license_scan.build()


def names(text):
    return [INDEX.names[f[1]] for f in license_scan.scan(pa.array([text]), INDEX, license_scan.LEAST_COVERAGE)]


def test_finds_notices_with_edits_and_their_spans(spark):
    full = dict(TEMPLATES)
    mit = full["mit-text"].split()
    edited = " ".join(w for i, w in enumerate(mit) if i % 17 != 5)
    half = " ".join(mit[: len(mit) // 2])
    apache = "Licensed under the Apache License, Version 2.0"
    rows = [(1, "é intro. " + apache + " outro", "s"), (2, "words " * 30 + edited + " words", "s"), (3, half, "s"), (4, None, "s"), (5, "", "s"), (6, "plain text only", "s"), (7, full["mit"].upper() + "\n" + full["mit"], "s"), (7, full["mit"].upper() + "\n" + full["mit"], "s"), (8, "filler " * 100000 + full["isc-text"], "s")]
    got = license_scan.licenses(documents(spark, rows)).collect()
    by = lambda i: sorted((r.license for r in got if r.doc_id == i))
    one = next(r for r in got if r.doc_id == 1)
    assert by(1) == ["apache-2.0"] and rows[0][1][one.start : one.end] == apache and one.coverage == 1
    assert by(2) == ["mit-text"] and next(r for r in got if r.doc_id == 2).coverage < 1
    assert by(3) == by(4) == by(5) == by(6) == []
    assert by(7) == ["mit"] * 4
    assert by(8) == ["isc-text"]


def test_every_template_finds_itself_and_nothing_else():
    for name, text in TEMPLATES:
        assert names(f"Some words before. {text} And some after.") == [name]
        assert names(text.lower()) == [name]


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("This work is licensed under the GNU General Public License, version 2.", ["gpl-2.0"]),
        ("Released under the BSD License.", []),
        ("Released under the MPL License.", []),
        ("Released under an MIT License", ["mit"]),
        ("Distributed under the MIT License", ["mit"]),
        ("Licensed under the Apache License, Version 2.1.", []),
        ("Licensed under the Apache License, Version 1.1.", []),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", ["cc-by-nc-4.0"]),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ["cc-by-sa-4.0"]),
        ("This work is licensed under a Creative Commons Attribution 3.0 Unported License.", []),
        ("Licensed under CC BY-NC 4.0. All rights reserved.", ["cc-by-nc-4.0", "all-rights-reserved"]),
        ("Licensed under the GNU Lesser General Public License, version 3", ["lgpl-3.0"]),
        ("the text speaks of the software and of the terms of the license and of any kind of work", []),
    ],
)
def test_names_the_licence_that_is_meant(text, found):
    assert names(text) == found


def test_inserted_words_count_against_a_place_and_wide_gaps_are_bridged():
    mit = dict(TEMPLATES)["mit-text"].split()
    middle = len(mit) // 2
    wide = " ".join(mit[:middle] + ["extra"] * 20 + mit[middle:])
    (one,) = license_scan.scan(pa.array([wide]), INDEX, 0.8)
    n = len(license_scan.template_words(" ".join(mit)))
    assert INDEX.names[one[1]] == "mit-text" and one[2] == n and one[3] == n + 20
    assert names(" ".join(mit[:middle] + ["extra"] * n + mit[middle:])) == []


def test_the_four_clause_text_is_no_three_clause_text():
    bsd4 = dict(TEMPLATES)["bsd-4-text"]
    own = bsd4.replace("developed by the copyright holder", "developed by the University of Nowhere and its contributors")
    assert names(bsd4) == names(own) == ["bsd-4-text"]


@pytest.mark.parametrize("clause", CLAUSES)
def test_no_text_with_a_clause_of_another_licence_passes(clause):
    """Inserted between two sentences of every long template, whole or reworded a little; one of its own clauses twice is its own."""
    for name, text in TEMPLATES:
        words = text.split()
        if len(words) < 60 or clause.strip() in text:
            continue
        middle = next(i for i in range(len(words) // 2, len(words)) if words[i - 1].endswith((".", ":", ";", ",")))
        for some in (clause.split(), clause.replace("this ", "the said ").split()):
            found = names(" ".join(words[:middle] + some + words[middle:]))
            assert name not in found, (name, found)
        extra = ["unrelated"] * len(clause.split())
        if len(words) >= 4 * len(extra):
            assert names(" ".join(words[:middle] + extra + words[middle:])) == [name]


def slow_score(a, b, low, high):
    """The best local score by the full recurrence within a band."""
    best, h = 0, {}
    for i in range(len(a)):
        for j in range(max(0, low + i), min(len(b), high + i + 1)):
            h[i, j] = max(0, h.get((i - 1, j - 1), 0) + (2 if a[i] == b[j] else -1), h.get((i - 1, j), 0) - 1, h.get((i, j - 1), 0) - 1)
            best = max(best, h[i, j])
    return best


def test_alignment_against_a_full_dynamic_programme():
    rng = random.Random(3)
    for _ in range(200):
        a = np.array([rng.randrange(6) for _ in range(rng.randrange(1, 25))], np.uint64)
        b = np.array([rng.randrange(6) for _ in range(rng.randrange(1, 40))], np.uint64)
        low = rng.randrange(-10, 10)
        high = low + rng.randrange(0, 12)
        matched, first, last = license_scan.align(a, b, low, high)
        want = slow_score(a.tolist(), b.tolist(), low, high)
        assert bool(matched) == bool(want)
        if matched:
            # the place's words alone reach that score, with as many matches
            assert slow_score(a.tolist(), b[first : last + 1].tolist(), low - first, high - first) == want and matched * 2 >= want


def test_alignment_counts_words_around_gaps():
    a = license_scan.template_words("a b c d e f g h i j")
    b = license_scan.template_words("x a b c y d e f g h j")
    assert license_scan.align(a, b, -3, 4) == (9, 1, 10)


def test_no_place_of_enough_coverage_is_missed():
    """Random edits of every template: wherever the full alignment reaches the coverage with the right words, the scan does."""
    rng = random.Random(5)
    for t, words in enumerate(INDEX.words):
        n = len(words)
        for _ in range(6):
            text = words.tolist()
            for _ in range(rng.randrange(0, n // 6 + 2)):
                at = rng.randrange(len(text))
                text[at : at + rng.choice((0, 1))] = [rng.getrandbits(60)] * rng.choice((0, 1))
            text = np.array([1, 2, 3, *text, 4, 5], np.uint64)
            matched, first, last = license_scan.align(words, text, -len(text), len(text))
            numbers, wanted = INDEX.telling[t]
            if matched < 0.8 * max(n, last - first + 1) or license_scan.telling(text[first : last + 1], numbers) != wanted:
                continue
            runs, at = license_scan.shingle_hashes(text, np.zeros(len(text), np.int64), min(2, n))
            k = min(2, n)
            hits = [(int(a) - p, p, c) for run, a in zip(runs.tolist(), at.tolist(), strict=True) for b, e in [_span(k, run)] for tt, p, c in INDEX.pairs[k][b:e].tolist() if tt == t]
            own = np.zeros(len(hits), np.int64)
            clusters, exact = license_scan._clusters(own, *np.array(hits).T, INDEX.needed[t : t + 1], INDEX.shared[t : t + 1], INDEX.reach[t : t + 1], INDEX.total[t : t + 1])
            places = list(license_scan._places(INDEX, t, text, [(a, b) for _, a, b in clusters], [d for _, d in exact], 0.8))
            assert max((m for m, _, _ in places), default=0) == matched, (INDEX.names[t], matched, n)


def _span(k, run):
    keys = INDEX.keys[k]
    at = int(np.searchsorted(keys, np.uint64(run)))
    if at == len(keys) or int(keys[at]) != run:
        return 0, 0
    return int(INDEX.begins[k][at]), int(INDEX.begins[k][at + 1])


def test_repeats_take_linear_time():
    for text, n in (("All rights reserved. " * 50_000, 50_000), ("Rights all reserved of the " * 40_000, None), ("free of charge to any person " * 35_000, None)):
        began = time.perf_counter()
        found = names(text)
        assert time.perf_counter() - began < 5
        assert n is None or len(found) == n


def test_ties_between_templates_and_odd_templates(spark):
    docs = documents(spark, [(1, "one two three four five", "s")])
    got = license_scan.licenses(docs, (("a", "one two three four five"), ("b", "one two three four five"), ("c", "..."), ("d", "two three")))
    assert [(r.doc_id, r.license) for r in got.collect()] == [(1, "a")]


def test_empty(spark):
    assert license_scan.licenses(documents(spark, [])).count() == 0
