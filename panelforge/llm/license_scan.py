"""License scans: winnowed template fingerprints pick places, banded alignment measures them.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z as a-z. A template's fingerprints are
hashes of runs of GRAM words; of long templates, the least hash of every WINDOW neighbouring runs. The
inverted index names the templates and places of each. Every run of a document's words is looked up; a hit
proposes a diagonal (where the template would begin). A notice that reaches least_coverage has its hits within
reach = words // 4 diagonals, and no fewer of them than `least_hits` (of all runs, which the index holds beside the chosen ones, more), so
only such clusters are aligned: to the words around them, in a band that is wider by that reach on either side (match 2, mismatch and gap -1, best local alignment,
found by numpy row by row). Aligned words are cut out and the rest of the cluster is aligned again, until nothing is left.

A place is reported if it covers least_coverage: matched words over the template's words or, where that is more, the
place's own words, so inserted words count against it. It must not hold a clause of CLAUSE words or more that other
templates or known variants have and this one lacks: then the text is another licence. Its telling words (names of licences, versions; see `licenses`) must be
those of the template. Over one stretch of text the templates contest: most matched words, then fewest words of the place, then the
first template win, and places reported for a document don't overlap.

How it scales: one scan, no shuffle; templates are a fixed list of bounded size in each task, and time is
linear in the text: a cluster is no wider than two reaches, and whole notices are settled without alignment.

Defined cases: null and empty texts hold nothing; repeated rows are reported each; equal templates report the first one's name;
templates without words are ignored; very long texts are scanned whole; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PLAIN, shingle_hashes, text_steps, word_hashes
from .licenses import CLAUSES, TELLING, TEMPLATES

GRAM, WINDOW, LEAST_COVERAGE = 2, 2, 0.8
#: Templates of fewer words keep every run.
LONG = 10
#: Words that a clause of another licence has at least, and of the runs it is known by.
CLAUSE, CLAUSE_GRAM = 8, 5
_PREFILTER_BITS = 18


def template_words(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return word_hashes(data, np.array([0, len(data)]), PLAIN)[0]


def _hash_of(words: list[str]) -> np.ndarray:
    return np.unique(template_words(" ".join(words)))


_NAMES = _hash_of(sorted(TELLING))
_NUMBERS = _hash_of([str(i) for i in range(100)] + [f"0{i}" for i in range(10)])


def telling(words: np.ndarray, numbers: bool) -> frozenset[int]:
    """The words that tell licences apart."""
    found = words[np.isin(words, _NAMES) | (np.isin(words, _NUMBERS) if numbers else False)]
    return frozenset(found.tolist())


def window_of(n: int) -> int:
    return WINDOW if n >= LONG else 1


def winnowed(words: np.ndarray, k: int, window: int) -> list[tuple[int, int]]:
    """(hash, place) of the least run in each window, the last of equals."""
    runs = shingle_hashes(words, np.zeros(len(words), np.int64), k)[0]
    chosen = set()
    for lo in range(max(1, len(runs) - window + 1)):
        some = runs[lo : lo + window]
        at = lo + len(some) - 1 - int(np.argmin(some[::-1]))
        chosen.add((int(runs[at]), at))
    return sorted(chosen)


def least_hits(n: int, coverage: float, window: int) -> int:
    """Hits that a place of that coverage has at least: of n words some are lost and some are inserted, each breaks a run of
    matched words, and a run of L words keeps (L - GRAM - window + 2) / window fingerprints or more."""
    if n < GRAM:
        return 1
    found = n
    for lost in range(n + 1):
        for inserted in range(n // 4 + 2):
            if n - lost >= coverage * max(n, n - lost + inserted) - 1e-9:
                found = min(found, math.ceil((n - lost - (1 + lost + inserted) * (GRAM + window - 2)) / window))
    return max(1, found)


@dataclass
class Index:
    words: list[np.ndarray]
    names: list[str]
    needed: np.ndarray  # hits of winnowed runs that a notice has at least
    shared: np.ndarray  # and of all runs
    reach: np.ndarray  # diagonals that a notice spreads over at most
    total: np.ndarray  # runs of each template
    telling: list[tuple[bool, frozenset[int]]]
    known: np.ndarray  # runs of CLAUSE_GRAM words of all templates and clauses
    own: list[np.ndarray]  # and of each template
    keys: dict[int, np.ndarray]
    begins: dict[int, np.ndarray]  # of each key: where its (template, place, is it winnowed) entries begin
    pairs: dict[int, np.ndarray]
    first: dict[int, np.ndarray]


def build(templates=TEMPLATES, coverage: float = LEAST_COVERAGE) -> Index:
    kept = [(name, w) for name, text in templates if len(w := template_words(text))]
    by: dict[int, dict[int, list[tuple[int, int, int]]]] = defaultdict(lambda: defaultdict(list))
    told, total = [], []
    for t, (_, words) in enumerate(kept):
        k = min(GRAM, len(words))
        chosen = set(winnowed(words, k, window_of(len(words))))
        every = list(enumerate(shingle_hashes(words, np.zeros(len(words), np.int64), k)[0].tolist()))
        for at, key in every:
            by[k][key].append((t, at, int((key, at) in chosen)))
        total.append(len(every))
        numbers = bool(np.isin(words, _NUMBERS).any())
        told.append((numbers, telling(words, numbers)))
    keys = {k: np.array(sorted(found), np.uint64) for k, found in by.items()}
    first, begins, pairs = {}, {}, {}
    for k, own in keys.items():
        first[k] = np.zeros(1 << _PREFILTER_BITS, bool)
        first[k][own & np.uint64((1 << _PREFILTER_BITS) - 1)] = True
        lists = [by[k][int(x)] for x in own]
        begins[k] = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
        pairs[k] = np.array([p for x in lists for p in x], np.int64)
    sizes = [len(w) for _, w in kept]
    long = lambda words: np.unique(shingle_hashes(words, np.zeros(len(words), np.int64), CLAUSE_GRAM)[0])
    own = [long(w) for _, w in kept]
    known = np.unique(np.concatenate([*own, *(long(template_words(c)) for c in CLAUSES), np.zeros(0, np.uint64)]))
    return Index([w for _, w in kept], [n for n, _ in kept], *(np.array(x, np.int64) for x in ([least_hits(n, coverage, window_of(n)) for n in sizes], [least_hits(n, coverage, 1) for n in sizes], [n // 4 for n in sizes], total)), told, known, own, keys, begins, pairs, first)


def align(template: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """(matched words, first and last matched word of text) of the best local alignment in a band.

    Word i of the template may meet words low + i to high + i of the text. Of equal alignments the one that ends first
    in the template, then in the text; steps back prefer the diagonal, then a skipped template word.
    """
    n, width = len(template), high - low + 1
    places = np.arange(width)
    score = np.zeros((n + 1, width + 1), np.int32)  # one column more: what lies beyond the band
    same = np.zeros((n, width), bool)
    for i in range(n):
        at = low + i + places
        inside = (at >= 0) & (at < len(text))
        same[i, inside] = text[at[inside]] == template[i]
        here = np.maximum(score[i, :width] + np.where(same[i], 2, -1), score[i, 1:] - 1)
        here = np.where(inside, np.maximum(here, 0), 0)
        score[i + 1, :width] = np.where(inside, np.maximum.accumulate(here + places) - places, 0)
    if not score.max():
        return 0, -1, -1
    i, s = divmod(int(score[1:, :width].argmax()), width)
    matched, first, last = 0, -1, -1
    while i >= 0 and score[i + 1, s] > 0:
        value = score[i + 1, s]
        if value == score[i, s] + (2 if same[i, s] else -1):
            if same[i, s]:
                matched, first = matched + 1, low + i + s
                last = max(last, first)
            i -= 1
        elif value == score[i, s + 1] - 1:
            i, s = i - 1, s + 1
        else:
            s -= 1
    return matched, first, last


def holds_clause(index: Index, t: int, place: np.ndarray) -> bool:
    """Do the words of a place hold a clause (runs of CLAUSE words in all) that other licences have and template t lacks?"""
    runs = shingle_hashes(place, np.zeros(len(place), np.int64), CLAUSE_GRAM)[0]
    return int((np.isin(runs, index.known) & ~np.isin(runs, index.own[t])).sum()) > CLAUSE - CLAUSE_GRAM


def _clusters(own: np.ndarray, diagonal: np.ndarray, place: np.ndarray, chosen: np.ndarray, needed: np.ndarray, shared: np.ndarray, reach: np.ndarray, total: np.ndarray) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """(key, least, largest diagonal) where enough places of a template are hit within its reach, of those that winnowing chose
    and of all, and (key, diagonal) where all are hit.

    Diagonals fall into blocks of reach + 1; what a notice hits lies in two neighbouring blocks, so their distinct places
    are counted. The band of an alignment goes a reach beyond them, so it covers the next pair too, which is left out.
    """
    order = np.lexsort((diagonal, own))
    own, diagonal, place, chosen = own[order], diagonal[order], place[order], chosen[order]
    shift = int(diagonal.min())
    span = int(diagonal.max()) - shift + 2
    line, size = np.unique(own * span + (diagonal - shift), return_counts=True)
    full = line[size >= total[line // span]]
    exact = list(zip((full // span).tolist(), (full % span + shift).tolist(), strict=True))
    block = (diagonal - shift) // (reach[own] + 1)
    most = int(place.max()) + 1
    second = block > 0
    pair = np.concatenate([own * span + block, (own * span + block - 1)[second]])
    both, flag = np.concatenate([place, place[second]]), np.concatenate([chosen, chosen[second]])
    distinct, at = np.unique(pair * most + both, return_index=True)
    pairs, begins, hits = np.unique(distinct // most, return_index=True, return_counts=True)
    good = pairs[(hits >= shared[pairs // span]) & (np.add.reduceat(flag[at].astype(np.int64), begins) >= needed[pairs // span])]
    out, last = [], -2
    line = own * span + block
    first, end = np.searchsorted(line, good), np.searchsorted(line, good + 2)
    for at, lo, hi in zip(good.tolist(), first.tolist(), end.tolist(), strict=True):
        if at == last + 1:
            continue
        last = at
        out.append((at // span, int(diagonal[lo]), int(diagonal[hi - 1])))
    return out, exact


def _places(index: Index, t: int, own: np.ndarray, clusters: list[tuple[int, int]], tries: list[int], least_coverage: float):
    """(matched, first, last) of the places of template t in a document's words: whole ones at the diagonals tried, others
    around clusters of diagonals."""
    template, reach = index.words[t], int(index.reach[t])
    n = len(template)
    exact = np.array(tries, np.int64)
    exact = exact[(exact >= 0) & (exact + n <= len(own))]
    for i in range(n):
        exact = exact[own[exact + i] == template[i]]
    for at in exact.tolist():
        yield n, at, at + n - 1
    numbers, wanted = index.telling[t]
    settled = np.searchsorted(exact, [high - n // 2 for _, high in clusters])
    for (low, high), near in zip(clusters, settled.tolist(), strict=True):
        if near < len(exact) and exact[near] <= low + n // 2:
            continue
        stretches = [(max(0, low - reach), min(len(own), high + reach + n))]
        while stretches:
            lo, hi = stretches.pop()
            if hi - lo < least_coverage * n:
                continue
            matched, first, last = align(template, own[lo:hi], low - reach - lo, high + reach - lo)
            first, last = first + lo, last + lo
            if matched < least_coverage * n:
                continue
            if matched >= least_coverage * max(n, last - first + 1) and telling(own[first : last + 1], numbers) == wanted and not holds_clause(index, t, own[first : last + 1]):
                yield matched, first, last
            stretches += [(lo, first), (last + 1, hi)]


def _contest(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Of (template, matched, first, last) those that win their stretch of text, in order of place."""
    taken: list[tuple[int, int, int, int]] = []
    for t, matched, first, last in sorted(set(found), key=lambda f: (-f[1], f[3] - f[2], f[0], f[2])):
        at = bisect_left(taken, (first,))
        if (at == len(taken) or taken[at][0] > last) and (not at or taken[at - 1][1] < first):
            insort(taken, (first, last, t, matched))
    return [(t, matched, first, last) for first, last, t, matched in taken]


def scan(texts: pa.Array, index: Index, least_coverage: float):
    """(row, template, matched, words of the place, first word's byte, end byte) and the text's bytes, in order."""
    low = np.uint64((1 << _PREFILTER_BITS) - 1)
    count = len(index.words)
    for lo, _, data, off in text_steps(texts):
        words, doc, start = word_hashes(data, off, PLAIN)
        begins = np.searchsorted(doc, np.arange(len(off)))
        owns, diagonals, places, chosen = [], [], [], []
        for k, keys in index.keys.items():
            runs, at = shingle_hashes(words, doc, k)
            maybe = np.flatnonzero(index.first[k][runs & low])
            place = np.minimum(np.searchsorted(keys, runs[maybe]), len(keys) - 1)
            sure = keys[place] == runs[maybe]
            place, word = place[sure], at[maybe[sure]]
            size = index.begins[k][place + 1] - index.begins[k][place]
            pair = index.pairs[k][np.repeat(index.begins[k][place], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)].reshape(-1, 3)
            word = np.repeat(word, size)
            owns.append(doc[word] * count + pair[:, 0])
            diagonals.append(word - begins[doc[word]] - pair[:, 1])
            places.append(pair[:, 1])
            chosen.append(pair[:, 2])
        if not owns or not sum(map(len, owns)):
            continue
        every = [np.tile(x, len(off)) for x in (index.needed, index.shared, index.reach, index.total)]
        clusters, exact = _clusters(np.concatenate(owns), np.concatenate(diagonals), np.concatenate(places), np.concatenate(chosen), *every)
        by: dict[int, dict[int, tuple[list, list]]] = defaultdict(lambda: defaultdict(lambda: ([], [])))
        for key, a, b in clusters:
            by[key // count][key % count][0].append((a, b))
        for key, at in exact:
            by[key // count][key % count][1].append(at)
        for row, templates in sorted(by.items()):
            own = words[begins[row] : begins[row + 1]]
            found = [(t, *p) for t, some in templates.items() for p in _places(index, t, own, *some, least_coverage)]
            if not found:
                continue
            starts = np.cumsum((data[off[row] : off[row + 1]] & 0xC0) != 0x80)
            for t, matched, first, last in _contest(found):
                begin, end = int(start[begins[row] + first]), int(start[begins[row] + last])
                while end < off[row + 1] and PLAIN[data[end]]:
                    end += 1
                yield lo + row, t, matched, last - first + 1, int(starts[begin - off[row]]) - 1, int(starts[end - off[row] - 1])


def licenses(docs: DataFrame, templates=TEMPLATES, least_coverage: float = LEAST_COVERAGE) -> DataFrame:
    """doc_id, license, matched, words (of the template), coverage, start and end in characters of every notice found."""
    index = docs.sparkSession.sparkContext.broadcast(build(templates, least_coverage))

    def run(batches):
        for batch in batches:
            found = list(scan(batch.column(1), index.value, least_coverage))
            sizes = [len(index.value.words[f[1]]) for f in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array([f[0] for f in found], pa.int64())),
                    pa.array([index.value.names[f[1]] for f in found], pa.string()),
                    pa.array([f[2] for f in found], pa.int32()),
                    pa.array(sizes, pa.int32()),
                    pa.array([f[2] / max(n, f[3]) for f, n in zip(found, sizes, strict=True)], pa.float64()),
                    pa.array([f[4] for f in found], pa.int64()),
                    pa.array([f[5] for f in found], pa.int64()),
                ],
                names=["doc_id", "license", "matched", "words", "coverage", "start", "end"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, license string, matched int, words int, coverage double, start long, end long")
