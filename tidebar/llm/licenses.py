"""License scans: winnowed fingerprints of templates, then banded alignment.

A template of n words of which m must be matched may miss e = n - m. So e changes
leave a run of t = ceil(m / (e + 1)) words unbroken somewhere. A template's
fingerprints are hashes of its k-word grams, k = min(K, t), winnowed over windows
of t - k + 1 grams: each window keeps its least hash (the last of equal ones), so
every run of t words holds a fingerprint. The fingerprints are the inverted
index; all of a document's grams are looked up in it. Since one change breaks at
most as many fingerprints as cover one word, a long template must show several,
on near diagonals (word place less template place): these make a candidate
region. No alignment with e changes or fewer (words left out, changed or put in)
lacks one. A banded alignment of the template with the region reports the words
matched in order and their span.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from importlib.resources import files

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

from . import textgrams as T
from .arrowmap import append_from_text

#: Words of a fingerprint's gram at most; templates of fewer words aren't looked for.
K = 3
#: An alignment may drift from its diagonal, either way, by a quarter of the template's words, this many at most.
BAND = 8
MIN_COVERAGE = 0.8
#: Templates are broadcast; more words than this are refused.
MOST_TEMPLATE_WORDS = 1_000_000

#: Short notices here; whole license texts, headers and warranties in license_texts.
NOTICES = {
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "BSD-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "ISC-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
TEMPLATES = NOTICES | {p.name.removesuffix(".txt"): p.read_text() for p in sorted(files(__package__).joinpath("license_texts").iterdir(), key=lambda p: p.name) if p.name.endswith(".txt")}


@dataclass
class TemplateIndex:
    names: list[str]
    words: list[np.ndarray]
    least: np.ndarray  # words that must match
    need: np.ndarray  # fingerprints that must be found
    sizes: list[int]  # words of grams in use
    keys: np.ndarray  # sorted distinct fingerprints
    first: np.ndarray  # of each key's entries, and the end
    template: np.ndarray  # of each entry
    place: np.ndarray


def _words(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return T.Tokens(data, np.array([0, len(data)]), T.WORDS).hash


def _grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive words."""
    acc = np.full(max(0, len(words) - k + 1), k, np.uint64)
    for i in range(k):
        acc = T.mix(acc * np.uint64(0x9E3779B97F4A7C15) + words[i : len(words) - k + 1 + i])
    return acc


def winnow(grams: np.ndarray, window: int) -> np.ndarray:
    """Places of the least gram of each window, the last of equal ones."""
    if len(grams) <= window:
        return np.array([len(grams) - 1 - int(grams[::-1].argmin())] if len(grams) else [], np.int64)
    shifted = np.lib.stride_tricks.sliding_window_view(grams, window)[:, ::-1]
    return np.unique(np.arange(len(shifted)) + window - 1 - shifted.argmin(axis=1))


def build_index(templates: dict[str, str], minimum: float = MIN_COVERAGE) -> TemplateIndex:
    names = sorted(templates)
    words = [_words(templates[n]) for n in names]
    if sum(map(len, words)) > MOST_TEMPLATE_WORDS:
        raise ValueError(f"templates hold over {MOST_TEMPLATE_WORDS} words")
    least, need, sizes, entries = [], [], set(), [np.zeros((0, 3), np.uint64)]
    for t, own in enumerate(words):
        n = len(own)
        m = max(1, math.ceil(minimum * n - 1e-9))
        run = max(1, -(-m // (n - m + 1)))
        k = min(K, run)
        at = winnow(_grams(own, k), run - k + 1)
        covers = np.zeros(n + k, np.int64)
        for i in range(k):
            covers[at + i] += 1
        least.append(m)
        need.append(max(1, len(at) - (n - m + _band(n)) * int(covers.max(initial=1))))
        if K <= n >= m:
            sizes.add(k)
            entries.append(np.stack((_grams(own, k)[at], np.full(len(at), t, np.uint64), at.astype(np.uint64)), axis=1))
    rows = np.concatenate(entries)
    rows = rows[np.argsort(rows[:, 0], kind="stable")]
    keys, first = np.unique(rows[:, 0], return_index=True)
    return TemplateIndex(names, words, np.array(least, np.int64), np.array(need, np.int64), sorted(sizes), keys, np.append(first, len(rows)), rows[:, 1].astype(np.int64), rows[:, 2].astype(np.int64))


def _band(n: int) -> int:
    return min(BAND, max(1, n // 4))


def align(template: np.ndarray, words: np.ndarray, diagonal: int, floor: int = 0, least: int = 0) -> tuple[int, int, int]:
    """(matched, first, stop): the most words of ``template`` matched in order in
    a band about the diagonal (word place less template place), none before
    ``floor``, and the span of places they take, the shortest that ends first;
    none if fewer than ``least`` match."""
    band = _band(len(template))
    best: dict[int, tuple[int, int]] = {}  # last place used -> matched, minus-first
    passed = (0, 0)  # the best of those that ended before the band
    top = (0, 0, 0)
    for i, w in enumerate(template):
        if top[0] + len(template) - i < least:
            return (0, 0, 0)
        lo = max(floor, i + diagonal - band)
        hi = max(lo, min(len(words), i + diagonal + band + 1))
        for last in [x for x in best if x < lo]:
            passed = max(passed, best.pop(last))
        for j in np.flatnonzero(words[lo:hi] == w)[::-1] + lo:
            before = max(((m, f) for last, (m, f) in best.items() if last < j), default=(0, int(j)))
            before = max(before, passed) if passed[0] else before
            now = (before[0] + 1, before[1])
            if now > best.get(int(j), (0, 0)):
                best[int(j)] = now
                if (now[0], now[1] - int(j)) > (top[0], top[1] - top[2]):
                    top = (now[0], now[1], int(j))
    return (top[0], top[1], top[2] + 1) if top[0] and top[0] >= least else (0, 0, 0)


def _candidates(tokens: T.Tokens, index: TemplateIndex) -> dict[tuple[int, int], list[int]]:
    """(document, template) to the diagonals, ascending and in places of the block,
    about which enough fingerprints could lie."""
    if not len(index.keys) or not len(tokens.hash):
        return {}
    hits, found_at = [], []
    for k in index.sizes:
        grams = _grams(tokens.hash, k)
        at = np.minimum(np.searchsorted(index.keys, grams), len(index.keys) - 1)
        hit = np.flatnonzero(index.keys[at] == grams)
        whole = np.searchsorted(tokens.first, hit, "right") == np.searchsorted(tokens.first, hit + k - 1, "right")  # in one document
        hits.append(hit[whole])
        found_at.append(at[hit[whole]])
    hit, key = np.concatenate(hits), np.concatenate(found_at)
    start, n = index.first[key], index.first[key + 1] - index.first[key]
    entry = np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())
    place, t = np.repeat(hit, n), index.template[entry]
    diagonal = place - index.place[entry]
    group = (np.searchsorted(tokens.first, place, "right") - 1) * len(index.names) + t
    order = np.lexsort((diagonal, group))
    group, diagonal = group[order], diagonal[order]
    t = group % len(index.names)
    upto = np.arange(len(group)) + index.need[t] - 1
    inside = upto < len(group)
    upto = np.where(inside, upto, 0)
    bands = np.array([_band(len(w)) for w in index.words])[t]
    found: dict[tuple[int, int], set[int]] = {}
    for k in np.flatnonzero(inside & (group[upto] == group) & (diagonal[upto] - diagonal <= 2 * bands)):
        own = found.setdefault((int(group[k]) // len(index.names), int(t[k])), set())
        own.update(range(int(diagonal[upto[k]] - bands[k]), int(diagonal[k] + bands[k]) + 1))
    return {k: sorted(v) for k, v in found.items()}


def _matches(own: np.ndarray, words: np.ndarray, diagonals: list[int], least: int) -> list[tuple[int, int, int]]:
    """(matched, first, stop) of one template: at the first diagonal that does, the
    best of those up to two bands on; then behind it."""
    found, end = [], 0
    for k, d in enumerate(diagonals):
        if d + len(own) <= end:
            continue
        best = align(own, words, d, end, least)
        if not best[0]:
            continue
        for other in diagonals[k + 1 :]:
            if other > d + 2 * _band(len(own)) or best[0] == len(own) == best[2] - best[1]:
                break
            now = align(own, words, other, end, best[0])
            if (now[0], now[1] - now[2]) > (best[0], best[1] - best[2]):
                best = now
        found.append(best)
        end = best[2]
    return found


_MATCH = StructType([StructField("license", StringType()), StructField("matched", LongType()), StructField("coverage", DoubleType()), StructField("start", LongType()), StructField("stop", LongType())])
_ARROW = pa.list_(pa.struct([("license", pa.string()), ("matched", pa.int64()), ("coverage", pa.float64()), ("start", pa.int64()), ("stop", pa.int64())]))


def scan_batch(texts: pa.Array, index: TemplateIndex) -> list[pa.Array]:
    rows = []
    for row, _, data, offsets in T.blocks(texts):
        tokens = T.Tokens(data, offsets, T.WORDS)
        matches: dict[int, list[tuple[int, int, float, int, int]]] = {}
        for (d, t), diagonals in _candidates(tokens, index).items():
            own, first = index.words[t], int(tokens.first[d])
            for m, s, e in _matches(own, tokens.hash[first : tokens.first[d + 1]], [x - first for x in diagonals], int(index.least[t])):
                matches.setdefault(d, []).append((t, m, m / len(own), s, e))
        for d, a in enumerate(tokens.first[:-1]):
            found = sorted(matches.get(d, []), key=lambda s: (s[3], s[4], s[0]))
            if found:
                raw = data[offsets[d] : offsets[d + 1]]
                marks = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))  # characters before each byte
            rows.append([{"license": index.names[t], "matched": m, "coverage": c, "start": int(marks[tokens.start[a + s] - offsets[d]]), "stop": int(marks[tokens.end[a + e - 1] - offsets[d]])} for t, m, c, s, e in found])
    return [pa.array(rows, _ARROW), pa.array([bool(r) for r in rows], pa.bool_())]


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, min_coverage: float = MIN_COVERAGE, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with licenses array<struct<license, matched, coverage, start,
    stop>> and licensed boolean.

    matched: template words found in order; coverage: their share of the
    template; start, stop: characters of the text (stop excluded). Matches are
    in order of place; those of one template don't overlap, those of different
    templates may. Null, empty and short texts have an empty list. Case and
    marks don't matter. A template of fewer than K words can't be found. Rows
    stay as many as they are; columns of ``docs`` named licenses or licensed are
    replaced; texts of any length are scanned whole."""
    index = docs.sparkSession.sparkContext.broadcast(build_index(TEMPLATES if templates is None else templates, min_coverage))
    fields = [StructField("licenses", ArrayType(_MATCH)), StructField("licensed", BooleanType())]
    return append_from_text(docs, text_col, fields, lambda texts: scan_batch(texts, index.value), keep)
