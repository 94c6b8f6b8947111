"""License scans: an exact set-similarity join of text blocks with license templates.

A text block is a line; a line of over WIDTH words is cut into windows of WIDTH words, half overlapping, so that whole
texts are covered. A block meets a template if it holds the stated share of the template's distinct words (containment).
Words are ordered by how many blocks of the corpus hold them, rarest first. Then a block and a template can only meet if

  prefix      one of the template's first |T| - o + 1 words stands in the block, o being the overlap asked for,
  length      the block has at least o of the templates' words,
  position    with what is left of both sides after the first common word, o can still be reached,

and those pairs alone are verified by counting common words. Blocks are reduced to words that some template has, which
changes no overlap. Templates are a small table: their words, in order, are all that is gathered and sent to tasks.

Base labels: places where a phrase's words stand consecutively. The score is 1 with a base label, else the largest
containment of a template that a block meets, else 0.

Defined results: null, empty and blank texts have no words, labels or places, and score 0; texts are never cut; repeated
rows have equal results; an empty table gives none; extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Phrases and their labels, as the contract has them.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Labels, notices by which licenses are named in texts, and the share of a notice's words that a block must hold. A notice
#: that differs from another license's by a word or two asks for all of its words.
TEMPLATES = (
    ("mit", "released under the mit license", 1.0),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 0.8),
    ("apache-2", "licensed under the apache license version 2 0", 1.0),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at www apache org licenses license 2 0", 0.8),
    ("gpl", "this work is licensed under the gnu general public license", 0.8),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", 0.8),
    ("lgpl", "gnu lesser general public license", 1.0),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", 0.8),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", 0.8),
    ("bsd", "licensed under the bsd license", 1.0),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", 0.8),
    ("cc-by-nc", "licensed under cc by nc", 1.0),
    ("cc-by-sa", "licensed under cc by sa", 1.0),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal", 0.8),
    ("proprietary", "all rights reserved", 1.0),
)
WIDTH = 64

#: Bytes of words: digits, letters, and all that is not ASCII.
WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def word_hash(words: Sequence[str]) -> np.ndarray:
    if not len(words):
        return np.zeros(0, np.uint64)
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in raw])
    return C.span_hashes(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, ends[:-1]], ends, C.BYTE_LOWER)


class Vocabulary:
    """The templates' and phrases' words, found among a text's words by hash and then byte by byte."""

    def __init__(self, words: Sequence[str]):
        self.words = list(words)
        h = word_hash(self.words)
        self.order = np.argsort(h)
        self.hashes = h[self.order]
        self.raw = [w.encode() for w in self.words]

    def ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Each span's number here, -1 for a word that is not here. data: lower-cased."""
        h = C.span_hashes(data, starts, ends, C.BYTE_EXACT)
        k = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        out = np.where(self.hashes[k] == h, self.order[k], -1)
        for i, w in enumerate(self.raw):  # hashes may collide: compare bytes
            own = np.flatnonzero(out == i)
            if len(own):
                same = ends[own] - starts[own] == len(w)
                own, gone = own[same], own[~same]
                bytes_ = data[starts[own][:, None] + np.arange(len(w))] == np.frombuffer(w, np.uint8)
                out[gone] = -1
                out[own[~bytes_.all(axis=1)]] = -1
        return out


def blocks(line_of: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """First and end word of each block, given each word's line (not falling)."""
    cut = np.flatnonzero(np.diff(line_of)) + 1
    first, end = np.r_[0, cut], np.r_[cut, len(line_of)]
    if not len(line_of):
        return first[:0], end[:0]
    n, half = end - first, width // 2
    parts = np.where(n > width, -(-(n - width) // half) + 1, 1)
    k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    s, e = np.repeat(first, parts) + k * half, np.repeat(end, parts)
    return s, np.where(np.repeat(n, parts) > width, np.minimum(s + width, e), e)


def parsed(col: pa.Array, vocabulary: Vocabulary, width: int) -> Iterator[tuple]:
    """Chunks of a text column: first row, offsets of each row's words, each word's number, each block's ends and distinct
    known words (block, word; by block)."""
    raw, off = C.text_bytes(col)
    for i, j in C.chunks(off):
        data, o = _FOLD[raw[off[i] : off[j]]], off[i : j + 1] - off[i]
        starts, ends, at = C.spans(WORD[data], o)
        ids = vocabulary.ids(data, starts, ends)
        new = np.cumsum(data == 10)
        row = np.repeat(np.arange(j - i), np.diff(at))
        line = (new[starts] if len(starts) else starts) + row  # a row's end is a line's end
        s, e = blocks(line, width)
        own = np.flatnonzero(ids >= 0)
        # a word stands in the blocks that begin at or before it and end after it: two at most
        last = np.searchsorted(s, own, "right") - 1
        block, word = last, ids[own]
        more = np.flatnonzero((last > 0) & (e[np.maximum(last - 1, 0)] > own))
        pair = np.unique(np.r_[block, last[more] - 1] * len(vocabulary.words) + np.r_[word, word[more]])
        yield i, at, ids, s, e, pair // len(vocabulary.words), pair % len(vocabulary.words)


def frequencies(docs: DataFrame, text: str, words: Sequence[str], width: int = WIDTH) -> dict[str, int]:
    """How many blocks of the corpus hold each of the templates' words."""
    vocabulary = Vocabulary(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(vocabulary.words), np.int64)
        for b in batches:
            for *_, word in parsed(b.column(0), vocabulary, width):
                n += np.bincount(word, minlength=len(n))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n)], names=["word", "n"])

    rows = docs.select(text).mapInArrow(C.lean(run), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {w: 0 for w in vocabulary.words} | {vocabulary.words[r["word"]]: r["n"] for r in rows}


class Index:
    """Templates with their words in the corpus's order, and which templates have a word in their prefix."""

    def __init__(self, templates: Sequence[tuple[str, str, float]], n: Mapping[str, int]):
        self.words = sorted(n, key=lambda w: (n[w], w))
        rank = {w: i for i, w in enumerate(self.words)}
        self.sets = [np.array(sorted({rank[w] for w in t.split()}), np.int64) for _, t, _ in templates]
        self.need = np.array([need(len(s), x[2]) for s, x in zip(self.sets, templates)])
        self.prefix = [s[: len(s) - o + 1] for s, o in zip(self.sets, self.need)]

    def met(self, block: np.ndarray, word: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of n blocks' words (ranks, by block and rank): template, blocks that meet it, their overlaps."""
        size = np.bincount(block, minlength=n)
        first = np.cumsum(size) - size
        place = np.arange(len(block)) - first[block]
        by = np.argsort(word, kind="stable")
        at = np.searchsorted(word[by], np.arange(len(self.words) + 1))
        for t, (own, o) in enumerate(zip(self.sets, self.need)):
            hits = [(by[at[w] : at[w + 1]], k) for k, w in enumerate(self.prefix[t])]
            near, k = np.concatenate([h for h, _ in hits]), np.concatenate([np.full(len(h), k) for h, k in hits])
            b = block[near]
            ok = (size[b] >= o) & (1 + np.minimum(size[b] - place[near] - 1, len(own) - k - 1) >= o)
            # by the first common word; before it neither side has one of the other's, so the rest bounds the overlap
            lead = np.full(n, len(own))
            np.minimum.at(lead, b, k)
            ok &= k == lead[b]
            c = np.unique(b[ok])
            if len(c):
                mark = np.zeros(len(self.words), bool)
                mark[own] = True
                among = np.zeros(n, bool)
                among[c] = True
                use = among[block] & mark[word]
                common = np.bincount(block[use], minlength=n)[c]
                if (common >= o).any():
                    yield t, c[common >= o], common[common >= o]


def need(size: int, least: float) -> int:
    """The overlap that a template of so many words asks for."""
    return max(1, int(np.ceil(least * size - 1e-9)))


def scanned(docs: DataFrame, text: str = "text", templates: Sequence[tuple[str, str, float]] = TEMPLATES, phrases: Mapping[str, str] = PHRASES, width: int = WIDTH) -> DataFrame:
    """docs, without text, with n_words, the places of phrases (phrase, word), and the blocks that meet a template
    (template, first word, words, overlap and the template's size); numbers are places in `phrases` and `templates`."""
    C.ship(docs.sparkSession)
    words = sorted({w for _, t, _ in templates for w in t.split()})
    index = Index(templates, frequencies(docs, text, words, width))
    more = sorted({w for p in phrases for w in p.split()} - set(words))
    own = len(index.words)
    vocabulary = Vocabulary([*index.words, *more])
    number = {w: i for i, w in enumerate(vocabulary.words)}
    wanted = [np.array([number[w] for w in p.split()]) for p in phrases]

    def make(b: pa.RecordBatch) -> list:
        col = b.column(b.schema.get_field_index(text))
        count, places, hits = np.zeros(len(col), np.int64), [], []
        for i, at, ids, s, e, block, word in parsed(col, vocabulary, width):
            count[i : i + len(at) - 1] = np.diff(at)
            row = np.repeat(np.arange(i, i + len(at) - 1), np.diff(at))
            for k, p in enumerate(wanted):
                x = np.flatnonzero(ids[: len(ids) - len(p) + 1] == p[0]) if len(ids) >= len(p) else np.zeros(0, np.int64)
                for d in range(1, len(p)):
                    x = x[ids[x + d] == p[d]]
                x = x[row[x] == row[x + len(p) - 1]]
                places.append(np.stack([row[x], np.full(len(x), k), x - at[row[x] - i]]))
            known = word < own
            for t, c, common in index.met(block[known], word[known], len(s)):
                r = row[s[c]]
                hits.append(np.stack([r, np.full(len(c), t), s[c] - at[r - i], e[c] - s[c], common, np.full(len(c), len(index.sets[t]))]))
        return [pa.array(count), listed(places, len(col), ("phrase", "word")), listed(hits, len(col), ("template", "word", "words", "overlap", "size"))]

    out = C.append_columns(docs, "n_words long, places array<struct<phrase: long, word: long>>, blocks array<struct<template: long, word: long, words: long, overlap: long, size: long>>", make)
    return out.drop(text)


def listed(rows: list[np.ndarray], n: int, names: Sequence[str]) -> pa.Array:
    """A list of structs for each of n rows, from columns (row, fields...)."""
    a = np.concatenate(rows, axis=1) if rows else np.zeros((1 + len(names), 0), np.int64)
    a = a[:, np.lexsort(a[::-1])]
    ends = np.searchsorted(a[0], np.arange(n + 1))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(c.astype(np.int64)) for c in a[1:]], list(names)))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    it = scanned(C.read(spark, sf_dir, "documents").select("doc_id", "text"))
    named = lambda labels, found, field: F.transform(found, lambda x: F.get(F.array(*map(F.lit, labels)), x[field].cast("int")))
    base = named(PHRASES.values(), F.col("places"), "phrase")
    other = named([label for label, *_ in TEMPLATES], F.col("blocks"), "template")
    text = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    start = F.transform("places", lambda x: x["word"])
    best = F.coalesce(F.array_max(F.transform("blocks", lambda x: x["overlap"] / x["size"])), F.lit(0.0))
    return it.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(start).alias("first_word"), F.array_max(start).alias("last_word"), text(base).alias("base_labels"), text(F.concat(base, other)).alias("labels"), F.when(F.size("places") > 0, 1.0).otherwise(best).alias("score"))
