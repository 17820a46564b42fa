"""License scans by diagonal voting (operator 11).

All rolling word k-grams of a text are joined by hash to the positions of the same k-grams in license
templates. A hit votes for the diagonal (word position minus template position) on which it lies; the
votes of a place where the template's words stand gather on one diagonal. Neighbouring diagonals, as
words inserted or left out make them, are merged; a merged span is verified by its template's k-grams
that it really holds, compared as text and counted once, and by its length.

Templates are phrases, which count only where all their words stand consecutively, and notices, of
which a share of the k-grams must be found. They are a parameter: the table of their k-grams is
broadcast only up to ``BROADCAST_GRAMS`` rows, else the join shuffles.

One reading of the documents makes everything: each text also emits an opening row without a k-gram, so
texts without hits, and their word counts, need no second reading. Only hits are shuffled, dealt by
document. The hashes of all k-grams of a text come from running sums over its bytes, by array
operations; texts are taken in pieces of 65,536 words that overlap by a k-gram.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritext.llm.common import small_batches

PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
    " documentation files the software to deal in the software without restriction": "mit",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the"
    " following conditions are met": "bsd",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "licensed under cc by 4 0": "cc-by",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under a creative commons attribution 4 0 international license": "cc-by",
    "all rights reserved": "reserved",
}
#: Longer tables of template k-grams (about 100 bytes a row) are joined by a shuffle.
BROADCAST_GRAMS = 100_000
#: Words hashed at a time, and rows in an Arrow batch of k-grams.
PIECE, ROWS = 1 << 16, 1 << 17

#: Bytes of words (digits, letters, all of characters beyond ASCII) as they are, capitals as small letters, all others as blanks.
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


@dataclass(frozen=True)
class Template:
    """Words joined by blanks, their label, the size of k-grams, and whether all of them must stand consecutively."""

    text: str
    label: str
    exact: bool
    k: int

    @property
    def grams(self) -> list[str]:
        w = self.text.split(" ")
        return [" ".join(w[i : i + self.k]) for i in range(len(w) - self.k + 1)]


def templates(phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES, k: int = 5) -> list[Template]:
    """Phrases vote by pairs of words; notices by k-grams, those of fewer than k + 2 words by pairs too."""
    out = [Template(t, label, True, 2) for t, label in phrases.items()]
    out += [Template(t, label, False, k if len(t.split(" ")) >= k + 2 else 2) for t, label in notices.items()]
    if any(len(t.text.split(" ")) < 2 for t in out):
        raise ValueError("a template needs two words at least")
    return out


class _Powers:
    """Powers of the hash's base and of its inverse, as many as were asked for so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = 1 << (n - 1).bit_length()
            steps = [np.full(size, x, dtype=np.uint64) for x in (_BASE, _INVERSE)]
            for x in steps:
                x[0] = 1
            self.up, self.down = (np.cumprod(x, dtype=np.uint64) for x in steps)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A text's words joined by blanks, as bytes, and where each word starts and stops there."""
    b = np.frombuffer(text.encode("utf-8", "replace").translate(_BYTES), dtype=np.uint8)
    blank = b == 32
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    b = b[keep]
    stops = np.flatnonzero(b == 32)
    if len(b) and b[-1] != 32:
        stops = np.append(stops, len(b))
    return b, np.append(0, stops[:-1] + 1)[: len(stops)], stops


def hashes(b: np.ndarray, starts: np.ndarray, stops: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    """64-bit hashes of all rolling k-grams of words for each size k, from sums of byte times power of its place."""
    up, down = _POWERS.get(len(b) + 1)
    sums = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    before, scale, out = sums[starts], down[starts], []
    for k in sizes:
        n = max(len(starts) - k + 1, 0)
        h = (sums[stops[len(stops) - n :]] - before[:n]) * scale[:n]
        h ^= h >> np.uint64(32)
        h *= np.uint64(_BASE)
        out.append((h ^ (h >> np.uint64(29))).view(np.int64))
    return out


def gram_hash(gram: str) -> int:
    b, starts, stops = words(gram)
    return int(hashes(b, starts, stops, [len(starts)])[0][0])


def _grams(docs: DataFrame, sizes: list[int], known: set[int], ident: str) -> DataFrame:
    """(row, pos, hash, gram, ident, n_words): all rolling k-grams of each size of each text, and for each text one row whose gram is ''.

    Only that row has ident and n_words. A k-gram's words are given where its hash is ``known``, for the
    comparison behind the join; elsewhere gram is null.
    """
    small_batches(docs.sparkSession)
    text = docs.select(F.monotonically_increasing_id().alias("row"), F.col(ident).alias("ident"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kind = text.schema["ident"].dataType.simpleString()
    wanted = np.array(sorted(known), dtype=np.int64)

    def pieces(row: int, b: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> Iterator[tuple]:
        for at in range(0, len(starts), PIECE):
            end = min(at + PIECE + max(sizes) - 1, len(starts))
            low = starts[at]
            part = b[low : stops[end - 1]], starts[at:end] - low, stops[at:end] - low
            for k, h in zip(sizes, hashes(*part, sizes)):
                h = h[:PIECE]
                found = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)] == h)
                grams = np.full(len(h), None, dtype=object)
                for i in found:
                    grams[i] = part[0][part[1][i] : part[2][i + k - 1]].tobytes().decode()
                yield np.full(len(h), row), np.arange(at, at + len(h)), h, grams

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "pos", "hash", "gram", "ident", "n_words"]
        held, size, none = [], 0, None

        def flush() -> pa.RecordBatch:
            row, pos, h, grams = (np.concatenate(x) for x in zip(*held))
            blank = [pa.nulls(len(h), none), pa.nulls(len(h), pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(row), pa.array(pos), pa.array(h), pa.array(grams, pa.string()), *blank], names=names)

        for b in batches:
            none, n_words = b.column("ident").type, []
            for row, t in zip(b.column("row").to_pylist(), b.column("text").to_pylist()):
                at = words(t)
                n_words.append(len(at[1]))
                for piece in pieces(row, *at):
                    held.append(piece)
                    size += len(piece[0])
                    if size >= ROWS:
                        yield flush()
                        held, size = [], 0
            zero = pa.array(np.zeros(b.num_rows, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([b.column("row"), zero, zero, pa.array([""] * b.num_rows, pa.string()), b.column("ident"), pa.array(n_words, pa.int64())], names=names)
        if held:
            yield flush()

    return text.mapInArrow(run, f"row long, pos long, hash long, gram string, ident {kind}, n_words long")


def _spans(docs: DataFrame, known: list[Template], ident: str, share: float, drift: int) -> DataFrame:
    """Merged diagonals of each text, and its opening row (template -1): row, ident, n_words, template, start, stop, share, verified."""
    spark = docs.sparkSession
    rows = [(g, gram_hash(g), t, i, k.k) for t, k in enumerate(known) for i, g in enumerate(k.grams)]
    grams = _grams(docs, sorted({t.k for t in known}), {r[1] for r in rows}, ident)
    places = spark.createDataFrame([*rows, ("", 0, -1, 0, 0)], "t_gram string, t_hash long, template int, place long, k int")
    if len(rows) < BROADCAST_GRAMS:
        places = F.broadcast(places)
    hits = grams.join(places, (F.col("hash") == F.col("t_hash")) & (F.col("gram") == F.col("t_gram")))
    hits = hits.withColumn("diagonal", F.col("pos") - F.col("place")).repartition("row")
    diagonals = hits.groupBy("row", "template", "diagonal").agg(
        F.collect_list("place").alias("places"), F.min("place").alias("low"), F.max(F.col("place") + F.col("k")).alias("high"),
        F.max("ident").alias("ident"), F.max("n_words").alias("n_words"),
    )

    facts = [(t, len(k.grams), len(k.text.split(" ")), k.exact, k.label) for t, k in enumerate(known)] + [(-1, 0, 0, True, None)]
    of = spark.createDataFrame(facts, "template int, n_grams int, length int, exact boolean, label string")
    diagonals = diagonals.join(F.broadcast(of), "template")
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    far = F.col("diagonal") - F.lag("diagonal").over(along) > F.when(F.col("exact"), 0).otherwise(drift)
    group = F.sum(F.coalesce(far, F.lit(True)).cast("int")).over(along)
    merged = diagonals.withColumn("group", group).groupBy("row", "template", "group").agg(
        F.min(F.col("diagonal") + F.col("low")).alias("start"), F.max(F.col("diagonal") + F.col("high")).alias("stop"),
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("held"),
        *[F.max(c).alias(c) for c in ("ident", "n_words", "n_grams", "length", "exact", "label")],
    )
    part = F.when(F.col("n_grams") > 0, F.col("held") / F.col("n_grams")).otherwise(F.lit(0.0))
    fits = F.when(F.col("exact"), F.col("held") == F.col("n_grams")).otherwise(
        (part >= share) & (2 * (F.col("stop") - F.col("start")) <= 3 * F.col("length"))
    )
    return merged.select("row", "ident", "n_words", "template", "label", "exact", "start", "stop", part.alias("share"), fits.alias("verified"))


def license_spans(docs: DataFrame, known: list[Template] | None = None, ident: str = "doc_id", share: float = 0.6, drift: int = 8) -> DataFrame:
    """Verified spans of license templates: ident, label, phrase (the template), exact, start, stop (words from 0, stop excluded), share.

    Null and empty texts have none. Overlapping spans of different templates are all returned, repeated rows each bring
    their own. An empty table gives an empty one. Columns other than ``ident`` and text are not read.
    """
    known = templates() if known is None else known
    names = F.array(*[F.lit(t.text) for t in known])
    out = _spans(docs, known, ident, share, drift).withColumn("ident", F.max("ident").over(Window.partitionBy("row")))
    return out.filter("verified and template >= 0").select(F.col("ident").alias(ident), "label", F.get(names, "template").alias("phrase"), "exact", "start", "stop", "share")


def license_scan(docs: DataFrame, known: list[Template] | None = None, ident: str = "doc_id", share: float = 0.6, drift: int = 8) -> DataFrame:
    """One row for each row of ``docs``: ident, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts all places of exact phrases (places of two phrases that overlap are two), first_word and
    last_word are the least and greatest start of them, null if there is none. ``labels`` adds the labels of verified
    notices. ``score`` is the greatest share of a template's k-grams on a merged diagonal, 0 without hits, 1 wherever a phrase
    stands. Null and empty texts have no words; texts of any length are read whole; repeated rows and ids, null
    ones too, are rows of their own; an empty table gives an empty one. Other columns are not read.
    """
    base = F.col("verified") & F.col("exact") & (F.col("template") >= 0)
    joined = lambda of: F.array_join(F.array_sort(F.collect_set(F.when(of, F.col("label")))), ",")
    out = _spans(docs, templates() if known is None else known, ident, share, drift).groupBy("row").agg(
        F.max("ident").alias(ident), F.max("n_words").alias("n_words"), F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("start"))).alias("first_word"), F.max(F.when(base, F.col("start"))).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.col("verified")).alias("labels"), F.max("share").alias("score"),
    )
    return out.drop("row")
