"""Licence scans by fuzzy short-notice search.

Each notice is split by the pigeonhole rule into ``errors + 1`` pieces: any occurrence with at most ``errors`` edits
holds one piece exactly. Exact seed hits locate candidate spans, from each word that can begin one to each word that can
end it, and the regex library's bounded-error matching verifies each of them alone and counts its edits (insertions,
deletions and substitutions of code points). So every run of whole words within the edits of a notice is found, whatever
stands beside it. Of runs that overlap, the likeliest stays. Three short base phrases are found exactly, word by word.

Words are lower-cased (A-Z only) runs of ASCII letters, digits and non-ASCII characters. Null texts count as empty;
texts of any length are taken whole; repeated rows give repeated results; an empty table gives an empty one; extra
columns are ignored. Of equally likely runs, the one that starts first stays, then the shorter, then by label.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .common import id_text

BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
NOTICES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under the gnu general public license version 3", "gpl-3"),
    ("licensed under the gnu general public license version 2", "gpl-2"),
    ("gnu lesser general public license", "lgpl"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("mozilla public license version 2 0", "mpl-2"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("all rights reserved", "proprietary"),
)
_KEEP = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


@lru_cache(maxsize=8)
def compiled(notices: tuple[tuple[str, str], ...] = NOTICES, errors: int = 3):
    """(notice, label, errors, seeds with their offsets, pattern): one edit for each 12 characters, one at least."""
    out = []
    for text, label in notices:
        text = normalise(text)[1].decode()[1:-1]
        e = min(errors, max(1, len(text) // 12)) if errors else 0
        cuts = [round(i * len(text) / (e + 1)) for i in range(e + 2)]
        out.append((text, label, e, [(text[a:b], a) for a, b in zip(cuts, cuts[1:]) if a < b], regex.compile(f"(?b)(?:{regex.escape(text, special_only=True)}){{e<={e}}}")))
    return out


def normalise(text: str) -> tuple[int, bytes]:
    """Number of words, and the words joined and framed by single spaces (UTF-8)."""
    words = text.encode().translate(_KEEP).split()
    return len(words), b" " + b" ".join(words) + b" "


def base_places(norm: bytes) -> list[tuple[int, str]]:
    out = []
    for phrase, label in BASE:
        key, at = f" {phrase} ".encode(), -1
        while (at := norm.find(key, at + 1)) >= 0:
            out.append((norm.count(b" ", 0, at), label))
    return sorted(out)


def occurrences(norm: bytes, notices: tuple[tuple[str, str], ...] = NOTICES, errors: int = 3) -> list[tuple[int, int, str, int, float]]:
    """(first word, end word, label, edits, likeness) of all runs of words within the edits of a notice."""
    line, spaces, out = None, [], []
    for text, label, e, seeds, pattern in compiled(notices, errors):
        spans = set()
        for seed, offset in seeds:
            if seed.encode() not in norm:
                continue
            if line is None:
                line = norm.decode()
                spaces = [i for i, c in enumerate(line) if c == " "]
            at = -1
            while (at := line.find(seed, at + 1)) >= 0:
                start, end = at - offset, at - offset + len(text)
                begins = spaces[bisect_left(spaces, start - e - 1) : bisect_right(spaces, start + e - 1)]
                ends = spaces[bisect_left(spaces, end - e) : bisect_right(spaces, end + e)]
                spans.update((a + 1, z) for a in begins for z in ends if a + 1 < z)
        for a, z in spans:
            if (m := pattern.fullmatch(line, a, z)) and (edits := sum(m.fuzzy_counts)) <= e:
                out.append((bisect_left(spaces, a - 1), bisect_left(spaces, z), label, edits, 1 - edits / len(text)))
    return sorted(out)


def likeliest(found: list[tuple[int, int, str, int, float]]) -> list[tuple[int, int, str, int, float]]:
    """Of runs that overlap, the likeliest, taken greedily."""
    used, kept = bytearray(max((f[1] for f in found), default=0)), []
    for f in sorted(found, key=lambda f: (-f[4], f)):
        if used.find(1, f[0], f[1]) < 0:
            used[f[0] : f[1]] = b"\x01" * (f[1] - f[0])
            kept.append(f)
    return sorted(kept)


SCHEMA = "doc_id long, n_words long, base array<struct<word int, label string>>, spans array<struct<first int, end int, label string, edits int, likeness double>>"
_TYPES = [pa.int64(), pa.int64(), pa.list_(pa.struct([("word", pa.int32()), ("label", pa.string())])), pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("edits", pa.int32()), ("likeness", pa.float64())]))]


def find_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", errors: int = 3, notices: tuple[tuple[str, str], ...] = NOTICES) -> DataFrame:
    """Base places and verified spans (in words) of ``notices`` (text, label) in every row. One narrow scan."""

    def scan(batches):
        for b in batches:
            counts, bases, spans = [], [], []
            for t in b.column(1).to_pylist():
                n, norm = normalise(t)
                counts.append(n)
                bases.append([{"word": w, "label": k} for w, k in base_places(norm)])
                spans.append([dict(zip(("first", "end", "label", "edits", "likeness"), s)) for s in likeliest(occurrences(norm, notices, errors))])
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v, t) for v, t in zip((counts, bases, spans), _TYPES[1:]))], ["doc_id", "n_words", "base", "spans"])

    return id_text(docs, id_col, text_col).mapInArrow(scan, SCHEMA)


def digest(found: DataFrame) -> DataFrame:
    """The columns of ``op5_license_scan``: the score is 1 with a base phrase, else the likeness of the best notice."""
    labels = lambda c: F.array_sort(F.array_distinct(c))
    base, more = F.col("base.label"), F.col("spans.label")
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min("base.word").cast("long").alias("first_word"), F.array_max("base.word").cast("long").alias("last_word"),
        F.array_join(labels(base), ",").alias("base_labels"), F.array_join(labels(F.concat(base, more)), ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.array_max("spans.likeness"), F.lit(0.0))).alias("score"),
        F.size("spans").cast("long").alias("n_spans"),
    )
