"""Document fingerprints by SimHash.

Terms (words, and pairs of neighbouring words) are hashed to ``bits`` signed votes, weighted and summed; the signs are
the fingerprint. ``within_radius`` finds all pairs of distinct fingerprints within a Hamming radius through block tables:
the bits are cut into more than ``radius / 2`` blocks, so any pair within the radius agrees on one of them but for at
most one bit, and there is one table for each block. None is missed; what is compared grows with the square of the rows.

Words are lower-cased (A-Z) runs without ASCII white space. Null or empty texts have the all-zero fingerprint;
equal texts have equal ones. Texts of any length are fingerprinted whole. Rows without an id have fingerprints, but
stand outside the order of ids: the empty text is their next. Rows that share an id follow each other by a hash of the
text. Extra columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import id_text, materialize, mix, partitions, word_hashes

BITS = 256
WORD_WEIGHT, PAIR_WEIGHT = 0.25, 1.0
#: Of the pairs of sf0.1 with a five-word Jaccard similarity of 0.8 or more, the farthest lie 33 bits apart.
RADIUS = 33
#: Fingerprints of a tile: at least where there are fewer than eight tiles, and at most.
SPLIT, TILE = 8192, 2**18


def fingerprint(text: str, bits: int = BITS) -> bytes:
    """bits/8 bytes; the votes of long texts are summed in blocks of 4096 terms."""
    h = word_hashes(text.encode().lower().split())
    votes = np.zeros(bits, np.float32)
    if not len(h):
        return bytes(bits // 8)
    pairs = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) if len(h) > 1 else h[:0]
    for terms, weight in ((h, WORD_WEIGHT), (pairs, PAIR_WEIGHT)):
        for at in range(0, len(terms), 4096):
            part = terms[at : at + 4096]
            lanes = np.stack([mix(part + np.uint64((j + 1) * 0xD1B54A32D192ED03 % 2**64)) for j in range(bits // 64)], axis=1)
            ones = np.unpackbits(lanes.view(np.uint8), axis=1)
            votes += weight * (2.0 * ones.sum(axis=0, dtype=np.float32) - len(part))
    return np.packbits(votes > 0).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """1 minus the share of differing bits."""
    return 1 - (int.from_bytes(a) ^ int.from_bytes(b)).bit_count() / (8 * len(a))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """(doc_id, n_chars, fingerprint as hex) of every row. One narrow scan."""

    def scan(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, texts), pa.int64()), pa.array([fingerprint(t, bits).hex() for t in texts], pa.string())], ["doc_id", "n_chars", "fingerprint"])

    return id_text(docs, id_col, text_col).mapInArrow(scan, "doc_id long, n_chars long, fingerprint string")


def with_next(docs: DataFrame, visit, schema: str, id_col: str = "doc_id", text_col: str = "text", rows_a_range: int = 4000) -> DataFrame:
    """``visit(id, text, next_text)`` of every row as a row of ``schema``. The next row is the one with the next larger
    id (rows of one id follow each other by a hash of the text), and the last row's next is the first. Rows without
    an id stand outside that ring; the empty text is their next.

    Ids are cut into ranges at approximate quantiles; each range is sorted on its own and also gets the first row of
    the range behind it; rows without an id are dealt to ranges of their own. So texts are shuffled once, no task holds
    more than one row in Python besides its Arrow batch, and nothing is numbered globally. The driver holds one
    (id, hash) per range, 100,000 at most; larger ranges are sorted on disk."""
    rows = id_text(docs, id_col, text_col).withColumn("key", F.xxhash64("text"))
    k = max(1, min(100_000, -(-rows.count() // rows_a_range)))
    found = rows.agg(F.percentile_approx("id", [i / k for i in range(1, k)], 20 * k)).first()[0] if k > 1 else None
    cuts = np.array(sorted(set(found or [])), np.int64)

    def place(ids: pa.Array, keys: pa.Array) -> np.ndarray:
        """The range of each id; without one, a negative number by the hash of the text."""
        return np.where(ids.is_null().to_numpy(zero_copy_only=False), -1 - keys.to_numpy() % k, np.searchsorted(cuts, ids.fill_null(0).to_numpy(zero_copy_only=False)))

    def heads_of(batches):
        for b in batches:
            at, first = place(b.column(0), b.column(1)), {}
            for g, i, key in zip(at.tolist(), b.column(0).to_pylist(), b.column(1).to_pylist()):
                if g >= 0 and (g not in first or (i, key) < first[g]):
                    first[g] = (i, key)
            yield pa.RecordBatch.from_arrays([pa.array(first, pa.int64()), pa.array([v[0] for v in first.values()], pa.int64()), pa.array([v[1] for v in first.values()], pa.int64())], ["g", "id", "key"])

    heads = sorted((r.g, r.h[0], r.h[1]) for r in rows.select("id", "key").mapInArrow(heads_of, "g long, id long, key long").groupBy("g").agg(F.min(F.struct("id", "key")).alias("h")).collect())
    first = {(i, key): heads[n - 1][0] for n, (_, i, key) in enumerate(heads)}  # the head of a range also goes to the range before it

    def spread(batches):
        for b in batches:
            at = place(b.column(0), b.column(2))
            more = [(n, first[x]) for n, x in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist())) if x in first]
            take = pa.array([*range(b.num_rows), *(n for n, _ in more)], pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(take) for c in b.columns), pa.array([*at.tolist(), *(g for _, g in more)], pa.int64()), pa.array([0] * b.num_rows + [1] * len(more), pa.int32())], ["id", "text", "key", "g", "ghost"])

    types = pa.schema([(c.split()[0], {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[c.split()[1]]) for c in schema.split(", ")])

    def walk(batches):
        held = None  # (range, id, text) that waits for the next row
        for b in batches:
            out = []
            for i, text, g, ghost in zip(*(b.column(c).to_pylist() for c in ("id", "text", "g", "ghost"))):
                if i is None:
                    out.append(visit(i, text, ""))
                    continue
                if held and held[0] == g:
                    out.append(visit(held[1], held[2], text))
                held = None if ghost else (g, i, text)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [()] * len(types), types)], schema=types)

    dealt = rows.mapInArrow(spread, "id long, text string, key long, g long, ghost int").repartition(max(partitions(docs.sparkSession), k), "g")
    return dealt.sortWithinPartitions("g", "ghost", "id", "key").mapInArrow(walk, schema)


def edited_text(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def edit_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """Fingerprints of every row, of its edited text, and the likeness of both to the row's own."""

    known = {}  # fingerprints of the last two whole texts: a row's next is visited right behind it

    def whole(text):
        if text not in known:
            if len(known) > 1:
                del known[next(iter(known))]
            known[text] = fingerprint(text, bits)
        return known[text]

    def visit(i, text, following):
        changed = edited_text(text, following)
        own, edited, other = whole(text), fingerprint(changed, bits), whole(following)
        return i, len(text), hashlib.sha256(changed.encode()).hexdigest(), own.hex(), edited.hex(), likeness(own, edited), likeness(own, other)

    return with_next(docs, visit, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double", id_col, text_col)


def _runs(start: np.ndarray, size: np.ndarray):
    """(left, right) of about a million pairs at a time: each i with start[i] and the size[i] - 1 numbers behind it."""
    ends, at = np.cumsum(size), 0
    while at < len(size):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 2**20, "right")))
        n = size[at:end]
        yield np.repeat(np.arange(at, end), n), np.arange(n.sum()) + np.repeat(start[at:end] - (np.cumsum(n) - n), n)
        at = end


def _near(v: np.ndarray, w: np.ndarray | None, radius: int, bits: int):
    """(x, y, distance) arrays of all pairs within the radius of a row of ``v`` and one of ``w``, or of two rows x < y of
    ``v`` where ``w`` is None, once each. Rows are distinct fingerprints of bits/8 bytes.

    Of ``blocks`` blocks one differs in at most radius // blocks bits, here at most one: each block is a table, in which
    a row meets the rows of its own key and of the keys one bit away. A pair counts in the first table it meets in."""
    blocks = max(radius // 2 + 1, bits // 16)  # of 16 bits at most, so tables are addressed directly
    edges = [round(i * bits / blocks) for i in range(blocks + 1)]
    sides = [v] if w is None else [v, w]
    wide = [x.view(np.uint64) for x in sides]
    keys = [np.stack([np.unpackbits(x, axis=1)[:, a:z].astype(np.uint16) @ (1 << np.arange(z - a)).astype(np.uint16) for a, z in zip(edges, edges[1:])]) for x in sides]
    for t, (a, z) in enumerate(zip(edges, edges[1:])):
        order = [np.argsort(k[t], kind="stable") for k in keys]
        left, right = order[0], order[-1]
        key, counts = keys[0][t][left].astype(np.int64), np.bincount(keys[-1][t], minlength=2 ** (z - a))
        begin = np.cumsum(counts) - counts
        words = [np.ascontiguousarray(wide[n][o].T) for n, o in ((0, left), (-1, right))]
        for flip in (0, *(1 << b for b in range(z - a))):
            start, size = begin[key ^ flip], counts[key ^ flip]
            if w is None and not flip:  # the rest of the own key
                start, size = np.arange(len(key)) + 1, start + size - np.arange(len(key)) - 1
            elif w is None:
                size = np.where(key & flip, 0, size)
            for i, j in _runs(start, size):
                far = np.zeros(len(i), np.int64)
                for c in range(len(words[0])):
                    far += np.bitwise_count(words[0][c][i] ^ words[1][c][j])
                    if c % 2:
                        i, j, far = (x[far <= radius] for x in (i, j, far))
                i, j, far = (x[far <= radius] for x in (i, j, far))
                x, y = left[i], right[j]
                for e in range(t):  # met before
                    new = np.bitwise_count(keys[0][e][x] ^ keys[-1][e][y]) > 1
                    x, y, far = x[new], y[new], far[new]
                if len(x):
                    yield (np.minimum(x, y), np.maximum(x, y), far) if w is None else (x, y, far)


def _block_tables(prints: DataFrame, radius: int, bits: int, emit, schema: str) -> DataFrame:
    """Rows of ``schema`` that ``emit(left, right, pairs)`` makes of the pairs of distinct fingerprints (hex) that differ in
    at most ``radius`` bits, each pair once: bytes of fingerprints, and (x, y, distance) arrays that number them.

    Fingerprints are dealt by hash into tiles, and a task runs the tables of one pair of tiles: tasks are of one size
    whatever keys are hot, and what is shuffled is each fingerprint once per tile."""
    classes = materialize(prints.where("fingerprint is not null").select(F.unhex("fingerprint").alias("f")).distinct(), "distinct")
    n, size = classes.count(), bits // 8
    tiles = max(1, -(-n // TILE), min(8, -(-n // SPLIT)))

    def deal(batches):
        for b in batches:
            v = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(-1, size)
            own = (mix(v.view(np.uint64)[:, 0]) % np.uint64(tiles)).astype(np.int64)
            parts = [(g, v[own == g].tobytes()) for g in np.unique(own).tolist()]
            rows = [(min(g, o), max(g, o), g, f) for g, f in parts for o in range(tiles)]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.binary()))], ["i", "j", "tile", "f"])

    def compare(key, table):
        i, j = (k.as_py() for k in key)
        side = lambda g: np.frombuffer(b"".join(f for f, at in zip(table.column("f").to_pylist(), table.column("tile").to_pylist()) if at == g), np.uint8).reshape(-1, size)
        v, w = side(i), side(j)
        return emit(v, w, _near(v, None if i == j else w, radius, bits))

    dealt = classes.mapInArrow(deal, "i int, j int, tile int, f binary")
    return dealt.repartition(max(partitions(prints.sparkSession), tiles * (tiles + 1) // 2), "i", "j").groupBy("i", "j").applyInArrow(compare, schema)


def within_radius(prints: DataFrame, radius: int = RADIUS, bits: int = BITS) -> DataFrame:
    """(a, b, distance) of all pairs a < b of distinct fingerprints (hex, column ``fingerprint``) that differ in at most
    ``radius`` bits. Equal fingerprints count once; their rows are their class."""

    def pairs(v, w, found):
        rows = [(*sorted((v[a].tobytes().hex(), w[b].tobytes().hex())), d) for x, y, far in found for a, b, d in zip(x.tolist(), y.tolist(), far.tolist())]
        return pa.table({n: pa.array([r[c] for r in rows], t) for c, (n, t) in enumerate((("a", pa.string()), ("b", pa.string()), ("distance", pa.int32())))})

    return _block_tables(prints, radius, bits, pairs, "a string, b string, distance int")


def near_counts(prints: DataFrame, radius: int = RADIUS, bits: int = BITS) -> DataFrame:
    """(fingerprint, n_near): to how many other distinct fingerprints each one is within the radius, those with none
    left out. Counts alone leave a task, never pairs."""

    def counts(v, w, found):
        left, right = np.zeros(len(v), np.int64), np.zeros(len(w), np.int64)
        for x, y, _ in found:
            left += np.bincount(x, minlength=len(v))
            right += np.bincount(y, minlength=len(w))
        at = [(s, n, np.flatnonzero(n)) for s, n in ((v, left), (w, right))]
        return pa.table({"f": pa.array([s[i].tobytes() for s, _, k in at for i in k.tolist()], pa.binary()), "n": pa.array(np.concatenate([n[k] for _, n, k in at]))})

    found = _block_tables(prints, radius, bits, counts, "f binary, n long").groupBy("f").agg(F.sum("n").alias("n_near"))
    return found.select(F.lower(F.hex("f")).alias("fingerprint"), "n_near")


def near_report(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """``edit_report`` with ``n_near``: how many other distinct fingerprints of the table lie within the radius."""
    report = materialize(edit_report(docs, id_col, text_col, bits), "fingerprints")
    salted = near_counts(report, radius, bits=bits).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # equal texts may be a third of all rows
    joined = report.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["fingerprint", "salt"], "left")
    return joined.select(*report.columns, F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))


SALTS = 8
