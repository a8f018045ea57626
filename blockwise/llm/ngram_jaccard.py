"""N-gram Jaccard join with token-combination prefixes.

A document is the set of its distinct word shingles (tokens). Tokens are ordered by document frequency, rare ones
first. Two sets that reach the threshold share many tokens, and the first r of them all lie in the first
``n - ceil(t n) + r`` tokens of each set: its prefix extended to r. Rare tokens of the prefix are indexed one by one.
Frequent tokens are dealt by hash into m < r classes, and pairs of one class are indexed: r shared tokens without a
rare one have two in some class, so no link is lost at any length. m grows with the set's size (by powers of two, which
both sides know), so that classes stay small and a set has a number of pairs in proportion to its tokens.

Equal sets are one class throughout. In the first pass each posting list proposes only its most central member with
each other one, a number linear in the list; verified links give components. The second pass compares all pairs of a
list whose members are still in different components, so no link between components is missed: short lists
propose their pairs; longer ones are compared in tiles, together with the lists that have the same most central member,
and tiles whose sizes cannot reach the threshold do not meet. Every pair is verified on the whole token sets (tokens of
one set only cannot be shared, so tokens of two sets or more and the set sizes decide), with integers.

Frequencies and posting lists are combined as in ``counting``: no task meets all sets of one token or pair of tokens,
but in short lists. Document frequencies count equal sets of different chunks each; they only order tokens.

Null texts have no words; sets without tokens link with nothing; rows without an id are returned with neither links nor
component; rows that share an id are one node. Texts of any length are taken whole. Extra columns are ignored; an empty
table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import discard, materialize, mix, shingle_hashes, trim
from .components import components, forest
from .counting import RANGED, Words, answers, met, n_ranges, summed, to_ranges, word_chunks
from .packing import pack, unpack

RARE = 64  # tokens of more sets than this are frequent
LIST = 24  # lists of more sets, of different components, are compared in tiles
TILE = 128
BLOCK = 2000  # sets whose signatures are one row
SALTS = 8
LIST_KEYS = 700_000  # lists that a range of signatures shall hold: an entry of a list has six values


def similar(shared, a, b, num: int, den: int):
    return den * shared >= num * (a + b - shared)


def least_overlap(n: int, num: int, den: int) -> int:
    """Tokens that a set of n shares with any set it links to, at least."""
    return -(-num * n // den)


def levels(n: int, num: int, den: int) -> range:
    """Of pairs with a set of n tokens, the powers of two that the larger set's size can have."""
    return range(n.bit_length() - 1, (n * den // num).bit_length())


def classes_at(level: int, num: int, den: int) -> int:
    """Classes of frequent tokens for pairs whose larger set has 2^level tokens or more; 0 where such a pair may share
    one token only, so that single tokens are indexed."""
    surely = least_overlap(1 << level, num, den)
    return min(max(1, round((den - num) * (1 << level) / den)), surely - 1)


def signatures(tokens: np.ndarray, df: np.ndarray, n: int, num: int, den: int, rare: int = RARE) -> np.ndarray:
    """Distinct index keys of a set of n tokens, of which ``tokens`` occur in two sets or more, ascending by ``df``."""
    out = []
    for level in levels(n, num, den):
        m = classes_at(level, num, den)
        head = max(0, n - least_overlap(n, num, den) + m + 1 - (n - len(tokens)))
        often = df[:head] > rare
        out.append(tokens[:head][~often])
        often = tokens[:head][often]
        if not m:
            out.append(often)
            continue
        dealt = mix(often ^ np.uint64(level)) % np.uint64(m)
        order = np.lexsort((often, dealt))
        often, dealt = often[order], dealt[order]
        for step in range(1, len(often)):
            i = np.flatnonzero(dealt[step:] == dealt[:-step])
            if not len(i):
                break
            out.append(mix(often[i] ^ mix(often[i + step])))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def _name(tokens: np.ndarray) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(tokens.tobytes())
    return h >> 64, h & (2**64 - 1)


def _signed(x: list[int]) -> np.ndarray:
    return np.array(x, np.uint64).view(np.int64)


def _sets(chunk: Words, words: int, num: int, den: int):
    """Of a chunk: each row's set as (size, name), and the distinct sets that may link with another, by name."""
    rows, sets = [], {}
    for i in range(len(chunk.sizes)):
        s = np.unique(shingle_hashes(chunk.row(i), words))
        name = _name(s)
        rows.append((len(s), *name))
        if den * len(s) >= num * (len(s) + 1):
            sets.setdefault(name, s)
    return rows, sets


def token_sets(docs: DataFrame, words: int, num: int, den: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, h1, h2, weight, tokens) of every row: its set's size and 128-bit name. Of the rows of a chunk with equal
    sets that may link with another, the one of the smallest id has ``tokens``: those of two sets or more, rare ones
    first, with their frequencies. ``weight`` is the sum of these by the set's size."""
    chunks = materialize(word_chunks(docs, True, id_col, text_col), "words")
    ranges = n_ranges(chunks)

    def entries(batches):
        for b in batches:
            for g, blob in zip(b.column("g").to_pylist(), b.column("blob").to_pylist()):
                _, sets = _sets(Words(blob), words, num, den)
                if sets:
                    keys, often = np.unique(np.concatenate([*sets.values()]), return_counts=True)
                    yield from to_ranges(g, keys, [often.astype(np.uint32)], ranges)
        trim()

    def shaped(g, blob, found):
        chunk = Words(blob)
        rows, sets = _sets(chunk, words, num, den)
        keys, place = np.unique(np.concatenate([*sets.values()]), return_inverse=True) if sets else (np.zeros(0, np.uint64), [])
        df = np.ones(len(keys), np.uint64)
        if found[0]:
            df[found[0][0]] = found[0][1]
        packed, at = {}, 0
        for name, s in sets.items():
            own = df[place[at : at + len(s)]]
            at += len(s)
            tokens, own = s[own > 1], own[own > 1]
            if len(tokens) >= least_overlap(len(s), num, den):
                order = np.lexsort((tokens, own))
                packed[name] = float(own.sum() / len(s)), pack(tokens[order], own[order])
        first: dict = {}
        for i, row in enumerate(rows):
            if chunk.known[i] and row[1:] in packed and (row[1:] not in first or chunk.ids[i] < chunk.ids[first[row[1:]]]):
                first[row[1:]] = i
        mine = [packed[row[1:]] if first.get(row[1:]) == i else (None, None) for i, row in enumerate(rows)]
        n, h1, h2 = (_signed([r[c] for r in rows]) for c in range(3))
        yield pa.RecordBatch.from_arrays([pa.array(chunk.ids, mask=~chunk.known), *map(pa.array, (n, h1, h2)), pa.array([m[0] for m in mine], pa.float64()), pa.array([m[1] for m in mine], pa.binary())], ["id", "n", "h1", "h2", "weight", "tokens"])

    df = materialize(answers(chunks.select("g", "blob").mapInArrow(entries, RANGED), summed), "frequencies")
    out = materialize(met(chunks, df, run=shaped, schema="id long, n long, h1 long, h2 long, weight double, tokens binary"), "sets")
    discard(chunks, df)
    return out


def blocks(sets: DataFrame, num: int, den: int, rare: int = RARE) -> DataFrame:
    """(g, n_words, blob) of (id, n, weight, component, tokens): the signatures of some sets as one row. ``g`` is drawn
    at random, so the result must be written before it is used twice."""
    import secrets

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK):
                part = b.slice(lo, BLOCK)
                ids, n, weight, comp = (part.column(c).to_numpy() for c in range(4))
                found = [signatures(*unpack(t), int(k), num, den, rare) for t, k in zip(part.column(4).to_pylist(), n)]
                size = np.array([len(s) for s in found], np.uint32)
                blob = pack(np.concatenate(found), size, *(np.ascontiguousarray(c).view(np.uint64) for c in (ids, n, weight, comp)))
                yield pa.RecordBatch.from_arrays([pa.array([secrets.randbits(63)], pa.int64()), pa.array([int(size.sum())], pa.int64()), pa.array([blob], pa.binary())], ["g", "n_words", "blob"])
        trim()

    return sets.select("id", "n", "weight", "component", "tokens").mapInArrow(run, "g long, n_words long, blob binary")


class _Lists:
    """The posting lists of a block: entries by signature, the most central set (``weight``, then smallest id) first."""

    def __init__(self, blob: bytes) -> None:
        sig, size, ids, n, weight, comp = unpack(blob)
        own = np.repeat(np.arange(len(size)), size)
        ids, n, weight, comp = ids.view(np.int64), n.view(np.int64), weight.view(np.float64), comp.view(np.int64)
        rank = np.empty(len(ids), np.int64)
        rank[np.lexsort((ids, -weight))] = np.arange(len(ids))
        order = np.lexsort((rank[own], sig))
        self.sig, own = sig[order], own[order]
        self.ids, self.n, self.comp, self.weight = ids[own], n[own], comp[own], weight[own]
        self.first = np.flatnonzero(np.concatenate([[True], self.sig[1:] != self.sig[:-1]])) if len(sig) else np.zeros(0, np.int64)
        self.size = np.diff(np.append(self.first, len(sig)))

    def says(self) -> list[np.ndarray]:
        """Of each list: its length, its components' range, and its most central set."""
        low, high = (f.reduceat(self.comp, self.first) for f in (np.minimum, np.maximum))
        return [self.size.astype(np.uint64), *(np.ascontiguousarray(x).view(np.uint64) for x in (low, high, self.weight[self.first], self.ids[self.first], self.n[self.first]))]


def _lists(starts: np.ndarray, values: list[np.ndarray]):
    """Lists of different components: their lengths, most central sets and these sets' sizes."""
    count, low, high, weight, lead, n = values
    total = np.add.reduceat(count, starts)
    mixed = np.minimum.reduceat(low.view(np.int64), starts) != np.maximum.reduceat(high.view(np.int64), starts)
    which = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(count))))
    best = np.lexsort((lead.view(np.int64), -weight.view(np.float64), which))[starts]
    return mixed, [total, lead[best], n[best]]


def candidates(signed: DataFrame, num: int, den: int, across: bool, short: int = LIST) -> DataFrame:
    """(a, b, hot) of the blocks ``signed``. Not ``across``: the most central set of each list with each other one. Else,
    of lists with different components: all their pairs in short ones, and (most central set, member) in hot ones."""
    ranges = n_ranges(signed, LIST_KEYS)

    def entries(batches):
        for b in batches:
            for g, blob in zip(b.column("g").to_pylist(), b.column("blob").to_pylist()):
                lists = _Lists(blob)
                if len(lists.first):
                    yield from to_ranges(g, lists.sig[lists.first], lists.says(), ranges)
        trim()

    def told(g, blob, found):
        if not found[0]:
            return
        lists, (at, total, lead, n) = _Lists(blob), found[0]
        size = lists.size[at]
        row = np.repeat(lists.first[at] - np.cumsum(size) + size, size) + np.arange(size.sum())
        total, lead, n = (np.repeat(x, size) for x in (total, lead.view(np.int64), n.view(np.int64)))
        if not across:
            yield _pairs(lead, lists.ids[row], n, lists.n[row], num, den)
            return
        hot = total > short
        yield _distinct(lead[hot], lists.ids[row[hot]], True)
        row = row[~hot]
        yield from to_members(lists.sig[row], lists.ids[row], lists.n[row], lists.comp[row])

    def to_members(sig, ids, n, comp):
        """Entries of short lists travel on to meet; the first three columns carry a range and its entries."""
        at = mix(sig) % np.uint64(ranges)
        for r in np.unique(at).tolist():
            own = at == r
            blob = pack(sig[own], *(np.ascontiguousarray(x[own]).view(np.uint64) for x in (ids, n, comp)))
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int64()), pa.array([0], pa.int64()), pa.array([None], pa.bool_()), pa.array([blob], pa.binary())], ["a", "b", "hot", "blob"])

    def meet(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sig, ids, n, comp = (np.concatenate(c) for c in zip(*[unpack(x) for b in batches for x in b.column("blob").to_pylist()]))
        order = np.argsort(sig, kind="stable")
        sig, ids, n, comp = sig[order], ids[order].view(np.int64), n[order].view(np.int64), comp[order]
        held = []
        for step in range(1, short):  # entries that stand so far apart in a list
            i = np.flatnonzero(sig[step:] == sig[:-step])
            if not len(i):
                break
            i = i[comp[i] != comp[i + step]]
            held.append((i, i + step))
        x, y = (np.concatenate(h) for h in zip(*held)) if held else (np.zeros(0, np.int64),) * 2
        yield _pairs(ids[x], ids[y], n[x], n[y], num, den).drop_columns(["blob"])
        trim()

    lists = answers(signed.select("g", "blob").mapInArrow(entries, RANGED), _lists)
    found = met(signed, lists, run=told, schema="a long, b long, hot boolean, blob binary")
    if not across:
        return found.select("a", "b").distinct()
    found = materialize(found, "lists")
    few = found.where("hot is null").select("a", "blob").groupBy("a").applyInArrow(meet, "a long, b long, hot boolean")
    return few.unionAll(found.where("hot").select("a", "b", "hot")).distinct()


def _distinct(a: np.ndarray, b: np.ndarray, hot: bool) -> pa.RecordBatch:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    fresh = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
    m = int(fresh.sum())
    return pa.RecordBatch.from_arrays([pa.array(a[fresh], pa.int64()), pa.array(b[fresh], pa.int64()), pa.array(np.full(m, hot)), pa.nulls(m, pa.binary())], ["a", "b", "hot", "blob"])


def _pairs(a, b, na, nb, num: int, den: int) -> pa.RecordBatch:
    ok = (a != b) & (den * np.minimum(na, nb) >= num * np.maximum(na, nb))
    return _distinct(np.minimum(a, b)[ok], np.maximum(a, b)[ok], False)


def tile_links(members: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) forests of the links between sets of different components within each ``cluster`` of (cluster, id). Sets
    fall into size classes of which only neighbouring ones can link, and classes into tiles of about ``TILE`` sets. Every
    pair of tiles is a task of its own: overlaps are a product of incidence matrices, and no pair leaves the
    task but a spanning forest of links."""
    step = math.log(den / num) * (1 + 1e-9)
    sized = members.join(sets.select("id", "n"), "id").withColumn("s", F.floor(F.log("n") / step).cast("int"))
    tiles = sized.groupBy("cluster", "s").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    own = sized.join(tiles, ["cluster", "s"]).withColumn("u", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")).select("cluster", "id", "s", "u")
    other = tiles.select("cluster", F.col("s").alias("s2"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("u2"))
    near = own.withColumn("s2", F.explode(F.array(F.col("s") - 1, F.col("s"), F.col("s") + 1))).join(other, ["cluster", "s2"])
    here, there = F.struct("s", "u"), F.struct(F.col("s2").alias("s"), F.col("u2").alias("u"))
    cells = near.select("cluster", F.least(here, there).alias("i"), F.greatest(here, there).alias("j"), "id").join(sets.select("id", "n", "component", "tokens"), "id")

    def compare(key, table):
        ids, n, comp = (table.column(c).to_numpy() for c in ("id", "n", "component"))
        found = [np.zeros(0, np.int64)] * 2
        if len(ids) and comp.min() != comp.max():
            sets = [unpack(t)[0] for t in table.column("tokens").to_pylist()]
            size = np.array(list(map(len, sets)))
            _, flat = np.unique(np.concatenate(sets), return_inverse=True)
            row = np.repeat(np.arange(len(sets)), size)
            order = np.argsort(flat, kind="stable")
            flat, row = flat[order], row[order]
            shared = np.zeros((len(sets), len(sets)), np.float32)
            for lo in range(0, int(flat[-1]) + 1, 4096):
                a, z = np.searchsorted(flat, [lo, lo + 4096])
                part = np.zeros((len(sets), 4096), np.float32)
                part[row[a:z], flat[a:z] - lo] = 1
                shared += part @ part.T
            x, y = np.nonzero(np.triu(similar(shared.astype(np.int64), n[:, None], n[None, :], num, den) & (comp[:, None] != comp[None, :]), 1))
            if len(x):
                found = forest(ids[x], ids[y])
        return pa.table({"a": pa.array(found[0], pa.int64()), "b": pa.array(found[1], pa.int64())})

    return cells.select("cluster", "i.s", "i.u", F.col("j.s").alias("s2"), F.col("j.u").alias("u2"), "id", "n", "component", "tokens").groupBy("cluster", "s", "u", "s2", "u2").applyInArrow(compare, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b, linked) of proposed pairs, on whole sets."""

    def check(batches):
        for b in batches:
            last, mine, out = None, None, []
            for na, nb, x, y in zip(*(b.column(c).to_pylist() for c in ("na", "nb", "ta", "tb"))):
                if x != last:
                    last, mine = x, np.sort(unpack(x)[0])
                other = unpack(y)[0]
                at = np.minimum(np.searchsorted(mine, other), len(mine) - 1)
                out.append(bool(similar(int((mine[at] == other).sum()), na, nb, num, den)))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(out, pa.bool_())], ["a", "b", "linked"])
        trim()

    left = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "na", "nb", "ta", "tb").mapInArrow(check, "a long, b long, linked boolean")


def jaccard_components(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", rare: int = RARE, short: int = LIST) -> DataFrame:
    """(doc_id, n_shingles, component_id): the component under links of Jaccard similarity num/den or more. ``rare`` and
    ``short`` set how tokens and lists are treated, and change no result."""
    rows = token_sets(docs, words, num, den, id_col, text_col)
    names = rows.select("id", "n", "h1", "h2")
    classes = names.where("id is not null and n > 0").groupBy("h1", "h2").agg(F.min("id").alias("id"))
    sets = materialize(rows.where("tokens is not null").join(classes, ["h1", "h2", "id"], "left_semi").dropDuplicates(["h1", "h2"]).select("id", "n", "weight", "tokens"), "tokens")
    signed = materialize(blocks(sets.withColumn("component", F.col("id")), num, den, rare), "signatures")
    tried = materialize(verified(candidates(signed, num, den, False), sets, num, den), "links")
    discard(signed)
    first = components(tried.where("linked").select("a", "b"))
    labelled = materialize(sets.join(first, "id", "left").withColumn("component", F.coalesce("component", "id")), "labelled")
    signed = materialize(blocks(labelled, num, den, rare), "signatures")
    rest = materialize(candidates(signed, num, den, True, short), "rest")
    few = rest.where("not hot").select("a", "b").join(tried, ["a", "b"], "left_anti")
    more = verified(few, labelled, num, den).where("linked").select("a", "b")
    if not (hot := rest.where("hot")).isEmpty():
        more = more.unionAll(tile_links(hot.select(F.col("a").alias("cluster"), F.col("b").alias("id")), labelled, num, den))
    more = materialize(more, "links")
    discard(signed, labelled, rest, sets, tried)
    every = first.select(F.col("id").alias("a"), F.col("component").alias("b")).unionAll(more)
    found = first if more.isEmpty() else components(every)
    by_class = classes.join(found, "id", "left").select("h1", "h2", F.coalesce("component", "id").alias("component"))
    salted = by_class.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # equal sets may be a third of all rows
    out = names.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salted, ["h1", "h2", "salt"], "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))


def drop_near_copies(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of each component stays: that of the smallest id, with all its columns. Rows of one id stay together;
    rows without an id stay."""
    gone = jaccard_components(docs, words, num, den).where("doc_id <> component_id").select("doc_id").distinct()
    gone = materialize(gone, "gone")
    return docs.join(gone, docs["doc_id"] == gone["doc_id"], "left_anti")
