"""Goldens, scalar models and error rules of the block-redundancy engine."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockwise import options
from blockwise.functions import collision, estimates, varint
from blockwise.operators import chunking, matching, ordering
from blockwise.sources import archive, codec
from blockwise.sources.seek import SeekSource

SCHEMA = "stream_id long, payload binary"


def blocks_of(pattern, size, tail=b""):
    """A stream of distinct random blocks by content id."""
    made = {}
    for c in pattern:
        if c not in made:
            made[c] = random.Random(c).randbytes(size)
    return b"".join(made[c] for c in pattern) + tail


def stream(spark, data):
    return spark.createDataFrame([(1, data)], SCHEMA)


def period10(n=160):
    return [i % 10 if 10 <= i < 60 else i for i in range(n)]


def test_zeros_golden_sizes(spark):
    one = codec.encode_indexed(stream(spark, bytes(50_000)), "fixed", 1000).first()
    assert (len(one["index"]), len(one["data"])) == (67, 1000)
    two = codec.encode_interleaved(stream(spark, bytes(50_000)), "fixed", 1000, 10_000).first()
    assert len(two["data"]) == 1068
    long = stream(spark, bytes(500_000))
    assert len(codec.encode_indexed(long, "fixed", 1000).first()["index"]) == 517
    assert len(codec.encode_interleaved(long, "fixed", 1000, 10_000).first()["data"]) == 1518
    index = codec.read_index(codec.encode_indexed(stream(spark, bytes(50_000)), "fixed", 1000))
    assert codec.peak_memory(codec.physical_spans(index)).first()["peak_bytes"] == 1000
    got = matching.fragments(stream(spark, bytes(50_050)), "fixed", 1000)
    assert got.count() == 51 and got.where("is_new").agg(F.sum("size")).first()[0] == 1050


def test_encoded_sizes_match_estimates(spark):
    data = stream(spark, blocks_of(period10(), 512, b"tail" * 9))
    for inter, enc in ((False, codec.encode_indexed(data, "fixed", 512)), (True, codec.encode_interleaved(data, "fixed", 512, 5120))):
        e = codec.entries(data, "fixed", 512, 5120 if inter else 0, inter)
        guess, real = estimates.encoded_size(e, 512, 10 if inter else None).first(), enc.first()
        if inter:
            assert guess["index_bytes"] + guess["data_bytes"] == len(real["data"])
        else:
            assert (guess["index_bytes"], guess["data_bytes"]) == (len(real["index"]), len(real["data"]))


@pytest.mark.parametrize("memory,interleaved,removed", [(0, False, 50), (5120, False, 50), (5120, True, 50)])
def test_period10_removed(spark, memory, interleaved, removed):
    e = codec.entries(stream(spark, blocks_of(period10(), 512)), "fixed", 512, memory, interleaved)
    assert e.where("kind = 'dup'").count() == removed


def test_reversed_copies_with_quarter_eviction(spark):
    pattern = list(range(200))
    for i in range(50):
        pattern[60 - i] = i % 10
    e = codec.entries(stream(spark, blocks_of(pattern, 512)), "fixed", 512, 9 * 512)
    assert e.where("kind = 'dup'").count() == 8


@pytest.mark.parametrize("mode", ["fixed", "dynamic", "entropy", "signature", "signature_only"])
def test_round_trips(spark, mode):
    rnd = random.Random(3)
    text = bytes(rnd.choices(b"abcdefgh \n", k=60_000)) + b"%PDF-" + rnd.randbytes(20_000) + bytes(9_000)
    rows = [(1, text * 2), (2, b""), (3, b"x"), (4, rnd.randbytes(5000)), (5, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = {i: p or None for i, p in rows}
    enc = codec.encode_indexed(df, mode, 2048)
    for blocks in (codec.restore_by_join(enc), codec.restore_by_range(enc), codec.restore_by_range(codec.encode_interleaved(df, mode, 2048, 20_480), True)):
        assert {r.stream_id: bytes(r.payload or b"") or None for r in codec.reassemble(blocks).collect()} == want
    sizes = [r.size for r in chunking.chunk(df, mode, 2048).collect()]
    assert max(sizes) <= 2048


def weighted_sum(values, factors):
    """Each value times its own factor and all that follow, mod 2^32."""
    total, product = 0, 1
    for v, f in zip(reversed(values), reversed(factors)):
        product = product * f % 2**32
        if not product:
            break
        total += v * product
    return total % 2**32


def greedy_cuts(data, least, most, limit, factor, counted=lambda start, end: True):
    """Block after block: the first end with ``least`` bytes whose weighted sum is under the limit, or ``most`` bytes.
    ``factor(start, i)`` is that of byte i in a block from ``start``; None takes it out of the sum."""
    out, start = [], 0
    while start < len(data):
        values, factors = [], []
        for end in range(start + 1, min(start + most, len(data)) + 1):
            if (f := factor(start, end - 1)) is not None:
                values.append(data[end - 1] + 1)
                factors.append(f)
            if end - start == most or end - start >= least and counted(start, end) and weighted_sum(values, factors) < limit:
                out.append(end)
                break
        else:
            break
        start = end
    return out


def rolling_definition(data, size):
    """A byte is predicted if it also followed the latest earlier byte of its context: the byte before it, or 0 at the
    start of a block. A context that was not seen predicts 0."""
    followed = {}

    def factor(start, i):
        context = data[i - 1] if i > start else 0
        predicted = followed.get(context, 0) == data[i]
        followed[context] = data[i]
        return chunking.HIT if predicted else chunking.MISS

    return greedy_cuts(data, size // 64, size, chunking.max_hash(size), factor)


def entropy_definition(data, size):
    """The stream's first bytes are counted and don't enter the sum; of the first block's others, those counted often
    are predicted; in later blocks none is."""
    least = min(max(size // 32, 512), 65535)
    often = {c for c in set(data[:least]) if data[:least].count(c) >= least // 255}

    def factor(start, i):
        if start == 0:
            return None if i < least else chunking.HIT if data[i] in often else chunking.MISS
        return chunking.MISS

    return greedy_cuts(data, least, size, chunking.max_hash(size), factor, lambda start, end: end > least)


@pytest.mark.parametrize("size", [512, 1024, 2048])
@pytest.mark.parametrize("kind", ["text", "random", "zeros", "short"])
def test_chunkers_against_definitions(size, kind):
    rnd = random.Random(size)
    data = {"text": bytes(rnd.choices(b"aabbbcdefg \n", k=9_000)), "random": rnd.randbytes(9_000), "zeros": bytes(6_000), "short": b"abc"}[kind]
    assert chunking.RollingChunker(size).ends(data) == rolling_definition(data, size)
    assert chunking.EntropyChunker(size).ends(data) == entropy_definition(data, size)


def test_streams_in_step(monkeypatch):
    """Streams cut in step have the cuts of streams cut alone, whatever their lengths and how many go at once."""
    rnd = random.Random(11)
    for few, lanes in ((1, 4096), (5, 16), (48, 4096)):
        monkeypatch.setattr(chunking, "FEW", few)
        monkeypatch.setattr(chunking, "LANES", lanes)
        rows = [bytes(rnd.choices(b"aabbc \n\x00", k=rnd.choice([1, 7, 300, 2000, rnd.randint(1, 6000)]))) for _ in range(120)] + [rnd.randbytes(9000), bytes(3000)]
        bounds = np.cumsum([0, *map(len, rows)])
        got = chunking.rolling_ends(np.frombuffer(b"".join(rows), np.uint8), bounds, 512)
        assert [e.tolist() for e in got] == [chunking.RollingChunker(512).ends(r) for r in rows]
    assert chunking.rolling_ends(np.zeros(0, np.uint8), np.zeros(1, np.int64), 512) == []


@pytest.mark.parametrize("mode", options.MODES)
def test_pieces_change_no_cut(mode):
    """Whatever the pieces, and through dumps of the state, a stream has the same cuts."""
    rnd = random.Random(7)
    for _ in range(40):
        data = b"".join(rnd.choice([bytes(rnd.choices(b"abc \n", k=rnd.randint(1, 900))), rnd.choice(chunking.SIGNATURES)]) for _ in range(12))
        engine = chunking.chunker(mode, 512)
        whole = [*engine.ends(data), *(len(data) + e for e in engine.close())]
        assert whole == sorted(set(whole)) and all(b - a <= 512 for a, b in zip([0, *whole], [*whole, len(data)]))
        if mode == "signature_only":
            starts, want, begin = {m.start() for m in engine.pattern.finditer(data)}, [], 0
            for p in range(1, len(data) + 1):
                if p - begin == 512 or p in starts and begin < p < len(data):
                    want.append(p)
                    begin = p
            assert whole == want
        engine, parts, at = chunking.chunker(mode, 512), [], 0
        while at < len(data):
            step = rnd.choice([1, 2, 5, 100, 700])
            parts += [at + e for e in engine.ends(data[at : at + step])]
            at = min(len(data), at + step)
            state = engine.dump()
            engine = chunking.chunker(mode, 512)
            engine.load(*state)
        assert parts + [at + e for e in engine.close()] == whole


def test_matching_against_a_dictionary(spark):
    rnd = random.Random(5)
    rows = [(s, i, f"h{rnd.randint(0, 30) if rnd.random() < 0.7 else 99}") for s in range(40) for i in range(rnd.randint(1, 20))]
    df = matching.number(spark.createDataFrame(rows, "stream_id long, idx long, hash string"), buckets=7)
    for policy, bound in (("unbounded", None), ("distance", 5), ("evicting", 8)):
        got = {r.n: r.back_offset for r in matching.match(df, bound, policy).collect()}
        seen, want = {}, {}
        for n, (_, _, h) in enumerate(sorted(rows), 1):
            want[n] = n - seen[h] if h in seen and (policy != "distance" or n - seen[h] <= bound) else None
            seen[h] = n
            if policy == "evicting" and len(seen) > bound:
                for old in sorted(seen, key=seen.get)[: bound // 4]:
                    del seen[old]
        assert got == want, policy


def test_ordering(spark):
    rnd = random.Random(6)
    v = [rnd.randint(-5, 50) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(v)), "pos long, v long")
    for up in (True, False):
        got = [(r.v, r.pos) for r in ordering.sort(df, ascending=up, tie="pos").orderBy("rank").collect()]
        assert got == sorted(((x, i) for i, x in enumerate(v)), key=lambda t: (t[0] if up else -t[0], t[1]))
        assert ordering.is_sorted(ordering.sort(df, ascending=up, tie="pos").select(F.col("rank").alias("pos"), "v"), ascending=up).first()[0]
        assert not ordering.is_sorted(df, ascending=up).first()[0]
    assert ordering.is_sorted(df.limit(0)).first()[0]


def test_collision_and_memory(spark):
    assert collision.describe(2**30) == "Collision probability is ~ 1/2535301202817642046627252275200 ~ 3.944304522431639e-31"
    assert collision.describe(1) == "Collision probability is 0"
    e, d = estimates.memory(F.lit(2**60), 1024)
    assert spark.range(1).select(e, d).first()[0] == 52 * 2**50
    assert estimates.interleaved_memory(1000, 10) == 10_000 and estimates.interleaved_memory(1000, 0) == -1


def test_varints(spark):
    for v in (0, 1, 127, 128, 300, 2**32, 2**63, varint.END_MARK):
        assert varint.decode(varint.encode(v), 0) == (v, len(varint.encode(v)))
    assert len(varint.encode(varint.END_MARK)) == 10
    values = [0, 127, 128, 2**14, 2**21 - 1, 2**62]
    got = spark.createDataFrame([(v,) for v in values], "v long").select(varint.length(F.col("v"))).collect()
    assert [r[0] for r in got] == [len(varint.encode(v)) for v in values]


def test_option_errors():
    for error, args in (
        (options.SizeTooSmall, ("fixed", 511, 0, False)), (options.UnknownMode, ("none", 512, 0, False)), (options.MaxMemoryTooSmall, ("fixed", 512, 511, True)),
        (options.MaxMemoryTooSmall, ("fixed", 512, 1024, False)), (options.SizeTooSmall, ("none", 0, 0, False)),
    ):
        with pytest.raises(error):
            options.max_blocks(*args)
    with pytest.warns(UserWarning):
        assert options.max_blocks("fixed", 1024, 100, False) == 0
    with pytest.raises(options.OptionError):
        chunking.SignatureChunker(512, [b"x"], True)


def test_format_errors():
    uv = lambda *v: b"".join(map(varint.encode, v))
    end = (varint.END_MARK, 512)
    assert codec.parse_index(uv(1, 512, *end, 0)) == [(1, "end", 1, None, 0, 0)]
    for error, raw, inter in (
        (options.UnknownFormat, uv(3), False), (options.CorruptStream, uv(1, 512, 0, 513), False), (options.CorruptStream, uv(1, 512, 1), False),
        (options.CorruptStream, uv(1, 512, 0, 0, 2), False), (options.CorruptStream, uv(1, 512, *end, 1), False), (options.CorruptStream, uv(1, 512), False),
        (options.SizeTooSmall, uv(2, 511, 4), True), (options.MaxMemoryTooSmall, uv(2, 512, 0), True), (options.CorruptStream, uv(2, 512, 4, 0, 512), True),
        (options.CorruptStream, uv(2, 512, 4, 0, 0) + b"short", True), (options.CorruptStream, uv(2, 512, 1, 0, 511) + b"a" + uv(0, 511) + b"b" + uv(2), True),
    ):
        with pytest.raises(error):
            codec.parse_index(raw, inter)


def test_truncated_data_fails(spark):
    enc = codec.encode_indexed(stream(spark, random.Random(1).randbytes(4000)), "fixed", 512).withColumn("data", F.expr("substring(data, 1, 100)"))
    with pytest.raises(Exception, match="truncated data"):
        codec.restore_by_range(enc).collect()


def test_manual_split(spark):
    df = spark.createDataFrame([(1, 0, b"a" * 600), (1, 1, b"a" * 600), (1, 2, b"")], "stream_id long, seq long, payload binary")
    assert [r.size for r in chunking.chunk(df, "fixed", 512).orderBy("idx").collect()] == [512, 88, 512, 88]
    assert [r.size for r in chunking.chunk(df, "dynamic", 512).orderBy("idx").collect()][-1] <= 512


def test_fragments_carry_payloads_and_columns(spark):
    data = blocks_of(period10(40), 512, b"tail")
    got = matching.fragments(stream(spark, data), "fixed", 512, payloads=True).orderBy("n").collect()
    assert b"".join(bytes(r.payload) for r in got) == data and all(hashlib.sha1(r.payload).hexdigest() == r.hash for r in got)
    rows = spark.createDataFrame([(1, data, "a", 5), (2, b"x", "b", None)], "stream_id long, payload binary, lang string, k int")
    for mode in ("fixed", "dynamic"):
        assert {(r.stream_id, r.lang, r.k) for r in chunking.chunk(rows, mode, 512, carry=("lang", "k")).collect()} == {(1, "a", 5), (2, "b", None)}


def test_overlap_and_unique(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2), ("y", 3)], "hash string, n long")
    b = spark.createDataFrame([("y",)], "hash string")
    assert matching.overlap(a, b).count() == 2 and matching.overlap(a, b, False).count() == 1 and matching.unique_blocks(a).count() == 2


def test_seek_source(spark, tmp_path):
    data = blocks_of(period10(80), 512, b"end")
    one = codec.encode_indexed(stream(spark, data), "fixed", 512).first()
    (tmp_path / "i").write_bytes(one["index"])
    (tmp_path / "d").write_bytes(one["data"])
    spark.dataSource.register(SeekSource)
    got = spark.read.format("blockwise_seek").option("index", str(tmp_path / "i")).option("data", str(tmp_path / "d")).option("blocks", "7").load()
    assert b"".join(bytes(r.payload) for r in got.orderBy("n").collect()) == data


def test_archive_files(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(1, blocks_of(period10(80), 512, b"end")), (2, b""), (3, None), (4, b"x"), *((i, rnd.randbytes(rnd.randint(1, 3000)) * 2) for i in range(5, 40))]
    df, path = spark.createDataFrame(rows, SCHEMA), str(tmp_path / "a")
    archives = archive.write(df, path, "fixed", 512)
    made = {r.stream_id: r for r in codec.encode_indexed(df, "fixed", 512).collect()}
    for r in archives.collect():
        for column, at, length in (("index", r.index_offset, r.index_bytes), ("data", r.data_offset, r.data_bytes)):
            assert (tmp_path / "a" / f"{r.part}.{column}").read_bytes()[at : at + length] == bytes(made[r.stream_id][column])
    got = {r.stream_id: bytes(r.payload or b"") for r in codec.reassemble(archive.read(archives, path)).collect()}
    assert got == {i: p or b"" for i, p in rows}
    some = archive.read(archives.where("stream_id = 1"), path, 30, 42).orderBy("n").collect()
    assert [r.n for r in some] == list(range(30, 43)) and b"".join(bytes(r.payload) for r in some) == rows[0][1][29 * 512 : 42 * 512]
    victim = tmp_path / "a" / f"{archives.where('stream_id = 1').first().part}.data"
    victim.write_bytes(victim.read_bytes()[:100])
    with pytest.raises(Exception, match="truncated data"):
        archive.read(archives, path).collect()
    assert archive.read(archive.write(df.limit(0), path + "0"), path + "0").count() == 0


def test_hashes(spark):
    for name in options.HASHES:
        assert spark.range(1).select(matching.block_hash(F.lit(b"abc"), name)).first()[0] == hashlib.new(name, b"abc").hexdigest()
    with pytest.raises(options.OptionError):
        matching.block_hash(F.lit(b""), "crc")


@pytest.mark.parametrize("width", [1, 3, 1 << 20])
def test_peak_memory_over_ranges(spark, width):
    rng = random.Random(5)
    spans = [(s, (a := rng.randrange(1, 40)), a + rng.randrange(20), rng.randrange(1, 100)) for s in range(3) for _ in range(15)]
    want = {s: max(sum(z for t, a, b, z in spans if t == s and a <= n <= b) for n in range(70)) for s in range(3)}
    got = codec.peak_memory(spark.createDataFrame(spans, "stream_id long, first_n long, last_n long, size int"), width)
    assert {r.stream_id: r.peak_bytes for r in got.collect()} == want
