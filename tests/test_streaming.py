"""Streaming results equal batch results, however the input falls into rows and micro-batches."""

import random

import pytest
from pyspark.sql import functions as F

from blockwise import options
from blockwise.operators import chunking, matching
from blockwise.sources import codec
from blockwise.streaming import fragments

IN = "stream_id long, seq long, payload binary, is_last boolean"
SIGNS = [b"%PDF-", b"GIF89a", b"SQLite format 3"]


def pieces(seed, cuts=9, size=6000):
    """Whole streams, and the same as rows."""
    rnd = random.Random(seed)
    whole, rows = {}, []
    for s in (1, 2):
        part = b"".join(bytes(rnd.choices(b"abcd \n", k=rnd.randint(1, 700))) + rnd.choice(SIGNS) for _ in range(size // 500))
        whole[s] = data = part * 2
        at = sorted(rnd.sample(range(1, len(data)), cuts))
        parts = [data[a:b] for a, b in zip([0, *at], [*at, len(data)])]
        rows += [(s, i, p, i == len(parts) - 1) for i, p in enumerate(parts)]
    return whole, rows


def run(spark, folder, batches, make):
    for rows in batches:
        spark.createDataFrame(rows, IN).coalesce(1).write.mode("append").parquet(str(folder / "in"))
    stream = spark.readStream.schema(IN).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
    q = make(stream).writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(str(folder / "out"))


def dealt(rows, batches, rnd):
    """Rows of each stream in order, in random micro-batches."""
    last = max(r[1] for r in rows)
    cuts = [0, *sorted(rnd.sample(range(1, last + 1), batches - 1)), last + 1]
    out = [[r for r in rows if a <= r[1] < b] for a, b in zip(cuts, cuts[1:])]
    for part in out:
        rnd.shuffle(part)
    return out


@pytest.mark.parametrize("mode", options.MODES)
def test_stateful_fragments_equal_batch(spark, tmp_path, mode):
    whole, rows = pieces(9)
    found = run(spark, tmp_path, dealt(rows, 4, random.Random(3)), lambda s: fragments.stateful_fragments(s, mode, 512, signatures=SIGNS)).collect()
    got = {s: [(r.n, r.hash, r.size, r.back_offset) for r in sorted((r for r in found if r.stream_id == s), key=lambda r: r.n)] for s in whole}
    batch = chunking.chunk(spark.createDataFrame(list(whole.items()), "stream_id long, payload binary"), mode, 512, SIGNS)
    batch = matching.match_within(batch.withColumn("hash", F.sha1("payload")).withColumn("n", F.col("idx"))).collect()
    assert got == {s: [(r.n, r.hash, r.size, r.back_offset) for r in sorted((r for r in batch if r.stream_id == s), key=lambda r: r.n)] for s in whole}


@pytest.mark.parametrize("mode", ["fixed", "signature"])
def test_wire_equals_the_batch_encoder(spark, tmp_path, mode):
    whole, rows = pieces(10)
    found = run(spark, tmp_path, dealt(rows, 3, random.Random(4)), lambda s: fragments.wire(s, mode, 512, 8, SIGNS if mode == "signature" else None)).collect()
    got = {s: b"".join(bytes(r.piece) for r in sorted((r for r in found if r.stream_id == s), key=lambda r: r.n)) for s in whole}
    if mode == "fixed":
        want = codec.encode_interleaved(spark.createDataFrame(list(whole.items()), "stream_id long, payload binary"), mode, 512, 8 * 512)
        assert got == {r.stream_id: bytes(r.data) for r in want.collect()}
    back = codec.reassemble(codec.restore_by_range(spark.createDataFrame(list(got.items()), "stream_id long, data binary"), True))
    assert {r.stream_id: bytes(r.payload) for r in back.collect()} == whole


def test_evicting_index_in_the_state(spark, tmp_path):
    rnd = random.Random(5)
    made = [rnd.randbytes(512) for _ in range(12)]
    data = b"".join(rnd.choice(made) for _ in range(60))
    rows = [(1, i, data[at : at + 3000], at + 3000 >= len(data)) for i, at in enumerate(range(0, len(data), 3000))]
    found = run(spark, tmp_path, dealt(rows, 4, rnd), lambda s: fragments.stateful_fragments(s, "fixed", 512, index_bound=8)).orderBy("n").collect()
    index = matching.EvictingIndex(8)
    assert [r.back_offset for r in found] == [index.back_offset(r.hash, r.n) for r in found] and any(r.back_offset for r in found)


@pytest.mark.parametrize("batches", [1, 3])
def test_rows_behind_the_end_fail(spark, tmp_path, batches):
    rows = [(1, 0, bytes(512), False), (1, 1, bytes(288), True), (1, 2, bytes(512), False)]
    with pytest.raises(Exception, match="behind its end"):
        run(spark, tmp_path, [rows] if batches == 1 else [[r] for r in rows], lambda s: fragments.stateful_fragments(s, "fixed", 512))


def test_first_seen(spark, tmp_path):
    spark.createDataFrame([(1, bytes(1024)), (2, bytes(600))], "stream_id long, payload binary").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("stream_id long, payload binary").parquet(str(tmp_path / "in"))
    q = fragments.first_seen(fragments.fixed_blocks(stream, 512)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
