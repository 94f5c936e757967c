"""Streams that repeat themselves, as a stream, in one batch and by a plain loop."""

import random
import re

import pytest

from quarry.streaming import repeats as R

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ended(lines):
    """The first row with a verdict, by the rules as they are said."""
    norm = lambda s: re.sub(r"[.,!?:;\s]+", " ", s.lower())
    long = lambda s: len(s) >= 60 and not (re.match(r"#{1,6}|\*\*|-\s*\*\*", s) and len(s) < 120)
    for k, (seq, _) in enumerate(lines):
        texts = [(x or "").strip(" ") for _, x in lines[: k + 1]]
        some, last = [t for t in texts if len(t) >= 25], texts[-1]
        if len(last) >= 25 and len(some) >= 3 and len({norm(t) for t in some[-3:]}) == 1:
            return seq, "LINE"
        if long(last) and sum(long(t) and norm(t) == norm(last) for t in texts) > 3:
            return seq, "PARAGRAPH"
        every = [s.strip(" ") for t in texts for s in re.split(r"(?<=[.?!])\s+", t)]
        mine = [s.strip(" ") for s in re.split(r"(?<=[.?!])\s+", last)]
        if any(long(s) and sum(long(x) and norm(x) == norm(s) for x in every) > 3 for s in mine):
            return seq, "SENTENCE"
    return None


def streams():
    rng = random.Random(6)
    pool = ["short", None, "", "a line of twenty five chars", "A line, of twenty five CHARS!", "# " + "heading " * 9, "w" * 59, "x " * 30, "Long sentence number one that is surely longer than sixty characters. ok", "Other. " + "Long sentence number one that is surely longer than sixty characters.", "- **bold item that repeats and is long enough to be counted otherwise**", "p" * 130]
    out = {f"r{k}": [(i, rng.choice(pool)) for i in range(rng.randrange(1, 40))] for k in range(40)}
    line = "a line that is long enough, yes"
    out |= {"gap": [(0, line), (1, "short"), (2, line.upper()), (3, None), (4, line + "!")], "never": [(i, f"line number {i} of many others") for i in range(30)], "tie": [(i, "y" * 70) for i in range(6)]}
    return out


def test_batch(spark):
    rows = [(s, i, t) for s, lines in streams().items() for i, t in lines]
    got = {r.stream: (r.seq, r.verdict) for r in R.repeats_in_batch(spark.createDataFrame(rows, "stream string, seq long, line string").repartition(3)).collect()}
    assert got == {s: e for s, lines in streams().items() if (e := ended(lines))}
    assert {v for _, v in got.values()} == {"LINE", "PARAGRAPH", "SENTENCE"}


def test_stream_and_batch_end_at_the_same_row(spark, tmp_path):
    pytest.importorskip("google.protobuf", reason="state of this kind is read by messages of that package")
    for part in range(4):  # rows arrive in four triggers
        rows = [(s, i, t) for s, lines in streams().items() for i, t in lines if i * 4 // 40 == part]
        spark.createDataFrame(rows, "stream string, seq long, line string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        source = spark.readStream.schema("stream string, seq long, line string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = R.detect_repeats(source).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination(200)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {r.stream: (r.seq, r.verdict) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {s: e for s, lines in streams().items() if (e := ended(lines))}
