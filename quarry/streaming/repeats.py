"""Streams that repeat themselves: lines in a row, paragraphs and sentences (R01), as a stateful stream and as a batch.

A line of text is a row; a long one is a paragraph and holds sentences. A stream ends at its first row with a verdict: LINE if it is the third equal one in a row,
else PARAGRAPH or SENTENCE if one of those comes more often than allowed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Characters from which a line counts, equal lines in a row that end a stream; characters of a paragraph or sentence, and how often one may come.
LINE, IN_A_ROW, LONG, ALLOWED = 25, 3, 60, 3
#: Headings and bold list items under so many characters are structure and may repeat.
STRUCTURE, STRUCTURE_CHARS = r"^(?:#{1,6}|\*{2}|-\s*\*{2})", 120
MARKS, SENTENCE_END = r"[.,!?:;\s]+", r"(?<=[.?!])\s+"
ENDS = "stream string, seq long, verdict string"


def plain(text: str) -> str:
    return re.sub(MARKS, " ", text.lower(), flags=re.ASCII)


def counts(text: str) -> bool:
    return len(text) >= LONG and not (re.match(STRUCTURE, text) and len(text) < STRUCTURE_CHARS)


class Repeats(StatefulProcessor):
    """State of a stream: the last line and how often in a row, whether it has ended, and a counter for each long paragraph and sentence.

    Counters expire after ``ttl_ms`` without an update (0: never), so a stream that goes on for ever keeps what it said lately."""

    def __init__(self, ttl_ms: int = 0):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "line string, run int, done boolean")
        self.seen = handle.getMapState("seen", "key string", "n int", ttlDurationMs=self.ttl_ms or None)

    def again(self, kind: str, text: str) -> int:
        key = (f"{kind} {plain(text)}",)
        n = (self.seen.getValue(key)[0] if self.seen.containsKey(key) else 0) + 1
        self.seen.updateValue(key, (n,))
        return n

    def verdict(self, text: str, run: int) -> str | None:
        if run >= IN_A_ROW:
            return "LINE"
        if counts(text) and self.again("p", text) > ALLOWED:
            return "PARAGRAPH"
        for s in re.split(SENTENCE_END, text, flags=re.ASCII):
            if counts(s.strip(" ")) and self.again("s", s.strip(" ")) > ALLOWED:
                return "SENTENCE"
        return None

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values: object) -> Iterator[pd.DataFrame]:
        line, run, done = self.last.get() if self.last.exists() else (None, 0, False)
        out = []
        if not done:
            for r in pd.concat(list(rows)).sort_values("seq").itertuples(index=False):
                text = (r.line or "").strip(" ")
                # Short lines stand between others without breaking a run.
                if len(text) >= LINE:
                    run = run + 1 if plain(text) == line else 1
                    line = plain(text)
                verdict = self.verdict(text, run if len(text) >= LINE else 0)
                if verdict:
                    out.append((key[0], r.seq, verdict))
                    done = True
                    break
            self.last.update((line, run, done))
            if done:
                self.seen.clear()
        yield pd.DataFrame(out, columns=["stream", "seq", "verdict"]).astype({"seq": "int64"})

    def close(self) -> None:
        pass


def detect_repeats(lines: DataFrame, ttl_ms: int = 0) -> DataFrame:
    """(stream, seq, verdict) where each stream of ``lines`` (stream string, seq long, line string) ends; rows after that are ignored. Rows of one trigger are taken in order of seq; seqs do not go back between triggers.

    Needs a state store for several column families: spark.sql.streaming.stateStore.providerClass set to the RocksDB provider."""
    return lines.groupBy("stream").transformWithStateInPandas(statefulProcessor=Repeats(ttl_ms), outputStructType=ENDS, outputMode="Append", timeMode="ProcessingTime" if ttl_ms else "None")


def repeats_in_batch(lines: DataFrame) -> DataFrame:
    """The same over a whole table, without state: runs by lags among the lines that count, paragraphs and sentences by running numbers of equal ones."""

    def shown(c: Column) -> Column:
        return F.regexp_replace(F.lower(c), MARKS, " ")

    def long(c: Column) -> Column:
        return (F.length(c) >= LONG) & ~(c.rlike(STRUCTURE) & (F.length(c) < STRUCTURE_CHARS))

    t = lines.select("stream", "seq", F.trim(F.coalesce("line", F.lit(""))).alias("text"))
    w = Window.partitionBy("stream").orderBy("seq")
    some = t.filter(F.length("text") >= LINE).withColumn("k", shown(F.col("text")))
    equal = F.lit(True)
    for k in range(1, IN_A_ROW):
        equal = equal & (F.lag("k", k).over(w) == F.col("k"))
    in_a_row = some.withColumn("hit", equal).filter("hit").select("stream", "seq", F.lit(0).alias("order"), F.lit("LINE").alias("verdict"))

    def often(units: DataFrame, order: int, name: str, *places: str) -> DataFrame:
        n = F.row_number().over(Window.partitionBy("stream", "k").orderBy("seq", *places))
        return units.withColumn("k", F.xxhash64(shown(F.col("text")), F.md5(shown(F.col("text")).cast("binary")))).withColumn("n", n).filter(F.col("n") > ALLOWED).select("stream", "seq", F.lit(order).alias("order"), F.lit(name).alias("verdict"))

    sentences = t.select("stream", "seq", F.posexplode(F.split("text", SENTENCE_END)).alias("at", "text")).withColumn("text", F.trim("text"))
    hits = in_a_row.unionByName(often(t.filter(long(F.col("text"))), 1, "PARAGRAPH")).unionByName(often(sentences.filter(long(F.col("text"))), 2, "SENTENCE", "at"))
    return hits.groupBy("stream").agg(F.min(F.struct("seq", "order", "verdict")).alias("m")).select("stream", "m.seq", "m.verdict")
