"""Media relations derived from the tables, alike in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HASH_BITS = 60
LANE = 30


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def simhash(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys and hash: of every bit the majority over the text's distinct tokens.

    Two bits share a sum, 30 bits apart, so there are 30 sums instead of 60.
    """
    tokens = rows.select(*keys, F.explode(F.array_distinct(F.split(F.lower(text), " "))).alias("t"))
    h = tokens.select(*keys, F.conv(F.substring(F.md5("t"), 1, 15), 16, 10).cast("bigint").alias("h"))
    two = F.lit(1 | (1 << LANE))
    sums = h.groupBy(*keys).agg(F.count("*").alias("n"), *[F.sum(F.shiftright("h", i).bitwiseAND(two)).alias(f"s{i}") for i in range(LANE)])
    low = F.lit((1 << LANE) - 1)
    bit = lambda c, i: F.when(c * 2 > F.col("n"), F.lit(1 << i)).otherwise(F.lit(0))
    total = None
    for i in range(LANE):
        s = F.col(f"s{i}")
        part = bit(s.bitwiseAND(low), i) + bit(F.shiftright(s, LANE), i + LANE)
        total = part if total is None else total + part
    return sums.select(*keys, total.cast("bigint").alias("hash"))


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash(table(spark, sf_dir, "documents"), ["doc_id"], "text")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ts, hash of every line with text; ts counts such lines from 0."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).alias("ts", "line"))
    return simhash(lines, ["doc_id", "ts"], "line").select("doc_id", F.col("ts").cast("double").alias("ts"), "hash")


class _Hashes(dict):
    """First 60 bits of a token's MD5; so many tokens are remembered."""

    most = 300_000

    def __missing__(self, token: bytes) -> int:
        h = int.from_bytes(md5(token).digest()[:8], "big") >> 4
        if len(self) < self.most:
            self[token] = h
        return h


#: Tokens whose bits are summed up at once.
TOKENS = 1 << 17


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of every bit the majority over each run of so many hashes. Bits 16 or 32 apart share a sum."""
    width = 16 if counts.max(initial=0) < 1 << 16 else 32
    lanes, starts = np.uint64(sum(1 << at for at in range(0, 64, width))), np.cumsum(counts) - counts
    out = np.zeros(len(counts), np.uint64)
    for i in range(width):
        sums = np.add.reduceat((hashes >> np.uint64(i)) & lanes, starts)
        for at in range(0, 64, width):
            most = (sums >> np.uint64(at)) & np.uint64((1 << width) - 1)
            out |= (most.astype(np.int64) * 2 > counts).astype(np.uint64) << np.uint64(at + i)
    return out.view(np.int64)


def _line_hashes(rows: DataFrame) -> DataFrame:
    """doc_id, hashes: those of `frames` in order, for documents with lines. A document is hashed where it is read; nothing moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        known_hash = known.__getitem__
        for batch in batches:
            found, counts, made, lines = [], [], [], []
            held = 0

            def close() -> None:
                if counts:
                    made.append(majority(np.array(found, np.uint64), np.array(counts)))
                found.clear(), counts.clear()

            for text in batch.column(1).to_pylist():
                n = 0
                for line in (text or b"").split(b"\n"):
                    if line.strip(b" "):
                        tokens = set(line.split(b" "))
                        if held + len(tokens) > TOKENS:
                            close()
                            held = 0
                        held += len(tokens)
                        found.extend(map(known_hash, tokens))
                        counts.append(len(tokens))
                        n += 1
                lines.append(n)
            close()
            kept = np.flatnonzero(lines)
            ends = np.concatenate([[0], np.cumsum(np.array(lines, np.int64)[kept])]).astype(np.int32)
            flat = pa.array(np.concatenate(made) if made else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept)), pa.ListArray.from_arrays(pa.array(ends), flat)], ["doc_id", "hashes"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", F.lower("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, hashes array<bigint>")


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path (the doc_id), duration (last ts), frames."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    if d.groupBy("doc_id").count().where("count > 1").isEmpty():
        return _packed_lines(_line_hashes(d))
    return _grouped_lines(frames(spark, sf_dir))  # lines of equal id and number are hashed together, as in the SQL


def _packed_lines(lines: DataFrame) -> DataFrame:
    frame = lambda h, i: F.struct(h.alias("hash"), i.cast("double").alias("timestamp"))
    return lines.select(F.col("doc_id").alias("path"), (F.size("hashes") - 1).cast("double").alias("duration"), F.transform("hashes", frame).alias("frames"))


def _grouped_lines(f: DataFrame) -> DataFrame:
    packed = f.groupBy("doc_id").agg(F.max("ts").alias("duration"), F.sort_array(F.collect_list(F.struct(F.col("ts").alias("timestamp"), "hash"))).alias("f"))
    return packed.select(F.col("doc_id").alias("path"), "duration", F.transform("f", lambda x: F.struct(x["hash"].alias("hash"), x["timestamp"].alias("timestamp"))).alias("frames"))


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file per document, with made-up traits."""
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), "p_brand")
    ext = F.element_at(F.array(*[F.lit(x) for x in ("jpg", "JPG", "png", "mp4", "mov", "txt")]), (i % 6 + 1).cast("int"))
    start = F.lit("2020-01-01 00:00:00").cast("timestamp_ntz")
    made = start + F.make_dt_interval(F.lit(0), i * 37)
    coord = F.when(i % 5 == 0, None).when(i % 7 == 0, 0.0).otherwise(i * 0.01)
    # what is needed of a text is taken before the join, so that no text moves
    d = d.select("doc_id", "source", "lang", F.octet_length("text").cast("bigint").alias("size"), F.md5(F.encode("text", "UTF-8")).alias("content_hash"))
    return d.join(parts, "doc_id", "left").select(
        i,
        F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), i, F.lit("."), ext).alias("path"),
        "size",
        made.alias("created_at"),
        F.when(i % 3 != 0, made - F.make_dt_interval(F.lit(5))).alias("image_date"),
        F.when(i % 4 != 0, F.col("p_brand")).alias("camera"),
        coord.alias("lat"),
        coord.alias("lon"),
        (100 * (1 + i % 40)).cast("int").alias("width"),
        (100 * (1 + i % 30)).cast("int").alias("height"),
        F.when((i % 6).isin(3, 4), i % 90 + 1).otherwise(0).cast("double").alias("duration"),
        "content_hash",
        F.when(i % 11 == 0, "unreadable").alias("error"),
    )


def simhash_sql(source: str, keys: str) -> str:
    bits = " + ".join(f"(case when sum((h >> {b}) & 1) * 2 > count(*) then {1 << b} else 0 end)" for b in range(HASH_BITS))
    return f"select {keys}, ({bits})::bigint as hash from (select {keys}, ('0x' || substr(md5(t), 1, 15))::bigint as h from (select {keys}, unnest(list_distinct(string_split(lower(x), ' '))) as t from {source})) group by {keys}"


HASHES_SQL = f"hashes as materialized ({simhash_sql('(select doc_id, text as x from documents)', 'doc_id')})"
FRAMES_SQL = (
    "lines as materialized (select doc_id, unnest(l) as x, (generate_subscripts(l, 1) - 1)::double as ts from (select doc_id, list_filter(string_split(text, chr(10)), lambda s: trim(s) <> '') as l from documents)), "
    f"frames as materialized ({simhash_sql('lines', 'doc_id, ts')}), media as materialized (select doc_id as path, max(ts) as duration from frames group by doc_id)"
)
INVENTORY_SQL = """inventory as materialized (
  select d.doc_id, source || '/' || lang || '/doc_' || d.doc_id || '.' || (['jpg', 'JPG', 'png', 'mp4', 'mov', 'txt'])[d.doc_id % 6 + 1] as path,
    strlen(text)::bigint as size, timestamp '2020-01-01' + to_hours(d.doc_id * 37) as created_at,
    case when d.doc_id % 3 <> 0 then timestamp '2020-01-01' + to_hours(d.doc_id * 37) - to_days(5) end as image_date,
    case when d.doc_id % 4 <> 0 then p_brand end as camera,
    case when d.doc_id % 5 = 0 then null when d.doc_id % 7 = 0 then 0.0::double else d.doc_id * 0.01::double end as lat,
    case when d.doc_id % 5 = 0 then null when d.doc_id % 7 = 0 then 0.0::double else d.doc_id * 0.01::double end as lon,
    (100 * (1 + d.doc_id % 40))::int as width, (100 * (1 + d.doc_id % 30))::int as height,
    (case when d.doc_id % 6 in (3, 4) then d.doc_id % 90 + 1 else 0 end)::double as duration,
    md5(text) as content_hash, case when d.doc_id % 11 = 0 then 'unreadable' end as error
  from documents d left join part on p_partkey = d.doc_id)"""
