"""Sharding by fixed virtual slots: records are hashed into slots, and a versioned map says which shard has a slot.

The number of slots never changes, so a record's slot never does. Rows and bytes are summed per slot; the map is made
and edited from those sums, which are a few thousand rows whatever the input. Everything that touches records is a
DataFrame expression.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 4096


@dataclass(frozen=True)
class SlotMap:
    """Version, and for each slot its shard, rows and bytes."""

    version: int
    n_shards: int
    shard: tuple[int, ...]
    rows: tuple[int, ...]
    bytes: tuple[int, ...]

    def loads(self) -> list[int]:
        out = [0] * self.n_shards
        for s, b in zip(self.shard, self.bytes):
            out[s] += b
        return out

    def offsets(self) -> list[int]:
        """For each slot the number of rows of the slots before it in its shard."""
        at = [0] * self.n_shards
        out = []
        for s, n in zip(self.shard, self.rows):
            out.append(at[s])
            at[s] += n
        return out


def size_of(text: Column) -> Column:
    """UTF-8 bytes and 1; 1 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def records(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, size, text_crc32 and virtual slot of each row."""
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), size_of(text).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    name = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("text_crc32").cast("string"), F.col("size").cast("string"))
    return rows.withColumn("virtual_slot", F.pmod(F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long"), F.lit(SLOTS)).cast("int"))


def slot_sums(rows: DataFrame) -> tuple[list[int], list[int]]:
    """Rows and bytes of every slot; at most SLOTS rows come to the driver."""
    n, size = [0] * SLOTS, [0] * SLOTS
    for r in rows.groupBy("virtual_slot").agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect():
        n[r["virtual_slot"]], size[r["virtual_slot"]] = r["n"], r["size"]
    return n, size


def new_map(rows: list[int], size: list[int], n_shards: int) -> SlotMap:
    """Slots in order of falling size, each to the shard with the fewest bytes so far; ties to the lower number."""
    load, shard = [0] * n_shards, [0] * SLOTS
    for slot in sorted(range(SLOTS), key=lambda s: (-size[s], s)):
        to = min(range(n_shards), key=lambda s: (load[s], s))
        shard[slot] = to
        load[to] += size[slot]
    return SlotMap(1, n_shards, tuple(shard), tuple(rows), tuple(size))


def rebalance(old: SlotMap, rows: list[int], size: list[int], n_shards: int, tolerance: float = 0.01) -> SlotMap:
    """The next version: slots move from the fullest shard to the emptiest until they are within ``tolerance``.

    Only the slots that have to move do; slots of shards that are no more move first.
    """
    shard, load = list(old.shard), [0] * n_shards
    homeless = [s for s in range(SLOTS) if shard[s] >= n_shards]
    for s in range(SLOTS):
        if shard[s] < n_shards:
            load[shard[s]] += size[s]
    for s in sorted(homeless, key=lambda s: (-size[s], s)):
        shard[s] = min(range(n_shards), key=lambda k: (load[k], k))
        load[shard[s]] += size[s]
    mean = sum(load) / n_shards
    while max(load) - min(load) > tolerance * mean:
        a, b = load.index(max(load)), load.index(min(load))
        gap = load[a] - load[b]
        fits = [s for s in range(SLOTS) if shard[s] == a and 0 < size[s] < gap]
        if not fits:
            break
        s = min(fits, key=lambda s: (abs(gap / 2 - size[s]), s))
        shard[s] = b
        load[a] -= size[s]
        load[b] += size[s]
    return SlotMap(old.version + 1, n_shards, tuple(shard), tuple(rows), tuple(size))


def _listed(values: list[int] | tuple[int, ...], kind: str) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def write_map(spark: SparkSession, made: SlotMap, path: str) -> None:
    """Append a version to the stored map: version, n_shards, slot, shard, rows, bytes."""
    slot = F.col("id").cast("int")
    table = spark.range(SLOTS).select(F.lit(made.version).alias("version"), F.lit(made.n_shards).alias("n_shards"), slot.alias("slot"), F.get(_listed(made.shard, "int"), slot).alias("shard"), F.get(_listed(made.rows, "long"), slot).alias("rows"), F.get(_listed(made.bytes, "long"), slot).alias("bytes"))
    table.coalesce(1).write.mode("append").parquet(path)


def read_map(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    """A stored version, or the latest one."""
    table = spark.read.parquet(path)
    version = version if version is not None else table.agg(F.max("version")).first()[0]
    rows = sorted(table.where(F.col("version") == version).collect(), key=lambda r: r["slot"])
    return SlotMap(version, rows[0]["n_shards"], tuple(r["shard"] for r in rows), tuple(r["rows"] for r in rows), tuple(r["bytes"] for r in rows))


def shard(docs: DataFrame, n_shards: int = 8, made: SlotMap | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and virtual_slot of every row of ``docs``.

    Without ``made`` a first map is made from the table's own sums, so shards differ by less than the smallest slot
    they were filled with (the law ``bytes``). ``slot`` numbers the rows of a shard without gaps from 0: rows are
    numbered within their virtual slot, and the map's row counts say where each virtual slot begins, so no window is
    larger than a virtual slot. Of a given map only the shards of its slots count: rows are counted anew.

    A null text has size 1 and a null text_crc32; a null doc_id takes part like any other. Rows that repeat in all
    columns get numbers of their own. An empty table gives an empty result; other columns are not read.
    """
    from pyspark.sql import Window

    rows = records(docs, id_col, text_col)
    counted = slot_sums(rows)
    made = new_map(*counted, n_shards) if made is None else SlotMap(made.version, made.n_shards, made.shard, *map(tuple, counted))
    place = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    at = F.col("virtual_slot")
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.get(_listed(made.shard, "int"), at).alias("shard"),
        (F.get(_listed(made.offsets(), "long"), at) + place - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
    )


#: The same in DuckDB: CRC-32 byte by byte, and the greedy map as a recursive query over the slots.
ORACLE_SQL = """
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
    FROM (SELECT unnest(range(256)) AS i))),
raw AS (SELECT doc_id, text, coalesce(octet_length(encode(text)), 0) + 1 AS size, hex(encode(text)) AS h FROM documents),
records0 AS (
  SELECT doc_id, size::BIGINT AS size, CASE WHEN text IS NULL THEN NULL ELSE
    xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, size), lambda k: ('0x' || substr(h, (2 * k - 1)::BIGINT, 2))::BIGINT)),
      lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) END::BIGINT AS text_crc32
  FROM raw, crc_table),
records AS (
  SELECT *, (('0x' || substr(md5(concat_ws(':', doc_id::VARCHAR, text_crc32::VARCHAR, size::VARCHAR)), 1, 8))::BIGINT % 4096)::INT AS virtual_slot
  FROM records0),
sums AS (
  SELECT s AS virtual_slot, count(doc_id) AS n, coalesce(sum(size), 0)::BIGINT AS size
  FROM (SELECT unnest(range(4096)) AS s) LEFT JOIN records ON virtual_slot = s GROUP BY s),
ordered AS (SELECT *, row_number() OVER (ORDER BY size DESC, virtual_slot) AS i FROM sums),
filled(i, virtual_slot, shard, loads) AS (
  SELECT 0::BIGINT, -1::BIGINT, -1::BIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]
  UNION ALL
  SELECT o.i, o.virtual_slot, list_position(loads, list_min(loads)) - 1,
    list_transform(loads, lambda x, k: CASE WHEN k = list_position(loads, list_min(loads)) THEN x + o.size ELSE x END)
  FROM filled f JOIN ordered o ON o.i = f.i + 1),
placed AS (
  SELECT f.virtual_slot, f.shard, coalesce(sum(n) OVER (PARTITION BY shard ORDER BY f.virtual_slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first
  FROM filled f JOIN sums s ON f.virtual_slot = s.virtual_slot)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard::INT AS shard,
  (first + row_number() OVER (PARTITION BY r.virtual_slot ORDER BY doc_id NULLS FIRST, text_crc32 NULLS FIRST, size) - 1)::BIGINT AS slot,
  NULL::INT AS grown_shard, r.virtual_slot
FROM records r JOIN placed p ON r.virtual_slot = p.virtual_slot
"""
