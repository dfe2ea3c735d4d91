"""Best-fit packing with conflicts: no bin holds two documents of a source or of a duplicate cluster.

Documents are pieces of at most ``capacity`` words. Bins are ordered by residual room; for each
residual a bitmap says which bins have it, and each source and duplicate cluster has a bitmap of
the bins that hold it already. From the smallest residual that fits, the search goes on to the
next until a bin is left whose bits are clear of both.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asofgraph.llm.common import WORD_PATTERN, read_table

CAPACITY = 2048
#: Words that one task packs, on average at most; bins don't reach across tasks.
SHARD_WORDS = 4_000_000
#: A word and the space after it have so many bytes at least, so that bytes bound words.
LEAST_WORD_BYTES = 2
#: Hash buckets from which shards are made, an upper bound of their number.
FINE = 1 << 20


class Packer:
    """Bins of one shard."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.room = [0] * (capacity + 1)  # residual -> bitmap of its bins
        self.nonempty = 0  # bitmap of residuals that some bin has
        self.residual: list[int] = []
        self.holds: dict[tuple[str, object], int] = {}

    def put(self, size: int, source: object, cluster: object) -> tuple[int, int]:
        """(bin, words in it before) for a piece: the tightest bin that fits without conflict, or a new one."""
        keys = (("source", source), ("cluster", cluster))
        taken = self.holds.get(keys[0], 0) | self.holds.get(keys[1], 0)
        left = self.nonempty >> size << size
        while left:
            residual = (left & -left).bit_length() - 1
            if free := self.room[residual] & ~taken:
                where = (free & -free).bit_length() - 1
                break
            left &= left - 1
        else:
            where, residual = len(self.residual), self.capacity
            self.residual.append(residual)
        bit = 1 << where
        if residual < self.capacity or self.room[residual] & bit:
            self.room[residual] &= ~bit
            if not self.room[residual]:
                self.nonempty &= ~(1 << residual)
        after = residual - size
        self.residual[where] = after
        self.room[after] |= bit
        self.nonempty |= 1 << after
        for key in keys:
            self.holds[key] = self.holds.get(key, 0) | bit
        return where, self.capacity - residual


_OUT = "shard long, bin long, doc_id long, piece long, words long, start long, source string, cluster string"


def _pack(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, packer = None, Packer(capacity)
        for batch in batches:
            columns = [batch[n].to_pylist() for n in ("shard", "words", "source", "cluster")]
            bins, starts = [], []
            for shard, size, source, cluster in zip(*columns, strict=True):
                if shard != now:
                    now, packer = shard, Packer(capacity)
                where, start = packer.put(size, source, cluster)
                bins.append(where)
                starts.append(start)
            arrays = [batch["shard"], pa.array(bins, pa.int64()), batch["doc_id"], batch["piece"], batch["words"], pa.array(starts, pa.int64()), batch["source"], batch["cluster"]]
            yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in _OUT.split(", ")])
    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, shard_words: int = SHARD_WORDS, cluster: str | None = None) -> DataFrame:
    """One row a piece: shard, bin (in its shard), doc_id, piece, words, start, source, cluster.

    A text of n words has ceil(n / capacity) pieces, all full but the last; one without words (or
    null) has one piece of size 0, so no document is lost. Pieces of a document never share a bin,
    as they have the same source. A null source conflicts with null. Documents are of one cluster if
    they agree in the column ``cluster`` (such as the component of a near-duplicate join; null conflicts with
    null) or, without one, if their texts agree but for A-Z case and white space (all blank texts are one).
    Shards are dealt by doc_id and text, so neither a source or cluster with a third of all rows nor rows
    without doc_id gather in one; what a task holds is bounded by ``shard_words`` and never includes
    texts. Largest pieces go first, ties by doc_id and piece; equal rows are packed each.
    """
    text = F.coalesce("text", F.lit(""))
    plain = F.trim(F.regexp_replace(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x20\x09-\x0D]+", " "))
    size = F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long")
    digest = F.md5(plain)
    fine = F.pmod(F.xxhash64(F.lit("shard"), "doc_id", digest), F.lit(FINE))
    group = digest if cluster is None else F.col(cluster).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), group.alias("cluster"), size.alias("size"), fine.alias("fine"))
    whole = (F.col("size") / capacity).cast("long")
    lengths = F.concat(F.array_repeat(F.lit(capacity).cast("long"), whole.cast("int")), F.array(F.col("size") - whole * capacity))
    lengths = F.when((F.col("size") > 0) & (F.col("size") == whole * capacity), F.slice(lengths, F.lit(1), whole.cast("int"))).otherwise(lengths)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, min(FINE, -(-total // (LEAST_WORD_BYTES * shard_words))))
    cut = rows.select((F.col("fine") % shards).alias("shard"), "doc_id", "source", "cluster", F.posexplode(lengths).alias("piece", "words"))
    cut = cut.withColumn("piece", F.col("piece").cast("long"))
    dealt = cut.repartition("shard").sortWithinPartitions("shard", F.desc("words"), "doc_id", "piece", "cluster", "source")
    return dealt.mapInArrow(_pack(capacity), _OUT)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))
