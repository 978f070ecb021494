"""Near-duplicate texts: MinHash bands propose, odd sketches sift, full sets decide.

1. A text is its set of distinct five-word shingles. Texts with equal sets are
   one class, represented by its smallest doc_id; from here on only
   representatives take part, so exact copies cost nothing.
2. A band is a group of MinHash samples; representatives that agree on a band
   share a bucket. Every member is tied to the bucket's smallest one. The
   connected parts of these ties are the clusters: no link crosses them.
3. A cluster is cut into blocks of at most ``BLOCK`` texts, and each pair of
   blocks is compared in a task of its own. The samples, folded into a parity
   bitmap (odd sketch), estimate the similarity of all pairs by XOR and bit
   count; what is not clearly below the limit is decided on the full sets. A
   task returns a spanning forest of the links it found, never the pairs.
4. The connected parts of the links are the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrearly.llm.common import NOT_SPACE, Words, grams, mix, written

SHINGLE = 5  # words
NUM, DEN = 75, 100  # linked if DEN * intersection >= NUM * union
# A pair at the limit agrees on none of the bands with probability
# (1 - 0.75 ** ROWS) ** BANDS, below one in a million.
BANDS, ROWS = 52, 5
SKETCH_BITS = 1024
# Deviations (of the estimate for a pair at the limit) a pair may fall below it.
MARGIN = 6.0
BLOCK = 256  # texts
# So many ids may be broadcast (16 bytes each); beyond, Spark shuffles both sides.
MAX_SENT_IDS = 1_000_000

_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def shingles(h: np.ndarray) -> np.ndarray:
    """Sorted distinct shingles of a text's word hashes."""
    return np.unique(grams(h, min(SHINGLE, len(h)))) if len(h) else h


def samples(s: np.ndarray) -> np.ndarray:
    """One MinHash sample per seed."""
    low = np.full(len(_SEEDS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for part in np.array_split(s, len(s) // 512 + 1):
        if len(part):
            np.minimum(low, (part[:, None] * _SEEDS).min(axis=0), out=low)
    return low


def bands(low: np.ndarray) -> np.ndarray:
    """One bucket number per band; bands never share buckets."""
    return grams(low.reshape(BANDS, ROWS).T, ROWS)[0] ^ _SEEDS[:BANDS]


def odd_sketch(low: np.ndarray) -> np.ndarray:
    """Parity bitmap of the samples: a sample flips the bit it hashes to.

    Equal samples of two texts flip the same bit and cancel in the XOR, so its
    ones count the samples that differ.
    """
    at = mix(low + _SEEDS) % np.uint64(SKETCH_BITS)
    bits = np.bincount(at.astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.uint64)


def most_ones() -> int:
    """Ones in the XOR of two sketches that a pair at the limit hardly exceeds."""
    k, j = len(_SEEDS), NUM / DEN
    differing = k * (1 - j) + MARGIN * np.sqrt(k * j * (1 - j))
    return int(np.ceil(SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** (2 * differing))))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """The odd sketches' estimate of the share of common elements."""
    ones = np.bitwise_count(a ^ b).sum()
    inner = max(1 - 2 * ones / SKETCH_BITS, 1e-9)
    return float(1 + SKETCH_BITS / (4 * len(_SEEDS)) * np.log(inner))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """The limit itself, on full sets."""
    if NUM * max(len(a), len(b)) > DEN * min(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DEN * both >= NUM * (len(a) + len(b) - both)


def _digests(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader = Words(NOT_SPACE)
    for batch in it:
        n, digest, keys = [], [], []
        for h in reader.each(batch.column(1)):
            s = shingles(h)
            n.append(len(s))
            digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            keys.append(bands(samples(s)).view(np.int64) if len(s) else [])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()),
             pa.array(keys, pa.list_(pa.int64())), *batch.columns[2:]],
            names=["doc_id", "n_shingles", "digest", "bands", *batch.schema.names[2:]],
        )


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that is reachable.

    Large-star and small-star rounds on ``edges`` (a, b). Every round is written
    to the shared folder, so a lost executor repeats no earlier round; the ends
    of a hot node are an inner join that adaptive execution can split.
    """
    edges = written(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("u <> v")
        .distinct()
    )
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written, so that a hot node's edges meet its minimum in a plain join.
        low = written(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))
        large = (
            both.join(low, "u")
            .where("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        edges = written(
            small.where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _forest(table: pa.Table) -> pa.Table:
    """Links within one pair of blocks, as a spanning forest."""
    reader = Words(NOT_SPACE)
    ids = table.column("rep").to_pylist()
    side = np.array(table.column("side").to_pylist())
    sets = [shingles(h) for h in reader.each(table.column("text").combine_chunks())]
    sketch = np.array([odd_sketch(samples(s)) for s in sets])
    root = list(range(len(ids)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    found, limit = [], most_ones()
    same_block = table.column("same_block")[0].as_py()
    for i in range(len(ids)):
        if not same_block and side[i] != 0:
            continue
        others = np.arange(i + 1, len(ids)) if same_block else np.flatnonzero(side == 1)
        ones = np.bitwise_count(sketch[others] ^ sketch[i]).sum(axis=1, dtype=np.int64)
        near = ones <= limit
        # The likeliest first: once two texts are connected, their pair is settled.
        for j in others[near][np.argsort(ones[near], kind="stable")].tolist():
            if find(i) != find(j) and linked(sets[i], sets[j]):
                root[find(j)] = find(i)
                found.append((ids[i], ids[j]))
    a, b = zip(*found) if found else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tag: str | None = None
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept, and if asked for
    ``tag``, a number of the row as it came.

    ``component_id`` is the smallest doc_id that links lead to. Texts without a
    word (NULL, empty) have no shingles and are linked with nothing; fewer words
    than a shingle make one shingle. A row without an id takes no part: its
    component is NULL and it is kept. Rows that repeat an id get equal results.
    Only the named columns are read, so others cannot clash.
    """
    source = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    tags = [F.col(tag).cast("bigint").alias("tag")] if tag else []
    tagged = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"), *tags
    )
    # Written, so that the costly samples are taken once.
    all_docs = written(
        tagged.mapInArrow(
            _digests,
            "doc_id bigint, n_shingles bigint, digest binary, bands array<bigint>"
            + ", tag bigint" * len(tags),
        )
    )
    with_words = all_docs.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # Equal sets have equal bands, so any row's bands are those of the class.
    classes = with_words.groupBy("digest").agg(
        F.min("doc_id").alias("rep"), F.first("bands").alias("bands")
    )
    buckets = classes.select(F.explode("bands").alias("bucket"), "rep")
    hubs = (
        buckets.groupBy("bucket")
        .agg(F.min("rep").alias("hub"), F.max("rep").alias("last"))
        .where("hub <> last")
        .select("bucket", "hub")
    )
    ties = buckets.join(hubs, "bucket").select(F.col("hub").alias("a"), F.col("rep").alias("b"))
    clusters = written(components(ties))
    links = written(_links(source, clusters))
    result = components(links).withColumnRenamed("node", "rep")
    reps = with_words.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    component = reps.join(result, "rep", "left").select(
        "digest", F.coalesce("component", "rep").alias("component")
    )
    carried = ["tag"] * len(tags)
    found = all_docs.select("doc_id", "n_shingles", "digest", *carried).join(component, "digest", "left")
    component_id = F.when(
        F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("component")
    ).otherwise(F.col("doc_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return found.select(
        "doc_id", "n_shingles", component_id.alias("component_id"), *carried
    ).select("doc_id", "n_shingles", "component_id", kept.alias("kept"), *carried)


def _links(source: DataFrame, clusters: DataFrame) -> DataFrame:
    """Verified links (a, b) inside clusters (node, component)."""
    sized = clusters.join(
        clusters.groupBy("component").agg(F.count("*").alias("size")), "component"
    ).select(
        F.col("node").alias("doc_id"),
        "component",
        F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"),
    )
    if clusters.count() <= MAX_SENT_IDS:
        sized = F.broadcast(sized)
    # Copies of an id would repeat a text; any of them serves, the least is taken.
    texts = (
        source.where("text IS NOT NULL")
        .join(sized, "doc_id")
        .withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    )
    # Block i meets every block j: the text goes to (i, j) as the lower or the upper one.
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    tiles = texts.select(
        F.col("doc_id").alias("rep"), "text", "component", "block", F.explode(every).alias("other")
    ).select(
        "rep",
        "text",
        "component",
        F.least("block", "other").alias("low"),
        F.greatest("block", "other").alias("high"),
        (F.col("block") > F.col("other")).cast("int").alias("side"),
        (F.col("block") == F.col("other")).alias("same_block"),
    )
    return tiles.groupBy("component", "low", "high").applyInArrow(_forest, "a bigint, b bigint")
