"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints differ in at most ``radius`` bits exactly if some value lies within half the radius
of both. So every distinct fingerprint emits all values within half the radius (65 for radius 2), the
values are shuffled, and fingerprints that meet at a value are candidates, which are verified by their
differing bits. Copies share one fingerprint and are merged before anything is emitted: a group of
copies of any size is one row, and a value is shared by at most as many fingerprints as lie within half
the radius of it (65), so no key is hot. Within a value the least fingerprint is linked to the others,
which for an even radius links everything that met there; other texts' links are never lost.

Fingerprints of several seeds are computed in one pass over the texts. Texts that are close in any seed
are linked, and the links of all seeds make one graph, whose nodes are numbers of the distinct arrays of
fingerprints. Of a seed's fingerprints only those emit values that agree with another in two of ``radius + 2``
blocks of bits, as all do that have another within the radius.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from otindex.llm.bytes_ import as_bytes, pieces
from otindex.llm.columns import orderable, quoted
from otindex.llm.components import components, spread_join
from otindex.session import broadcast_if_small, materialize

_FOLDED = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

#: Shingles whose bits are counted at a time.
_BLOCK = 1 << 16


def fingerprint(text: bytes, size: int = 3, seed: int = 42) -> int:
    """The 64-bit fingerprint of a text's word shingles, repeats included.

    A bit is set if more than half of the shingles' XXH64 have it set. Fewer words than ``size`` make
    one shingle; no words give zero.
    """
    return seeded_fingerprints(text, size, (seed,))[0]


def seeded_fingerprints(text: bytes, size: int, seeds: tuple[int, ...]) -> list[int]:
    """The fingerprint for each seed; the text is split once."""
    from xxhash import xxh64_intdigest

    words = text.translate(_FOLDED).split()
    if not words:
        return [0] * len(seeds)
    if len(words) <= size:
        return [xxh64_intdigest(b" ".join(words), seed) for seed in seeds]
    count = len(words) - size + 1
    ones = np.zeros((len(seeds), 64), np.int64)
    for at in range(0, count, _BLOCK):
        few = [words[at + k : min(at + _BLOCK, count) + k] for k in range(size)]
        shingles = list(map(b" ".join, zip(*few, strict=True)))
        for k, seed in enumerate(seeds):
            hashes = np.array([xxh64_intdigest(s, seed) for s in shingles], "<u8")
            bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones[k] += bits.sum(axis=0, dtype=np.int64)
    return [int.from_bytes(np.packbits(2 * o > count, bitorder="little").tobytes(), "little") for o in ones]


def _column(texts: list[bytes], size: int, seeds: tuple[int, ...]) -> pa.Array:
    """Fingerprints as signed longs, arrays of them for several seeds."""
    found = [seeded_fingerprints(t, size, seeds) for t in texts]
    values = pa.array(np.array(found, np.uint64).reshape(-1).view(np.int64))
    if len(seeds) == 1:
        return values
    return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * len(seeds)), values)


def _type(seeds: tuple[int, ...]) -> str:
    return "bigint" if len(seeds) == 1 else "array<bigint>"


def fingerprints(documents: DataFrame, size: int = 3, seeds: tuple[int, ...] = (42,)) -> DataFrame:
    """(doc_id, bits): every document's fingerprint as a signed long, or an array of them for several seeds.

    Null texts have zero.
    """

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                bits = _column(as_bytes(piece.column("text")).to_pylist(), size, seeds)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), bits], ["doc_id", "bits"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id bigint, bits {_type(seeds)}")


def _masks(half: int) -> list[int]:
    """All 64-bit values with at most ``half`` bits set, as signed longs."""
    masks = [sum(1 << b for b in bits) for k in range(half + 1) for bits in combinations(range(64), k)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def near_links(distinct: DataFrame, radius: int = 2, by: tuple[str, ...] = ()) -> DataFrame:
    """Distinct links (a, b) between the values of column ``bits`` that connect all within ``radius``.

    Links are between different fingerprints of at most ``radius`` differing bits. Not every such pair
    is listed, but each pair is connected by listed ones. ``radius`` must be even. Values that differ in
    the columns ``by``, which come first in the result, are not linked.
    """
    if radius % 2 or not 0 <= radius <= 4:
        raise ValueError("radius must be 0, 2 or 4")
    masks = F.array(*(F.lit(m) for m in _masks(radius // 2)))
    variants = distinct.select(
        *by, "bits", F.explode(F.transform(masks, lambda m: F.col("bits").bitwiseXOR(m))).alias("near")
    )
    meeting = Window.partitionBy(*by, "near")
    return (
        variants.withColumn("least", F.min("bits").over(meeting))
        .where(F.col("bits") != F.col("least"))
        .where(F.bit_count(F.col("bits").bitwiseXOR(F.col("least"))) <= radius)
        .select(*by, F.col("least").alias("a"), F.col("bits").alias("b"))
        .distinct()
    )


def crowded(distinct: DataFrame, radius: int = 2, by: tuple[str, ...] = ()) -> DataFrame:
    """The rows of ``distinct`` whose ``bits`` may have another value within ``radius``, and no others if possible.

    Of ``radius + 2`` blocks of bits such values share two. A row emits its bits in every pair of blocks, and
    stays if one of these also comes from another row; nothing is paired, so a frequent one is only counted.
    """
    cuts = [64 * k // (radius + 2) for k in range(radius + 3)]
    blocks = [(1 << high) - (1 << low) for low, high in zip(cuts, cuts[1:])]
    masks = [m - (1 << 64) if m >> 63 else m for m in (x | y for x, y in combinations(blocks, 2))]
    emitted = distinct.select(*by, "bits", F.posexplode(F.array(*(F.lit(m) for m in masks))).alias("pair", "mask"))
    emitted = emitted.select(*by, "bits", "pair", F.col("bits").bitwiseAND(F.col("mask")).alias("part"))
    key = [*by, "pair", "part"]
    met = materialize(emitted.groupBy(*key).count().where("count > 1").select(*key))
    return emitted.join(broadcast_if_small(met), key, "left_semi").select(*by, "bits").distinct()


def _seeded_links(distinct: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) between the ``node`` numbers of arrays ``bits`` that connect all within ``radius`` in some seed.

    Each value of a seed is stood for by its least node: nodes that share a value are linked to it, and
    close values by theirs. Only values of several nodes are joined with all nodes.
    """
    each = distinct.select(F.col("node").alias("b"), F.posexplode("bits").alias("seed", "value"))
    heads = materialize(each.groupBy("seed", "value").agg(F.min("b").alias("a"), F.count(F.lit(1)).alias("nodes")))
    value = F.struct("seed", "value").alias("value")
    several = heads.where("nodes > 1").select(value, "a")
    shared = spread_join(each.select(value, "b"), several, "value", "b").where("a != b").select("a", "b")
    close = crowded(heads.select("seed", F.col("value").alias("bits")), radius, ("seed",))
    close = materialize(near_links(close, radius, ("seed",)))

    def end(links: DataFrame, name: str) -> DataFrame:
        least = heads.select("seed", F.col("value").alias(name), F.col("a").alias(f"{name}_node"))
        return least.join(broadcast_if_small(links, BROADCAST_LINKS), ["seed", name])

    near = end(materialize(end(close, "a")), "b")
    return materialize(shared.unionByName(near.select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))))


def _grouped(documents: DataFrame, size: int, radius: int, seeds: tuple[int, ...]) -> tuple[DataFrame, DataFrame]:
    """(doc_id, bits) of all rows, and (bits, component, component_id) of all distinct fingerprints."""
    rows = materialize(fingerprints(documents, size, seeds))
    distinct = rows.groupBy("bits").agg(F.min("doc_id").alias("least"))
    if len(seeds) == 1:
        distinct = materialize(distinct).withColumn("node", F.col("bits"))
        links = near_links(distinct, radius)
    else:
        distinct = materialize(distinct.withColumn("node", F.monotonically_increasing_id()))
        links = _seeded_links(distinct, radius)
    merged = distinct.select("node", "least").join(components(links), "node")
    named = merged.groupBy("label").agg(F.min("least").alias("component_id"))
    linked = spread_join(merged, named, "label", "node").select("node", "label", "component_id")
    groups = distinct.join(linked, "node", "left").select(
        "bits",
        F.coalesce("label", "node").alias("component"),
        F.when(F.col("label").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"),
    )
    return rows, materialize(groups)


#: Links up to which they are broadcast.
BROADCAST_LINKS = 1_000_000


def near_duplicates(documents: DataFrame, size: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``documents``.

    Documents link at ``radius`` or fewer differing bits; component_id is the least doc_id reachable,
    itself included. Texts without words, null ones too, have the fingerprint zero and link like
    others. Repeated rows stay and share a component; a null doc_id counts as larger than any, so
    component_id is null only where no document of the component has an id. Other columns are ignored.
    """
    rows, groups = _grouped(documents, size, radius, (seed,))
    return rows.join(groups, "bits").select(
        "doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id"
    )


#: Dropped ids up to which they are broadcast.
BROADCAST_IDS = 1_000_000


def deduplicate(documents: DataFrame, size: int = 3, radius: int = 2, seed: int | tuple[int, ...] = 42) -> DataFrame:
    """One document of each component, in the columns of ``documents``: that with the least doc_id.

    With several seeds, documents link that are within ``radius`` for any of them.

    Rows with a null or repeated doc_id are told apart by their fingerprints; among those that could
    stay for a component, the least row (column by column; maps and variants by their JSON text) does.
    A component without any doc_id keeps one row too.
    """
    names = [quoted(c) for c in documents.columns]
    seeds = (seed,) if isinstance(seed, int) else tuple(seed)
    rows, groups = _grouped(documents, size, radius, seeds)
    judged = rows.join(groups, "bits")
    repeated = materialize(rows.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    odd_ids = broadcast_if_small(repeated, BROADCAST_IDS)
    dropped = materialize(judged.where("doc_id != component_id").select("doc_id").distinct())
    plain = documents.where("doc_id is not null").join(odd_ids, "doc_id", "left_anti")
    plain = plain.join(broadcast_if_small(dropped, BROADCAST_IDS), "doc_id", "left_anti").select(*names)

    nameless, shared = documents.where("doc_id is null"), documents.join(odd_ids, "doc_id", "left_semi").select(*names)
    key = F.struct(*(orderable(f) for f in documents.schema)).alias("key")
    odd = nameless.unionByName(shared).select(F.struct(F.struct(*names).alias("whole"), key).alias("row"), "text")
    marked = _with_bits(odd, size, seeds).join(groups, "bits")
    stay = marked.where(F.col("row.whole.doc_id").eqNullSafe(F.col("component_id")))
    one = stay.groupBy("component").agg(F.min_by("row.whole", "row.key").alias("whole"))
    return plain.unionByName(one.select("whole.*"))


def _with_bits(rows: DataFrame, size: int, seeds: tuple[int, ...]) -> DataFrame:
    """(row, bits) of (row, text)."""

    def run(batches):
        for batch in batches:
            bits = _column(as_bytes(batch.column("text")).to_pylist(), size, seeds)
            yield pa.RecordBatch.from_arrays([batch.column("row"), bits], ["row", "bits"])

    bits = LongType() if len(seeds) == 1 else ArrayType(LongType())
    schema = StructType([rows.schema["row"], StructField("bits", bits)])
    return rows.select("row", "text").mapInArrow(run, schema)
