"""SimHash near-duplicates by a segment-popcount embedding and a grid range-join.

A fingerprint's 64 bits are cut into segments of three; the vector of the segments' bit counts
embeds it so that the Manhattan distance of two vectors is never more than the Hamming distance of
the fingerprints. The grid's cells are the vectors themselves, and each fingerprint goes to its own
cell and to those at distance one: two vectors within distance two, and no others, have a cell in
common (a step from one towards the other). Wider segments would make fewer cells that unrelated
fingerprints meet in, of four bits so few that those grow with the square of the input. Fingerprints that share a cell are verified exactly, by the values around them: two lie
within two bits exactly if some value lies within one bit of both. Joining through the least holder
of such a value links all that hold it, so no step forms pairs within a group, however large.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, discard, join_hot, map_arrow, materialise, shingle_hashes, whole_row
from .shingles import similar

BITS = 64
SEGMENT = 3
CHUNK = 1 << 15


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(hashes: list[int]) -> int:
    """Bit set where over half of the hashes have it; 0 of none."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), CHUNK):
        raw = np.array(hashes[at : at + CHUNK], ">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def _marked(hashes: list[int]) -> int:
    return _signed(fingerprint(hashes))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = [_marked(shingle_hashes(t)) for t in batch.column("_text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) for each row, fp as a signed long. A null text has no words: fingerprint 0."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    return map_arrow(rows, _fingerprints, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


SEGMENTS = [(at, min(SEGMENT, BITS - at)) for at in range(0, BITS, SEGMENT)]


def _count(fp: Column, at: int, width: int) -> Column:
    return F.bit_count(F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1))).cast("long")


def embedding(fp: Column) -> Column:
    """The segments' bit counts, 0 to 3 each, in pairs of bits of a long."""
    packed = F.lit(0).cast("long")
    for k, (at, width) in enumerate(SEGMENTS):
        packed = packed.bitwiseOR(F.shiftleft(_count(fp, at, width), 2 * k))
    return packed


def cells(vector: Column) -> Column:
    """The vector and those one step from it in which every count is still one of its segment's."""
    near = [vector]
    for k, (_, width) in enumerate(SEGMENTS):
        count, step = F.shiftrightunsigned(vector, 2 * k).bitwiseAND(F.lit(3)), F.lit(1 << (2 * k)).cast("long")
        near += [F.when(count < width, vector + step), F.when(count > 0, vector - step)]
    return F.array_compact(F.array(*near))


def links(prints: DataFrame) -> DataFrame:
    """(a, b) links between distinct fingerprints whose closure is that of all pairs within two bits.

    ``prints`` has a column fp of distinct values.
    """
    vectors = prints.select("fp", embedding(F.col("fp")).alias("vector"))
    keyed = materialise(vectors.select("fp", F.explode(cells(F.col("vector"))).alias("cell")))
    shared = keyed.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1").select("cell")
    likely = materialise(keyed.join(shared, "cell").select("fp").distinct())
    discard(keyed)
    around = F.explode(F.array(F.lit(0).cast("long"), *(F.lit(_signed(1 << k)) for k in range(BITS)))).alias("flip")
    ball = likely.select("fp", around).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid"))
    middle = ball.groupBy("mid").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1")
    return ball.join(middle, "mid").select("a", F.col("fp").alias("b")).where("a < b").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id for each row.

    component_id is the smallest doc_id that links reach, a row's own included. Equal fingerprints
    are one node, so copies cost nothing beyond their own row. Null and empty texts, and texts of
    white space, have fingerprint 0 and link like any other; a null doc_id gets a component by its
    text and names one only where all others there are null too. Repeated rows give repeated rows,
    an empty table an empty one; other columns are left out.
    """
    rows = materialise(fingerprints(docs))
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    nodes = materialise(distinct)
    roots = components(links(nodes.select("fp")))
    joined = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", "copies", F.coalesce("root", "fp").alias("root"))
    named = materialise(joined.join(joined.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "copies", "component_id"))
    return join_hot(rows, named, ["fp"], "copies").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, size: int = 5, share: float = 0.8) -> DataFrame:
    """One row of each group of near copies: the one with the smallest doc_id, whatever its other columns.

    Near copies are texts whose fingerprints over runs of ``size`` words are within two bits, by
    ``links``, or whose sets of these runs have a Jaccard similarity of ``share`` or more, see
    ``shingles.similar``. Decided row by row: of rows that share a doc_id each
    is judged by its own text, repeated rows leave one, and of rows without a doc_id one stays where
    its group has no other. Among equal ids the text with the least hash stays.
    """
    packed = docs.select(whole_row(docs).alias("_row"), "doc_id", F.col("text").cast("string").alias("text"))
    rows = materialise(packed.withColumn("_at", F.monotonically_increasing_id()))
    groups = materialise(similar(rows.select(F.col("_at").alias("doc_id"), "text"), _marked, links, size, share).withColumnsRenamed({"doc_id": "_at", "component_id": "_group"}))
    named = rows.select("_at", F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), "_at").alias("_first")).join(groups, "_at")
    stays = named.groupBy("_group").agg(F.min("_first").alias("_first")).select(F.col("_first._at").alias("_at"))
    return rows.join(materialise(stays), "_at", "left_semi").select("_row.*")
