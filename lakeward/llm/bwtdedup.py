"""Removal of repeated byte strings by merging shard Burrows-Wheeler transforms.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts in a document with a smaller
doc_id. Anchors find where such strings can be at all: the k-grams that have the least hash in some
window of LENGTH bytes. Equal strings have equal anchors, so

1. each text's anchors are dealt by hash, with a hash of all the bytes whose strings they stand for
   (their context); of equal contexts all but those of the smallest document are covered at once;
2. an anchor that several contexts share is left: its contexts' bytes form shards, whose transforms
   are merged by refining their interleaving, two more symbols of context a round, up to LENGTH; a
   suffix that no other one shares is dropped as soon as that shows. The blocks that the rounds leave unsplit are the intervals of suffixes with a common prefix of
   LENGTH; in each, the suffixes of all but the smallest document start covered strings. No suffix
   of one shard is ever compared with one of another.

Every step drops all but the first holder of what a batch holds repeatedly before anything is dealt,
so what a third of all documents share arrives once for each batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, map_arrow, materialise

LENGTH = 50
GRAM = 20
SPAN = LENGTH - GRAM + 1
SHARD = 1 << 16
BUCKET_BYTES = 6 << 20
#: Anchors with more contexts than this are split further, by the strings themselves.
HOT = 4000
STEP = 8
#: Pieces that are merged at a time, at least; processors hold the arrays of so many close by.
PORTION = 1 << 13
#: Symbols that are sorted at once; a number holds them.
WORD = 7
U = np.uint64
LOW_BYTES = U((1 << 40) - 1)
_RNG = np.random.default_rng(20)
_TABLE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if not _POWERS or len(_POWERS[0]) < n:
        size, inverse = 1 << max(16, n.bit_length()), pow(_BASE, -1, 1 << 64)
        _POWERS[:] = [np.cumprod(np.concatenate([[U(1)], np.full(size, b, U)])) for b in (U(_BASE), U(inverse))]
    return _POWERS[0], _POWERS[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Hashes:
    """Hashes of any substring of a text, from running sums."""

    def __init__(self, data: np.ndarray):
        power, self.inverse = _powers(len(data) + 1)
        self.sums = np.concatenate([[U(0)], np.cumsum(_TABLE[data] * power[: len(data)])])

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return _mix((self.sums[high] - self.sums[low]) * self.inverse[low])


def _slide(x: np.ndarray, size: int, op) -> np.ndarray:
    """op over each window of ``size`` entries."""
    reach = 1
    while reach * 2 <= size:
        x = op(x[:-reach], x[reach:])
        reach *= 2
    return op(x[: len(x) - (size - reach)], x[size - reach :]) if reach < size else x


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, hashes and context hashes of the anchors of a text of LENGTH bytes or more."""
    n, sums = len(data), Hashes(data)
    at = np.arange(n - GRAM + 1)
    grams = sums.of(at, at + GRAM)
    least = np.pad(_slide(grams, SPAN, np.minimum), SPAN - 1)
    places = np.nonzero(_slide(least, SPAN, np.maximum) == grams)[0]
    low, high = np.maximum(places - SPAN + 1, 0), np.minimum(places + LENGTH, n)
    context = sums.of(low, high) ^ _mix((places - low).astype(U) * U(131) + (high - places).astype(U))
    return places, grams[places], context


# Keys of rows: doc_id, which orders them, and a hash of the text, which tells rows of one doc_id apart.


def _first_of(keys: tuple[np.ndarray, ...], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by keys and doc, and, in that order, the smallest doc of equal keys."""
    order = np.lexsort((doc, *reversed(keys)))
    new = np.ones(len(doc), bool)
    if len(doc) > 1:
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    starts = np.nonzero(new)[0]
    return order, np.repeat(doc[order][starts], np.diff(np.append(starts, len(doc))))


ANCHORS = "bucket int, hash binary, context binary, doc binary, row binary, place binary"
MARKS = "_d long, _t long, place int, upto int, hash long, kind int"
COVER, REST, RUN = 0, 1, 2


def _planes(x: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each entry, byte by byte: what entries have in common compresses."""
    return x.view(np.uint8).reshape(len(x), -1)[:, :width].T.tobytes()


def _entries(data: bytes, kind, width: int) -> np.ndarray:
    n = len(data) // width
    out = np.zeros((n, np.dtype(kind).itemsize), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, n).T
    return out.view(kind).reshape(n)


#: Columns of packed anchors and the bytes kept of each. Five bytes of an anchor's hash are enough,
#: as equal ones only bring contexts together, and those are told apart by all eight of theirs.
PACKED = {"hash": (U, 5), "context": (U, 8), "doc": (np.int64, 8), "row": (np.int64, 5), "place": (np.int32, 4)}


def _emit(bucket: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    """One row per bucket with its entries packed, in order of document and place."""
    order = np.lexsort((columns[4], columns[2], bucket))
    bucket = bucket[order]
    cuts = np.concatenate([[0], np.nonzero(np.diff(bucket))[0] + 1])
    ends = np.append(cuts[1:], len(bucket))
    packed = [[_planes(c[a:b], w) for a, b in zip(cuts, ends, strict=True)] for c, (_, w) in zip((c[order] for c in columns), PACKED.values(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[cuts], pa.int32()), *(pa.array(p, pa.binary()) for p in packed)], ["bucket", *PACKED])


def _find(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple] = []
            for d, t, text in zip(*(batch.column(c).to_pylist() for c in ("_d", "_t", "_text")), strict=True):
                data = np.frombuffer(text.encode(), np.uint8)
                if len(data) >= LENGTH:
                    places, grams, context = anchors(data)
                    found.append((grams, context, np.full(len(places), d), np.full(len(places), t), places.astype(np.int32)))
            if not found:
                continue
            grams, context, doc, row, place = (np.concatenate(c) for c in zip(*found, strict=True))
            order, first = _first_of((grams, context), doc)
            grams, context, doc, row, place = (c[order] for c in (grams, context, doc, row, place))
            covered = doc > first
            # Covered entries go on with no hash to where their document's hash sends them.
            grams &= LOW_BYTES
            grams[grams == 0] = 1
            grams[covered] = 0
            bucket = np.where(covered, (_mix(doc.astype(U)) % U(buckets)), _mix(grams) % U(buckets)).astype(np.int32)
            yield _emit(bucket, [grams, context, doc, row, place])

    return run


def _marks(doc, row, place, upto, grams, kind) -> pa.RecordBatch:
    n = len(doc)
    return pa.RecordBatch.from_arrays(
        [pa.array(doc, pa.int64()), pa.array(row, pa.int64()), pa.array(place, pa.int32()), pa.array(np.broadcast_to(upto, n), pa.int32()), pa.array(grams.view(np.int64), pa.int64()), pa.array(np.broadcast_to(np.int32(kind), n), pa.int32())],
        ["_d", "_t", "place", "upto", "hash", "kind"],
    )


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The packed rows of one bucket after the other, of batches sorted by bucket."""
    held, now = [], None
    for batch in batches:
        for r in batch.to_pylist():
            if held and r["bucket"] != now:
                yield held
                held = []
            now = r["bucket"]
            held.append(r)
    if held:
        yield held


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _by_bucket(batches):
        grams, context, doc, row, place = (np.concatenate([_entries(r[c], k, w) for r in rows]) for c, (k, w) in PACKED.items())
        done = grams == 0
        yield _marks(doc[done], row[done], place[done], 0, grams[done], COVER)
        grams, context, doc, row, place = (c[~done] for c in (grams, context, doc, row, place))
        if not len(doc):
            continue
        order, first = _first_of((grams, context), doc)
        grams, context, doc, row, place = (c[order] for c in (grams, context, doc, row, place))
        covered = doc > first
        yield _marks(doc[covered], row[covered], place[covered], 0, grams[covered], COVER)
        starts = np.concatenate([[0], np.nonzero(np.diff(grams))[0] + 1])
        sizes = np.diff(np.append(starts, len(grams)))
        new = np.ones(len(grams), bool)
        new[1:] = (context[1:] != context[:-1]) | (grams[1:] != grams[:-1])
        several = (np.add.reduceat(new.astype(int), starts) > 1) & (np.maximum.reduceat(doc, starts) > np.minimum.reduceat(doc, starts))
        rest = np.repeat(several, sizes) & ~covered
        yield _marks(doc[rest], row[rest], place[rest], 0, grams[rest], REST)


def shard_transform(pieces: list[bytes], depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix order by ``depth`` symbols or more, Burrows-Wheeler transform and LF mapping of pieces that end in ordered sentinels.

    Symbols are bytes plus one (UTF-8 has no byte 255), 0 is a sentinel; the i-th piece's sentinel
    sorts before the next one's, so suffixes differ where one ends. The first WORD symbols are sorted
    as one number, then doubling goes on; what is equal to ``depth`` symbols keeps its place.
    """
    text = np.frombuffer(b"\xff".join(pieces) + b"\xff", np.uint8) + np.uint8(1)
    n = len(text)
    ends = text == 0
    key, over = text.astype(np.int64), ends.copy()
    for k in range(1, min(WORD, n)):
        ahead = np.zeros(n, np.int64)
        ahead[: n - k] = text[k:]
        # Behind its sentinel a suffix has nothing.
        key = key * 256 + np.where(over, 0, ahead)
        over[: n - k] |= ends[k:]
    order = np.argsort(key, kind="stable")
    new = np.ones(n, bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | over[order][1:]
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(new) - 1
    step = WORD
    while step < min(depth, n) and not new.all():
        behind = np.zeros(n, np.int64)
        behind[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + behind
        order = np.argsort(key, kind="stable")
        new[1:] = key[order][1:] != key[order][:-1]
        rank[order] = np.cumsum(new) - 1
        step *= 2
    rank[order] = np.arange(n)
    starts = np.concatenate([[True], ends[:-1]])
    before = np.where(starts, np.uint8(0), np.roll(text, 1))
    lf = rank[order - 1]
    return order, before[order], lf


def merge(shards: list[tuple[np.ndarray, np.ndarray, np.ndarray]], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Refines the interleaving of shards' transforms until suffixes stand in order of ``depth`` symbols.

    Returns the suffixes that share ``depth`` symbols with another, as places in the shards' suffix
    orders one after the other, and the number of each one's block: those of a block share them. A
    round takes the two symbols before the suffixes in their present order, sorts them stably, and so
    has the order by two more symbols; two suffixes stay in a block if their symbols and the blocks
    behind them agree. What comes before a suffix that is alone in its block is alone in the next
    order too, so such suffixes go, and so do those at a piece's start.
    """
    n = sum(len(s[0]) for s in shards)
    kind = np.int32 if n < 1 << 31 else np.int64
    offsets = np.concatenate([[0], np.cumsum([len(s[0]) for s in shards])[:-1]])
    symbols = np.concatenate([s[1] for s in shards])
    back = np.concatenate([(s[2] + o).astype(kind) for s, o in zip(shards, offsets, strict=True)])
    further = symbols[back]
    pairs = np.where((symbols > 0) & (further > 0), further.astype(np.uint16) << 8 | symbols, 0).astype(np.uint16)
    now, block = np.arange(n, dtype=kind), np.zeros(n, kind)
    steps = [(symbols, back)] * (depth % 2) + [(pairs, back[back])] * (depth // 2)
    for before, there in steps:
        ahead = before[now]
        order = np.argsort(ahead, kind="stable")[np.count_nonzero(ahead == 0) :]
        symbol, old = ahead[order], block[order]
        new = np.ones(len(order) + 1, bool)
        new[1:-1] = (symbol[1:] != symbol[:-1]) | (old[1:] != old[:-1])
        several = ~(new[:-1] & new[1:])
        now, block = there[now[order[several]]], np.cumsum(new[:-1], dtype=kind)[several]
        if not len(now):
            break
    return now, block


def covered_starts(pieces: list[bytes], docs: np.ndarray, depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(piece, offset) of each string of ``depth`` bytes that a piece of a smaller document holds too."""
    shards, at = [], 0
    while at < len(pieces):
        end, size = at, 0
        while end < len(pieces) and (size == 0 or size + len(pieces[end]) < SHARD):
            size += len(pieces[end]) + 1
            end += 1
        shards.append(shard_transform(pieces[at:end], depth))
        at = end
    now, block = merge(shards, depth)
    lengths = np.array([len(p) + 1 for p in pieces])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    base = np.concatenate([[0], np.cumsum([len(s[0]) for s in shards])[:-1]])
    where = np.concatenate([s[0] + b for s, b in zip(shards, base, strict=True)])[now]
    piece = np.searchsorted(starts, where, side="right") - 1
    offset = where - starts[piece]
    whole = offset + depth <= lengths[piece] - 1
    piece, offset, block = piece[whole], offset[whole], block[whole]
    if not len(piece):
        return piece, offset
    doc = docs[piece]
    cuts = np.concatenate([[0], np.nonzero(np.diff(block))[0] + 1])
    least = np.repeat(np.minimum.reduceat(doc, cuts), np.diff(np.append(cuts, len(block))))
    return piece[doc > least], offset[doc > least]


def _likely(pieces: list[bytes], places: list[int], docs: np.ndarray) -> list[tuple[int, int, int]]:
    """(piece, low, high) of the stretches that can hold a string that another document's piece holds.

    The strings of a piece stand at up to SPAN places before its anchor. Those of STEP neighbouring
    places have LENGTH - STEP + 1 bytes in common, which another document must hold at the same
    distance from its anchor.
    """
    owner, group, keys = [], [], []
    core = LENGTH - STEP + 1
    for k, (piece, at) in enumerate(zip(pieces, places, strict=True)):
        n = len(piece)
        for g in range((SPAN + STEP - 1) // STEP):
            a = at - g * STEP
            if a >= 0 and a - STEP + 1 <= n - LENGTH:
                owner.append(k)
                group.append(g)
                keys.append(hash((g, piece[a : a + core])))
    if not keys:
        return []
    owners, keys_, doc = np.array(owner), np.array(keys, np.int64), docs[owner]
    order = np.argsort(keys_, kind="stable")
    k, d = keys_[order], doc[order]
    cuts = np.concatenate([[0], np.nonzero(np.diff(k))[0] + 1])
    several = np.maximum.reduceat(d, cuts) > np.minimum.reduceat(d, cuts)
    keep = np.sort(order[np.repeat(several, np.diff(np.append(cuts, len(k))))])
    out: list[tuple[int, int, int]] = []
    for i in keep.tolist():
        k, a = int(owners[i]), places[owner[i]] - group[i] * STEP
        low, high = max(0, a - STEP + 1), min(a + LENGTH, len(pieces[k]))
        if out and out[-1][0] == k and out[-1][1] == low + STEP:
            out[-1] = (k, low, out[-1][2])
        elif out and out[-1][0] == k and group[i] and out[-1][1] <= low + STEP:
            out[-1] = (k, low, max(high, out[-1][2]))
        else:
            out.append((k, low, high))
    return out


def _merge_bucket(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    pieces, places = rows["piece"].to_pylist(), rows["at"].to_pylist()
    docs, texts, base = (rows[c].to_numpy().astype(np.int64) for c in ("_d", "_t", "low"))
    parts = _likely(pieces, places, docs)
    if not parts:
        return
    own = np.array([k for k, _, _ in parts])
    low = base[own] + np.array([a for _, a, _ in parts])
    piece, offset = covered_starts([pieces[k][a:b] for k, a, b in parts], docs[own])
    if not len(piece):
        return
    order = np.lexsort((offset, piece))
    piece, offset = piece[order], offset[order]
    # Runs of neighbouring starts are one cover.
    new = np.ones(len(piece), bool)
    new[1:] = (piece[1:] != piece[:-1]) | (offset[1:] != offset[:-1] + 1)
    a = np.nonzero(new)[0]
    b = np.append(a[1:], len(piece)) - 1
    yield _marks(docs[own[piece[a]]], texts[own[piece[a]]], (low[piece[a]] + offset[a]).astype(np.int32), (low[piece[b]] + offset[b] + LENGTH).astype(np.int32), np.zeros(len(a), np.int64), RUN)


def _merge_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges the pieces of whole anchors, PORTION pieces or more at a time, of batches sorted by hash within a bucket."""
    held: list[pa.RecordBatch] = []
    count, last = 0, None
    for batch in batches:
        if not len(batch):
            continue
        anchor = batch.column("hash").to_numpy(zero_copy_only=False)
        cuts, at = (np.nonzero(np.diff(anchor))[0] + 1).tolist(), 0
        for cut in cuts if anchor[0] == last else [0, *cuts]:
            if count + cut - at >= PORTION:
                yield from _merge_bucket(pa.Table.from_batches([*held, batch.slice(at, cut - at)]))
                held, count, at = [], 0, cut
        held.append(batch.slice(at))
        count, last = count + len(batch) - at, anchor[-1]
    if held:
        yield from _merge_bucket(pa.Table.from_batches(held))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("_d"), F.xxhash64(text).bitwiseAND(F.lit((1 << 40) - 1)).alias("_t"), text.alias("_text"))


def find_covers(docs: DataFrame) -> DataFrame:
    """(_d, _t, place, upto, kind) of covers: kind 0 is an anchor whose whole context goes, 2 is a run of bytes."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = _keyed(docs).drop("doc_id")
    size = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    buckets = max(8, -(-size // BUCKET_BYTES))
    marks = materialise(map_arrow(rows, _find(buckets), ANCHORS).repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_resolve, MARKS))
    rest = marks.where(F.col("kind") == REST)
    hot = materialise(rest.groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("hash", F.lit(True).alias("_hot")))
    rest = rest.join(hot, "hash", "left")
    wanted = rest.groupBy("_d", "_t").agg(F.collect_list(F.struct("place", "hash", F.coalesce("_hot", F.lit(False)).alias("hot"))).alias("_rest"))
    found = rows.join(wanted, ["_d", "_t"])
    low = F.greatest(F.col("_r.place") - (SPAN - 1), F.lit(0))
    pieces = materialise(
        found.select("_d", "_t", F.encode("_text", "UTF-8").alias("_b"), F.explode("_rest").alias("_r"))
        .select("_d", "_t", F.col("_r.hash").alias("hash"), F.col("_r.hot").alias("hot"), low.alias("low"), (F.col("_r.place") - low).alias("at"), F.expr("substring(_b, greatest(_r.place - %d, 0) + 1, least(_r.place, %d) + %d)" % (SPAN - 1, SPAN - 1, LENGTH)).alias("piece"))
        .dropDuplicates(["_d", "_t", "low", "at"])
    )
    del found, wanted, rest, hot
    cold = pieces.where(~F.col("hot")).drop("hot").withColumn("bucket", F.pmod(F.xxhash64("hash"), F.lit(buckets)).cast("int"))
    merged = cold.repartition(buckets, "bucket").sortWithinPartitions("bucket", "hash").mapInArrow(_merge_all, MARKS)
    # Strings of hot anchors are dealt by themselves; the least document of each is a partial minimum.
    starts = F.sequence(F.lit(0), F.length("piece") - LENGTH)
    strings = pieces.where(F.col("hot") & (F.length("piece") >= LENGTH)).select("_d", "_t", "low", "piece", F.explode(starts).alias("_o")).select("_d", "_t", (F.col("low") + F.col("_o")).alias("place"), F.expr(f"substring(piece, _o + 1, {LENGTH})").alias("_s"))
    least = strings.groupBy("_s").agg(F.min("_d").alias("_least"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    split = strings.join(least, "_s").where("_d > _least").select("_d", "_t", "place", (F.col("place") + LENGTH).alias("upto"), F.lit(0).cast("long").alias("hash"), F.lit(RUN).alias("kind"))
    more = materialise(merged.unionAll(split))
    del cold, merged, strings, least, split
    return marks.where(F.col("kind") == COVER).unionAll(more).select("_d", "_t", "place", "upto", "kind")


RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(data: bytes, place: np.ndarray, upto: np.ndarray, kind: np.ndarray) -> tuple[list[bytes], int, int]:
    """What is left of a text, the bytes removed and the number of runs that they form."""
    n = len(data)
    if not len(place):
        return [data], 0, 0
    whole = kind == COVER
    low = np.where(whole, np.maximum(place - SPAN + 1, 0), place)
    high = np.where(whole, np.minimum(place + LENGTH, n), upto)
    order = np.argsort(low)
    low, high = low[order], np.maximum.accumulate(high[order])
    first = np.concatenate([[True], low[1:] > high[:-1]])
    begin, end = low[first], high[np.append(np.nonzero(first)[0][1:] - 1, len(low) - 1)]
    kept, at = [], 0
    for a, b in zip(begin.tolist(), end.tolist(), strict=True):
        kept.append(data[at:a])
        at = b
    return [*kept, data[at:]], int((end - begin).sum()), len(begin)


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for each row; ``with_text`` adds the bytes left.

    A null text is empty. A null doc_id is smaller than any other. Rows of one doc_id never cover
    each other, as none is smaller; repeated rows give repeated rows. Texts shorter than LENGTH bytes
    stay as they are; an empty table gives an empty one; other columns are left out.
    """
    covers = find_covers(docs).groupBy("_d", "_t").agg(F.collect_list(F.struct(F.coalesce("place", F.lit(0)).alias("place"), F.coalesce("upto", F.lit(0)).alias("upto"), F.coalesce("kind", F.lit(0)).alias("kind"))).alias("_covers"))
    rows = _keyed(docs).join(covers, ["_d", "_t"], "left").select("doc_id", "_text", F.coalesce("_covers", F.array().cast("array<struct<place:int,upto:int,kind:int>>")).alias("_covers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            lists = batch.column("_covers")
            place, upto, kind = (f.to_numpy(zero_copy_only=False) for f in lists.values.flatten())
            cuts = lists.offsets.to_numpy()
            for text, a, b in zip(batch.column("_text").to_pylist(), cuts, cuts[1:], strict=False):
                data = text.encode()
                kept, removed, spans = _cut(data, place[a:b], upto[a:b], kind[a:b])
                left = b"".join(kept)
                for column, value in zip(out, (len(data), removed, spans, hashlib.sha256(left).hexdigest(), left), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            use = 5 if with_text else 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, k) for v, k in list(zip(out, kinds, strict=True))[:use])], ["doc_id", *names[:use]])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(rows, run, f"doc_id {kind}, {RESULT}" + (", kept binary" if with_text else ""))
