"""Benchmark decontamination: a BM25 inverted index of test items, searched by block-max WAND.

Every passage of every text is a query; all items that reach the threshold are retrieved, and a hit
counts when both the item's question and its answer overlap with the passage.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import discard, map_arrow, materialise, whole_row

BLOCK = 8
BANDS = 64
STARTS = 128
PUNCTUATION = ".,;:!?()"
SHARD_BYTES = 4 << 20
TOKEN_CACHE = 400_000
_EDGE = re.compile(r"^\W+|\W+$")
_SENTENCE = re.compile(r"(?<=[.?!])\s+|\n+")


def term_of(word: str) -> str:
    """The word in lower case without punctuation around it; a word of punctuation stays."""
    low = word.lower()
    bare = low.strip(PUNCTUATION)
    if bare and bare[0].isalnum() and bare[-1].isalnum():
        return bare
    return _EDGE.sub("", low) or low


def terms_of(text: str) -> list[str]:
    return [term_of(w) for w in text.split()]


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """Terms of all sentences but the last, and of the last; a single sentence is cut at two thirds."""
    parts = [p for p in _SENTENCE.split(text) if p.strip()]
    if len(parts) > 1:
        return terms_of(" ".join(parts[:-1])), terms_of(parts[-1])
    words = terms_of(text)
    at = max(1, len(words) * 2 // 3)
    return words[:at], words[at:]


def _runs(terms: list[str], size: int) -> set[tuple[str, ...]]:
    size = max(1, min(size, len(terms)))
    return set(zip(*(terms[i:] for i in range(size)), strict=False))


@dataclass(frozen=True)
class Settings:
    """``share``: the part of an item's score against itself that a passage must reach.
    ``overlap``: the part of the question's and of the answer's words that must lie in runs that occur in it.
    ``run``: the most words of such a run; shorter sides take a sixth of their words, one at least, so
    that one changed word, which costs a run's length at most, leaves a side of five words or more found."""

    share: float = 0.6
    overlap: float = 0.8
    run: int = 5
    k1: float = 1.2
    b: float = 0.75


class Index:
    """Postings of one shard of items. Scores are divided by what the item requires, so 1 is enough."""

    def __init__(self, items: list[tuple], df: dict[str, int], n_items: int, mean_length: float, settings: Settings, longest: int = 1):
        self.settings = settings
        items = sorted(items, key=lambda x: (len(x[1]), x[0]))
        self.items = [i for i, _ in items]
        self.sides = []
        self.longest = longest
        found: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for at, (_, text) in enumerate(items):
            terms = terms_of(text)
            self.longest = max(self.longest, len(terms))
            self.sides.append([(max(1, min(settings.run, len(s) // 6)), s) for s in question_and_answer(text) if s])
            tf: dict[str, int] = defaultdict(int)
            for t in terms:
                tf[t] += 1
            norm = settings.k1 * (1 - settings.b + settings.b * len(terms) / mean_length)
            score = {t: math.log(1 + (n_items - df[t] + 0.5) / (df[t] + 0.5)) * f * (settings.k1 + 1) / (f + norm) for t, f in tf.items()}
            need = settings.share * sum(score.values())
            for t, s in score.items():
                found[t].append((at, s / need))
        self.term = {t: k for k, t in enumerate(found)}
        self.docs = [[d for d, _ in p] for p in found.values()]
        self.gain = [[g for _, g in p] for p in found.values()]
        # Block maxima by term, laid out so that one sum over a passage's terms bounds every block.
        self.block_ids = [np.unique(np.array(d) // BLOCK) for d in self.docs]
        self.block_max = [np.array([max(g for x, g in zip(d, gs, strict=True) if x // BLOCK == b) for b in ids]) for d, gs, ids in zip(self.docs, self.gain, self.block_ids, strict=True)]
        # The same in at most BANDS bands of blocks, as one row per term; the last row is for other words.
        blocks = -(-len(items) // BLOCK)
        width = max(1, -(-blocks // BANDS))
        self.bands = np.zeros((len(self.docs) + 1, max(1, -(-blocks // width))), np.float32)
        for t, (ids, most) in enumerate(zip(self.block_ids, self.block_max, strict=True)):
            np.maximum.at(self.bands[t], ids // width, most)

    def within_reach(self, terms: list[int]) -> np.ndarray:
        """Blocks of items whose maxima add up to 1: no other block has an item that qualifies."""
        ids, most = self.block_ids, self.block_max
        bounds = np.bincount(np.concatenate([ids[t] for t in terms]), np.concatenate([most[t] for t in terms]))
        return np.nonzero(bounds >= 1 - 1e-9)[0]

    def search(self, terms: list[int]) -> list[int]:
        """Items whose score reaches 1, by block-max WAND.

        Blocks are aligned for all lists, so the blocks out of reach are passed over by all cursors
        at once. Inside a block the lists are kept in order of their next item, and the first list
        at which the sum of their maxima reaches 1 gives the pivot, the first item that can qualify.
        """
        out: list[int] = []
        for block in self.within_reach(terms).tolist():
            low, high = block * BLOCK, (block + 1) * BLOCK
            heads = []
            for t in terms:
                docs = self.docs[t]
                at = bisect_left(docs, low)
                if at < len(docs) and docs[at] < high:
                    k = bisect_left(self.block_ids[t], block)
                    heads.append((docs[at], t, at, self.block_max[t][k]))
            while heads:
                heads.sort()
                total, pivot = 0.0, -1
                for k, head in enumerate(heads):
                    total += head[3]
                    if total >= 1 - 1e-9:
                        pivot = k
                        break
                if pivot < 0:
                    break
                item = heads[pivot][0]
                score, after = 0.0, item if heads[0][0] < item else item + 1
                if after > item:
                    score = sum(self.gain[t][at] for d, t, at, _ in heads if d == item)
                    if score >= 1 - 1e-9:
                        out.append(item)
                moved = []
                for d, t, at, m in heads:
                    if d < after:
                        at = bisect_left(self.docs[t], after, at)
                        if at == len(self.docs[t]) or self.docs[t][at] >= high:
                            continue
                        d = self.docs[t][at]
                    moved.append((d, t, at, m))
                heads = moved
        return out

    def verified(self, item: int, terms: list[str]) -> float:
        """The smaller overlap of question and answer with the passage: the part of their words in runs that it holds."""
        runs: dict[int, set] = {}
        least = 1.0
        for size, side in self.sides[item]:
            if size not in runs:
                runs[size] = _runs(terms, size)
            covered, upto = 0, 0
            for k, run in enumerate(zip(*(side[i:] for i in range(size)), strict=False)):
                if run in runs[size]:
                    covered += k + size - max(k, upto)
                    upto = k + size
            least = min(least, covered / len(side))
        return least


class Searcher:
    """Cuts texts into passages and searches those that can reach the threshold at all.

    A passage has twice the words of the longest item and starts that many words after the last
    one, so each place where an item could stand lies whole in some passage.
    """

    def __init__(self, index: Index):
        self.index, self.known = index, {}

    def _terms(self, words: list[str]) -> np.ndarray:
        known = self.known
        got = list(map(known.get, words))
        if None in got:
            term = self.index.term
            if len(known) > TOKEN_CACHE:
                known.clear()
            for k, g in enumerate(got):
                if g is None:
                    got[k] = known[words[k]] = term.get(term_of(words[k]), -1)
        return np.array(got, np.int64)

    def _reaching(self, ids: np.ndarray, n: int, step: int) -> Iterator[tuple[int, list[int]]]:
        """(number, terms) of the passages whose distinct terms' maxima add up to 1 in some band of the index."""
        size = np.int64(len(self.index.bands))
        for at in range(0, n, STARTS):
            words = ids[at * step : (min(n, at + STARTS) + 1) * step]
            part = np.arange(len(words)) // step
            part, words = part[words >= 0], words[words >= 0]
            most = min(n - at, STARTS)
            # Each word belongs to the passage that starts in its part and to the one before.
            pairs = np.concatenate([(part * size + words)[part < most], ((part - 1) * size + words)[part > 0]])
            if not len(pairs):
                continue
            pairs = np.unique(pairs)
            passage, terms = pairs // size, pairs % size
            cuts = np.concatenate([[0], np.nonzero(np.diff(passage))[0] + 1])
            good = np.add.reduceat(self.index.bands[terms], cuts, axis=0).max(axis=1) >= 1 - 1e-4
            ends = np.append(cuts[1:], len(pairs))
            for c in np.nonzero(good)[0]:
                yield at + int(passage[cuts[c]]), terms[cuts[c] : ends[c]].tolist()

    def search(self, text: str) -> tuple[int, int, dict[int, float]]:
        """Passages, retrieved pairs, and the verified items with their best overlap."""
        words, step = text.split(), self.index.longest
        if not words or not self.index.items:
            return 0, 0, {}
        ids = self._terms(words)
        hits = 0
        found: dict[int, float] = {}
        n = max(1, -(-(len(words) - step) // step))
        for passage, own in self._reaching(ids, n, step):
            at = passage * step
            for item in self.index.search(own):
                hits += 1
                terms = [term_of(w) for w in words[at : at + 2 * step]]
                share = self.index.verified(item, terms)
                if share >= self.index.settings.overlap:
                    found[item] = max(share, found.get(item, 0.0))
        return n, hits, found


RESULT = "n_passages long, n_retrieved long, items array<long>, contaminated boolean, overlap double"


def shards(items: DataFrame, settings: Settings, shard_bytes: int = SHARD_BYTES) -> tuple[int, Iterator[Index]]:
    """The number of shards of about ``shard_bytes`` of text, and their indexes one after the other.

    Statistics and the passages' length are those of all items; the driver holds one shard at a time.
    """
    rows = materialise(items.select(F.col("item_id").cast("long").alias("item_id"), F.trim("text").alias("text")).where("text is not null and text <> '' and item_id is not null").distinct())
    size = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    if not size.n:
        return 0, iter(())
    parts = -(-size.bytes // shard_bytes)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [terms_of(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(terms, pa.list_(pa.string()))], ["item_id", "terms"])

    terms = materialise(map_arrow(rows, split, "item_id long, terms array<string>"))
    mean, longest = terms.agg(F.avg(F.size("terms")), F.max(F.size("terms"))).first()
    df = materialise(terms.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("df")))

    def each() -> Iterator[Index]:
        for k in range(parts):
            mine = F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k
            of = terms.where(mine).select(F.explode(F.array_distinct("terms")).alias("term")).distinct()
            counts = {r.term: r.df for r in df.join(of, "term", "left_semi").toLocalIterator()}
            found = sorted((r.item_id, r.text) for r in rows.where(mine).toLocalIterator())
            if found:
                yield Index(found, counts, size.n, mean, settings, longest)
        discard(rows, terms, df)

    return parts, each()


def find_leaks(docs: DataFrame, items: DataFrame, settings: Settings | None = None, keep: list[str] | None = None) -> DataFrame:
    """doc_id, n_passages, n_retrieved (passage-item pairs that reach the BM25 threshold), items (the
    verified ones, in order), contaminated and overlap (the best verified one, 0 of none) per row.

    ``keep`` lists other columns to carry along. The index goes to the executors in shards of at
    most about ``SHARD_BYTES`` of item text, one after the other, and only one is held at a time;
    with a single shard all is one pass over the texts. A null text has no passages; null or empty
    items are left out; without items there are no passages and nothing is contaminated; repeated rows give repeated rows, an empty table gives an empty one.
    """
    settings, spark = settings or Settings(), docs.sparkSession
    names = [x.split()[0] for x in RESULT.split(", ")]
    carried = [c for c in dict.fromkeys([*(keep or []), "doc_id"]) if c not in names]
    rows = docs.select(*carried, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))

    def scan(shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            searcher = Searcher(shared.value)
            for batch in batches:
                got = [searcher.search(t) for t in batch.column("_text").to_pylist()]
                columns = [
                    pa.array([p for p, _, _ in got], pa.int64()),
                    pa.array([h for _, h, _ in got], pa.int64()),
                    pa.array([sorted(searcher.index.items[i] for i in f) for _, _, f in got], pa.list_(pa.int64())),
                    pa.array([bool(f) for _, _, f in got], pa.bool_()),
                    pa.array([max(f.values(), default=0.0) for _, _, f in got], pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), *columns], [*carried, *names])

        return map_arrow(rows, run, StructType([*rows.select(*carried).schema.fields, *StructType.fromDDL(RESULT).fields]))

    parts, indexes = shards(items, settings)
    if parts <= 1:
        found = list(indexes)
        return scan(spark.sparkContext.broadcast(found[0] if found else Index([], {}, 0, 1.0, settings)))
    # Several shards: each row's key stands for it, and what the shards find for equal rows is the same.
    rows = rows.withColumn("_key", F.xxhash64("_text"))
    carried.append("_key")
    each = []
    for k, index in enumerate(indexes):
        shared = spark.sparkContext.broadcast(index)
        each.append(materialise(scan(shared).drop(*[c for c in carried if c not in ("doc_id", "_key")]).withColumn("_shard", F.lit(k))))
        shared.destroy()
        del index
    found = each[0]
    for more in each[1:]:
        found = found.unionAll(more)
    keys = [F.coalesce(F.col("doc_id").cast("string"), F.lit("\0")).alias("_id"), "_key"]
    total = found.distinct().groupBy(*keys).agg(F.max("n_passages").alias("n_passages"), F.sum("n_retrieved").alias("n_retrieved"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), F.max("contaminated").alias("contaminated"), F.max("overlap").alias("overlap"))
    base = rows.select(*carried[:-1], *keys)
    return base.join(total, ["_id", "_key"]).select(*carried[:-1], *names)


def drop_leaks(docs: DataFrame, items: DataFrame, settings: Settings | None = None) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all of their columns, whatever their names."""
    packed = docs.select(whole_row(docs).alias("_row"), "doc_id", "text")
    return find_leaks(packed, items, settings, ["_row"]).where("not contaminated").select("_row.*")
