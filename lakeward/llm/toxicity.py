"""Toxicity by a linear-chain conditional random field over tokens.

Document labels mark tokens: those that occur in toxic documents significantly more often than
chance allows are toxic where a toxic document holds them; near copies count as one document, so
words that merely stand in copies of one toxic text are not marked. A chain with two states learns from those, by features of a token and its neighbours; in a text each
line is a sequence, forward-backward gives each token's marginal, and the marginals make the
document's score and the offending offsets.

The sample is bounded, by rows of each label, characters of a text and lines; each row stands for
as many labelled rows as its label has per sampled one, so shares, thresholds and the calibration
mean the same at every size.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

BUCKETS = 1 << 17
PUNCTUATION = ".,;:!?()"
TRAIN_TOXIC, TRAIN_OTHER = 2500, 2500
TRAIN_LINES = 6_000
TRAIN_CHARS = 20_000
SKETCH = 16
SEGMENT = 64
STEMS = (5, 6, 7, 8)
EMISSION_CACHE = 400_000
_EDGE = re.compile(r"^\W+|\W+$")
#: Kinds of features, as the states from which their hashes start.
_WORD, _END, _BEHIND, _BEFORE = (crc32(k) for k in (b"w:", b"s:", b"p:", b"n:"))
_STEM = [(n, crc32(f"{n}:".encode())) for n in STEMS]
_OTHERS = BUCKETS - 1


def normal(word: str) -> str:
    low = word.lower()
    bare = low.strip(PUNCTUATION)
    if bare and bare[0].isalnum() and bare[-1].isalnum():
        return bare
    return _EDGE.sub("", low) or low


def stems(word: str) -> list[str]:
    """The word and its beginnings: inflected words share those."""
    return [word + "$", *(word[:n] for n in STEMS if len(word) >= n)]


def features(word: str) -> list[int]:
    """Hashed features of a token: a bias, the word, its beginnings (as many for each) and its end."""
    raw, size = word.encode(), len(word)
    out = [0, 1 + crc32(raw, _WORD) % _OTHERS]
    for n, seed in _STEM:
        out.append(1 + crc32(raw if size <= n else word[:n].encode(), seed) % _OTHERS)
    out.append(1 + crc32(raw if size <= 4 else word[-4:].encode(), _END) % _OTHERS)
    return out


def context(word: str) -> tuple[int, int]:
    """Hashed features of a word to the token behind it and to the one before it."""
    raw = word.encode()
    return 1 + crc32(raw, _BEHIND) % _OTHERS, 1 + crc32(raw, _BEFORE) % _OTHERS


WIDTH = len(features("")) + 2
BORDER = "\n"


def families(texts: list[list[str]]) -> list[int]:
    """A number for each text that near copies share: half of their SKETCH least hashes of word runs are equal."""
    root = list(range(len(texts)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    holders: dict[int, list[int]] = {}
    for k, words in enumerate(texts):
        own = sorted({crc32(" ".join(words[i : i + 3]).encode()) for i in range(max(1, len(words) - 2))})[:SKETCH]
        shared = Counter(j for h in own for j in holders.get(h, ()))
        for j, n in shared.items():
            if 2 * n >= len(own):
                low, high = sorted((find(j), find(k)))
                root[high] = low
        for h in own:
            holders.setdefault(h, []).append(k)
    return [find(k) for k in range(len(texts))]


def lexicon(texts: list[list[str]], labels: list[int], weights: tuple[float, float] = (1.0, 1.0), risk: float = 0.01) -> set[str]:
    """Words and beginnings whose share of toxic documents is beyond chance, at ``risk`` over all that are tried.

    Near copies with one label count once; ``weights`` are those of a clean and of a toxic document.
    """
    seen: tuple[dict[str, set[int]], dict[str, set[int]]] = ({}, {})
    groups: tuple[set[int], set[int]] = (set(), set())
    for words, label, family in zip(texts, labels, families(texts), strict=True):
        groups[label].add(family)
        for w in set(words):
            for s in stems(w):
                seen[label].setdefault(s, set()).add(family)
    toxic, clean = len(groups[1]) * weights[1], len(groups[0]) * weights[0]
    if not toxic or not clean:
        return set()
    rate = toxic / (toxic + clean)
    bound = math.log(risk / len(seen[1]))
    out = set()
    for word, own in seen[1].items():
        k, others = len(own), len(seen[0].get(word, ()))
        share = k * weights[1] / (k * weights[1] + others * weights[0])
        # Chernoff's bound on the binomial tail; at least nine of ten documents must be toxic.
        if share >= 0.9 and share > rate:
            tail = -(k + others) * (share * math.log(share / rate) + ((1 - share) * math.log((1 - share) / (1 - rate)) if share < 1 else 0.0))
            if tail < bound:
                out.add(word)
    return out


class Chain:
    """Weights of the chain; all scores are log odds of the toxic state against the other."""

    def __init__(self):
        self.weight = np.zeros(BUCKETS)
        self.move = np.array([[0.0, 0.0], [0.0, 0.0]])
        self.scale = np.array([0.0, 0.0, 0.0])
        self.forget()

    def forget(self) -> None:
        """Empties the memory of words; rows of ``table`` are what a word brings to itself and its neighbours."""
        self.known: dict[str, int] = {}
        self.table = np.zeros((1 << 12, 3))

    def emission(self, words: list[str], lengths: np.ndarray) -> np.ndarray:
        """Log odds of each raw word of lines that stand one after the other.

        What a word brings to itself and to its two neighbours depends on the word alone and is remembered.
        """
        known = self.known
        got = list(map(known.get, words))
        weight = self.weight.item
        if None in got:
            if len(known) > EMISSION_CACHE:
                self.forget()
                known, got = self.known, [None] * len(words)
            for k, g in enumerate(got):
                if g is None:
                    at = known.get(words[k])
                    if at is None:
                        at = known[words[k]] = len(known)
                        if at == len(self.table):
                            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                        w = normal(words[k])
                        behind, before = context(w)
                        self.table[at] = sum(map(weight, features(w))), weight(behind), weight(before)
                    got[k] = at
        own, behind, before = self.table[got].T
        ends = np.cumsum(lengths)
        first, last = ends - lengths, ends - 1
        border = context(BORDER)
        previous, following = np.roll(behind, 1), np.roll(before, -1)
        previous[first], following[last] = weight(border[0]), weight(border[1])
        return own + previous + following

    def marginals(self, odds: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log odds of the toxic state at each place of padded sequences; the forward and backward parts too."""
        (oo, ot), (to, tt) = self.move
        rows, most = odds.shape
        ahead, back = np.empty((most, rows)), np.zeros((most, rows))
        by_place = np.ascontiguousarray(odds.T)
        ahead[0] = by_place[0]
        for t in range(1, most):
            x = ahead[t - 1]
            ahead[t] = by_place[t] + np.logaddexp(x + tt, ot) - np.logaddexp(x + to, oo)
        for t in range(most - 2, -1, -1):
            c = back[t + 1] + by_place[t + 1]
            now = np.logaddexp(c + tt, to) - np.logaddexp(c + ot, oo)
            back[t] = np.where(t + 1 < lengths, now, 0.0)
        return (ahead + back).T, ahead.T, back.T

    def fit(self, lines: list[list[str]], tags: list[list[int]], rounds: int = 40, rate: float = 0.25, decay: float = 1e-4) -> None:
        """Maximum likelihood by Adam over all lines at once, in padded groups of similar length."""
        order = sorted(range(len(lines)), key=lambda k: len(lines[k]))
        groups = []
        for at in range(0, len(order), 512):
            own = order[at : at + 512]
            most = len(lines[own[-1]])
            feats = np.zeros((len(own), most, WIDTH), np.int64)
            gold, mask = np.zeros((len(own), most)), np.zeros((len(own), most), bool)
            for r, k in enumerate(own):
                n = len(lines[k])
                around = [context(w) for w in (BORDER, *lines[k], BORDER)]
                feats[r, :n] = [[*features(w), around[t][0], around[t + 2][1]] for t, w in enumerate(lines[k])]
                gold[r, :n], mask[r, :n] = tags[k], True
            groups.append((feats, gold, mask, mask.sum(axis=1)))
        tokens = sum(int(m.sum()) for _, _, m, _ in groups)
        first, second = np.zeros(BUCKETS + 4), np.zeros(BUCKETS + 4)
        for step in range(1, rounds + 1):
            slope, moved = np.zeros(BUCKETS), np.zeros((2, 2))
            for feats, gold, mask, lengths in groups:
                odds = np.where(mask, self.weight[feats].sum(axis=2), 0.0)
                both, ahead, back = self.marginals(odds, lengths)
                p = 1 / (1 + np.exp(-np.clip(both, -40, 40)))
                miss = np.where(mask, gold - p, 0.0)
                for k in range(feats.shape[2]):
                    slope += np.bincount(feats[:, :, k].ravel(), miss.ravel(), BUCKETS)
                if odds.shape[1] > 1:
                    on = mask[:, 1:]
                    a, c = ahead[:, :-1], back[:, 1:] + odds[:, 1:]
                    scores = np.stack([np.broadcast_to(self.move[0, 0], a.shape), self.move[0, 1] + c, a + self.move[1, 0], a + self.move[1, 1] + c])
                    pair = np.exp(scores - np.logaddexp.reduce(scores, axis=0))
                    g0, g1 = gold[:, :-1], gold[:, 1:]
                    seen = np.stack([(1 - g0) * (1 - g1), (1 - g0) * g1, g0 * (1 - g1), g0 * g1])
                    moved += ((seen - pair) * on).sum(axis=(1, 2)).reshape(2, 2)
            grad = np.concatenate([slope, moved.ravel()]) / max(1, tokens) * 100
            grad -= decay * np.concatenate([self.weight, self.move.ravel()])
            first = 0.9 * first + 0.1 * grad
            second = 0.99 * second + 0.01 * grad * grad
            change = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
            self.weight += change[:BUCKETS]
            self.move += change[BUCKETS:].reshape(2, 2)

    def raw(self, texts: list[str], spans: bool = False) -> list[tuple[float, float, list[int]]]:
        """Per text the greatest marginal's log odds, the sum of marginals, and the places of toxic tokens."""
        lines, owner, base = [], [], []
        for k, text in enumerate(texts):
            at = 0
            for line in text.split("\n"):
                words = line.split()
                if words:
                    lines.append(words)
                    owner.append(k)
                    base.append(at)
                    at += len(words)
        out = [[-20.0, 0.0, []] for _ in texts]
        order = sorted(range(len(lines)), key=lambda k: len(lines[k]))
        at = 0
        while at < len(order):
            end = at + 1
            # A group's lines differ little in length and its cells are bounded.
            while end < len(order) and len(lines[order[end]]) <= 1.25 * len(lines[order[at]]) + 4 and (end - at) * len(lines[order[end]]) < 200_000:
                end += 1
            own = order[at:end]
            lengths = np.array([len(lines[k]) for k in own])
            mask = np.arange(lengths[-1]) < lengths[:, None]
            odds = np.zeros(mask.shape)
            odds[mask] = self.emission([w for k in own for w in lines[k]], lengths)
            both = np.where(mask, np.clip(self.marginals(odds, lengths)[0], -20, 20), -40.0)
            top, mass = both.max(axis=1), (1 / (1 + np.exp(-both))).sum(axis=1)
            for r, k in enumerate(own):
                row = out[owner[k]]
                row[0], row[1] = max(row[0], float(top[r])), row[1] + float(mass[r])
                if spans and top[r] >= 0:
                    row[2] += [base[k] + int(x) for x in np.nonzero(both[r] >= 0)[0]]
            at = end
        return [(a, b, sorted(c)) for a, b, c in out]

    def scored(self, top: float, mass: float) -> float:
        a, b, c = self.scale
        z = a * top + b * math.log1p(mass) + c
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def train(texts: list[str], labels: list[int], weights: tuple[float, float] = (1.0, 1.0), most_lines: int = TRAIN_LINES) -> Chain:
    """Fits the chain and the two-weight calibration; without both labels every score is 0.

    ``weights`` say how many labelled rows a clean and a toxic text stand for. The chain learns from
    at most ``most_lines`` lines (pieces of SEGMENT words of longer ones), those with marked tokens
    first and else those with the least hash; the calibration uses all texts.
    """
    chain = Chain()
    chain.scale = np.array([0.0, 0.0, -30.0])
    marked = lexicon([[normal(w) for w in t.split()] for t in texts], labels, weights)
    if not marked:
        return chain
    hot, cold = [], []
    for text, label in zip(texts, labels, strict=True):
        for line in text.split("\n"):
            own = [normal(w) for w in line.split()]
            for at in range(0, len(own), SEGMENT):
                part = own[at : at + SEGMENT]
                tags = [int(label and not marked.isdisjoint(stems(w))) for w in part]
                (hot if any(tags) else cold).append((part, tags))
    hot = sorted(hot, key=lambda x: crc32(" ".join(x[0]).encode()))[: most_lines // 2]
    cold = sorted(cold, key=lambda x: crc32(" ".join(x[0]).encode()))[: most_lines - len(hot)]
    chain.fit([a for a, _ in hot + cold], [b for _, b in hot + cold])
    raw = chain.raw(texts)
    x = np.array([[a, math.log1p(b), 1.0] for a, b, _ in raw])
    y = np.array(labels, float)
    stands = np.where(y == 1, weights[1], weights[0])
    stands = stands / stands.mean()
    w = np.zeros(3)
    ridge = np.diag([0.05, 0.05, 0.01])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (stands * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (stands * (y - p)) - ridge @ w)
        w += np.clip(step, -2, 2)
    chain.scale = w
    chain.forget()
    return chain


def held_out(doc_id) -> F.Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(5)) == 0


def training_sample(docs: DataFrame, labels: DataFrame, toxic: int = TRAIN_TOXIC, other: int = TRAIN_OTHER, chars: int = TRAIN_CHARS) -> tuple[list[str], list[int], tuple[float, float]]:
    """At most ``toxic`` and ``other`` labelled texts, those with the smallest hash of doc_id, and what each stands for.

    Never held-out ones, and none of more than ``chars`` characters, so what reaches the driver is
    bounded; with the labels, the weights of a clean and of a toxic text.
    """
    own = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_label")).where(~held_out(F.col("doc_id")))
    some = [own.where(F.col("_label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in ((1, toxic), (0, other))]
    chosen = some[0].unionAll(some[1])
    # Bounded by the two parameters, so it may be broadcast whatever the corpus.
    found = docs.select("doc_id", "text").where(F.length("text") <= chars).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("_label").alias("_label"))
    rows = sorted((r.doc_id, r.text, r._label) for r in found.toLocalIterator())
    texts, marks = [t for _, t, _ in rows], [k for _, _, k in rows]
    n = {r._label: r.n for r in own.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    return texts, marks, tuple(n.get(k, 0) / max(1, marks.count(k)) for k in (0, 1))


RESULT = "score double, predicted int, n_spans long, spans string"


def score_documents(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id, held_out, score, predicted (score of 0.5 or more), n_spans and spans for each row.

    spans lists start:end in code points of each token with a marginal of one half or more. A null
    text is empty and scores as one without toxic tokens; repeated rows give repeated rows, an empty
    table gives an empty one; other columns are left out. The chain's size is fixed.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            scores, spans = [], []
            for text, (top, mass, places) in zip(texts, chain.raw(texts, spans=True), strict=True):
                scores.append(chain.scored(top, mass))
                at = [m.span() for m in re.finditer(r"\S+", text)] if places else []
                spans.append([f"{at[p][0]}:{at[p][1]}" for p in places])
            columns = [pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(list(map(len, spans)), pa.int64()), pa.array([",".join(s) for s in spans], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *columns], ["doc_id", "held_out", "score", "predicted", "n_spans", "spans"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    return map_arrow(rows, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, {RESULT}")
