"""Byte-level BPE by prefix dynamic programming.

For every byte prefix of a piece exactly one token can end its encoding: the one that is
compatible with the last token of the prefix before it. Storing that token for each prefix gives
the encoding of all prefixes at once, so appending bytes only extends the table and an edit only
recomputes from the edit until the table agrees with the old one again.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

UNIT_CACHE = 400_000
PAIR_CACHE = 400_000
LONGEST_CACHED = 64


class Ranks:
    """Vocabulary of mergeable byte strings; a token's id is the rank of the merge that makes it."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ids = ranks
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            self.bytes_of[i] = token
        self.longest = max(map(len, ranks), default=0)
        self.halves = {i: self._halves(token, i) for token, i in ranks.items() if len(token) > 1}
        tails: dict[bytes, set[int]] = {}
        for token, i in ranks.items():
            if len(token) > 1 and self.halves[i]:
                tails.setdefault(token[-3:], set()).add(len(token))
        self.tails = {t: tuple(sorted(n, reverse=True)) for t, n in tails.items()}

    @classmethod
    @lru_cache(maxsize=4)
    def load(cls, path: str) -> Ranks:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})

    def _halves(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The two tokens that the last merge joins; None for a token that merges never reach."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = min(((r, k) for k in range(len(parts) - 1) if (r := self.ids.get(parts[k] + parts[k + 1])) is not None and r < rank), default=(-1, -1))
            if at < 0:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return self.ids[parts[0]], self.ids[parts[1]]


class PrefixEncoder:
    """Keeps, for each prefix of a byte string, the last token of that prefix's encoding."""

    def __init__(self, ranks: Ranks, data: bytes = b"", pairs: dict | None = None):
        self.ranks, self.pairs = ranks, {} if pairs is None else pairs
        self.data, self.last = bytearray(), []
        if data:
            self.append(data)

    def _compatible(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b together leaves the border between them alone.

        Undoes the merges next to the border from the latest to the earliest. At each moment the
        two tokens there would have been merged if their union has a lower rank than the merge
        undone last; at equal ranks the merge further left comes first.
        """
        key = (a, b)
        known = self.pairs.get(key)
        if known is not None:
            return known
        ids, text, halves = self.ranks.ids, self.ranks.bytes_of, self.ranks.halves
        bound, good = float("inf"), True
        while True:
            union = ids.get(text[a] + text[b])
            if union is not None and union < bound:
                good = False
                break
            x, y = halves.get(a), halves.get(b)
            if x is None and y is None:
                break
            if y is None or (x is not None and a > b):
                bound, a = a, x[1]
            else:
                bound, b = b + 1, y[0]
        if len(self.pairs) >= PAIR_CACHE:
            self.pairs.clear()
        self.pairs[key] = good
        return good

    def append(self, more: bytes) -> None:
        start = len(self.data)
        self.data += more
        self._fill(start, len(self.data))

    def _fill(self, start: int, stop: int) -> None:
        """Last tokens of the prefixes that end after start, up to stop: the longest compatible one.

        Candidates are the tokens that end there; three last bytes leave few lengths to look up.
        """
        data, last, ids = bytes(self.data), self.last, self.ranks.ids
        get, lengths, halves, known, none = ids.get, self.ranks.tails.get, self.ranks.halves, self.pairs.get, ()
        for end in range(start + 1, stop + 1):
            if end > 1:
                found = -1
                tail = data[end - 3 if end > 2 else 0 : end]
                for n in lengths(tail, none):
                    if n <= end and (t := get(data[end - n : end])) is not None and halves[t]:
                        if n == end:
                            found = t
                            break
                        before = last[end - n - 1]
                        good = known((before, t))
                        if self._compatible(before, t) if good is None else good:
                            found = t
                            break
                if found < 0 and end > 2 and (t := get(tail[1:])) is not None:
                    before = last[end - 3]
                    good = known((before, t))
                    if self._compatible(before, t) if good is None else good:
                        found = t
                last.append(found if found >= 0 else ids[data[end - 1 : end]])
            else:
                last.append(ids[data[:1]])

    def become(self, data: bytes) -> None:
        """Encodes other bytes, keeping what is known of the prefix that both share."""
        same, most, old = 0, min(len(data), len(self.data)), self.data
        while same < most and old[same] == data[same]:
            same += 1
        del self.data[same:], self.last[same:]
        self.append(data[same:])

    def splice(self, at: int, removed: int, inserted: bytes) -> int:
        """Replaces bytes; returns for how many prefixes the last token was computed anew.

        A prefix's last token depends on no more than the longest token's bytes before it and the
        last tokens there, so after that many equal entries in a row the rest is as it was.
        """
        at = min(at, len(self.data))
        after, old = bytes(self.data[at + removed :]), self.last[at + removed :]
        self.data[at:] = inserted + after
        self.last[at:] = []
        self._fill(at, at + len(inserted))
        same = done = 0
        while done < len(old) and same < self.ranks.longest:
            step = min(len(old) - done, self.ranks.longest)
            self._fill(len(self.last), len(self.last) + step)
            for new, was in zip(self.last[-step:], old[done : done + step], strict=True):
                same = same + 1 if new == was else 0
            done += step
        self.last += old[done:]
        return len(inserted) + done

    def tokens(self) -> list[int]:
        out, end, size = [], len(self.data), self.ranks.bytes_of
        while end:
            t = self.last[end - 1]
            out.append(t)
            end -= len(size[t])
        return out[::-1]


class TextEncoder:
    """Encodes whole texts: each match of the pattern is a piece that is encoded by itself.

    A blank before a character that is no white space always begins a piece, so a text can be cut
    there; what lies between two cuts is a unit, and units repeat enough to be worth remembering.
    The units that a batch brings anew are cut into pieces; these are encoded in sorted order, so
    that each only extends the prefix that it shares with the one before. The caches take no more
    entries when full and start anew when they no longer fit the texts; they bound memory and never
    change a result.
    """

    def __init__(self, ranks: Ranks, pattern: str):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.units: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.pairs: dict = {}
        self.prefixes = PrefixEncoder(ranks, pairs=self.pairs)

    def _cut(self, text: str) -> list[str]:
        """Units of a text; each but the first stands for itself with a blank before it."""
        parts = text.split(" ")
        if "" not in parts and not any(p[0].isspace() for p in parts):
            return parts
        out, at = [], 0
        for end in range(1, len(parts) + 1):
            if end == len(parts) or (parts[end] and not parts[end][0].isspace()):
                out.append(parts[at] if end == at + 1 else " ".join(parts[at:end]))
                at = end
        return out

    def _learn(self, units: dict[str, list[str]]) -> dict[str, bytes]:
        """Ids of units not known yet, given with the pieces of each."""
        known, fresh = self.pieces, {}
        ids = self.ranks.ids
        for piece in sorted({p for pieces in units.values() for p in pieces if p not in known}):
            raw = piece.encode()
            whole = ids.get(raw)
            if whole is not None:
                fresh[piece] = whole.to_bytes(4, "little")
            else:
                self.prefixes.become(raw)
                fresh[piece] = np.array(self.prefixes.tokens(), "<u4").tobytes()
        made = {u: b"".join([fresh[p] if p in fresh else known[p] for p in pieces]) for u, pieces in units.items()}
        self._keep(known, fresh)
        return made

    @staticmethod
    def _keep(cache: dict[str, bytes], fresh: dict[str, bytes]) -> None:
        if len(cache) >= UNIT_CACHE and len(fresh) > len(cache) // 2:
            cache.clear()
        for k, v in fresh.items():
            if len(cache) >= UNIT_CACHE:
                break
            if len(k) <= LONGEST_CACHED:
                cache[k] = v

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """For each text the ids as little-endian unsigned 32-bit integers."""
        cut = [self._cut(t) for t in texts]
        units, find = self.units, self.find
        new = {u for c in cut for u in c[1:] if u not in units}
        made = self._learn({u: find(" " + u) for u in new}) if new else {}
        firsts = {c[0] for c in cut}
        heads = self._learn({u: find(u) for u in firsts})
        out = []
        for c in cut:
            got = list(map(units.get, c))
            got[0] = heads[c[0]]
            if None in got:
                got = [made[u] if g is None else g for u, g in zip(c, got, strict=True)]
            out.append(b"".join(got))
        self._keep(units, made)
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_batch([text])[0]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.ranks.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


SCHEMA = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, path: str, pattern: str, keep: list[str] | None = None, with_ids: bool = False) -> DataFrame:
    """Token count and digests of ids and decoded bytes for each row; ``with_ids`` adds ``ids`` (binary).

    One row per input row: a null text is the empty text (no tokens), repeated rows give repeated
    rows, an empty table an empty one. ``keep`` lists the input's columns to carry along (doc_id by
    default); a carried column that has the name of a result column gives way to the result.
    The rank file is read on the driver and broadcast: its size is that of a vocabulary, whatever
    the corpus.
    """
    spark = docs.sparkSession
    new = SCHEMA + (", ids binary" if with_ids else "")
    names = [x.split()[0] for x in new.split(", ")]
    carried = [c for c in (keep or ["doc_id"]) if c not in names]
    shared = spark.sparkContext.broadcast(Ranks.load(path))
    fields = docs.select(*carried).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = TextEncoder(shared.value, pattern)
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for ids in coder.encode_batch(batch.column("_text").to_pylist()):
                row = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(coder.decode(ids)).hexdigest(), ids)
                for column, value in zip(out, row, strict=False):
                    column.append(value)
            kinds = (pa.int64(), pa.string(), pa.string(), pa.binary())
            kept = [batch.column(c) for c in carried]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(v, k) for v, k in zip(out, kinds, strict=False))], [*carried, *names])

    spec = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), new])
    return map_arrow(docs.select(*carried, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text")), run, spec)
