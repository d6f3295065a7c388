"""Token counts with a sentencepiece model, lengths only.

No piece of such a vocabulary has the blank mark after another character, so a text can be cut
before each run of blanks without changing its pieces. The units between the cuts are the batches
that go to the library, balanced by bytes; a unit's count is remembered in a bounded cache.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

MARK = "▁"
CACHE = 500_000
SEND_BYTES = 256 << 10
LONGEST_CACHED = 64


class Counter:
    """Counts the tokens of whole texts as the library would give them."""

    def __init__(self, model: bytes):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = (self.library.id_to_piece(i) for i in range(self.library.vocab_size()))
        self.cuts = not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces) and self._plain()
        self.known: dict[str, int] = {}

    def _plain(self) -> bool:
        """Whether the model leaves texts as they are but for one blank before them."""
        probe = "a  b\tc  dＡ\n e "
        return self.library.normalize(probe) == MARK + probe.replace(" ", MARK)

    def units(self, text: str) -> list[str]:
        """What stands between two cuts, each without the one blank that the library puts before it."""
        out, blanks = [], 0
        for part in text.split(" "):
            if part:
                out.append(" " * blanks + part if blanks else part)
                blanks = 0
            else:
                blanks += 1
        if blanks and text:
            out.append(" " * (blanks - 1))
        return out

    def _learn(self, units: list[str]) -> dict[str, int]:
        """Counts of units not known yet, sent in batches of about as many bytes."""
        found: dict[str, int] = {}
        batch, size = [], 0

        def send():
            found.update(zip(batch, map(len, self.library.encode(batch, num_threads=1)), strict=True))
            batch.clear()

        for unit in units:
            if not unit:
                found[unit] = 1
                continue
            batch.append(unit)
            size += len(unit) * 2
            if size >= SEND_BYTES:
                send()
                size = 0
        if batch:
            send()
        return found

    def count(self, texts: list[str]) -> list[int]:
        split = [self.units(t) if self.cuts and MARK not in t else None for t in texts]
        new = {u for s in split if s for u in s if u not in self.known}
        if new:
            found = self._learn(list(new))
            if len(self.known) + len(found) > CACHE:
                needed = {u for s in split if s for u in s}
                self.known = {u: self.known[u] for u in needed if u in self.known}
            self.known.update(found)
        out = [len(self.library.encode(t)) if s is None else sum(map(self.known.__getitem__, s)) for t, s in zip(texts, split, strict=True)]
        if new:
            for u in [u for u in found if len(u) > LONGEST_CACHED]:
                del self.known[u]
        return out


def count_tokens(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens) for each row.

    A null text is the empty text with 0 tokens; repeated rows give repeated rows; other columns
    are left out. Batches end at a number of bytes, so a very long text stands alone. The model
    file is read on the driver and broadcast: its size is that of a vocabulary.
    """
    with open(path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(model.value)
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            n = counter.count(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([k > limit for k in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text")), run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
