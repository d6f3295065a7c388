"""Secret scan with corpus-wide ownership frequency.

Candidates are found in whole texts; how many distinct owners and repositories hold the same
value then tells widely copied examples from credentials that one owner leaked.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_hot, map_arrow, materialise

# The base kinds, in the order in which spans that start together are listed.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
BASE = ("assign", "access", "hex")
LEAST = {"assign": 6, "access": 20, "hex": 24}
# Kinds that this scan adds: key blocks, credentials in addresses, bearer headers, vendor prefixes.
MORE = {
    "key_block": r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s]{16,}",
    "url_login": r"\b[a-z][a-z0-9+]{1,9}://[^\s/:@]{1,64}:([^\s/:@]{4,128})@",
    "bearer": r"\b[Bb]earer\x20+([A-Za-z0-9._~+/-]{16,}=*)",
    "vendor": r"\b(?:gh[pousr]_[A-Za-z0-9]{20,}|xox[abpr]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})",
}
KINDS = (*BASE, *MORE)

_ASSIGN = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_MORE = [(k, re.compile(p, re.ASCII)) for k, p in MORE.items()]


def entropy(value: str) -> float:
    """Bits per character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def scan(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind's place in KINDS, end, value) of all spans, by start and kind; ends exclusive.

    The shortest access and hex runs are part of the patterns: a run is matched to its end, so a
    run that is too short can hold no other match. A short assignment is matched, then dropped.
    """
    out = [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    for k, (_, pattern) in enumerate(_MORE, len(BASE)):
        out += [(m.start(), k, m.end(), m[m.lastindex or 0]) for m in pattern.finditer(text)]
    return sorted(out)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[] for _ in range(6)]
        for text in batch.column("_text").to_pylist():
            found = scan(text)
            n = Counter(k for _, k, _, _ in found)
            spans = [f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in found]
            base = ",".join(s for s, (_, k, _, _) in zip(spans, found, strict=True) if k < len(BASE))
            values = {v: entropy(v) for _, _, _, v in found}
            row = (n[0], n[1], n[2], hashlib.sha256(base.encode()).hexdigest(), ",".join(spans), [{"hash": hashlib.sha256(v.encode()).hexdigest(), "bits": e} for v, e in values.items()])
            for column, value in zip(out, row, strict=True):
                column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("hash", pa.string()), ("bits", pa.float64())])))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_owner"), batch.column("_repo"), *(pa.array(v, k) for v, k in zip(out, kinds, strict=True))], ["doc_id", "_owner", "_repo", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "_found"])


def ownership(found: DataFrame) -> DataFrame:
    """(hash, n_owners, n_repos, n_docs) of all candidates over the whole corpus.

    Counts per owner and repository are summed before anything is dealt by hash, so that a value
    that a third of all rows hold reaches the last step as one row for each repository.
    """
    by_repo = found.groupBy("hash", "_owner", "_repo").agg(F.count("*").alias("n"))
    by_owner = by_repo.groupBy("hash", "_owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"), F.sum("n").alias("n_docs"))


def scan_documents(docs: DataFrame, owner: Column, repository: Column, copied_owners: int = 3, live_bits: float = 3.0) -> DataFrame:
    """Spans and verdicts for each row.

    Returns doc_id, n_assign, n_access, n_hex, base_sha256, spans, then n_values (distinct values),
    n_copied (held by ``copied_owners`` owners or more), n_owner_specific (the others), n_live (of
    those, the ones with ``live_bits`` bits a character or more) and max_owners.
    A null text is empty: no spans and the digest of the empty string. A null owner or repository
    counts as one of its own. Repeated rows give repeated rows and count as one holder; an empty
    table gives an empty one; other columns are left out.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"), owner.cast("string").alias("_owner"), repository.cast("string").alias("_repo"))
    spec = f"doc_id {kind}, _owner string, _repo string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, _found array<struct<hash:string,bits:double>>"
    rows = materialise(map_arrow(rows, _find, spec).withColumn("_row", F.monotonically_increasing_id()))
    found = rows.where(F.size("_found") > 0).select("_row", "_owner", "_repo", F.explode("_found").alias("f")).select("_row", "_owner", "_repo", "f.hash", "f.bits")
    verdict = join_hot(found, materialise(ownership(found)), ["hash"], "n_docs")
    copied = F.col("n_owners") >= copied_owners
    by_row = verdict.groupBy("_row").agg(
        F.count("*").alias("n_values"),
        F.count_if(copied).alias("n_copied"),
        F.count_if(~copied).alias("n_owner_specific"),
        F.count_if(~copied & (F.col("bits") >= live_bits)).alias("n_live"),
        F.max("n_owners").alias("max_owners"),
    )
    sums = ["n_values", "n_copied", "n_owner_specific", "n_live", "max_owners"]
    none = rows.where(F.size("_found") == 0).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", *(F.lit(0).cast("long").alias(c) for c in sums))
    some = rows.where(F.size("_found") > 0).join(by_row, "_row").select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", *sums)
    return none.unionAll(some)
