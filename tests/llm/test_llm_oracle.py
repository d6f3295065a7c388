"""Training-data queries over whole tables: against their DuckDB SQL, or against plain Python where SQL can't say it."""

import hashlib
import os
import re

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash

from lakeward.llm import bpe, decontaminate, quality
from lakeward.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def rows(names, data):
    order = [names.index(n) for n in sorted(names)]
    return sorted(tuple("" if r[i] is None else str(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").collect()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    db.execute("SET enable_progress_bar=false")
    for f in os.listdir(SF):
        db.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    df = QUERIES[name](spark, SF)
    found = db.execute(ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got and got == rows(names, found.fetchall())


def test_simhash_equals_brute_force(spark, docs):
    prints = {}
    for d in docs:
        words = re.findall(rb"[^\x20\x09-\x0D]+", (d.text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))
        runs = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
        prints[d.doc_id] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    ids = sorted(prints)
    root = {i: i for i in ids}
    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2 and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op6_simhash"](spark, SF).collect()}
    assert got == {i: (f"{prints[i]:016x}", root[i]) for i in ids} and len(set(root.values())) < len(ids)


def _plain_mcd(x):
    """Centre and covariance of the half with the least determinant, by concentration from the same first halves."""
    n, p = x.shape
    h = (n + p + 1) // 2
    floor = np.array([quality.FLOORS[s] * quality.SCALE for s in quality.STATS]) ** 2
    low = lambda v: np.sort(v, axis=0)[-(-n // 2) - 1]
    middle = low(x)
    z = np.abs(x - middle) / np.sqrt((low(np.abs(x - middle)) * 1.4826) ** 2 + floor)
    ends = []
    for d in ((z * z).sum(1), z.sum(1), z.max(1)):
        last = None
        for _ in range(100):
            half = x[d <= np.sort(d)[min(h, n) - 1] * (1 + 1e-12) + 1e-12]
            mean = half.mean(0)
            cov = (half.T @ half / len(half) - np.outer(mean, mean)) / 0.43 + np.diag(floor)
            det = np.linalg.slogdet(cov)[1]
            if last is not None and abs(det - last) < 1e-9:
                break
            last = det
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
        ends.append((round(det, 6), len(ends), mean, cov))
    return min(ends, key=lambda e: e[:2])[2:]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_quality_verdicts_equal_a_plain_mcd(spark, sf):
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect()}
    groups, got = {}, QUERIES["op4_quality_rules"](spark, f"/root/testdata/{sf}").collect()
    for r in got:
        if not r.base_failed:
            lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in text[r.doc_id].split("\n"))
            v = (np.log((r.word_chars + 500) / (r.n_words + 100)), np.log1p(100 * r.n_symbols / (r.word_chars + 500)), r.n_repeat_words / (r.n_words + 100), r.n_dup_lines / (lines + 20))
            groups.setdefault((r.lang, r.source), []).append((r, [round(c * quality.SCALE) for c in v]))
    rejected, off = 0, 0
    for rows_ in groups.values():
        x = np.array([v for _, v in rows_], float)
        mean, cov = _plain_mcd(x)
        d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
        for (r, _), far in zip(rows_, d, strict=True):
            off += r.kept != (far <= quality.CUTOFF)
            rejected += not r.kept
    assert rejected > 0 and off == 0


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def _plain_line_dedup(docs):
    """Texts by doc_id without the lines that stand earlier, all held against all by plain edit distance."""
    seen, out = [], {}
    for i, text in sorted(docs):
        kept = []
        for line in text.split("\n"):
            w = re.findall(r"[^\x20\x09-\x0D]+", line)
            near = False
            if len(w) >= 5:
                bag = {}
                for x in w:
                    bag[x] = bag.get(x, 0) + 1
                for v, other in seen:
                    most = max(len(v), len(w)) // 5
                    if abs(len(v) - len(w)) <= most and max(len(v), len(w)) - sum(min(n, bag.get(x, 0)) for x, n in other.items()) <= most and _distance(v, w) <= most:
                        near = True
                        break
                seen.append((w, bag))
            if not near:
                kept.append(line)
        out[i] = "\n".join(kept)
    return out


def _plain_near_dedup(docs):
    sets = []
    for _, text in sorted(docs):
        w = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(sets)))
    for b in range(len(sets)):
        for a in range(b):
            both = len(sets[a] & sets[b])
            if root[a] != root[b] and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    return {sorted(docs)[k][0] for k in set(root)}


def test_pipeline_stages_equal_plain_python(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = c.quality_rules(spark, docs, SF)
    verdict = {r.doc_id for r in QUERIES["op4_quality_rules"](spark, SF).collect() if r.kept}
    assert {r.doc_id for r in kept.collect()} == verdict
    text = {r.doc_id: r.text for r in kept.collect()}
    kept = c.line_dedup(spark, kept, SF)
    got = {r.doc_id: r.text for r in kept.collect()}
    assert got == _plain_line_dedup(list(text.items())) and all(r.n_chars == len(r.text) for r in kept.collect())
    kept = c.near_dedup(spark, kept, SF)
    assert {r.doc_id for r in kept.collect()} == _plain_near_dedup(list(got.items()))
    clean = c.decontamination(spark, kept, SF)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    whole = {r.doc_id for r in kept.collect() if any(" ".join(t.split()) in " ".join(r.text.split()) for _, t in items)}
    left = {r.doc_id for r in clean.collect()}
    assert not left & whole
    for r in kept.collect():
        if r.doc_id not in left and r.doc_id not in whole:
            words = set(decontaminate.terms_of(r.text))
            assert any(len(words & set(decontaminate.terms_of(t))) >= 0.7 * len(set(decontaminate.terms_of(t))) for _, t in items)
    ranks = bpe.Ranks.load(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.ids, special_tokens={})
    ids = {r.doc_id: library.encode_ordinary(r.text) for r in clean.collect()}
    out = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in c.byte_bpe(spark, clean, SF).collect()}
    assert out == {k: (len(v), hashlib.sha256(np.array(v, "<u4").tobytes()).hexdigest()) for k, v in ids.items()}
    assert {r.doc_id for r in c.run(spark, SF).collect()} == set(out)


NAMES = ["_d", "_t", "_text", "_lines", "_gone", "_row", "_at", "_group", "_w", "_h", "n_lines", "n_removed", "kept", "node", "items", "fp", "n_words", "_lang", "a.b"]


def test_pipeline_stages_take_odd_rows_and_names(spark):
    import corpus_pipeline as c

    body = " ".join(f"word{k}" for k in range(30))
    rows = [(1, body, "en", "s"), (1, body, "en", "s"), (2, body + " more", None, None), (None, body, "en", "s"), (None, None, None, None), (3, None, "en", "s"), (4, "", "en", "s"), (5, "x " * 20000 + body, "de", "t"), (5, "one line of its own that stays\n" + " ".join(f"other{k}" for k in range(40)), "en", "s")]
    schema = "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"`{n}` string" for n in NAMES)
    docs = spark.createDataFrame([(*r, len(r[1] or ""), *(f"v{k}" for k in range(len(NAMES)))) for r in rows], schema)
    for start in (docs, docs.limit(0)):
        out = start
        for _, stage in c.STAGES[:4]:
            each = stage(spark, start, SF)
            assert each.schema == docs.schema and each.count() <= start.count()
            out = stage(spark, out, SF)
            for r in out.collect():
                assert [r[n] for n in NAMES] == [f"v{k}" for k in range(len(NAMES))]
        assert c.STAGES[4][1](spark, out, SF).count() == out.count()
    lines = {(r.doc_id, r.text) for r in c.line_dedup(spark, docs, SF).collect()}
    assert (3, None) in lines and (4, "") in lines and (None, body) in lines and (2, "") in lines
