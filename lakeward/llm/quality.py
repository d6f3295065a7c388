"""Quality rules with robust multivariate outliers, in DataFrame expressions only.

Word and line statistics of each text give a vector; per language and source a minimum covariance
determinant estimate says where the bulk of such vectors lies, and vectors too far from it by
Mahalanobis distance are rejected. Several deterministic starts pick a first half of each group,
concentration steps go on until no half changes, and of the ends the one whose covariance has the
least determinant counts (the first start's where they are equal). A floor on each scale keeps
determinants above zero. Vectors are fixed-point integers and sums are exact, so the result does
not depend on the order in which executors add things up.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise, whole_row

BLANK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
# The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
RUN = 5
SCALE = 10_000
#: Distances are counted in bins of their logarithm, and in parts of the one bin where the half ends.
BINS, PARTS = 32, 1024
#: Words, characters and lines of typical text that are added to each ratio, so that short texts don't scatter more than long ones.
PRIOR_WORDS, PRIOR_LENGTH, PRIOR_LINES = 100, 5, 20
#: Least scale of each statistic: differences within a few of these are no reason to reject.
FLOORS = {"v_length": 0.08, "v_symbols": 0.25, "v_repeats": 0.05, "v_lines": 0.08}
STATS = tuple(FLOORS)
#: Squared distance; a normal vector of four goes beyond it once in about 10**7 texts.
CUTOFF = 38.0
#: Steps go on until they settle, at most so many.
STEPS = 30
STARTS = 3
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def with_counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and the base counts of each row's whole text, in one pass over the row without a shuffle."""
    text = F.col("_t")
    base = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_t"))
    words = F.array_remove(F.split(text, BLANK), "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    step = base.select(*keep, words.alias("_w"), lines.alias("_l"), (F.length(text) - F.length(F.translate(text, " \t\n\x0b\f\r", ""))).alias("_blank"), F.length(text).alias("_len"), (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"))
    w, n = F.col("_w"), F.size("_w")
    runs = F.when(n >= RUN, F.transform(F.sequence(F.lit(0), n - RUN), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(RUN))))).otherwise(F.array().cast("array<bigint>"))
    step = step.select(
        *keep,
        n.cast("long").alias("n_words"),
        (F.col("_len") - F.col("_blank")).cast("long").alias("word_chars"),
        "n_symbols",
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        runs.alias("_h"),
    )
    counts = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    again = F.size(F.array_distinct("_h")) < F.size("_h")
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    step = step.select(*keep, *counts, F.when(again, F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(none).alias("_s"))
    s = F.col("_s")
    same = lambda e, j: F.coalesce(F.get(s, j)["h"] == e["h"], F.lit(False))
    starts = F.sort_array(F.transform(F.filter(s, lambda e, j: same(e, j + 1) | ((j > 0) & same(e, F.greatest(j - 1, F.lit(0))))), lambda e: e["i"]))
    step = step.select(*keep, *counts, starts.alias("_p"))
    p = F.col("_p")
    covered = F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(RUN), F.coalesce(F.get(p, j + 1) - x, F.lit(RUN)))), F.lit(0).cast("long"), lambda a, x: a + x)
    return step.select(*keep, *counts, covered.alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def vector() -> list[Column]:
    """The transformed statistics as fixed-point integers."""
    n, chars = F.col("n_words"), F.col("word_chars")
    values = {
        "v_length": F.log((chars + PRIOR_WORDS * PRIOR_LENGTH) / (n + PRIOR_WORDS)),
        "v_symbols": F.log1p(100 * F.col("n_symbols") / (chars + PRIOR_WORDS * PRIOR_LENGTH)),
        "v_repeats": F.col("n_repeat_words") / (n + PRIOR_WORDS),
        "v_lines": F.col("n_dup_lines") / (F.col("n_lines") + PRIOR_LINES),
    }
    return [F.round(v * SCALE).cast("long").alias(k) for k, v in values.items()]


def _factor(df: DataFrame, size: int) -> DataFrame:
    """Adds the Cholesky factor l{i}{j} of the columns c{i}{j}, a column of entries at a time."""
    for j in range(size):
        root = F.sqrt(F.col(f"c{j}{j}") - sum((F.col(f"l{j}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0)))
        df = df.withColumn(f"l{j}{j}", root)
        for i in range(j + 1, size):
            df = df.withColumn(f"l{i}{j}", (F.col(f"c{j}{i}") - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))) / F.col(f"l{j}{j}"))
    return df


def _distance(df: DataFrame, size: int) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance of STATS from m{i} under the factor l{i}{j}."""
    for i, name in enumerate(STATS):
        rest = F.col(name).cast("double") - F.col(f"m{i}") - sum((F.col(f"l{i}{k}") * F.col(f"z{k}") for k in range(i)), F.lit(0.0))
        df = df.withColumn(f"z{i}", rest / F.col(f"l{i}{i}"))
    return df.withColumn("d2", sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(size)), F.lit(0.0))).drop(*(f"z{i}" for i in range(size)))


GROUP = ["_lang", "_source"]


def _centres(rows: DataFrame) -> DataFrame:
    """Per group the median m{i} and scale s{i} of each statistic."""
    size, half = len(STATS), F.ceil(F.col("_n") / 2)
    long = rows.select(*GROUP, F.explode(F.array(*(F.struct(F.lit(i).alias("_i"), F.col(s).alias("_x")) for i, s in enumerate(STATS)))).alias("_e")).select(*GROUP, "_e._i", "_e._x")

    def median(df: DataFrame, value: Column, name: str) -> DataFrame:
        keys = [*GROUP, "_i"]
        counted = df.select(*keys, value.alias("_bin")).groupBy(*keys, "_bin").agg(F.count("*").alias("_c"))
        total = counted.withColumn("_cum", F.sum("_c").over(Window.partitionBy(*keys).orderBy("_bin"))).withColumn("_n", F.sum("_c").over(Window.partitionBy(*keys)))
        return total.where(F.col("_cum") >= half).groupBy(*keys).agg(F.min("_bin").alias(name))

    centre = materialise(median(long, F.col("_x"), "_m"))
    spread = median(long.join(centre, [*GROUP, "_i"]), F.abs(F.col("_x") - F.col("_m")), "_s")
    both = centre.join(spread, [*GROUP, "_i"])
    pick = lambda i, c: F.max(F.when(F.col("_i") == i, F.col(c))).cast("double")
    wide = both.groupBy(*GROUP).agg(*(pick(i, "_m").alias(f"m{i}") for i in range(size)), *(pick(i, "_s").alias(f"s{i}") for i in range(size)))
    scale = [F.sqrt(F.pow(F.col(f"s{i}") * 1.4826, F.lit(2.0)) + F.lit((FLOORS[s] * SCALE) ** 2)).alias(f"s{i}") for i, s in enumerate(STATS)]
    return materialise(wide.select(*GROUP, *(f"m{i}" for i in range(size)), *scale))


def _first_distances(rows: DataFrame, centres: DataFrame) -> DataFrame:
    """Adds _start and d2: each start ranks rows by another norm of their distance to the medians in scales."""
    z = [F.abs((F.col(s).cast("double") - F.col(f"m{i}")) / F.col(f"s{i}")) for i, s in enumerate(STATS)]
    squares, total, most = sum((x * x for x in z), F.lit(0.0)), sum(z, F.lit(0.0)), F.greatest(*z)
    norms = F.array(*(F.struct(F.lit(k).alias("_start"), d.alias("d2")) for k, d in enumerate((squares, total, most))))
    return rows.join(centres, GROUP).select(*GROUP, *STATS, F.explode(norms).alias("_e")).select(*GROUP, *STATS, "_e._start", "_e.d2")


def _concentrate(near: DataFrame) -> DataFrame:
    """The estimate of the nearer half of each group and start: centre, factor, log determinant and size.

    The half is what lies up to the place of the middle row: its bin is found from counts of all
    bins, the part of that bin from counts of its parts, so no group's rows meet anywhere. Rows at
    one distance are in or out together.
    """
    size, keys = len(STATS), [*GROUP, "_start"]
    place = F.log(F.col("d2") + 1e-6) * BINS
    near = near.select("*", F.floor(place).alias("_bin"), F.floor((place - F.floor(place)) * PARTS).alias("_part"))
    counts = materialise(near.groupBy(*keys, "_bin", "_part").agg(F.count("*").alias("_c")))
    bins = counts.groupBy(*keys, "_bin").agg(F.sum("_c").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_bin"))
    bins = bins.withColumn("_cum", upto).withColumn("_need", F.floor((F.sum("_c").over(Window.partitionBy(*keys)) + size + 1) / 2))
    edge = bins.where("_cum >= _need").groupBy(*keys).agg(F.min(F.struct("_bin", "_cum", "_c", "_need")).alias("_e")).select(*keys, F.col("_e._bin").alias("_last"), (F.col("_e._need") - F.col("_e._cum") + F.col("_e._c")).alias("_left"))
    parts = counts.join(edge, keys).where("_bin = _last").withColumn("_cum", F.sum("_c").over(Window.partitionBy(*keys).orderBy("_part")))
    limit = parts.where("_cum >= _left").groupBy(*keys, "_last").agg(F.min("_part").alias("_limit"))
    half = near.join(limit, keys).where((F.col("_bin") < F.col("_last")) | ((F.col("_bin") == F.col("_last")) & (F.col("_part") <= F.col("_limit"))))
    pairs = list(combinations_with_replacement(range(size), 2))
    exact = lambda c: F.sum(c.cast("decimal(20,0)"))
    sums = half.groupBy(*keys).agg(F.count("*").alias("_k"), *(exact(F.col(s)).cast("double").alias(f"t{i}") for i, s in enumerate(STATS)), *(exact(F.col(STATS[i]) * F.col(STATS[j])).cast("double").alias(f"p{i}{j}") for i, j in pairs))
    # The nearer half of a normal cloud of four has about 0.43 of its variance.
    mean = [(F.col(f"t{i}") / F.col("_k")).alias(f"m{i}") for i in range(size)]
    cov = []
    for i, j in pairs:
        c = (F.col(f"p{i}{j}") / F.col("_k") - F.col(f"t{i}") / F.col("_k") * F.col(f"t{j}") / F.col("_k")) / 0.43
        cov.append((c + F.lit((FLOORS[STATS[i]] * SCALE) ** 2) if i == j else c).alias(f"c{i}{j}"))
    made = _factor(sums.select(*keys, "_k", *mean, *cov), size).drop(*(f"c{i}{j}" for i, j in pairs))
    found = materialise(made.withColumn("_logdet", sum((2 * F.log(f"l{i}{i}") for i in range(size)), F.lit(0.0))))
    discard(counts)
    return found


def estimates(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """Per language and source the centre and factor of the half with the least determinant, from ``rows`` with GROUP and STATS."""
    size, keys = len(STATS), [*GROUP, "_start"]
    centres = _centres(rows)
    found = _concentrate(_first_distances(rows, centres))
    for _ in range(steps):
        more = _concentrate(_distance(rows.join(found.drop("_k", "_logdet"), GROUP), size).select(*keys, *STATS, "d2"))
        old = found.select(*keys, F.col("_k").alias("_ok"), F.col("_logdet").alias("_od"))
        # A step never makes the determinant larger; one that leaves size and determinant alone leaves the half alone.
        moved = not more.join(old, keys).where((F.col("_k") != F.col("_ok")) | (F.abs(F.col("_logdet") - F.col("_od")) > 1e-9)).isEmpty()
        discard(found)
        found = more
        if not moved:
            break
    discard(centres)
    best = found.groupBy(*GROUP).agg(F.min(F.struct(F.round("_logdet", 9).alias("_d"), "_start")).alias("_b")).select(*GROUP, F.col("_b._start").alias("_start"))
    return materialise(found.join(best, keys).drop("_k", "_start"))


def grouped(counted: DataFrame, keep: list[str]) -> DataFrame:
    """A null language or source is a group of its own."""
    return counted.select(*keep, *(F.coalesce(F.col(c).cast("string"), F.lit("\0")).alias(g) for c, g in (("lang", "_lang"), ("source", "_source"))), *vector())


def _verdicts(docs: DataFrame, names: list[str], steps: int, cutoff: float) -> DataFrame:
    """``names``, the base counts, base_failed, kept and d2; the counts are taken once and written."""
    counted = materialise(grouped(with_counts(docs, names), [*names, *COUNTS, base_failed().alias("base_failed")]))
    found = estimates(counted.where(~F.col("base_failed")).select(*GROUP, *STATS), steps)
    far = _distance(counted.join(found.drop("_logdet"), GROUP, "left"), len(STATS))
    within = F.coalesce(F.col("d2") <= cutoff, F.lit(True))
    return far.select(*names, *COUNTS, "base_failed", (~F.col("base_failed") & within).alias("kept"), "d2")


def judge(docs: DataFrame, steps: int = STEPS, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, lang, source, the base counts, base_failed, kept and distance (squared) for each row.

    ``steps`` bounds the concentration steps, which end when no half changes. kept is false where base_failed, else whether the distance is within ``cutoff``. The estimate of
    a group uses its rows that pass the base rules. A null text has no words and fails; a null
    language or source is a group of its own; equal rows share a verdict; in a group that is too
    small to differ from its own centre all rows that pass the base rules stay; an empty table
    gives an empty one; other columns are left out.
    """
    return _verdicts(docs, ["doc_id", "lang", "source"], steps, cutoff).withColumnRenamed("d2", "distance")


def keep_good(docs: DataFrame, steps: int = STEPS, cutoff: float = CUTOFF) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all of their columns, whatever their names."""
    packed = docs.select(whole_row(docs).alias("_row"), "lang", "source", "text")
    return _verdicts(packed, ["_row", "lang", "source"], steps, cutoff).where("kept").select("_row.*")
