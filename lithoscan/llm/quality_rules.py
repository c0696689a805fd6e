"""Quality rules: base statistics, then robust multivariate outliers.

Statistics and estimates are DataFrame expressions only. A minimum covariance
determinant estimate for each language and source: of the sets of ``CORE`` of a
group's rows, the one whose covariance has the least determinant gives centre
and covariance. It is sought from several starts (medians and quartiles, all
rows, and a few rows drawn by seeded hashes): the rows that lie nearest give the
next estimate, which never has a larger determinant, until the determinant
stays; the least one of all starts counts. Rows far from their group's estimate,
by Mahalanobis distance, are rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

SPACE = " \t\n\u000b\f\r"
SYMBOLS = "#*$%&|<>"
#: What stands between words.
GAP = "[\\x20\\x09-\\x0D]+"

#: Parameters of the estimate. ``CORE``: the share of rows that an estimate is
#: made from. ``SCALE``: what makes a covariance of that share consistent for
#: normal rows of four dimensions. ``CUT``: the squared distance beyond which a
#: row goes. ``LEAST_ROWS``: groups below it take their language's estimate, and
#: such languages that of all rows; 0 gives each group its own. ``STARTS``: drawn
#: starts beside the two others, of ``DRAWN`` rows each. ``FLOOR``: the least
#: standard deviation of each statistic, as most rows have no symbol and no
#: repeated line at all; its square is part of every covariance, so determinants
#: are never 0. ``STAYS``: the change of a determinant's logarithm that ends a search.
CORE, SCALE, CUT, LEAST_ROWS, STARTS, DRAWN, STAYS = 0.75, 1.488, 40.0, 60, 2, 8, 1e-3
FLOOR = {"z_length": 0.12, "z_symbols": 0.10, "z_lines": 0.15, "z_repeats": 0.10}
NAMES = list(FLOOR)
LEAST_WORDS, MOST_REPEATS = 50, 50
#: Keys up to which the table of estimates is broadcast; beyond, it is joined.
BROADCAST_KEYS = 20_000
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def base_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source, text_hash`` and the base statistics of every row of ``docs``.

    Also n_lines, the lines with a word. A null text has no words; its hash is
    that of the empty text.
    """
    t, words, win, ranked, pos = (F.col(c) for c in ("t", "words", "win", "ranked", "pos"))
    d = docs.select("doc_id", "lang", "source", F.coalesce(F.col("text"), F.lit("")).alias("t"))
    d = d.withColumn("words", F.array_remove(F.split(t, GAP), "")).withColumn(
        "lines", F.filter(F.split(t, "\n"), lambda line: F.length(F.translate(line, SPACE, "")) > 0)
    )
    d = d.withColumn("n_words", F.size(words).cast("long")).withColumn(
        "win",
        F.when(
            F.size(words) >= 3,
            F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - 3, F.lit(0))), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    # only texts with a repeated window are sorted: windows beside an equal one, by position
    pair = lambda h, i: F.struct(h.alias("h"), i.alias("i"))
    d = d.withColumn("ranked", F.sort_array(F.when(F.size(F.array_distinct(win)) < F.size(win), F.transform(win, pair)).otherwise(F.transform(F.slice(win, 1, 0), pair))))
    equal = lambda x, k: F.coalesce(F.get(ranked, k)["h"] == x["h"], F.lit(False))
    d = d.withColumn("pos", F.sort_array(F.transform(F.filter(ranked, lambda x, k: equal(x, k - 1) | equal(x, k + 1)), lambda x: x["i"])))
    covered = F.aggregate(F.transform(pos, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(pos, k + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    return d.select(
        "doc_id",
        "lang",
        "source",
        F.xxhash64("t").alias("text_hash"),
        "n_words",
        F.length(F.translate(t, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATS * F.col("n_words"))


def transformed(stats: DataFrame) -> DataFrame:
    """``stats`` with the vector z_*: logarithms of the mean word's length and of the shares of symbols, repeated lines and repeated words."""
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return stats.withColumns({
        "z_length": F.log(chars / words),
        "z_symbols": F.log1p(20 * F.col("n_symbols") / chars),
        "z_lines": F.log1p(2 * F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))),
        "z_repeats": F.log1p(2 * F.col("n_repeat_words") / words),
    })


def _key(*names: str) -> Column:
    return F.concat_ws("\u0001", F.lit(str(len(names))), *[F.coalesce(F.col(n).cast("string"), F.lit("\u0002")) for n in names])


def _with(rows: DataFrame, small: DataFrame, few: bool) -> DataFrame:
    """``rows`` with the columns of ``small(key, ...)``, broadcast where it has ``few`` rows."""
    return rows.join(F.broadcast(small) if few else small, "key")


PAIRS = [(i, j) for i in range(len(NAMES)) for j in range(i + 1)]
_CENTRE = [f"m_{i}" for i in range(len(NAMES))]
_FACTOR = [f"l_{i}{j}" for i, j in PAIRS]


def _distance_sql() -> str:
    """Squared Mahalanobis distance by forward substitution in the Cholesky factor l_*, as SQL: one expression, whatever its length."""
    y: list[str] = []
    for i, z in enumerate(NAMES):
        rest = "".join([f"({z} - m_{i})", *(f" - l_{i}{j} * {y[j]}" for j in range(i))])
        y.append(f"(({rest}) / l_{i}{i})")
    return " + ".join(f"{v} * {v}" for v in y)


def _distance() -> Column:
    return F.expr(_distance_sql())


def _factored(moments: DataFrame) -> DataFrame:
    """``(key, start, m_i, l_ij, log_det)`` of centres m_i and covariances c_ij (j <= i): the covariance, scaled and
    with the squares of ``FLOOR`` added, as its Cholesky factor and the logarithm of its determinant."""
    d = moments
    for j in range(len(NAMES)):  # column by column of the factor
        rest = lambda i: f"c_{i}{j} * {SCALE}D" + (f" + {FLOOR[NAMES[i]] ** 2!r}D" if i == j else "") + "".join(f" - l_{i}{k} * l_{j}{k}" for k in range(j))  # noqa: B023, E731
        d = d.selectExpr("*", f"sqrt(greatest({rest(j)}, 1e-6D)) AS l_{j}{j}")
        if j + 1 < len(NAMES):
            d = d.selectExpr("*", *[f"({rest(i)}) / l_{j}{j} AS l_{i}{j}" for i in range(j + 1, len(NAMES))])
    log_det = " + ".join(f"2 * ln(l_{i}{i})" for i in range(len(NAMES)))
    # rounded, so that the order in which tasks add up changes nothing
    return d.selectExpr("key", "start", *[f"round({c}, 9) AS {c}" for c in [*_CENTRE, *_FACTOR]], f"round({log_det}, 9) AS log_det")


def _moments(rows: DataFrame, start: str) -> DataFrame:
    """Centres and covariances of ``rows`` by key, each row as often as its ``weight``."""
    terms = [f"weight * {c} AS t_{i}" for i, c in enumerate(NAMES)] + [f"weight * {NAMES[i]} * {NAMES[j]} AS t_{i}{j}" for i, j in PAIRS]
    sums = rows.selectExpr("key", f"{start} AS start", "weight", *terms).groupBy("key", "start").sum("weight", *(t.split(" AS ")[1] for t in terms))
    mean = {i: f"`sum(t_{i})` / `sum(weight)`" for i in range(len(NAMES))}
    return sums.selectExpr("key", "start", *[f"{mean[i]} AS m_{i}" for i in mean], *[f"`sum(t_{i}{j})` / `sum(weight)` - ({mean[i]}) * ({mean[j]}) AS c_{i}{j}" for i, j in PAIRS])


def _starts(rows: DataFrame, starts: int) -> DataFrame:
    """The estimates that the search begins with, as of :func:`_factored`, for each key of ``rows``."""
    quart = rows.groupBy("key").agg(*[F.expr(f"percentile(round({c}, 2), array(0.25, 0.5, 0.75)) AS {c}") for c in NAMES])
    spread = lambda i: f"pow(({NAMES[i]}[2] - {NAMES[i]}[0]) / 1.349D, 2)"
    found = quart.selectExpr("key", "0 AS start", *[f"{c}[1] AS m_{i}" for i, c in enumerate(NAMES)], *[f"{spread(i) if i == j else '0D'} AS c_{i}{j}" for i, j in PAIRS])
    found = found.union(_moments(rows.selectExpr("*", "1D AS weight"), "1"))
    if starts:
        # the row of the least hash, for each of so many hashes
        z = f"struct({', '.join(NAMES)})"
        draws = [F.expr(f"min_by({z}, xxhash64(row, {k}, {n})) AS d_{k}_{n}") for k in range(starts) for n in range(DRAWN)]
        each = ", ".join(f"struct({k + 2} AS start, d_{k}_{n} AS z)" for k in range(starts) for n in range(DRAWN))
        few = rows.groupBy("key").agg(*draws).selectExpr("key", f"inline(array({each})) AS (start, z)").selectExpr("key", "start AS s", "z.*", "1D AS weight")
        found = found.union(_moments(few, "s"))
    return _factored(found)


def _concentrated(rows: DataFrame, now: DataFrame, core: float, few: bool) -> DataFrame:
    """The estimates from the share ``core`` of each key's rows that lie nearest to the estimates ``now``.

    Distances are counted in steps of a 32nd of a power of two, so a key has a
    bounded number of counts; of the step in which the share ends, each row has
    the same part of the weight.
    """
    far = _with(rows, now, few).selectExpr("key", "start", *NAMES, f"cast(floor(32 * log2({_distance_sql()} + 1e-6D)) AS int) AS bin")
    over = "OVER (PARTITION BY key, start"
    bins = far.groupBy("key", "start", "bin").count().selectExpr("*", f"sum(count) {over} ORDER BY bin ROWS UNBOUNDED PRECEDING) AS upto", f"{core}D * sum(count) {over}) AS most")
    bins = bins.where("upto - count < most").selectExpr("key AS k", "start AS s", "struct(bin, least(1D, (most - (upto - count)) / count) AS part) AS end")
    ends = bins.groupBy("k", "s").agg(F.expr("max(end) AS end"))
    near = far.join(F.broadcast(ends) if few else ends, F.expr("key = k AND start = s")).where("bin <= end.bin")
    return _factored(_moments(near.selectExpr(*far.columns, "CASE WHEN bin < end.bin THEN 1D ELSE end.part END AS weight"), "start"))


def estimates(z: DataFrame, core: float = CORE, least_rows: int = LEAST_ROWS, starts: int = STARTS) -> tuple[DataFrame, DataFrame]:
    """``(keys, parameters)``: the key of each (lang, source), and each key's centre, factor and ``log_det``.

    ``z`` is the transformed table, read several times; rows that fail the base
    rules don't count. Every pass is a partial aggregation by key, and a search
    goes on from each start until its determinant stays. Values enter quantiles
    rounded, so a quantile's state has a bounded number of values. Eager.
    """
    good = z.where(~base_failed()).select("lang", "source", F.xxhash64("doc_id", "text_hash").alias("row"), *NAMES)
    sizes = materialize(good.groupBy("lang", "source").count(), "mcd-sizes")
    by_lang = sizes.groupBy(F.col("lang").alias("g")).agg(F.sum("count").alias("n_lang"))
    keyed = sizes.join(by_lang, F.col("lang").eqNullSafe(F.col("g")), "left").select(
        _key("lang", "source").alias("own"),
        F.when(F.col("count") >= least_rows, _key("lang", "source")).when(F.col("n_lang") >= least_rows, _key("lang")).otherwise(_key()).alias("key"),
    )
    keyed = materialize(keyed, "mcd-keys")
    used = materialize(keyed.select("key").distinct(), "mcd-used")
    few = used.count() * (2 + starts) <= BROADCAST_KEYS
    rows = good.withColumn("key", F.explode(F.array(_key("lang", "source"), _key("lang"), _key()))).select("key", "row", *NAMES)
    rows = materialize(_with(rows, used, few), "mcd-rows")
    now = materialize(_starts(rows, starts).withColumn("log_det", F.lit(float("inf"))), "mcd")
    done = None
    while now.head(1):  # each determinant falls by STAYS at least or its search ends, and none falls below that of FLOOR
        step = _concentrated(rows, now, core, few).join(now.selectExpr("key", "start", "log_det AS was"), ["key", "start"])
        step = materialize(step.selectExpr("*", f"log_det < was - {STAYS} AS goes_on").drop("was"), "mcd")
        ended = step.where("not goes_on").drop("goes_on")
        done = ended if done is None else done.union(ended)
        now = step.where("goes_on").drop("goes_on")
    if done is None:
        done = now
    best = done.groupBy("key").agg(F.min(F.struct("log_det", "start", *[c for c in done.columns if c[:2] in ("m_", "l_")])).alias("b"))
    return keyed, materialize(best.select("key", "b.*").drop("start"), "mcd")


def judge(docs: DataFrame, core: float = CORE, cut: float = CUT, least_rows: int = LEAST_ROWS, starts: int = STARTS) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, base statistics, base_failed, distance, kept.

    ``distance`` is the squared Mahalanobis distance to the estimate of the
    row's language and source (null where base rules already fail); rows beyond
    ``cut`` aren't kept. Null languages and sources are groups like others, a
    null text is empty (and so fails), an empty table gives an empty result, and
    equal rows get equal verdicts. Other columns of ``docs`` are ignored.
    """
    z = materialize(transformed(base_statistics(docs)), "quality")
    keyed, found = estimates(z, core, least_rows, starts)
    scored = z.withColumn("own", _key("lang", "source"))
    few = keyed.count() <= BROADCAST_KEYS
    both = keyed.join(found, "key").drop("key")
    scored = scored.join(F.broadcast(both) if few else both, "own", "left")
    failed = base_failed()
    distance = F.when(~failed, _distance())
    return scored.select(
        "doc_id", "text_hash", *BASE, failed.alias("base_failed"), distance.alias("distance"), (~failed & F.coalesce(distance <= cut, F.lit(True))).alias("kept")
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that :func:`judge` rejects, all columns as they were."""
    gone = judge(docs).where("not kept").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    same = docs["doc_id"].eqNullSafe(gone["__id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == gone["__hash"])
    return docs.join(gone, same, "left_anti")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select("doc_id", *BASE, "base_failed", "kept", "distance")
