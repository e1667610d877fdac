"""Quality rules: word, symbol and repetition counts, and robust multivariate outliers.

Documents that fail the base rule (few words, or mostly repeated three-word windows) go first. Of the others, vectors of
transformed statistics are judged within their language and source by the minimum covariance determinant: the mean
and covariance of the SHARE of rows nearest to them. Concentration steps lead there from two starts (medians with
interquartile ranges, and the mean and covariance of all rows) until no determinant falls any more or MOST steps are done; the start with the least
determinant stays. A document is rejected if its squared Mahalanobis distance, made consistent at the
median, exceeds CUTOFF, which chi-squared with five degrees of freedom exceeds once in seven million. A source's mean, covariance and consistency are shrunk towards its language's, and those towards the
corpus's: an estimate from n rows has the weight n / (n + LEAST). So groups of any size are judged, with no step at a size.

All of it is SQL on the executors. Every estimate is a sum over all rows of a group: medians and the limits of the
concentration steps come from exact counts of fine bins, so groups of any size are summed before the shuffle. Corpus, languages and
sources go through the same steps at once. The
statistics of a document (a dozen numbers) are written once and read by every step; the groups' parameters are written after each step.
Rows meet their group's parameters by a broadcast of BROADCAST_GROUPS groups at most, beyond that by a join that salts large groups.

Edges: null and empty texts have no words and fail the base rule; a null language or source is a value of its own;
repeated rows are documents like any other and are judged alike; columns with constant values have a variance floor; a very long text takes
arrays of its words' hashes in one task; an empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import meet, release, saved, table

FEATURES = ("log_words", "word_length", "symbol_share", "repeat_share", "capital_share")
SHARE, MOST, CUTOFF, LEAST, FLOOR = 0.75, 10, 40.0, 60, 0.15
#: Rows of about 300 bytes.
BROADCAST_GROUPS = 50_000
MEDIAN_CHI2 = 4.3515  # median of chi-squared with as many degrees of freedom as features
BINS = 32  # per unit of a feature, and per doubling of a distance
DIM = len(FEATURES)
PAIRS = [(i, j) for i in range(DIM) for j in range(i + 1)]
#: A group: the corpus (level 0, empty names), a language (1), or a language's source (2).
BY = ["level", "lang", "source"]
STATS = [*(f"a{i}" for i in range(DIM)), *(f"v{i}{j}" for i, j in PAIRS)]
SPACE = r"[\\x20\\x09-\\x0D]"


def statistics(docs: DataFrame, *, key: str, text: str, lang: str, source: str) -> DataFrame:
    """One narrow row per document: counts, the base rule and the features."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = docs.select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(source).alias("source"), t.alias("t"), F.expr(f"transform(filter(split(coalesce(`{text}`, ''), '{SPACE}+'), w -> w <> ''), w -> xxhash64(w))").alias("h"))
    windows = words.withColumn("n_words", F.size("h").cast("long")).withColumn("w", F.expr("case when size(h) < 3 then array() else array_sort(transform(sequence(0, size(h) - 3), i -> struct(xxhash64(h[i], h[i + 1], h[i + 2]) as v, i as i))) end"))
    twice = windows.withColumn("s", F.expr("array_sort(transform(filter(transform(w, (x, k) -> case when (k > 0 and w[k - 1].v = x.v) or (k < size(w) - 1 and w[k + 1].v = x.v) then x.i end), i -> i is not null), i -> i))"))
    lines = f"filter(split(t, '\\n'), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')"
    counted = twice.select(
        "key",
        "lang",
        "source",
        "n_words",
        F.expr(f"cast(length(regexp_replace(t, '{SPACE}+', '')) as bigint)").alias("word_chars"),
        F.expr("cast(length(t) - length(translate(t, '#*$%&|<>', '')) as bigint)").alias("n_symbols"),
        F.expr(f"cast(size({lines}) - size(array_distinct({lines})) as bigint)").alias("n_dup_lines"),
        F.expr("cast(coalesce(aggregate(transform(s, (x, k) -> case when k = size(s) - 1 then 3 else least(3, s[k + 1] - x) end), 0, (a, x) -> a + x), 0) as bigint)").alias("n_repeat_words"),
        F.expr("length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))").alias("capitals"),
    )
    failed = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    return counted.select(
        "key",
        "lang",
        "source",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        F.log1p("n_words").alias("f0"),
        F.expr("ln(1 + word_chars / greatest(n_words, 1)) * 4").alias("f1"),
        F.expr("sqrt(n_symbols / greatest(word_chars, 1)) * 4").alias("f2"),
        F.expr("sqrt(n_repeat_words / greatest(n_words, 1)) * 2").alias("f3"),
        F.expr("sqrt(capitals / greatest(word_chars, 1)) * 4").alias("f4"),
    )


def _quantiles(counts: DataFrame, by: list[str], at: dict[str, float]) -> DataFrame:
    """The bins at which the cumulated counts n of each group first reach the shares."""
    from pyspark.sql import Window

    order = Window.partitionBy(*by).orderBy("bin")
    run = counts.withColumn("run", F.sum("n").over(order)).withColumn("all", F.sum("n").over(Window.partitionBy(*by)))
    return run.groupBy(*by).agg(*(F.min(F.when(F.col("run") >= F.ceil(F.col("all") * share), F.col("bin"))).alias(name) for name, share in at.items()))


def _factored(stats: DataFrame, *others: str) -> DataFrame:
    """Other columns, m0.. (mean) and l00.. (Cholesky factor of the covariance with the floor added)."""
    out = stats.select(*others, *(F.col(f"a{i}").alias(f"m{i}") for i in range(DIM)), *(F.col(f"v{i}{j}").alias(f"c{i}{j}") for i, j in PAIRS))
    for i, j in PAIRS:
        rest = F.col(f"c{i}{j}") + (FLOOR**2 if i == j else 0.0)
        for k in range(j):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(FLOOR**2))) if i == j else rest / F.col(f"l{j}{j}"))
    return out.drop(*(f"c{i}{j}" for i, j in PAIRS))


def _distance(rows: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance: the squared length of the forward solution."""
    out = rows
    for i in range(DIM):
        rest = F.col(f"f{i}") - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"y{k}")
        out = out.withColumn(f"y{i}", rest / F.col(f"l{i}{i}"))
    return out.withColumn("d2", sum((F.col(f"y{i}") ** 2 for i in range(1, DIM)), F.col("y0") ** 2)).drop(*(f"y{i}" for i in range(DIM)))


def _bin() -> Column:
    return F.floor(F.log2(F.col("d2") + 1e-9) * BINS).cast("int")


def _with(rows: DataFrame, params: DataFrame, how: str = "inner") -> DataFrame:
    """The rows with the parameters of their group; params is a written table, its column `members` counts a group's rows."""
    if params.count() <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(params.drop("members")), BY, how)
    if "start" not in params.columns:
        return meet(rows, params, BY, spread="mark", how=how)
    return meet(rows.withColumn("start", F.explode(F.array(F.lit(0), F.lit(1)))), params, [*BY, "start"], spread="mark", how=how)


def _mcd(levels: DataFrame) -> DataFrame:
    """(BY, members, STATS): mean and covariance of the SHARE of a group's rows nearest to them, of the better of two starts."""
    moments = [*(F.avg(f"f{i}").alias(f"a{i}") for i in range(DIM)), *(F.covar_pop(f"f{i}", f"f{j}").alias(f"v{i}{j}") for i, j in PAIRS)]
    whole = saved(levels.groupBy(*BY).agg(F.count("*").alias("members"), *moments))
    bins = levels.select(*BY, F.explode(F.array(*(F.struct(F.lit(i).alias("f"), F.floor(F.col(f"f{i}") * BINS).cast("int").alias("bin")) for i in range(DIM)))).alias("x"))
    places = _quantiles(bins.groupBy(*BY, "x.f", "x.bin").agg(F.count("*").alias("n")), [*BY, "f"], {"low": 0.25, "mid": 0.5, "high": 0.75})
    spread = (F.col("high") - F.col("low")) / (BINS * 1.349)
    wide = places.groupBy(*BY).agg(*(F.max(F.when(F.col("f") == i, (F.col("mid") + 0.5) / BINS)).alias(f"a{i}") for i in range(DIM)), *(F.max(F.when(F.col("f") == i, spread)).alias(f"s{i}") for i in range(DIM)))
    middle = wide.select(*BY, *(f"a{i}" for i in range(DIM)), *((F.col(f"s{i}") ** 2 if i == j else F.lit(0.0)).alias(f"v{i}{j}") for i, j in PAIRS))
    starts = [middle.join(whole.select(*BY, "members"), BY), whole]
    columns = [*BY, "members", "start", *STATS]
    stats = saved(starts[0].withColumn("start", F.lit(0)).select(*columns).unionByName(starts[1].withColumn("start", F.lit(1)).select(*columns)))
    size = F.expr(" + ".join(f"2 * ln(l{i}{i})" for i in range(DIM)))
    before = None
    for _ in range(MOST):
        params = saved(_factored(stats, *BY, "members", "start").withColumn("size", size))
        if before is not None:
            settled = before.select(*BY, "start", F.col("size").alias("was")).join(params, [*BY, "start"]).where("was - size > 1e-3").isEmpty()
            release(before)
            if settled:
                break
        before = params
        far = _distance(_with(levels, params))
        limits = saved(_quantiles(far.groupBy(*BY, "start", _bin().alias("bin")).agg(F.count("*").alias("n")), [*BY, "start"], {"limit": SHARE}))
        near = _distance(_with(levels, saved(params.join(limits, [*BY, "start"])))).where(_bin() <= F.col("limit"))
        new = near.groupBy(*BY, "start").agg(*moments)
        stats = saved(new.join(whole.select(*BY, "members"), BY).select(*columns))
    final = _factored(stats, *BY, "members", "start", *STATS).withColumn("size", size)
    best = final.groupBy(*BY, "members").agg(F.min_by(F.struct(*STATS), F.struct("size", "start")).alias("best"))
    return saved(best.select(*BY, "members", "best.*"))


def _above(own: DataFrame, above: DataFrame, level: int, columns: list[str]) -> DataFrame:
    """The groups of a level with the columns, as far_.., of the groups they are part of."""
    # A language's name for the source is the corpus's for the language: empty.
    far = above.select(F.col("lang").alias("up"), *(F.col(c).alias(f"far_{c}") for c in columns))
    return own.withColumn("up", F.col("source" if level == 1 else "lang")).join(far, "up").drop("up")


def _shrunk(levels: DataFrame) -> DataFrame:
    """(BY, members, STATS, unit) of every group: its own estimate and those of the levels above it, weighted by the numbers of rows."""
    own = _mcd(levels).withColumn("w", F.when(F.col("level") == 0, 1.0).otherwise(F.col("members") / (F.col("members") + LEAST)))

    def down(rows: DataFrame, columns: list[str]) -> DataFrame:
        out = [rows.where("level = 0")]
        for level in (1, 2):
            met = _above(rows.where(F.col("level") == level), out[-1], level, columns)
            out.append(met.select(*BY, "members", "w", *((F.col("w") * F.col(c) + (1 - F.col("w")) * F.col(f"far_{c}")).alias(c) if c in columns else F.col(c) for c in rows.columns if c not in (*BY, "members", "w"))))
        return saved(out[0].unionByName(out[1]).unionByName(out[2]))

    mixed = down(own, STATS)
    far = _distance(_with(levels, saved(_factored(mixed, *BY, "members"))))
    middles = saved(_quantiles(far.groupBy(*BY, _bin().alias("bin")).agg(F.count("*").alias("n")), BY, {"mid": 0.5}))
    unit = F.greatest(F.pow(F.lit(2.0), (F.col("mid") + 0.5) / BINS) / MEDIAN_CHI2, F.lit(1.0))
    return down(mixed.join(middles, BY).withColumn("unit", unit).drop("mid"), ["unit"])


def judged(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", cutoff: float = CUTOFF) -> DataFrame:
    """(key, lang, source, counts, base_failed, d2, kept): d2 is null where the base rule failed."""
    rows = saved(statistics(docs, key=key, text=text, lang=lang, source=source))
    # A null language or source gets a name no other can have.
    name = lambda c: F.concat(F.when(F.col(c).isNull(), "0").otherwise("1"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    kinds = F.array(F.struct(F.lit(0).alias("level"), F.lit("").alias("lang"), F.lit("").alias("source")), F.struct(F.lit(1).alias("level"), name("lang").alias("lang"), F.lit("").alias("source")), F.struct(F.lit(2).alias("level"), name("lang").alias("lang"), name("source").alias("source")))
    numbers = [f"f{i}" for i in range(DIM)]
    base = rows.where("not base_failed")
    levels = base.select(F.explode(kinds).alias("g"), F.xxhash64("key").alias("mark"), *numbers).select("g.*", "mark", *numbers)
    ready = saved(_factored(_shrunk(levels).where("level = 2"), *BY, "members", "unit"))
    kept_columns = rows.withColumnsRenamed({"lang": "lang_", "source": "source_"})
    keyed = kept_columns.withColumns({"level": F.lit(2), "lang": name("lang_"), "source": name("source_"), "mark": F.xxhash64("key")})
    out = _distance(_with(keyed, ready, "left")).drop("lang", "source").withColumnsRenamed({"lang_": "lang", "source_": "source"})
    out = out.withColumn("d2", F.when(~F.col("base_failed"), F.col("d2") / F.col("unit")))
    counts_ = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return out.select(F.col("key").alias(key), F.col("lang").alias(lang), F.col("source").alias(source), *counts_, "d2", (~F.col("base_failed") & (F.col("d2") <= cutoff)).alias("kept"))


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = judged(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
