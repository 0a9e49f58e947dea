"""Operator 5: robust multivariate outliers among text statistics (DataFrame functions only).

Documents that pass the base rules are described by five transformed
statistics. Per language and source, a regularised minimum-covariance-determinant
estimate is fitted by concentration steps and documents are rejected by their
Mahalanobis distance from it.

A concentration step is one pass with partial aggregation: distances are
binned on a logarithmic scale, moments are summed per group and bin, and a
running sum over the bins of a group yields the moments of its nearest rows; rows
of the bin at the edge count in part. Steps go on until no determinant falls.
Statistics are fixed-point integers, so the sums are exact and reruns agree.

Every estimate is drawn towards that of all documents together, the more the
smaller its group is, so there is no size from which on a group counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, unstage
from .quality_stats import n_dup_lines, n_repeat_words, n_symbols, word_chars, words_of

SCALE = 1000
#: Steps of the bins: 64 to a factor e of the squared distance.
BINS = 64
#: Name of the group of all documents.
ALL = "all"
#: Groups up to which their estimates are broadcast, some 50 numbers each.
MOST_BROADCAST = 50_000


def _join_groups(rows: DataFrame, groups: DataFrame, few: bool) -> DataFrame:
    """Rows with what is known of their group: broadcast if the groups were counted and are few,
    else joined by sorting, where Spark splits hot groups."""
    return rows.join(F.broadcast(groups) if few else groups, "grp")


def _chi2_cdf(x: float, k: int) -> float:
    """Distribution function of chi-square, by its series."""
    term = total = 1.0 / (k / 2)
    i = k / 2
    while term > total * 1e-15:
        i += 1
        term *= (x / 2) / i
        total += term
    return total * math.exp(-x / 2 + (k / 2) * math.log(x / 2) - math.lgamma(k / 2))


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2_cdf(max(mid, 1e-12), k) < p else (low, mid)
    return high


def consistency(alpha: float, p: int) -> float:
    """Factor by which the covariance of the nearest ``alpha`` of normal rows falls short."""
    return alpha / _chi2_cdf(chi2_quantile(alpha, p), p + 2)


def _factored(groups: DataFrame, keys: list[str], p: int) -> DataFrame:
    """``keys`` and the means, with the Cholesky factor ``l_i_j`` of the covariance ``s_i_j`` and ``logdet``."""
    for j in range(p):
        for i in range(j, p):
            rest = F.col(f"s_{i}_{j}")
            for k in range(j):
                rest = rest - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            groups = groups.withColumn(f"l_{i}_{j}", F.sqrt(rest) if i == j else rest / F.col(f"l_{j}_{j}"))
    logdet = sum((F.log(F.col(f"l_{i}_{i}")) for i in range(1, p)), F.log("l_0_0"))
    names = [f"m_{i}" for i in range(p)] + [f"s_{i}_{j}" for i in range(p) for j in range(i + 1)] + [f"l_{i}_{j}" for i in range(p) for j in range(i + 1)]
    return groups.select(*keys, *names, logdet.alias("logdet"))


def _distances(rows: DataFrame, groups: DataFrame, features: list[str], few: bool) -> DataFrame:
    """Rows with ``d2``, their squared Mahalanobis distance in their group."""
    out = _join_groups(rows, groups, few)
    for i, x in enumerate(features):
        rest = F.col(x) - F.col(f"m_{i}")
        for k in range(i):
            rest = rest - F.col(f"l_{i}_{k}") * F.col(f"y_{k}")
        out = out.withColumn(f"y_{i}", rest / F.col(f"l_{i}_{i}"))
    d2 = sum((F.col(f"y_{i}") * F.col(f"y_{i}") for i in range(1, len(features))), F.col("y_0") * F.col("y_0"))
    return out.withColumn("d2", d2)


def _sums(features: list[str]) -> list[Column]:
    exact = lambda c: F.sum(c.cast("decimal(20,0)"))
    out = [F.count(F.lit(1)).alias("c")] + [exact(F.col(x)).alias(f"a_{i}") for i, x in enumerate(features)]
    return out + [exact(F.col(x) * F.col(features[j])).alias(f"b_{i}_{j}") for i, x in enumerate(features) for j in range(i + 1)]


def _moments(sums: DataFrame, keys: list[str], p: int, factor: float, floors: list[float]) -> DataFrame:
    """Means and regularised covariances from the sums ``c, a_i, b_i_j``."""
    c = F.col("c").cast("double")
    mean = {i: F.col(f"a_{i}").cast("double") / c for i in range(p)}
    cols = {f"m_{i}": mean[i] for i in range(p)}
    for i in range(p):
        for j in range(i + 1):
            s = (F.col(f"b_{i}_{j}").cast("double") / c - mean[i] * mean[j]) * F.lit(factor)
            cols[f"s_{i}_{j}"] = F.greatest(s, F.lit(0.0)) + F.lit(floors[i] ** 2) if i == j else s
    return sums.select(*keys, *[v.alias(k) for k, v in cols.items()])


def _robust_start(rows: DataFrame, features: list[str], floors: list[float]) -> DataFrame:
    """Start from coordinate-wise medians and quartile ranges, exact, by counts of values."""
    values = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(x).alias("x")) for i, x in enumerate(features)])).alias("v")
    # Written once summed: rows are dealt by group and value, sums alone by group.
    counts = stage(rows.select("grp", "n", values).groupBy("grp", "n", "v.i", "v.x").agg(F.count(F.lit(1)).alias("k")), "mcd-values")
    below = F.sum("k").over(Window.partitionBy("grp", "i").orderBy("x"))
    at = lambda q: F.min(F.when(F.col("to") >= q * F.col("n"), F.col("x")))
    marks = counts.withColumn("to", below).groupBy("grp", "i").agg(at(0.25).alias("q1"), at(0.5).alias("q2"), at(0.75).alias("q3"))
    wide = marks.groupBy("grp").agg(
        *[F.max(F.when(F.col("i") == i, F.col("q2"))).cast("double").alias(f"m_{i}") for i in range(len(features))],
        # 1.349: quartile range of the standard normal distribution.
        *[(F.pow(F.max(F.when(F.col("i") == i, F.col("q3") - F.col("q1"))) / 1.349, 2) + floors[i] ** 2).alias(f"s_{i}_{i}") for i in range(len(features))],
    )
    zeros = [F.lit(0.0).alias(f"s_{i}_{j}") for i in range(len(features)) for j in range(i)]
    return wide.select("*", *zeros)


def fit_mcd(rows: DataFrame, features: list[str], floors: list[float], alpha: float = 0.75, few: bool = False, most_steps: int = 100) -> DataFrame:
    """Estimates ``grp, n, m_i, s_i_j`` for rows ``grp, n, *features``, n the group's size.

    Two deterministic starts, classical moments and coordinate-wise quartiles, are
    concentrated on the nearest ``alpha`` of the rows, both in one pass, for as long as
    a determinant falls (``most_steps`` is far beyond what that takes); per group the
    estimate of smaller determinant wins. ``floors`` are standard deviations added to
    the diagonal: they keep the estimate regular where most rows share one value.
    """
    p, factor, keys = len(features), consistency(alpha, len(features)), ["grp", "start"]
    classical = _moments(rows.groupBy("grp").agg(*_sums(features)), ["grp"], p, 1.0, floors)
    starts = classical.withColumn("start", F.lit("classical")).unionByName(_robust_start(rows, features, floors).withColumn("start", F.lit("quartiles")))
    groups = stage(_factored(starts, keys, p).withColumn("step", F.lit(0)), "mcd-start")
    order = Window.partitionBy(*keys).orderBy("bin")
    moments = [c for c in ("c", *(f"a_{i}" for i in range(p)), *(f"b_{i}_{j}" for i in range(p) for j in range(i + 1)))]
    columns = [c for c in groups.columns if c != "step"]
    for step in range(1, most_steps + 1):
        # Only what fell in the step before can fall again; a start is no estimate yet.
        falling = groups.filter(F.col("step") == step - 1).select(*columns)
        near = _distances(rows, falling.select(*keys, *[c for c in columns if c[:2] in ("m_", "l_")]), features, few)
        near = near.withColumn("bin", F.floor(F.log(F.col("d2") + 1e-9) * BINS))
        sums = stage(near.groupBy(*keys, "n", "bin").agg(*_sums(features)), "mcd-sums")
        running = sums.select(*keys, "n", "bin", *moments, *[F.sum(c).over(order).alias(f"to_{c}") for c in moments])
        wanted = F.ceil(F.lit(alpha) * F.col("n"))
        edge = running.filter((F.col("to_c") >= wanted) & (F.col("to_c") - F.col("c") < wanted))
        part = (wanted - (F.col("to_c") - F.col("c"))) / F.col("c")
        upto = edge.select(*keys, *[((F.col(f"to_{c}") - F.col(c)).cast("double") + F.col(c).cast("double") * part).alias(c) for c in moments])
        # Written before it is compared, so that the factor's expressions are not copied into a join.
        found = stage(_factored(_moments(upto, keys, p, factor, floors), keys, p).withColumn("step", F.lit(step)), "mcd-step")
        better = found
        if step > 1:
            old = groups.select(*keys, F.col("logdet").alias("had"))
            better = found.join(old, keys).filter(F.col("logdet") < F.col("had") - 1e-9).select(*found.columns)
        after = stage(groups.join(better.select(*keys), keys, "left_anti").unionByName(better), "mcd-groups")
        unstage(sums, found, groups)
        groups = after
        if groups.filter(F.col("step") == step).isEmpty():
            break
    best = Window.partitionBy("grp").orderBy("logdet", "start")
    won = groups.withColumn("r", F.row_number().over(best)).filter("r = 1")
    sizes = rows.groupBy("grp").agg(F.first("n").alias("n"))
    return stage(won.join(sizes, "grp").select("grp", "n", *[c for c in columns if c[:2] in ("m_", "s_")]), "mcd")


def shrunken(estimates: DataFrame, p: int, strength: float) -> DataFrame:
    """Estimates ``grp, m_i, l_i_j`` drawn towards the one of ``ALL``, which counts for ``strength`` rows.

    That is the mean and covariance of both taken as one, so what sets a group apart widens
    its covariance; a group of many rows keeps its own estimate.
    """
    moments = [c for c in estimates.columns if c[:2] in ("m_", "s_")]
    whole = estimates.filter(F.col("grp") == ALL).select(*[F.col(c).alias(f"all_{c}") for c in moments])
    own = F.col("n") / (F.col("n") + F.lit(strength))
    gap = lambda i: F.col(f"m_{i}") - F.col(f"all_m_{i}")
    mixed = {c: own * F.col(c) + (1 - own) * F.col(f"all_{c}") for c in moments}
    for c in moments:
        if c[:2] == "s_":
            _, i, j = c.split("_")
            mixed[c] = mixed[c] + own * (1 - own) * gap(i) * gap(j)
    # One row on the right.
    joined = estimates.filter(F.col("grp") != ALL).join(F.broadcast(whole), F.lit(True))
    return _factored(joined.select("grp", *[v.alias(c) for c, v in mixed.items()]), ["grp"], p)


#: The five statistics in thousandths, and the standard deviations added to each.
FEATURES = ["x_length", "x_word", "x_symbols", "x_lines", "x_repeats"]
FLOORS = [200.0, 500.0, 250.0, 75.0, 65.0]


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source``, the counts, ``base_failed`` and the transformed ``FEATURES``."""
    rows = docs.select(
        F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"),
        F.struct(words_of().alias("w")).alias("words"), word_chars().alias("word_chars"), n_symbols().alias("n_symbols"), n_dup_lines().alias("n_dup_lines"),
    )
    rows = rows.select("doc_id", "lang", "source", F.size("words.w").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", n_repeat_words(F.col("words.w")).alias("n_repeat_words"))
    rows = stage(rows, "rule-counts")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    n = F.greatest(F.col("n_words"), F.lit(1))
    fixed = lambda c: F.round(c * SCALE).cast("long")
    return rows.withColumn("base_failed", failed).withColumns(
        {
            "x_length": fixed(F.log1p("n_words")),
            "x_word": fixed(F.col("word_chars") / n),
            "x_symbols": fixed(F.log1p(100 * F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)))),
            "x_lines": fixed(F.log1p("n_dup_lines") / 4),
            "x_repeats": fixed(F.col("n_repeat_words") / n),
        }
    )


def quality_rules(docs: DataFrame, tail: float = 1e-7, alpha: float = 0.75, strength: float = 100.0) -> DataFrame:
    """Verdict of every document, with its counts and its squared distance ``d2``.

    Rejected (``kept`` false) is what fails the base rules, and what lies beyond
    the chi-square quantile that leaves ``tail`` of normal rows. Estimates use
    all documents that pass the base rules; a group is a language and source, null a
    value like any other, and the estimate of all groups together counts in it for
    ``strength`` documents. Documents of a group of which none passes have null ``d2``.
    Null texts have no words and fail the base rules, as do all texts of fewer than 50
    words; texts of any length are read whole. Repeated rows count and are judged one by
    one. An empty table gives no rows. Columns besides ``doc_id``, ``text``, ``lang`` and
    ``source`` play no part.
    """
    rows = statistics(docs)
    # A group's name cannot be that of all: it is a JSON object.
    rows = rows.withColumn("grp", F.to_json(F.struct(F.col("lang").alias("l"), F.col("source").alias("s"))))
    passed = rows.filter("not base_failed").select(F.explode(F.array("grp", F.lit(ALL))).alias("grp"), *FEATURES)
    sizes = stage(passed.groupBy("grp").agg(F.count(F.lit(1)).alias("n")), "mcd-sizes")
    few = sizes.count() <= MOST_BROADCAST
    described = stage(_join_groups(passed, sizes, few).select("grp", "n", *FEATURES), "mcd-rows")
    p = len(FEATURES)
    estimates = stage(shrunken(fit_mcd(described, FEATURES, FLOORS, alpha, few), p, strength), "mcd-shrunken")
    unstage(described, sizes)
    limit = chi2_quantile(1 - tail, p)
    kept = ~F.col("base_failed") & (F.col("d2").isNull() | (F.col("d2") <= F.lit(limit)))
    missing = rows.join(F.broadcast(estimates.select("grp")) if few else estimates.select("grp"), "grp", "left_anti").withColumn("d2", F.lit(None).cast("double"))
    scored = _distances(rows, estimates, FEATURES, few).select(*rows.columns, "d2").unionByName(missing)
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "d2")


def oracle(tail: float = 1e-7, alpha: float = 0.75, strength: float = 100.0, steps: int = 24) -> str:
    """The verdicts of ``quality_rules`` in DuckDB SQL over ``documents``, written independently of it.

    Concentration is written out for ``steps`` steps: an error where a determinant falls in the last.
    """
    p, gap = range(5), r"[\x20\x09-\x0D]"
    pairs = [(i, j) for i in p for j in range(i + 1)]
    names = [f"m{i}" for i in p] + [f"s{i}{j}" for i, j in pairs]
    floor = lambda i, j: f" + {FLOORS[i] ** 2}::DOUBLE" if i == j else ""
    # Aliases may be used further on in the same list.
    factor = ", ".join(
        (f"sqrt(s{i}{j}{''.join(f' - l{i}{k} * l{i}{k}' for k in range(j))})" if i == j else f"(s{i}{j}{''.join(f' - l{i}{k} * l{j}{k}' for k in range(j))}) / l{j}{j}") + f" AS l{i}{j}" for j in p for i in range(j, 5)
    ) + ", " + " + ".join(f"ln(l{i}{i})" for i in p) + " AS logdet"
    distance = ", ".join(f"(x{i} - m{i}{''.join(f' - l{i}{k} * y{k}' for k in range(i))}) / l{i}{i} AS y{i}" for i in p) + ", " + " + ".join(f"y{i} * y{i}" for i in p) + " AS d2"

    def moments(sum_, sum2, count, scale):
        """Means and covariances from sums."""
        out = [f"({sum_(i)})::DOUBLE / ({count}) AS m{i}" for i in p]
        for i, j in pairs:
            s = f"((({sum2(i, j)})::DOUBLE / ({count}) - m{i} * m{j}) * {scale!r}::DOUBLE)"
            out.append((f"greatest({s}, 0)" if i == j else s) + floor(i, j) + f" AS s{i}{j}")
        return ", ".join(out)

    part = lambda c: f"(t_{c} - {c})::DOUBLE + {c}::DOUBLE * part"
    sums = ["c", *(f"a{i}" for i in p), *(f"b{i}{j}" for i, j in pairs)]
    sql = f"""
    WITH d AS MATERIALIZED (
        SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
    ), win AS (
        SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)
    ), rep AS (
        SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS q FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1) GROUP BY r
    ), lines AS (
        SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d
    ), f AS MATERIALIZED (
        SELECT r, doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '{gap}', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
               (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
               'group ' || coalesce('=' || lang, '-') || chr(10) || coalesce('=' || source, '-') AS grp,
               round(1000 * ln(1 + n_words))::BIGINT AS x0, round(1000 * (word_chars::DOUBLE / greatest(n_words, 1)))::BIGINT AS x1,
               round(1000 * ln(1 + 100 * n_symbols::DOUBLE / greatest(word_chars, 1)))::BIGINT AS x2, round(1000 * (ln(1 + n_dup_lines) / 4))::BIGINT AS x3, round(1000 * (n_repeat_words::DOUBLE / greatest(n_words, 1)))::BIGINT AS x4
        FROM d JOIN lines USING (r) LEFT JOIN rep USING (r)
    ), e AS MATERIALIZED (
        SELECT *, count(*) OVER (PARTITION BY grp) AS n FROM (SELECT unnest([grp, 'all']) AS grp, {', '.join(f'x{i}' for i in p)} FROM f WHERE NOT base_failed)
    ), ranks AS (
        SELECT *, {', '.join(f'row_number() OVER (PARTITION BY grp ORDER BY x{i}) AS k{i}' for i in p)} FROM e
    ), marks AS (
        SELECT grp, {', '.join(f'max(x{i}) FILTER (k{i} = ceil({q} * n)) AS q{n}{i}' for i in p for n, q in ((1, 0.25), (2, 0.5), (3, 0.75)))} FROM ranks GROUP BY grp
    ), start AS (
        SELECT grp, 'classical' AS start, {moments(lambda i: f'sum(x{i})', lambda i, j: f'sum(x{i} * x{j})', 'count(*)', 1.0)} FROM e GROUP BY grp
        UNION ALL SELECT grp, 'quartiles', {', '.join(f'q2{i}::DOUBLE' for i in p)}, {', '.join(f'pow((q3{i} - q1{i}) / 1.349::DOUBLE, 2){floor(i, i)}' if i == j else '0' for i, j in pairs)} FROM marks
    ), g0 AS MATERIALIZED (SELECT grp, start, {', '.join(names)}, {factor} FROM start)"""
    for k in range(steps):
        old = "false" if k == 0 else "g.logdet >= o.logdet - 1e-9::DOUBLE"
        sql += f""", n{k} AS (
        SELECT grp, start, any_value(n) AS n, bin, count(*) AS c, {', '.join(f'sum(x{i}) AS a{i}' for i in p)}, {', '.join(f'sum(x{i} * x{j}) AS b{i}{j}' for i, j in pairs)}
        FROM (SELECT e.*, start, {distance}, floor(ln(d2 + 1e-9::DOUBLE) * {BINS}) AS bin FROM e JOIN g{k} USING (grp)) GROUP BY grp, start, bin
    ), u{k} AS (
        SELECT *, {', '.join(f'sum({c}) OVER (PARTITION BY grp, start ORDER BY bin) AS t_{c}' for c in sums)} FROM n{k}
    ), v{k} AS (
        SELECT grp, start, {moments(lambda i: part(f'a{i}'), lambda i, j: part(f'b{i}{j}'), part('c'), consistency(alpha, 5))}
        FROM (SELECT *, (ceil({alpha}::DOUBLE * n) - (t_c - c)) / c::DOUBLE AS part FROM u{k} WHERE t_c >= ceil({alpha}::DOUBLE * n) AND t_c - c < ceil({alpha}::DOUBLE * n))
    ), h{k} AS MATERIALIZED (SELECT grp, start, {', '.join(names)}, {factor} FROM v{k}
    ), g{k + 1} AS MATERIALIZED (
        SELECT grp, start, {', '.join(f'CASE WHEN {old} THEN o.{c} ELSE g.{c} END AS {c}' for c in [*names, *(f'l{i}{j}' for i, j in pairs), 'logdet'])} FROM h{k} AS g JOIN g{k} AS o USING (grp, start)
    )"""
    mixed = lambda c: f"own * b.{c} + (1 - own) * a.{c}"
    return sql + f""", settled AS (
        SELECT CASE WHEN count(*) FILTER (g.logdet < o.logdet - 1e-9::DOUBLE) > 0 THEN error('more steps are needed') END AS x FROM g{steps} AS g JOIN g{steps - 1} AS o USING (grp, start)
    ), best AS (
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY logdet, start) AS k FROM g{steps}) WHERE k = 1
    ), fit AS MATERIALIZED (
        SELECT b.grp, n / (n + {strength}::DOUBLE) AS own, {', '.join(f'{mixed(f"m{i}")} AS m{i}' for i in p)},
               {', '.join(f'{mixed(f"s{i}{j}")} + own * (1 - own) * (b.m{i} - a.m{i}) * (b.m{j} - a.m{j}) AS s{i}{j}' for i, j in pairs)}
        FROM best AS b JOIN (SELECT grp, any_value(n) AS n FROM e GROUP BY grp) USING (grp), best AS a WHERE a.grp = 'all' AND b.grp <> 'all'
    ), last AS MATERIALIZED (SELECT grp, {', '.join(f'm{i}' for i in p)}, {factor} FROM fit), dist AS (SELECT r, {distance} FROM f JOIN last USING (grp))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(d2 <= {chi2_quantile(1 - tail, 5)!r}::DOUBLE, true) AS kept
    FROM f LEFT JOIN dist USING (r), settled
    """
