"""Quality rules with robust multivariate outliers (operator 2), DataFrame functions only.

Base rules look at one text. Beyond them each language and source gets a location and a scatter
of its transformed statistics by a deterministic minimum-covariance-determinant search: start
with the share ``COVER`` of documents nearest to the medians in units of the MAD, then repeat
concentration steps (mean and covariance of the subset, distances of all, the nearest share
again), each of which can only lower the determinant. A document whose squared Mahalanobis
distance exceeds ``CUTOFF`` is rejected.

Every document gets a verdict, however small its group: an estimate starts from the moments of
its language over all sources, which start from those of all documents, with the weight of
``PRIOR`` documents each. In a large group that is nothing, a small one is judged by its language.

Quantiles come from mergeable sketches and moments from partial sums, so no group ever meets in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import SPACES

#: Share of a group that the estimate rests on, and its consistency factor for five dimensions:
#: 0.75 / P(chi-square with 7 degrees < 6.6257), where 6.6257 is the 0.75 quantile with 5.
COVER, CONSISTENCY = 0.75, 1.4113
#: Concentration steps.
STEPS = 3
#: Squared distance beyond which a document is an outlier: the 1 - 1e-6 quantile of the chi-square with five degrees.
CUTOFF = 35.89
#: Documents that the moments of the level above count for.
PRIOR = 40
#: Up to so many groups (a few hundred bytes each) are broadcast; beyond, the join shuffles.
BROADCAST_GROUPS = 20_000
#: The transformed statistics, and the least standard deviation that each is given: variation of this size is never odd.
FLOORS = {"z_length": 0.5, "z_word": 0.05, "z_symbols": 0.05, "z_lines": 0.1, "z_repeats": 0.2}
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def statistics(rows: DataFrame, text: str) -> DataFrame:
    """Adds the base statistics of a text column (null: none) and base_failed.

    Every statistic covers the whole text. Each array is projected before it is used, so it is
    computed once.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = rows.withColumn("_t", whole).withColumn("_b", F.btrim("_t", F.lit(SPACES)))
    rows = rows.withColumn("_w", F.when(F.col("_b") == "", F.array().cast("array<string>")).otherwise(F.split("_b", r"[\x20\x09-\x0D]+")))
    rows = rows.withColumn("n_words", F.size("_w").cast("long")).withColumn("word_chars", F.length(F.translate("_t", SPACES, "")).cast("long"))
    rows = rows.withColumn("n_symbols", (F.length("_t") - F.length(F.translate("_t", "#*$%&|<>", ""))).cast("long"))
    rows = rows.withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""))
    rows = rows.withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long")).drop("_t", "_b", "_l")
    # Windows of three words by hash; only texts in which a hash repeats are looked at further.
    last = F.col("n_words").cast("int") - 3
    windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)))
    rows = rows.withColumn("_h", F.when(last >= 0, windows)).drop("_w")
    rows = rows.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))).drop("_h")
    twin = lambda j: (F.get("_s", j - 1)["x"] == F.get("_s", j)["x"]) | (F.get("_s", j + 1)["x"] == F.get("_s", j)["x"])
    rows = rows.withColumn("_p", F.when(F.col("_s").isNotNull(), F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), F.size("_s") - 1), twin), lambda j: F.get("_s", j)["i"])))).drop("_s")
    steps = F.zip_with(F.slice("_p", F.lit(1), F.size("_p") - 1), F.slice("_p", F.lit(2), F.size("_p") - 1), lambda a, b: F.least(F.lit(3), b - a).cast("long"))
    rows = rows.withColumn("n_repeat_words", F.when(F.col("_p").isNotNull(), F.aggregate(steps, F.lit(3).cast("long"), lambda s, x: s + x)).otherwise(F.lit(0).cast("long"))).drop("_p")
    return rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _transformed(rows: DataFrame) -> DataFrame:
    """The statistic vector on scales where honest texts spread evenly."""
    n, c = F.greatest("n_words", F.lit(1)).cast("double"), F.greatest("word_chars", F.lit(1)).cast("double")
    of = {"z_length": F.log(n), "z_word": F.log(c / n), "z_symbols": F.sqrt(F.col("n_symbols") / c), "z_lines": F.sqrt(F.col("n_dup_lines") / n), "z_repeats": F.sqrt(F.col("n_repeat_words") / n)}
    return rows.withColumns(of)


def _with_groups(rows: DataFrame, groups: DataFrame, few: bool) -> DataFrame:
    return rows.join(F.broadcast(groups) if few else groups, ["g_lang", "g_source"])


def _sum(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def _sums(rows: DataFrame, near: Column) -> DataFrame:
    """Per group the number, the sums and the sums of products of the rows that are near."""
    names = list(FLOORS)
    x = [F.when(near, F.col(c)) for c in names]
    sums = [F.count(x[0]).cast("double").alias("n"), *(F.coalesce(F.sum(x[i]), F.lit(0.0)).alias(f"m{i}") for i in range(len(names)))]
    return rows.groupBy("g_lang", "g_source").agg(*sums, *(F.coalesce(F.sum(x[i] * x[j]), F.lit(0.0)).alias(f"s{i}{j}") for i in range(len(names)) for j in range(i + 1)))


def _moments() -> list[str]:
    p = len(FLOORS)
    return [*(f"m{i}" for i in range(p)), *(f"s{i}{j}" for i in range(p) for j in range(i + 1))]


def _shrunk(c: str, up: Column) -> Column:
    """A mean moment of a group from its sums, with that of the level above as ``PRIOR`` documents."""
    return ((F.col(c) + PRIOR * up) / (F.col("n") + PRIOR)).alias(c)


def _scatter(rows: DataFrame, near: Column) -> DataFrame:
    """Per group the mean and the Cholesky factor of the scatter of the rows that are near."""
    p = len(FLOORS)
    sums, names = common.stash(_sums(rows, near), "quality-sums"), _moments()
    total = sums.agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in names)).first()  # one row of 21 numbers
    by_lang = sums.groupBy("g_lang").agg(*(F.sum(c).alias(c) for c in ("n", *names)))
    by_lang = by_lang.select(F.col("g_lang").alias("up_lang"), *(_shrunk(c, F.lit(total[c] / total["n"] if total["n"] else None).cast("double")).alias(f"up_{c}") for c in names))
    est = sums.join(by_lang, sums["g_lang"] == by_lang["up_lang"]).select("g_lang", "g_source", *(_shrunk(c, F.col(f"up_{c}")) for c in names))
    for i in range(p):
        for j in range(i + 1):
            cov = (F.col(f"s{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}")) * CONSISTENCY
            cov = F.greatest(cov, F.lit(0.0)) + list(FLOORS.values())[i] ** 2 if i == j else cov
            left = cov - _sum([F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)]) if j else cov
            est = est.withColumn(f"l{i}{j}", F.sqrt(F.greatest(left, F.lit(1e-12))) if i == j else left / F.col(f"l{j}{j}"))
    return est.select("g_lang", "g_source", *(f"m{i}" for i in range(p)), *(f"l{i}{j}" for i in range(p) for j in range(i + 1)))


def _distance(rows: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance, by forward substitution."""
    names = list(FLOORS)
    for i, c in enumerate(names):
        d = F.col(c) - F.col(f"m{i}")
        rows = rows.withColumn(f"y{i}", (d - _sum([F.col(f"l{i}{k}") * F.col(f"y{k}") for k in range(i)]) if i else d) / F.col(f"l{i}{i}"))
    return rows.withColumn("d2", _sum([F.col(f"y{i}") ** 2 for i in range(len(names))]))


def estimate(rows: DataFrame) -> DataFrame:
    """Location and scatter of each group; ``rows`` has g_lang, g_source and the transformed statistics."""
    keys, names = ["g_lang", "g_source"], list(FLOORS)
    groups = rows.select(*keys).distinct().count()
    few = groups <= BROADCAST_GROUPS
    mid = rows.groupBy(*keys).agg(*(F.percentile_approx(c, 0.5).alias(f"med_{c}") for c in names))
    off = _with_groups(rows, mid, few)
    mad = off.groupBy(*keys).agg(*(F.first(f"med_{c}").alias(f"med_{c}") for c in names), *(F.percentile_approx(F.abs(F.col(c) - F.col(f"med_{c}")), 0.5).alias(f"mad_{c}") for c in names))
    z = _sum([((F.col(c) - F.col(f"med_{c}")) / F.greatest(1.4826 * F.col(f"mad_{c}"), F.lit(FLOORS[c]))) ** 2 for c in names])
    measured = _with_groups(rows, mad, few).select(*keys, *names, z.alias("d2"))
    for _ in range(STEPS):
        cut = measured.groupBy(*keys).agg(F.percentile_approx("d2", COVER).alias("cut"))
        est = common.stash(_scatter(_with_groups(measured, cut, few), F.col("d2") <= F.col("cut")), "quality-groups")
        measured = _distance(_with_groups(rows, est, few)).select(*keys, *names, "d2")
    cut = measured.groupBy(*keys).agg(F.percentile_approx("d2", COVER).alias("cut"))
    return common.stash(_scatter(_with_groups(measured, cut, few), F.col("d2") <= F.col("cut")), "quality-groups")


def _judged(docs: DataFrame, carry: list[str], id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """The rows with statistics and verdict; carried columns are called _c0, _c1, ..., the id is doc_id."""
    group = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))  # noqa: E731  a null is a group of its own
    rows = docs.select(*(F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)), F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), group(lang_col).alias("g_lang"), group(source_col).alias("g_source"))
    rows = common.stash(_transformed(statistics(rows, "_text")).drop("_text"), "quality-rows")
    est = estimate(rows.filter("not base_failed").select("g_lang", "g_source", *FLOORS))
    few = est.count() <= BROADCAST_GROUPS
    rows = _distance(rows.join(F.broadcast(est) if few else est, ["g_lang", "g_source"], "left"))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("d2") <= CUTOFF))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, the base statistics, base_failed, kept, and distance (squared).

    A null text has no words and fails the base rules. Null languages and sources form groups of
    their own. Every document that passes the base rules has a distance; of others those in a group without any such document have none.
    Ids are carried, never compared: null and repeated ids give their own rows. Other columns
    aren't read; an empty table gives an empty result.
    """
    return _judged(docs, [], id_col, text_col, lang_col, source_col).select("doc_id", *BASE, "base_failed", "kept", F.col("d2").alias("distance"))


def keep_clean(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with their own columns whatever their names.

    Null and empty texts fail the base rules and go; null languages and sources form groups of their own;
    repeated rows stay or go together; an empty table gives an empty result.
    """
    names = docs.columns
    numbered = docs.toDF(*(f"_d{i}" for i in range(len(names))))
    at = {c: f"_d{names.index(c)}" for c in (text_col, lang_col, source_col)}
    rows = _judged(numbered, numbered.columns, at[text_col], at[text_col], at[lang_col], at[source_col])
    return rows.filter("kept").select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(names)))
