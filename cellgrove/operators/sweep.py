"""Parameter grids, shortlists and leaderboards over result tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellgrove.operators.cells import SIZE, join_stats
from cellgrove.operators.evaluate import confusion_counts, pool_metrics
from cellgrove.operators.quantiles import group_stats

#: Parameter rows that are attached to a sample at a time.
CONFIGS_AT_ONCE = 1_000


def param_grid(spark: SparkSession, values: dict[str, list]) -> DataFrame:
    """All combinations, one exploded constant per parameter."""
    return extend_grid(spark.range(1), values).drop("id")


def extend_grid(base: DataFrame, values: dict[str, list]) -> DataFrame:
    """Each base row with all combinations of further parameters."""
    for name, options in values.items():
        base = base.withColumn(name, F.explode(F.array(*[F.lit(o) for o in options])))
    return base


def dedupe_configs(df: DataFrame, keys: list[str], order: str, digits: int = 5) -> DataFrame:
    """One row per configuration after rounding its numbers; the first wins."""
    numeric = {f.name for f in df.schema.fields if f.dataType.simpleString() in ("double", "float")}
    shown = [F.round(k, digits).alias(k) if k in numeric else F.col(k) for k in keys]
    rest = [c for c in df.columns if c not in keys]
    return (
        df.select(*shown, *rest)
        .groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), order).alias("_first"))
        .select(*keys, "_first.*")
    )


def attach_configs(samples: DataFrame, configs: DataFrame, name: str = "cfg") -> DataFrame:
    """Every sample with every configuration.

    Configurations are packed into rows of about ``CONFIGS_AT_ONCE``; samples
    meet each pack by its number, in an equi-join with one row a pack.
    """
    packs = -(-max(1, configs.count()) // CONFIGS_AT_ONCE)
    number = F.pmod(F.xxhash64(*configs.columns), F.lit(packs)).cast("int").alias("_pack")
    packed = configs.groupBy(number).agg(F.collect_list(F.struct(*configs.columns)).alias("_all"))
    met = samples.withColumn("_pack", F.explode(F.sequence(F.lit(0), F.lit(packs - 1)))).join(packed, "_pack")
    return met.withColumn(name, F.explode("_all")).drop("_pack", "_all")


def evaluate_grid(
    configs: DataFrame,
    samples: DataFrame,
    fn: Callable[[DataFrame], DataFrame],
    gt: str,
    region: str,
    rule: str = "guarded",
) -> DataFrame:
    """Pooled and mean metrics of every configuration over all samples.

    ``fn`` receives the samples with a ``cfg`` struct and adds a boolean ``pred``.
    Counts are combined map-side: what is shuffled is one row per configuration
    and image.
    """
    predicted = fn(attach_configs(samples, configs))
    counts = confusion_counts(predicted, ["cfg", "image_id"], "pred", gt, region)
    return pool_metrics(counts, ["cfg"], rule).select("cfg.*", "*").drop("cfg")


def cutoffs_by_density(samples: DataFrame, value: str, region: str, densities: list[float]) -> DataFrame:
    """Per image, a map from density to the value above which that share lies.

    A sweep over densities needs the percentiles once, not once per configuration.
    """
    v = F.when(F.col(region), F.col(value))
    spec = {f"q{i}": (v, 1.0 - d) for i, d in enumerate(densities)}
    found = group_stats(samples, ["image_id"], spec, size=SIZE)
    pairs = [x for i, d in enumerate(densities) for x in (F.lit(d), F.col(f"q{i}"))]
    return found.select("image_id", F.create_map(*pairs).alias("cutoffs"))


def density_counts(samples: DataFrame, value: str, gt: str, region: str, densities: list[float]) -> DataFrame:
    """density, image_id, tp, fp, fn, tn of the mask that each density gives, all densities at once.

    A cell is looked up once among its image's cut-off values and counted under
    the set of densities that take it in; there are about as many sets as densities, and
    sums over them give every table. Cells never meet the configurations one by one.
    """
    v = F.when(F.col(region), F.col(value))
    names = [f"_q{i}" for i in range(len(densities))]
    cuts = group_stats(samples, ["image_id"], {q: (v, 1.0 - d) for q, d in zip(names, densities)}, size=SIZE)
    inside = samples.filter(F.col(region) & F.col(value).isNotNull() & F.col(gt).isNotNull())
    taken = F.array(*[F.col(value) >= F.col(q) for q in names])
    sets = join_stats(inside, cuts).groupBy("image_id", taken.alias("taken")).agg(F.count_if(F.col(gt)).alias("hit"), F.count_if(~F.col(gt)).alias("off"))
    each = F.inline(F.arrays_zip(F.array(*[F.lit(d) for d in densities]).alias("density"), F.col("taken").alias("p")))
    of = lambda c, holds: F.sum(F.when(holds, F.col(c)).otherwise(0)).alias
    p = F.col("p")
    return sets.select("image_id", "hit", "off", each).groupBy("density", "image_id").agg(of("hit", p)("tp"), of("off", p)("fp"), of("hit", ~p)("fn"), of("off", ~p)("tn"))


def evaluate_densities(samples: DataFrame, value: str, gt: str, region: str, densities: list[float], rule: str = "guarded") -> DataFrame:
    """Pooled and mean metrics of every density over all samples; as ``evaluate_grid`` with a density threshold."""
    return pool_metrics(density_counts(samples, value, gt, region, densities), ["density"], rule)


def _top(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def shortlist(
    df: DataFrame, key: str, metrics: list[str], n: int, floor: tuple[str, float] | None = None
) -> DataFrame:
    """Keys among the n best by any metric, above a floor unless no row reaches it."""
    pool = df
    if floor:
        passing = df.agg(F.count_if(F.col(floor[0]) >= floor[1]).alias("n")).scalar()
        pool = df.filter((F.col(floor[0]) >= floor[1]) | (passing == 0))
    chosen = None
    for m in metrics:
        part = _top(pool, [F.col(m).desc(), F.col(key)], n).select(key)
        chosen = part if chosen is None else chosen.union(part)
    return chosen.distinct()


def merge_expensive(df: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    """Results with the expensive metrics of the shortlist; others get NULL and a flag."""
    flagged = extra.withColumn("evaluated", F.lit(True))
    return df.join(flagged, key, "left").withColumn("evaluated", F.coalesce("evaluated", F.lit(False)))


def leaderboards(df: DataFrame, key: str, metrics: list[str], n: int) -> DataFrame:
    """The n best rows by each metric, one board per metric."""
    long = df.unpivot([key], metrics, "metric", "score")
    order = Window.partitionBy("metric").orderBy(F.col("score").desc(), F.col(key))
    return long.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def tune_validate(results: DataFrame, config: str, split: str, score: str, k: int, digits: int = 4) -> DataFrame:
    """The k best configurations on train with their test score, best test first.

    Ties go to the later name, on train and on test.
    """
    means = results.groupBy(config).agg(
        *[F.avg(F.when(F.col(split) == s, F.col(score))).alias(s) for s in ("train", "test")]
    )
    best = _top(means.filter("train is not null"), [F.col("train").desc(), F.col(config).desc()], k)
    shown = best.select(config, *[F.round(s, digits).alias(s) for s in ("train", "test")])
    return shown.orderBy(F.col("test").desc(), F.col(config).desc())


def best_worst(df: DataFrame, key: str, metric: str, k: int) -> DataFrame:
    """The k best and the k worst rows with ``rank_group``; small tables may overlap."""
    best = _top(df, [F.col(metric).desc(), F.col(key)], k).withColumn("rank_group", F.lit("best"))
    worst = _top(df, [F.col(metric), F.col(key)], k).withColumn("rank_group", F.lit("worst"))
    return best.unionByName(worst)


def ablation_table(df: DataFrame, row: str, col: str, value: str, cols: list[str], base: tuple[str, str]) -> DataFrame:
    """Option x step table with the difference of each cell to the base cell."""
    wide = df.groupBy(row).agg(*[F.max(F.when(F.col(col) == c, F.col(value))).alias(c) for c in cols])
    start = df.agg(F.max(F.when((F.col(row) == base[0]) & (F.col(col) == base[1]), F.col(value))).alias("b")).scalar()
    return wide.withColumns({f"{c}_delta": F.col(c) - start for c in cols})
