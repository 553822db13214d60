"""Learned positions of sorted keys as DataFrame analytics: two-stage linear models, their errors, merging of changes.

Keys are distinct numbers; a key's position is how many are less. Stage one is one line through (key, position); it
routes every key to one of `models` lines of stage two, each fitted to its own keys. A model's window is how far its
prediction lies behind (`back`) or ahead (`fwd`) of the truth at worst, so a key is always found within its window.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.files import ranked


@dataclass(frozen=True)
class DynamicConfig:
    # The defaults of the writable layout.
    models: int = 1024
    search_threshold: int = 64
    delta_order: int = 32
    merge_ratio: float = 0.05
    score_threshold: float = float("inf")
    score_check_interval: int = 64
    rebuild_factor: float = 4.0


def positions(keys: DataFrame, key: str = "key") -> DataFrame:
    """(key, pos) of distinct keys."""
    return ranked(keys.select(F.col(key).alias("key")).distinct(), "key", "pos")


def line(x: Column, y: Column) -> tuple[Column, Column]:
    """(slope, intercept) of the least-squares line as aggregates. No spread in x: slope 0 and the mean; no rows: 0, 0."""
    flat = F.coalesce(F.var_pop(x), F.lit(0.0)) == 0
    slope = F.when(flat, 0.0).otherwise(F.coalesce(F.regr_slope(y, x), F.lit(0.0)))
    return slope, F.when(flat, F.coalesce(F.avg(y), F.lit(0.0))).otherwise(F.coalesce(F.regr_intercept(y, x), F.lit(0.0)))


@dataclass
class Rmi:
    """keys: (key, pos, model, pred, err); models: (model, n, slope, intercept, back, fwd)."""

    keys: DataFrame
    models: DataFrame
    stage1: tuple[float, float]
    size: int
    count: int

    def route(self, key: Column) -> Column:
        p = (F.lit(self.stage1[0]) * key.cast("double") + F.lit(self.stage1[1])) * F.lit(self.count / max(self.size, 1))
        return F.when(p <= 0, 0).when(p >= self.count, self.count - 1).otherwise(F.floor(p)).cast("int")

    PAGE = 1024  # positions that are read together

    def find(self, wanted: DataFrame, key: str = "key") -> DataFrame:
        """(key, pos) of the wanted keys that are there: each is looked for in the pages that its model's window touches,
        and nowhere else."""
        w = wanted.select(F.col(key).alias("key")).withColumn("model", self.route(F.col("key"))).join(self.models, "model")
        guess = clamped(F.col("slope") * F.col("key").cast("double") + F.col("intercept"), self.size)
        first, last = F.greatest(guess - F.col("back"), F.lit(0)), F.least(guess + F.col("fwd"), F.lit(max(self.size - 1, 0)))
        w = w.select("key", first.alias("first"), last.alias("last"))
        w = w.withColumn("page", F.explode(F.sequence((F.col("first") / self.PAGE).cast("long"), (F.col("last") / self.PAGE).cast("long"))))
        pages = self.keys.select((F.col("pos") / self.PAGE).cast("long").alias("page"), "key", "pos")
        return w.join(pages, ["page", "key"]).filter(F.col("pos").between(F.col("first"), F.col("last"))).select("key", "pos").distinct()

    def stats(self) -> DataFrame:
        """One row: size, models, max_error, mean_error, max_window, empty_models."""
        errors = self.keys.agg(F.coalesce(F.max(F.abs("err")), F.lit(0)).alias("max_error"), F.coalesce(F.avg(F.abs("err")), F.lit(0.0)).alias("mean_error"))
        windows = self.models.agg(F.coalesce(F.max(F.col("back") + F.col("fwd") + 1), F.lit(0)).alias("max_window"), (F.lit(self.count) - F.count("*")).alias("empty_models"))
        return errors.crossJoin(windows).select(F.lit(self.size).alias("size"), F.lit(self.count).alias("models"), "*")  # one row each

    def validate(self) -> DataFrame:
        """Keys that lie outside their window: none, if all is well."""
        return self.keys.join(self.models, "model").filter((F.col("err") > F.col("back")) | (-F.col("err") > F.col("fwd")))


def clamped(p: Column, size: int) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(max(size - 1, 0)), F.floor(p))).cast("long")


def fit(keys: DataFrame, models: int = 1024, key: str = "key") -> Rmi:
    pos = positions(keys, key)
    n, slope, intercept = pos.agg(F.count("*"), *line(F.col("key").cast("double"), F.col("pos").cast("double"))).first()
    rmi = Rmi(pos, pos, (slope, intercept), n, models)
    routed = pos.withColumn("model", rmi.route(F.col("key")))
    s, i = line(F.col("key").cast("double"), F.col("pos").cast("double"))
    lines = routed.groupBy("model").agg(F.count("*").alias("n"), s.alias("slope"), i.alias("intercept"))
    found = routed.join(lines.drop("n"), "model").withColumn("pred", clamped(F.col("slope") * F.col("key").cast("double") + F.col("intercept"), n))
    found = found.withColumn("err", F.col("pred") - F.col("pos")).drop("slope", "intercept")
    windows = found.groupBy("model").agg(F.max(F.greatest("err", F.lit(0))).alias("back"), F.max(F.greatest(-F.col("err"), F.lit(0))).alias("fwd"))
    return Rmi(found, lines.join(windows, "model"), (slope, intercept), n, models)


def moments(rmi: Rmi) -> DataFrame:
    """(model, n, sx, sp, sxx, sxp) of every model: what a line is fitted from, and what a change adds to."""
    x, p = F.col("key").cast("double"), F.col("pos").cast("double")
    return rmi.keys.groupBy("model").agg(F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(p).alias("sp"), F.sum(x * x).alias("sxx"), F.sum(x * p).alias("sxp"))


def merge(rmi: Rmi, added: DataFrame, removed: DataFrame | None = None) -> tuple[Rmi, DataFrame]:
    """(new index, report). Stage one stays, so keys keep their models. The report has, of each model, `disturbed`
    (its own keys changed; its line is fitted anew) and `shift` (how far its positions moved as a whole)."""
    gone = removed.select(F.col(removed.columns[0]).alias("key")) if removed is not None else added.limit(0).select(F.col(added.columns[0]).alias("key"))
    new = added.select(F.col(added.columns[0]).alias("key")).join(rmi.keys.select("key"), "key", "left_anti").distinct()
    kept = rmi.keys.select("key").join(gone, "key", "left_anti").unionByName(new)
    pos = positions(kept)
    size = pos.count()
    same = Rmi(pos, pos, rmi.stage1, rmi.size, rmi.count)  # routing keeps the old scale
    routed = pos.withColumn("model", same.route(F.col("key")))
    touched = new.unionByName(gone.join(rmi.keys.select("key"), "key", "left_semi")).withColumn("model", same.route(F.col("key"))).select("model").distinct().withColumn("disturbed", F.lit(True))
    firsts = rmi.keys.groupBy("model").agg(F.min("pos").alias("old")).join(routed.groupBy("model").agg(F.min("pos").alias("new")), "model")
    report = routed.select("model").distinct().join(touched, "model", "left").join(firsts, "model", "left")
    report = report.select("model", F.coalesce("disturbed", F.lit(False)).alias("disturbed"), F.coalesce(F.col("new") - F.col("old"), F.lit(0)).alias("shift"))
    s, i = line(F.col("key").cast("double"), F.col("pos").cast("double"))
    refit = routed.join(report.filter("disturbed").select("model"), "model", "left_semi").groupBy("model").agg(s.alias("slope"), i.alias("intercept"))
    moved = rmi.models.join(report.filter("not disturbed"), "model").select("model", "slope", (F.col("intercept") + F.col("shift")).alias("intercept"))
    lines = refit.unionByName(moved)
    found = routed.join(lines, "model").withColumn("pred", clamped(F.col("slope") * F.col("key").cast("double") + F.col("intercept"), size)).withColumn("err", F.col("pred") - F.col("pos"))
    windows = found.groupBy("model").agg(F.count("*").alias("n"), F.max(F.greatest("err", F.lit(0))).alias("back"), F.max(F.greatest(-F.col("err"), F.lit(0))).alias("fwd"))
    out = Rmi(found.drop("slope", "intercept"), lines.join(windows, "model"), rmi.stage1, rmi.size, rmi.count)
    return out, report


def model_scores(rmi: Rmi) -> DataFrame:
    """(key, model, score): Cook's distance of every key in its model's line; 0 where the line has no spread."""
    x, p = F.col("key").cast("double"), F.col("pos").cast("double")
    m = rmi.keys.groupBy("model").agg(F.count("*").alias("n"), F.avg(x).alias("mx"), (F.var_pop(x) * F.count("*")).alias("sxx"))
    j = rmi.keys.join(m, "model").join(rmi.models.select("model", "slope", "intercept"), "model")
    j = j.withColumn("res", p - (F.col("slope") * x + F.col("intercept")))
    j = j.join(j.groupBy("model").agg(F.sum(F.col("res") * F.col("res")).alias("sse")), "model")
    h = 1 / F.col("n") + F.try_divide((x - F.col("mx")) * (x - F.col("mx")), F.col("sxx"))
    mse = F.try_divide(F.col("sse"), F.col("n") - 2)
    return j.select("key", "model", F.coalesce(F.try_divide(F.col("res") * F.col("res") * h, 2 * mse * (1 - h) * (1 - h)), F.lit(0.0)).alias("score"))


def merge_on_read(base: DataFrame, delta: DataFrame, tombstones: DataFrame, key: str = "key") -> DataFrame:
    """(key, value): the delta wins over the base, tombstones take away what the base holds."""
    old = base.join(tombstones.select(key), key, "left_anti").select(key, F.col("value").alias("old"))
    return old.join(delta.select(key, F.col("value").alias("new"), F.lit(True).alias("is_new")), key, "full").select(key, F.when(F.col("is_new"), F.col("new")).otherwise(F.col("old")).alias("value"))


class DynamicIndex:
    """Base, delta and tombstones; a merge is due when the changes reach merge_ratio of the base."""

    def __init__(self, base: DataFrame, config: DynamicConfig = DynamicConfig(), key: str = "key"):
        spark = base.sparkSession
        self.config, self.key, self.base = config, key, base
        self.delta = spark.createDataFrame([], base.select(key, "value").schema)
        self.tombstones = spark.createDataFrame([], base.select(key).schema)
        self.merges = 0

    def live(self) -> DataFrame:
        return merge_on_read(self.base, self.delta, self.tombstones, self.key)

    def insert(self, rows: DataFrame) -> DataFrame:
        """Adds rows whose key isn't live; the keys that were refused."""
        live = self.live().select(self.key)
        refused = rows.join(live, self.key, "left_semi").select(self.key)
        self.delta = self.delta.unionByName(rows.join(live, self.key, "left_anti").dropDuplicates([self.key]))
        return refused

    def erase(self, keys: DataFrame) -> None:
        self.delta = self.delta.join(keys, self.key, "left_anti")
        self.tombstones = self.tombstones.unionByName(keys.select(self.key)).distinct()

    def pending(self) -> int:
        return self.delta.count() + self.tombstones.join(self.base, self.key, "left_semi").count()

    def merge_due(self) -> bool:
        return self.pending() >= self.config.merge_ratio * max(self.base.count(), 1)

    def merge(self) -> None:
        self.base = self.live().checkpoint()
        self.delta, self.tombstones, self.merges = self.delta.limit(0), self.tombstones.limit(0), self.merges + 1

    def find(self, key) -> DataFrame:
        return self.live().filter(F.col(self.key) == key)

    def range(self, low, high) -> DataFrame:
        return self.live().filter(F.col(self.key).between(low, high)).orderBy(self.key)


def position_error(pos: DataFrame) -> DataFrame:
    """One row: mean and greatest distance of the positions from their one line, and its linearity (squared correlation)."""
    x, p = F.col("key").cast("double"), F.col("pos").cast("double")
    s, i = line(x, p)
    one = pos.agg(s.alias("s"), i.alias("i"), F.coalesce(F.pow(F.corr(x, p), F.lit(2)), F.lit(1.0)).alias("linearity"))
    res = F.abs(p - (F.col("s") * x + F.col("i")))
    return pos.crossJoin(F.broadcast(one)).agg(F.avg(res).alias("mean_error"), F.max(res).alias("max_error"), F.first("linearity").alias("linearity"))  # one is one row


def normalise_keys(df: DataFrame, key: str = "key") -> DataFrame:
    """Keys on 0 to 1; all 0 if they are equal."""
    one = df.agg(F.min(key).cast("double").alias("lo"), F.max(key).cast("double").alias("hi"))
    return df.crossJoin(F.broadcast(one)).withColumn("x", F.coalesce(F.try_divide(F.col(key).cast("double") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0))).drop("lo", "hi")


def lower_bound(df: DataFrame, value, column: str = "key") -> DataFrame:
    return df.filter(F.col(column) < value).agg(F.count("*").alias("pos"))


def upper_bound(df: DataFrame, value, column: str = "key") -> DataFrame:
    return df.filter(F.col(column) <= value).agg(F.count("*").alias("pos"))


def threshold_for_selectivity(df: DataFrame, column: str, share: float) -> float:
    """The value below which a share of the rows lies, exact; the least value for none, one above the greatest for all."""
    import math

    if not 0 <= share <= 1:
        raise ValueError("a share lies between 0 and 1")
    n, lo, hi = df.agg(F.count(column), F.min(column), F.max(column)).first()
    k = round(share * n)
    if k <= 0:
        return float(lo)
    if k >= n:
        return math.nextafter(float(hi), math.inf)
    return float(ranked(df.select(column).filter(F.col(column).isNotNull()), column, "r").filter(F.col("r") == k).first()[column])


class ScalarColumn:
    """An order-preserving code of an attribute: the stable rank of its rows by (value, row)."""

    def __init__(self, df: DataFrame, value: str, row: str):
        self.frame = ranked(df.select(F.struct(value, row).alias("o")), "o", "rank").select(F.col(f"o.{row}").alias("row"), F.col(f"o.{value}").alias("value"), "rank")

    def encode(self, threshold) -> int:
        """Rows below the threshold: the code at which they end."""
        return self.frame.filter(F.col("value") < threshold).count()

    def encode_range(self, low, high) -> tuple[int, int]:
        """Codes [from, to) of low <= value <= high."""
        return self.encode(low), self.frame.filter(F.col("value") <= high).count()

    def rows_below(self, cut: int) -> DataFrame:
        return self.frame.filter(F.col("rank") < cut).select("row")

    def rows_equal(self, value) -> DataFrame:
        return self.frame.filter(F.col("value") == value).select("row")

    def key_cut_for_selectivity(self, share: float) -> int:
        return round(share * self.frame.count())

    def attach_to(self, planner, name: str) -> None:
        """Gives a planner the codes as an int64 attribute."""
        planner.set_column(name, self.frame.select("row", F.col("rank").cast("long")), "int64")
