"""Operators on ordered series: one exchange and one sort by (keys, order) serve all windows of a chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import null_if_nan


def along(keys: list[str], *order: str):
    return Window.partitionBy(*keys).orderBy(*order)


def whole(keys: list[str], *order: str):
    return along(keys, *order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def up_to(keys, *order):
    return along(keys, *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def next_known(col: str, window) -> Column:
    """The first value of `col` at or after the row: in linear time, where a frame to the end is read anew for each row."""
    return F.coalesce(F.col(col), F.expr(f"lead(`{col}`, 1) ignore nulls").over(window))


def listed(x: str | list[str]) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def velocity(df: DataFrame, keys: list[str], order: str, col: str, out: str, per: float = 1.0) -> DataFrame:
    """diff(col) / diff(order); null in the first row and where the order doesn't move."""
    w = along(keys, order)
    dt = (F.col(order) - F.lag(order).over(w)) / per
    return df.withColumn(out, (F.col(col) - F.lag(col).over(w)) / F.when(dt != 0, dt))


def mask_outliers(df: DataFrame, size: str, most: float, cols: list[str]) -> DataFrame:
    """Null for `cols` where `size` exceeds `most`."""
    ok = ~F.coalesce(null_if_nan(F.col(size)) > most, F.lit(False))
    return df.withColumns({c: F.when(ok, F.col(c)) for c in cols})


def numbered(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adds _row (from 1) and _rows, the series' length."""
    return df.withColumns({"_row": F.row_number().over(along(keys, order)), "_rows": F.count("*").over(whole(keys, order))})


def _interpolated(df: DataFrame, keys: list[str], order: str, cols: list[str], outs: list[str], both: bool) -> DataFrame:
    df = df.withColumns({f"_k_{c}": F.when(F.col(c).isNotNull(), F.struct(F.col("_row").alias("n"), F.col(c).alias("v"))) for c in cols})
    sides = {f"_a_{c}": F.last(f"_k_{c}", True).over(up_to(keys, order)) for c in cols} | {f"_b_{c}": next_known(f"_k_{c}", along(keys, order)) for c in cols}
    df = df.withColumns(sides)

    def value(c: str) -> Column:
        a, b = F.col(f"_a_{c}"), F.col(f"_b_{c}")
        inside = a["v"] + (b["v"] - a["v"]) * (F.col("_row") - a["n"]) / (b["n"] - a["n"])
        return F.coalesce(F.col(c), inside, F.coalesce(a["v"], b["v"]) if both else a["v"])

    return df.withColumns({o: value(c) for c, o in zip(cols, outs, strict=True)}).drop(*(f"_{x}_{c}" for c in cols for x in "kab"))


def interpolate(df: DataFrame, keys: list[str], order: str, col: str | list[str], out: str | list[str], both: bool = True) -> DataFrame:
    """Linear by row position; the end is filled with the last value, the start with the first if `both`."""
    return _interpolated(numbered(df, keys, order), keys, order, listed(col), listed(out), both).drop("_row", "_rows")


def _fitted(v: Column, at: Column, size: Column) -> Column:
    """The value at row `at` of a series shorter than the window, smoothed with `size` rows (odd)."""
    low = F.greatest(F.lit(1), F.least(at - F.floor(size / 2), F.size(v) - size + 1)).cast("int")
    part, mid = F.slice(v, low, size.cast("int")), (size + 1) / 2
    mean = F.aggregate(part, F.lit(0.0), lambda s, x: s + x) / size
    rise = F.aggregate(F.transform(part, lambda x, j: (j + 1 - mid) * x), F.lit(0.0), lambda s, x: s + x) / (size * (size * size - 1) / 12)
    return mean + rise * (at - low + 1 - mid)


def _smoothed(df: DataFrame, keys: list[str], order: str, cols: list[str], outs: list[str], window: int) -> DataFrame:
    if window < 3:
        return df.withColumns({o: F.coalesce(F.col(c), F.lit(0.0)) for c, o in zip(cols, outs, strict=True)})
    w, k = along(keys, order), window // 2
    df = df.withColumns({f"_v_{c}": F.coalesce(F.col(c), F.lit(0.0)) for c in cols})
    around = {f"_f_{c}": [(F.lead(f"_v_{c}", d).over(w), F.lag(f"_v_{c}", d).over(w)) for d in range(1, k + 1)] for c in cols}
    squares = 2.0 * sum(d * d for d in range(1, k + 1))
    fits = {f: F.struct((sum((b + a for b, a in ds), F.col(f.replace("_f_", "_v_", 1))) / window).alias("mean"), (sum((d * (b - a) for d, (b, a) in enumerate(ds, 1)), F.lit(0.0)) / squares).alias("slope")) for f, ds in around.items()}
    short = {f"_s_{c}": F.collect_list(F.when(F.col("_rows") < window, F.col(f"_v_{c}"))).over(whole(keys, order)) for c in cols}
    df = df.withColumns(fits | short)

    def value(c: str) -> Column:
        i, n, size = F.col("_row"), F.col("_rows"), F.col("_rows") - 1 + F.col("_rows") % 2
        out = F.when(n < 3, F.col(f"_v_{c}")).when(n < window, _fitted(F.col(f"_s_{c}"), i, size))
        for j in range(1, k + 1):  # the ends lie on the line of the first or last whole window, j rows from its middle
            first, last = F.lead(f"_f_{c}", j).over(w), F.lag(f"_f_{c}", j).over(w)
            out = out.when(i == k + 1 - j, first["mean"] - j * first["slope"]).when(i == n - k + j, last["mean"] + j * last["slope"])
        return out.otherwise(F.col(f"_f_{c}")["mean"])

    return df.withColumns({o: value(c) for c, o in zip(cols, outs, strict=True)}).drop(*(f"_{x}_{c}" for c in cols for x in "vfs"))


def smooth(df: DataFrame, keys: list[str], order: str, col: str | list[str], out: str | list[str], window: int = 7) -> DataFrame:
    """Savitzky-Golay of order 1: means inside, the end windows' fitted lines at the ends. A window longer than the series
    shrinks to the longest odd one; series too short for any stay as they are. Nulls count as 0."""
    return _smoothed(numbered(df, keys, order), keys, order, listed(col), listed(out), window).drop("_row", "_rows")


def kinematics(df: DataFrame, keys: list[str], order: str, axes: list[str], most_speed: float, most_acceleration: float, window: int = 7, per: float = 1.0) -> DataFrame:
    """Positions to smoothed speed and acceleration: interpolate, differentiate, mask, interpolate, smooth, twice over.
    Adds v<axis>, a<axis>, v and a; v and a are cut to the limits after smoothing, their components are not."""
    df = _interpolated(numbered(df, keys, order), keys, order, axes, axes, False)
    norm = lambda cols: F.sqrt(sum((F.col(c) * F.col(c) for c in cols[1:]), F.col(cols[0]) * F.col(cols[0])))
    for source, target, size, most in ((axes, [f"v{a}" for a in axes], "v", most_speed), ([f"v{a}" for a in axes], [f"a{a}" for a in axes], "a", most_acceleration)):
        for s, t in zip(source, target, strict=True):
            df = velocity(df, keys, order, s, t, per)
        df = mask_outliers(df.withColumn("_size", norm(target)), "_size", most, target).drop("_size")
        df = _smoothed(_interpolated(df, keys, order, target, target, True), keys, order, target, target, window)
        df = df.withColumn(size, F.least(norm(target), F.lit(most)))
    return df.drop("_row", "_rows")


def fill_forward(c: str | Column, keys, *order) -> Column:
    return F.last(c, True).over(up_to(keys, *order))


def fill_backward(c: str, keys, *order) -> Column:
    return next_known(c, along(keys, *order))


def fill_between(c: str, keys, *order) -> Column:
    """The value on both sides where they agree, else null."""
    before, after = fill_forward(c, keys, *order), fill_backward(c, keys, *order)
    return F.when(before == after, before)


def shifted(cols: list[str], k: int, keys, *order) -> Column:
    """The row k on (back if negative) as a struct; at the edges the row itself."""
    own = F.struct(*cols)
    return F.coalesce(F.lead(own, k).over(along(keys, *order)) if k > 0 else F.lag(own, -k).over(along(keys, *order)), own)


def sessions(df: DataFrame, keys: list[str], order: str, gap: float, out: str = "session") -> DataFrame:
    """Numbers from 0, a new one where the order moves by more than `gap`."""
    step = F.col(order) - F.lag(order).over(along(keys, order))
    return df.withColumn("_new", (step > gap).cast("long")).withColumn(out, F.sum(F.coalesce("_new", F.lit(0))).over(up_to(keys, order))).drop("_new")


def episodes(df: DataFrame, keys: list[str], order: str, gap: float, margin: float, within: DataFrame | None = None) -> DataFrame:
    """Spans of the sessions with a margin on both sides; numbers go on over the keys in their order. `within` holds all rows
    of the keys (phases, say): margins end at the first and last of them."""
    s = sessions(df, keys, order, gap).groupBy(*keys, "session").agg((F.min(order) - margin).alias("start"), (F.max(order) + margin).alias("stop"), F.count("*").alias("n_rows"))
    if within is not None:
        ends = within.groupBy(*keys).agg(F.min(order).alias("_low"), F.max(order).alias("_high"))
        s = s.join(ends, keys).withColumns({"start": F.greatest("start", "_low"), "stop": F.least("stop", "_high")}).drop("_low", "_high")
    sizes = s.groupBy(*keys).agg(F.count("*").alias("_k"))
    first = sizes.withColumn("_before", F.coalesce(F.sum("_k").over(Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each key
    return s.join(first.drop("_k"), keys).withColumn("episode", F.col("session") + F.col("_before")).drop("_before")


def phases(df: DataFrame, keys: list[str], order: str, change: Column, out: str = "phase") -> DataFrame:
    """Counts the change points up to and including each row."""
    return df.withColumn(out, F.sum(change.cast("long")).over(up_to(keys, order)))


def present(df: DataFrame, spans: DataFrame, keys: list[str], order: str, cols: list[str]) -> DataFrame:
    """Null for `cols` outside each key's span (t_in, t_out)."""
    inside = F.col(order).between(F.col("t_in"), F.col("t_out"))
    return df.join(spans, keys, "left").withColumns({c: F.when(inside, F.col(c)) for c in cols}).drop("t_in", "t_out")


def _pchip_slopes(df: DataFrame, keys, t: str, v: str) -> DataFrame:
    w = along(keys, t)
    h1, h0 = F.lead(t).over(w) - F.col(t), F.col(t) - F.lag(t).over(w)
    d1, d0 = (F.lead(v).over(w) - F.col(v)) / h1, (F.col(v) - F.lag(v).over(w)) / h0
    df = df.withColumns({"_h0": h0.cast("double"), "_h1": h1.cast("double"), "_d0": d0, "_d1": d1})
    df = df.withColumns({"_h2": F.lead("_h1").over(w), "_d2": F.lead("_d1").over(w), "_g0": F.lag("_h0").over(w), "_e0": F.lag("_d0").over(w)})

    def edge(h, hh, d, dd):
        s = ((2 * h + hh) * d - h * dd) / (h + hh)
        s = F.when(F.signum(s) != F.signum(d), 0.0).when((F.signum(d) != F.signum(dd)) & (F.abs(s) > F.abs(3 * d)), 3 * d).otherwise(s)
        return F.when(hh.isNull(), d).otherwise(s)

    c = F.col
    w1, w2 = 2 * c("_h1") + c("_h0"), c("_h1") + 2 * c("_h0")
    mid = F.when(c("_d0") * c("_d1") <= 0, 0.0).otherwise((w1 + w2) / (w1 / c("_d0") + w2 / c("_d1")))
    s = F.when(c("_h0").isNull() & c("_h1").isNull(), 0.0).when(c("_h0").isNull(), edge(c("_h1"), c("_h2"), c("_d1"), c("_d2"))).when(c("_h1").isNull(), edge(c("_h0"), c("_g0"), c("_d0"), c("_e0"))).otherwise(mid)
    return df.withColumn("_s", s).drop("_h0", "_h1", "_d0", "_d1", "_h2", "_d2", "_g0", "_e0")


def resample(df: DataFrame, keys: list[str], t: str, v: str | list[str], step: int, method: str = "linear", fill: list[str] | None = None, first_by: list[str] | None = None) -> DataFrame:
    """Each series on the grid 0, step, ... up to its largest t: the columns `v` interpolated between their samples (linear
    or pchip), `fill` carried forward. Rows of the grid before the first sample, or without any value, are dropped. Of samples
    at one time the first in the order of `first_by` counts, by default in that of the values, nulls last."""
    vs, fill = listed(v), fill or []
    order = [F.col(c).asc_nulls_last() for c in first_by or [*vs, *fill]]
    earlier = F.lag(t).over(Window.partitionBy(*keys).orderBy(t, *order))
    df = df.withColumn("_earlier", earlier).where(F.col("_earlier").isNull() | (F.col("_earlier") != F.col(t))).select(*keys, t, *vs, *fill)
    for c in vs:
        df = _pchip_slopes(df, keys, t, c).withColumnRenamed("_s", f"_s_{c}") if method == "pchip" else df.withColumn(f"_s_{c}", F.lit(0.0))
    one = F.struct(F.col(t).alias("t"), *(F.struct(F.col(c).alias("v"), F.col(f"_s_{c}").alias("s")).alias(c) for c in vs))
    df = df.withColumns({c: fill_forward(c, keys, t) for c in fill} | {"_a": one}).withColumn("_b", F.lead("_a").over(along(keys, t)))
    # each sample makes the grid's steps from its own time up to the next one's
    first = F.greatest(F.lit(0), F.ceil(F.col(t) / step)).cast("long") * step
    last = F.coalesce(F.col("_b.t") - 1, F.col(t)).cast("long")
    steps = F.when(first <= last, F.sequence(first, last, F.lit(step).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    rows = df.select(*keys, F.explode(steps).alias(t), "_a", "_b", *fill)
    a, b = F.col("_a"), F.col("_b")
    h = (b["t"] - a["t"]).cast("double")
    u = (F.col(t) - a["t"]) / h

    def value(c: str) -> Column:
        p, q, s, r = a[c]["v"], b[c]["v"], a[c]["s"], b[c]["s"]
        if method == "pchip":
            inside = p * (1 + 2 * u) * (1 - u) * (1 - u) + h * s * u * (1 - u) * (1 - u) + q * u * u * (3 - 2 * u) + h * r * u * u * (u - 1)
        else:
            inside = p + (q - p) * u
        return F.when(a["t"] == F.col(t), p).otherwise(inside)

    out = rows.select(*keys, t, *(value(c).alias(c) for c in vs), *fill)
    return out.where(F.coalesce(*vs).isNotNull())
