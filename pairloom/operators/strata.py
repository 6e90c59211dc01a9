"""Exact cuts in all strata of a table at once, by counting.

Every stratum gets a quota, and its rows have an order. The cut is the place where the rows
before it weigh as much as the quota allows. It is found by refinement: each pass counts,
for all open strata together, the weight by ranges of the order's key within the part that
holds the cut. Counts are combined before they move; no row is sorted, moved or written.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame, Window, functions as F

from pairloom.functions.text import ColumnOrName, col

# Ranges per stratum and pass, and the number of rows that are ordered at the end.
RANGES = 4096
READ_OUT = 10_000
# Scores beyond count as this one; a missing score or one that is no number as its negative.
FAR = 1e300

Stratum = tuple[Any, ...]


def by_key(stratum: Stratum) -> tuple:
    """Order of strata: missing parts first."""
    return tuple((v is not None, v) for v in stratum)


def apportion(sizes: Mapping[Stratum, int], n: int, weights: Mapping[Stratum, float] | None = None) -> dict[Stratum, int]:
    """Divide ``n`` over the strata by largest remainder, none above its size.

    Shares follow the sizes, or ``weights``; what a stratum is too small for goes to the
    others in the same way. Equal remainders go to the larger size first, then by key.
    """
    out = dict.fromkeys(sizes, 0)
    n = min(n, sum(sizes.values()))
    share = {s: (sizes[s] if weights is None else weights.get(s, 0)) for s in sizes}
    left = n
    while left > 0:
        open_ = [s for s in sizes if out[s] < sizes[s] and share[s] > 0]
        if not open_:  # only strata without weight have room
            open_ = [s for s in sizes if out[s] < sizes[s]]
            share = sizes
        total = sum(share[s] for s in open_)
        exact = {s: left * share[s] / total if weights else left * share[s] // total for s in open_}
        rest = {s: (exact[s] % 1 if weights else left * share[s] % total) for s in open_}
        give = {s: int(exact[s]) for s in open_}
        short = left - sum(give.values())
        for s in sorted(open_, key=lambda s: (-rest[s], -sizes[s], by_key(s)))[:short]:
            give[s] += 1
        for s in open_:
            out[s] += min(give[s], sizes[s] - out[s])
        left = n - sum(out.values())
    return out


@dataclass
class Cut:
    """Rows up to ``(k0, k1)``, inclusive, weigh ``taken``; the next ones, all with the key
    ``(next0, next1)``, weigh ``next_weight`` and would exceed the quota."""

    k0: float | int | None = None
    k1: int | None = None
    taken: int = 0
    next0: float | int | None = None
    next1: int | None = None
    next_weight: int = 0


def score_key(score: ColumnOrName) -> Column:
    """Ascending key of a descending score."""
    known = F.nanvl(F.coalesce(col(score).cast("double"), F.lit(-FAR)), F.lit(-FAR))
    return -F.greatest(F.least(known, F.lit(FAR)), F.lit(-FAR))


def _range_of(key: Column, lo: Column, hi: Column, whole: bool) -> Column:
    """Which of ``RANGES`` ranges from lo to hi holds the key. Rising with the key, and the
    two ends lie in different ranges."""
    if whole:
        wide = lambda c: c.cast("decimal(20,0)")
        step = F.floor((wide(hi) - wide(lo)) / F.lit(RANGES)) + 1
        return F.floor((wide(key) - wide(lo)) / step).cast("int")
    at = F.floor((key - lo) / (hi - lo) * RANGES)
    return F.least(at, F.lit(RANGES - 1)).cast("int")


def _same(by: Sequence[str], names: Sequence[str]) -> Column:
    return reduce(and_, [F.col(b).eqNullSafe(F.col(n)) for b, n in zip(by, names, strict=True)])


def with_strata(df: DataFrame, by: Sequence[str], rows: Sequence[tuple], schema: str) -> DataFrame:
    """Join rows of one stratum each, ``(*stratum, *values)``, to ``df``; a missing part of a
    stratum is a value like others. The rows are a broadcast: one per stratum."""
    names = [f"_s{i}" for i in range(len(by))]
    kinds = [f"{n} {df.schema[b].dataType.simpleString()}" for n, b in zip(names, by, strict=True)]
    small = df.sparkSession.createDataFrame(list(rows), ", ".join([*kinds, schema]))
    return df.join(F.broadcast(small), _same(by, names)).drop(*names)


def strata_sizes(df: DataFrame, by: Sequence[str], weight: ColumnOrName | None = None) -> dict[Stratum, int]:
    total = F.count(F.lit(1)) if weight is None else F.sum(col(weight))
    return {tuple(r)[:-1]: r["_w"] for r in df.groupBy(*by).agg(total.alias("_w")).collect()}


def cuts(
    df: DataFrame, by: Sequence[str], k0: Column, k1: Column | None, quotas: Mapping[Stratum, int], weight: ColumnOrName | None = None
) -> dict[Stratum, Cut]:
    """The cut of every stratum in the order of ``k0``, equal ones by the whole number ``k1``.

    Rows with equal keys are on the same side. Eager: a few passes over the columns in
    use, each of which gives a row per stratum to the driver. Give it a written table, or
    one that is cheap to read.
    """
    whole = dict(df.select(k0.alias("_k0")).dtypes)["_k0"] in ("bigint", "int")
    k0 = k0 if whole else k0.cast("double")
    w = F.lit(1).cast("bigint") if weight is None else col(weight).cast("bigint")
    rows = df.select(*by, k0.alias("_k0"), (F.lit(0) if k1 is None else k1).cast("bigint").alias("_k1"), w.alias("_w"))
    kind = "bigint" if whole else "double"
    bounds = [F.min("_k0").alias("lo0"), F.max("_k0").alias("hi0"), F.min("_k1").alias("lo1"), F.max("_k1").alias("hi1"), F.count(F.lit(1)).alias("n"), F.sum("_w").alias("w")]
    found = {s: Cut() for s in quotas}
    open_ = [r for r in rows.groupBy(*by).agg(*bounds).collect() if tuple(r)[: len(by)] in quotas]
    state = {}
    for r in open_:
        stratum = tuple(r)[: len(by)]
        if quotas[stratum] >= r["w"]:
            found[stratum] = Cut(r["hi0"], r["hi1"], r["w"])
        else:
            state[stratum] = r
    schema = f"lo0 {kind}, hi0 {kind}, lo1 bigint, hi1 bigint, need bigint"

    def inside(strata: Mapping[Stratum, Any]) -> DataFrame:
        local = [(*s, r["lo0"], r["hi0"], r["lo1"], r["hi1"], quotas[s] - found[s].taken) for s, r in strata.items()]
        held = with_strata(rows, by, local, schema)
        return held.filter(F.col("_k0").between(F.col("lo0"), F.col("hi0")) & F.col("_k1").between(F.col("lo1"), F.col("hi1")))

    def close(s: Stratum, r: Any) -> None:
        """All of the open part has one key, and it does not fit."""
        cut = found[s]
        cut.next0, cut.next1, cut.next_weight = r["lo0"], r["lo1"], r["w"]

    while state:
        one = {s: r for s, r in state.items() if r["lo0"] == r["hi0"] and r["lo1"] == r["hi1"]}
        for s, r in one.items():
            close(s, r)
        few = {s: r for s, r in state.items() if s not in one and r["n"] <= READ_OUT}
        many = {s: r for s, r in state.items() if s not in one and s not in few}
        if few:
            # The rest of a stratum is small: order its keys.
            keys = inside(few).groupBy(*by, "need", "_k0", "_k1").agg(F.sum("_w").alias("w"))
            order = Window.partitionBy(*by).orderBy("_k0", "_k1")
            run = keys.withColumn("_run", F.sum("w").over(order))
            last = F.struct("_run", "_k0", "_k1")
            split = run.groupBy(*by).agg(
                F.max(F.when(F.col("_run") <= F.col("need"), last)).alias("last"), F.min(F.when(F.col("_run") > F.col("need"), F.struct("_run", "_k0", "_k1", "w"))).alias("next")
            )
            for r in split.collect():
                cut = found[tuple(r)[: len(by)]]
                if r["last"] is not None:
                    cut.k0, cut.k1, cut.taken = r["last"]["_k0"], r["last"]["_k1"], cut.taken + r["last"]["_run"]
                cut.next0, cut.next1, cut.next_weight = r["next"]["_k0"], r["next"]["_k1"], r["next"]["w"]
        state = {}
        if many:
            lo0, hi0, lo1, hi1 = (F.col(c) for c in ("lo0", "hi0", "lo1", "hi1"))
            at = F.when(lo0 < hi0, _range_of(F.col("_k0"), lo0, hi0, whole)).otherwise(_range_of(F.col("_k1"), lo1, hi1, True))
            counts = inside(many).groupBy(*by, "need", at.alias("_at")).agg(*bounds)
            order = Window.partitionBy(*by).orderBy("_at")
            # At most RANGES rows per stratum.
            run = counts.withColumns({"_run": F.sum("w").over(order), "_hi0": F.lag("hi0").over(order), "_hi1": F.lag("hi1").over(order)})
            for r in run.filter((F.col("_run") > F.col("need")) & (F.col("_run") - F.col("w") <= F.col("need"))).collect():
                s = tuple(r)[: len(by)]
                if r["_run"] > r["w"]:
                    # Within one k0 the ranges rise with k1; else hi1 is not the last row's.
                    same = many[s]["lo0"] == many[s]["hi0"]
                    found[s].k0, found[s].k1 = r["_hi0"], r["_hi1"] if same else None
                    found[s].taken += r["_run"] - r["w"]
                state[s] = r
    return found


def up_to(k0: Column, k1: Column | None, cut0: Column, cut1: Column) -> Column:
    """Rows before or at the cut; no cut takes none, and a cut without ``k1`` all of its k0."""
    tie = cut1.isNull() if k1 is None else cut1.isNull() | (k1 <= cut1)
    return F.coalesce((k0 < cut0) | ((k0 == cut0) & tie), F.lit(False))


def quota_top_n(
    df: DataFrame,
    by: str | Sequence[str],
    n: int,
    score: str = "score",
    tie: str = "pair_id",
    weights: Mapping[Stratum, float] | None = None,
) -> DataFrame:
    """The best rows of every stratum, ``n`` in all, divided over the strata by their sizes
    (``apportion``), so the selection has the table's own mix.

    Order is descending score, then ascending ``tie``, a unique whole number; a null score
    and one that is no number come last, and a null in ``by`` is a stratum of its own. The
    rows are only compared with their stratum's cut: none is sorted or shuffled, and a
    stratum with a third of all rows is counted like the others. Strata are to be some
    thousands at most: the driver holds a row for each.
    """
    by = [by] if isinstance(by, str) else list(by)
    k0, k1 = score_key(score), F.col(tie)
    quotas = apportion(strata_sizes(df, by), n, weights)
    found = cuts(df, by, k0, k1, {s: q for s, q in quotas.items() if q > 0})
    cut = [(*s, c.k0, c.k1) for s, c in found.items() if c.k0 is not None]
    held = with_strata(df, by, cut, "_cut0 double, _cut1 bigint")
    return held.filter(up_to(k0, k1, F.col("_cut0"), F.col("_cut1"))).drop("_cut0", "_cut1")
