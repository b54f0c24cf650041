"""Cluster bootstrap: n draws with replacement from the n clusters of a group, exactly.

The draws of a replicate are never rows. Clusters of a group are dealt by their hash into
buckets, the leaves of a binary tree over hash prefixes. The n draws of a replicate are
split top-down: of the draws that reach a node, a binomial number goes left, with the
share of clusters on the left as its probability. Every task walks from the root to its
own bucket; the draws of a node come from a generator keyed by that node, so all tasks
agree and nothing is exchanged. In the bucket the remaining draws pick clusters by integer
mixing. That is the multinomial distribution, and weights of a replicate add up to n.

A bucket turns its weights into sums per (group, replicate, cell) at once, so what is
shuffled is one row of sums per bucket, replicate and cell. All sums are integers, so
intervals do not depend on partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textjudge import fixed
from textjudge.functions.columns import share
from textjudge.functions.keys import CLUSTER, expected_label
from textjudge.operators.index import hash_number
from textjudge.operators.lineage import materialize
from textjudge.operators.votes import VOTE_UNIT

CI_95 = (0.025, 0.975)

# fixed values of the 32-bit mixing steps (two odd increments, multiplier, mask)
INCREMENT, SECOND, MULTIPLIER, MASK = 2654435769, 2246822519, 73244475, 4294967295
#: clusters of a bucket, and weights that a task holds at once
BUCKET, HELD = 1 << 16, 1 << 21
#: bucket sizes that are sent to the tasks, 8 bytes each; larger inputs get larger buckets
SENT = 1 << 22
DIGITS = 15
#: values of one group that may be sorted in a row, and bins of a histogram
LISTED, BINS = 1024, 256


def mixed(x: np.ndarray) -> np.ndarray:
    """Pseudo-random 32-bit numbers of 32-bit numbers, by plain integer steps."""
    for _ in range(2):
        x = (x ^ (x >> np.uint32(16))) * np.uint32(MULTIPLIER)
    return x ^ (x >> np.uint32(16))


def stream(key: int, samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 32-bit numbers of each replicate, from a 60-bit key."""
    step = (samples + 1).astype(np.uint32)
    low, high = np.uint32(key & MASK), np.uint32(key >> 28)
    return mixed(low + step * np.uint32(INCREMENT)), mixed(high + step * np.uint32(SECOND))


def picks(key: int, samples: np.ndarray, draws: np.ndarray, clusters: int) -> np.ndarray:
    """Clusters (0..clusters-1) that the draws of each replicate pick, one after the other."""
    first, second = stream(key, samples)
    number = np.arange(draws.sum()) - np.repeat(np.cumsum(draws) - draws, draws)
    x = mixed(np.repeat(first, draws) + (number + 1).astype(np.uint32) * np.uint32(INCREMENT))
    x = mixed(x + np.repeat(second, draws))
    return (x.astype(np.uint64) * np.uint64(clusters) >> np.uint64(32)).astype(np.int64)


def draws_of(bucket: int, sizes: np.ndarray, key: int, samples: int) -> np.ndarray:
    """Draws of each replicate that reach a bucket: the walk from the root of the tree.

    ``sizes`` are the clusters of all buckets; their number is a power of two.
    """
    left, right = 0, len(sizes)
    draws = np.full(samples, sizes.sum(), np.int64)
    while right - left > 1:
        middle = (left + right) // 2
        a, both = int(sizes[left:middle].sum()), int(sizes[left:right].sum())
        went = np.random.Generator(np.random.Philox(key=np.array([key, left << 32 | right], np.uint64))).binomial(draws, a / both if both else 0.0)
        if bucket < middle:
            right, draws = middle, went
        else:
            left, draws = middle, draws - went
    return draws


def weights(key: int, draws: np.ndarray, clusters: int):
    """(first replicate, weights of some replicates x clusters) until all are drawn."""
    step = max(1, HELD // max(1, clusters, int(draws.max(initial=0))))
    for start in range(0, len(draws), step):
        some = draws[start : start + step]
        at = np.repeat(np.arange(len(some)), some) * clusters + picks(key, np.arange(start, start + len(some)), some, clusters)
        yield start, np.bincount(at, minlength=len(some) * clusters).reshape(len(some), clusters)


def product(w: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Exact integer products; by floating point where no sum can pass 53 bits."""
    if float(np.abs(values).max(initial=0)) * float(w.sum(1).max(initial=0)) < 1 << 53:
        return (w.astype(float) @ values.astype(float)).astype(np.int64)
    return w @ values


def cluster_sums(
    rows: DataFrame, group: Sequence[str], measures: Sequence[str], seed: int,
    cell: str | None = None, cluster: Sequence[str] = CLUSTER,
) -> DataFrame:
    """Sums of each cluster of a group, per cell, written once for all that follows.

    A frequent cluster is one row per cell from here on.
    """
    name = F.lit("").alias("cell") if cell is None else F.col(cell).alias("cell")
    summed = rows.groupBy(*group, *cluster, name).agg(*[F.sum(m).cast("long").alias(m) for m in measures])
    of_group = F.concat_ws("|", F.lit(str(seed)), *group)
    return materialize(summed.withColumns({"_group": of_group, "_key": hash_number(F.lit(str(seed)), *cluster)}))


def replicate_sums(
    rows: DataFrame, group: Sequence[str], measures: Sequence[str], samples: int, seed: int,
    cell: str | None = None, cluster: Sequence[str] = CLUSTER, bucket: int = BUCKET,
) -> DataFrame:
    """(group, rep, cell, sums) for every replicate; each group draws from its own clusters."""
    return drawn_sums(cluster_sums(rows, group, measures, seed, cell, cluster), group, measures, samples, cluster, bucket)


def drawn_sums(
    keyed: DataFrame, group: Sequence[str], measures: Sequence[str], samples: int,
    cluster: Sequence[str] = CLUSTER, bucket: int = BUCKET,
) -> DataFrame:
    """The replicates of ``cluster_sums``. A task holds the clusters of one bucket."""
    group, cluster, measures = list(group), list(cluster), list(measures)
    known = keyed.select("_group", "_key", *cluster).distinct()
    most = known.groupBy("_group").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.count(F.lit(1))).first()
    largest, groups = most[0] or 0, most[1]
    bits = min(max(0, math.ceil(math.log2(max(1, largest / bucket)))), int(math.log2(max(1, SENT // max(1, groups)))))
    place = F.shiftright("_key", 4 * DIGITS - bits).cast("int")
    sizes: dict[str, np.ndarray] = {}
    if bits:
        for g, b, n in known.groupBy("_group", place.alias("b")).count().collect():
            sizes.setdefault(g, np.zeros(1 << bits, np.int64))[b] = n
    shared = keyed.sparkSession.sparkContext.broadcast(sizes)

    def spread(table: pa.Table) -> pa.Table:
        frame = table.select(["_key", "_hash", "_root", *cluster, "cell", *measures]).to_pandas()
        frame[cluster] = frame[cluster].astype(object).where(frame[cluster].notna(), "")
        frame = frame.sort_values(["_key", *cluster], kind="stable")
        own, key = table.column("_group")[0].as_py(), int(frame["_hash"].iloc[0])
        offset = np.cumsum((frame[["_key", *cluster]] != frame[["_key", *cluster]].shift()).any(axis=1).to_numpy()) - 1
        n, at = int(offset[-1]) + 1, int(table.column("_bucket")[0].as_py())
        root = int(frame["_root"].iloc[0]) if bits else 0
        draws = draws_of(at, shared.value[own], root, samples) if bits else np.full(samples, n, np.int64)
        cells, names = frame["cell"].factorize(use_na_sentinel=False)
        values = frame[measures].to_numpy(np.int64)
        out = []
        for first, w in weights(key, draws, n):
            for c in range(len(names)):
                held = cells == c
                out.append((np.arange(first, first + len(w)), c, product(w[:, offset[held]], values[held])))
        sums = np.concatenate([x for _, _, x in out])
        rep = np.concatenate([r for r, _, _ in out])
        which = np.repeat([c for _, c, _ in out], [len(r) for r, _, _ in out])
        same = pa.array(np.zeros(len(rep), np.int64))
        columns = {g: table.column(g).take(same) for g in group}
        columns |= {"rep": pa.array(rep.astype(np.int32)), "cell": pa.array(names.astype(object)).cast(pa.string()).take(pa.array(which))}
        return pa.table(columns | {m: pa.array(np.ascontiguousarray(sums[:, k])) for k, m in enumerate(measures)})

    kinds = dict(keyed.dtypes)
    schema = ", ".join([*[f"`{g}` {kinds[g]}" for g in group], "rep int", "cell string", *[f"`{m}` long" for m in measures]])
    text = [F.col("_group"), F.col("_bucket")]
    dealt = keyed.withColumn("_bucket", place).withColumn("_hash", hash_number(*text)).withColumn("_root", hash_number("_group"))
    partial = dealt.groupBy("_group", "_bucket").applyInArrow(spread, schema)
    return materialize(partial.groupBy(*group, "rep", "cell").agg(*[F.sum(m).alias(m) for m in measures]))


def cluster_counts(rows: DataFrame, group: Sequence[str], cluster: Sequence[str] = CLUSTER) -> DataFrame:
    """(group, source_item_clusters)."""
    distinct = rows.select(*group, *cluster).distinct()
    return distinct.groupBy(*group).agg(F.count(F.lit(1)).alias("source_item_clusters"))


def between(a: Column, b: Column, part: Column) -> Column:
    return a + (b - a) * part


def quantile(sorted_values: Column, q: float) -> Column:
    """Linear interpolation between the neighbours of position ``q * (size - 1)``."""
    at = (F.size(sorted_values) - 1) * F.lit(q)
    low = F.floor(at).cast("int")
    high = F.ceil(at).cast("int")
    return between(F.get(sorted_values, low), F.get(sorted_values, high), at - low)


def intervals(
    replicates: DataFrame, group: Sequence[str], value: str, names: dict[str, float], most: int | None = None, listed: int = LISTED,
) -> DataFrame:
    """Percentile intervals per group, equal to sorting the values of a group.

    A replicate that drew nothing of a group has no number and is left out. Groups of up to
    ``listed`` values are sorted in a row. In larger ones the two values around a position
    are found by counting: bins of equal width between least and greatest value, then bins
    inside the bin that holds the wanted rank, until a bin is small or holds one value.
    ``most`` values of a group are known to exist at most (the resamples), if given.
    """
    group = list(group)
    if most is not None and most <= listed:
        packed = replicates.where(F.col(value).isNotNull()).groupBy(*group).agg(F.array_sort(F.collect_list(value)).alias("_v"))
        return packed.select(*group, *[quantile(F.col("_v"), q).alias(n) for n, q in names.items()])
    values = materialize(replicates.where(F.col(value).isNotNull()).select(*group, F.col(value).alias("_x")))
    spans = values.groupBy(*group).agg(F.min("_x").alias("lo"), F.max("_x").alias("hi"), F.count("_x").alias("n"))
    ends = [f(F.lit(q) * (F.col("n") - 1)).cast("long") for q in names.values() for f in (F.floor, F.ceil)]
    wanted = spans.select(*group, "lo", "hi", "n", F.posexplode(F.array(*ends)).alias("which", "rank"))
    wanted = materialize(wanted.withColumn("span", F.struct("lo", "hi")))
    found = [wanted.where("lo = hi").select(*group, "which", F.col("lo").alias("x"))]
    wanted = wanted.where("lo < hi")
    same = [F.col(f"v.{g}").eqNullSafe(F.col(f"w.{g}")) for g in group]
    inside = F.col("v._x").between(F.col("w.lo"), F.col("w.hi"))
    while (wanted.agg(F.max("n")).first()[0] or 0) > listed:
        small = wanted.where(F.col("n") <= listed)
        spans = wanted.where(F.col("n") > listed).select(*group, "lo", "hi").distinct()
        width = (F.col("w.hi") - F.col("w.lo")) / BINS
        number = F.least(F.lit(BINS - 1), F.floor((F.col("v._x") - F.col("w.lo")) / width))
        binned = values.alias("v").join(spans.alias("w"), [*same, inside]).select(*[F.col(f"w.{g}").alias(g) for g in group], F.struct("w.lo", "w.hi").alias("span"), number.alias("bin"), "v._x")
        counts = binned.groupBy(*group, "span", "bin").agg(F.min("_x").alias("lo"), F.max("_x").alias("hi"), F.count("_x").alias("n"))
        below = F.coalesce(F.sum("n").over(Window.partitionBy(*group, "span").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        bins = counts.withColumn("below", below)
        hit = [F.col(f"b.{g}").eqNullSafe(F.col(f"w.{g}")) for g in group] + [F.col("b.span") == F.col("w.span"), F.col("w.rank").between(F.col("b.below"), F.col("b.below") + F.col("b.n") - 1)]
        narrowed = wanted.where(F.col("n") > listed).alias("w").join(bins.alias("b"), hit).select(
            *[f"w.{g}" for g in group], "b.lo", "b.hi", "b.n", "w.which", (F.col("w.rank") - F.col("b.below")).alias("rank"), F.struct("b.lo", "b.hi").alias("span")
        )
        whole = materialize(small.select(narrowed.columns).unionByName(narrowed))
        found.append(whole.where("lo = hi").select(*group, "which", F.col("lo").alias("x")))
        wanted = whole.where("lo < hi")
    spans = wanted.select(*group, "lo", "hi").distinct()
    lists = values.alias("v").join(spans.alias("w"), [*same, inside]).groupBy(*[F.col(f"w.{g}").alias(g) for g in group], F.struct("w.lo", "w.hi").alias("span")).agg(F.array_sort(F.collect_list("v._x")).alias("xs"))
    hit = [F.col(f"l.{g}").eqNullSafe(F.col(f"w.{g}")) for g in group] + [F.col("l.span") == F.col("w.span")]
    found.append(wanted.alias("w").join(lists.alias("l"), hit).select(*[f"w.{g}" for g in group], "w.which", F.get("l.xs", F.col("w.rank").cast("int")).alias("x")))
    points = found[0]
    for more in found[1:]:
        points = points.unionByName(more)
    total = values.groupBy(*group).agg(F.count("_x").alias("n"))
    ordered = points.groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("which", "x"))).alias("p"))
    out = []
    for k, (name, q) in enumerate(names.items()):
        at = F.lit(q) * (F.col("n") - 1)
        out.append(between(F.col("p")[2 * k], F.col("p")[2 * k + 1], at - F.floor(at)).alias(name))
    joined = ordered.alias("o").join(total.alias("t"), [F.col(f"o.{g}").eqNullSafe(F.col(f"t.{g}")) for g in group])
    return joined.select(*[f"o.{g}" for g in group], *out)


def model_intervals(
    rows: DataFrame, group: Sequence[str] = ("model",), score: str = "score",
    samples: int = fixed.BOOTSTRAP_SAMPLES, seed: int = fixed.BOOTSTRAP_SEED,
) -> DataFrame:
    """Mean score per group with its 95 percent cluster interval."""
    group = list(group)
    measured = rows.select(
        *group, *CLUSTER, F.col(score).cast("long").alias("num"), F.lit(1).cast("long").alias("den")
    )
    keyed = cluster_sums(measured, group, ["num", "den"], seed)
    observed = keyed.groupBy(*group).agg(
        F.sum("den").alias("judged_rows"), share(F.sum("num"), F.sum("den")).alias("mean_score")
    )
    drawn = drawn_sums(keyed, group, ["num", "den"], samples).withColumn("value", share(F.col("num"), F.col("den")))
    bounds = intervals(drawn, group, "value", dict(zip(("ci_95_low", "ci_95_high"), CI_95)), samples)
    half = F.greatest(
        F.col("mean_score") - F.col("ci_95_low"), F.col("ci_95_high") - F.col("mean_score")
    )
    joined = cluster_counts(keyed, group).join(observed, group).join(bounds, group)
    return joined.withColumn("ci_95_half_width", half)


MEASURES = [f"{kind}_{x}" for x in fixed.LABELS for kind in ("num", "den")]


def _weighted(rows: DataFrame, group: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """Vote-weighted numerators and weights per row, in vote units."""
    out = []
    for x in fixed.LABELS:
        out.append((F.col("score") * F.col(f"units_{x}")).cast("long").alias(f"num_{x}"))
        out.append(F.col(f"units_{x}").cast("long").alias(f"den_{x}"))
    return rows.select(*group, *CLUSTER, *extra, *out)


def _ratios() -> list[Column]:
    return [
        share(F.col(f"num_{x}"), F.col(f"den_{x}")).alias(f"value_{x}") for x in fixed.LABELS
    ]


def _label_rows(df: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Columns ``<field>_<label>`` to one row per label."""
    rows = [
        F.struct(
            F.lit(x).alias("predicted_label"), *[F.col(f"{f}_{x}").alias(f) for f in fields]
        )
        for x in fixed.LABELS
    ]
    return df.select(*keys, F.inline(F.array(*rows)))


class PerceivedBootstrap:
    """Perceived-class means per group with one shared resample for all classes.

    Sharing the draws pairs the classes within each replicate, which the contrasts
    need; the intervals of single classes use the same replicates.
    """

    def __init__(
        self, rows: DataFrame, group: Sequence[str] = ("size_group",),
        samples: int = fixed.BOOTSTRAP_SAMPLES, seed: int = fixed.BOOTSTRAP_SEED,
    ):
        self.group = list(group)
        self.samples = samples
        weighted = cluster_sums(_weighted(rows, self.group), self.group, MEASURES, seed)
        drawn = drawn_sums(weighted, self.group, MEASURES, samples)
        self.replicates = drawn.select(*self.group, "rep", *_ratios())
        sums = weighted.groupBy(*self.group).agg(*[F.sum(m).alias(m) for m in MEASURES])
        self.observed = cluster_counts(weighted, self.group).join(sums, self.group).select("*", *_ratios())

    def means(self) -> DataFrame:
        """Mean, 95 percent interval and effective count per group and class."""
        per_label = _label_rows(self.replicates, [*self.group, "rep"], ["value"])
        # an empty class has no ratio in a replicate and is skipped there
        usable = per_label.filter(F.col("value").isNotNull())
        keys = [*self.group, "predicted_label"]
        bounds = intervals(usable, keys, "value", dict(zip(("ci_95_low", "ci_95_high"), CI_95)), self.samples)
        base = [*self.group, "source_item_clusters"]
        shown = _label_rows(self.observed, base, ["value", "den"])
        joined = shown.join(bounds, keys, "left")
        return joined.select(
            *base, "predicted_label",
            F.col("value").alias("mean_score"),
            "ci_95_low", "ci_95_high",
            share(F.col("den"), F.lit(VOTE_UNIT)).alias("effective_count"),
        )

    def contrasts(self, base: str = "CFA", others: Sequence[str] = ("FA", "FI")) -> DataFrame:
        """Paired differences with plain and family-wise intervals."""
        tail = fixed.FAMILY_ALPHA / (2 * fixed.PLANNED_COMPARISONS)
        pairs = F.array(
            *[
                F.struct(
                    F.lit(f"{x} - {base}").alias("comparison"),
                    (F.col(f"value_{x}") - F.col(f"value_{base}")).alias("difference"),
                )
                for x in others
            ]
        )
        keys = [*self.group, "comparison"]
        drawn = self.replicates.select(*self.group, F.inline(pairs)).filter(
            F.col("difference").isNotNull()
        )
        names = {
            "ci_95_low": CI_95[0],
            "ci_95_high": CI_95[1],
            "familywise_low": tail,
            "familywise_high": 1 - tail,
        }
        bounds = intervals(drawn, keys, "difference", names, self.samples)
        shown = self.observed.select(*self.group, "source_item_clusters", F.inline(pairs))
        clear = (F.col("familywise_low") > 0) | (F.col("familywise_high") < 0)
        return (
            shown.withColumnRenamed("difference", "mean_difference")
            .join(bounds, keys, "left")
            .withColumn("significant_familywise", clear)
        )


def macro_intervals(
    rows: DataFrame, samples: int = fixed.BOOTSTRAP_SAMPLES, seed: int = fixed.BOOTSTRAP_SEED,
) -> DataFrame:
    """True x perceived class: interval of the mean over models of per-model ratios."""
    group = ["true_label"]
    labelled = rows.withColumn("true_label", expected_label(F.col("variant")))
    weighted = cluster_sums(_weighted(labelled, group, ["model"]), group, MEASURES, seed, cell="model")
    drawn = drawn_sums(weighted, group, MEASURES, samples)
    per_label = _label_rows(drawn.select(*group, "rep", "cell", *_ratios()), [*group, "rep", "cell"], ["value"])
    keys = [*group, "predicted_label"]
    # one ratio per model; added in model order
    listed = F.array_sort(
        F.collect_list(F.when(F.col("value").isNotNull(), F.struct("cell", "value")))
    )
    total = F.aggregate(listed, F.lit(0.0), lambda acc, e: acc + e["value"])
    macro = per_label.groupBy(*keys, "rep").agg(
        F.try_divide(total, F.size(listed)).alias("value")
    )
    usable = macro.filter(F.col("value").isNotNull())
    bounds = intervals(usable, keys, "value", dict(zip(("ci_95_low", "ci_95_high"), CI_95)), samples)
    return bounds.join(cluster_counts(weighted, group), group)
