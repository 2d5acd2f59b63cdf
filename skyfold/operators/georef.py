"""Georeferencing: metric scale, accuracy, bounds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from skyfold.functions import geodesy as geo, linalg as la
from skyfold.functions.linalg import rounded
from skyfold.operators.quantiles import exact_quantiles
from skyfold.session import cut_lineage, spread

# Source names and confidences of the scale sources, error factors.
SCALE_CONFIDENCE = {"CHECKPOINT_REFERENCE_SCALE": 0.95, "RTK_PPK_GNSS_BASELINES": 0.92,
                    "STANDALONE_GNSS_BASELINES": 0.78, "BAROMETRIC_LASER_ALTIMETRY": 0.55}
CE90, LE90 = 1.5175, 1.6449
PAIR_BLOCK = 2048


def scale_from_baselines(cameras: DataFrame, baselines: DataFrame) -> DataFrame:
    """Median of true over relative length of surveyed lines, however many a mission has."""
    ends = lambda side: cameras.select(
        "mission_id", F.col("idx").alias(f"idx_{side}"), F.col("rel").alias(f"_{side}")
    )
    joined = baselines.join(ends("a"), ["mission_id", "idx_a"]).join(ends("b"), ["mission_id", "idx_b"])
    d = la.norm(la.sub(la.arr3("_a"), la.arr3("_b")))
    ratios = joined.withColumn("_d", d).where("_d > 1e-4").withColumn("_s", F.col("distance_m") / F.col("_d"))
    sums = ratios.groupBy("mission_id").agg(F.count(F.lit(1)).alias("evaluated"), F.stddev_pop("_s").alias("_std"))
    out = sums.join(exact_quantiles(ratios, ["mission_id"], "_s", {"scale": 0.5}), "mission_id")
    return out.select(
        "mission_id", "scale", F.when(F.col("evaluated") > 1, F.col("_std")).otherwise(0.02 * F.col("scale")).alias("std"),
        "evaluated", F.lit("CHECKPOINT_REFERENCE_SCALE").alias("source"),
    )


def _pair_ratios(a: np.ndarray, b: np.ndarray, same: bool) -> np.ndarray:
    """Geographic over relative length of the camera pairs of two blocks; columns rel xyz, geo xyz."""
    rel = np.sqrt(sum((a[:, None, i] - b[None, :, i]) ** 2 for i in range(3)))
    wide = np.sqrt(sum((a[:, None, i] - b[None, :, i]) ** 2 for i in range(3, 6)))
    use = (rel > 0.1) & (wide > 0.2)
    if same:
        use &= np.triu(np.ones(use.shape, dtype=bool), 1)
    return wide[use] / rel[use]


def robust_scale(ratios: np.ndarray) -> tuple[float, float, int]:
    """Median of the ratios within 2.5 deviations of the median; all when none is."""
    middle = np.median(ratios)
    spread_ = np.median(np.abs(ratios - middle))
    inliers = ratios[np.abs(ratios - middle) <= 2.5 * max(spread_, 1e-4)]
    inliers = inliers if len(inliers) else ratios
    scale = float(np.median(inliers))
    return scale, float(np.std(inliers)) if len(inliers) > 1 else 0.05 * scale, len(inliers)


_COORDS = ["r0", "r1", "r2", "g0", "g1", "g2"]


def _bits(values: np.ndarray) -> np.ndarray:
    """Non-negative doubles as integers in the same order."""
    return values.view(np.int64)


def _select_ranks(blocks: DataFrame, targets: DataFrame, digit: int = 12) -> DataFrame:
    """The values at given ranks among all pair ratios of a mission, without listing the pairs.

    ``targets(mission_id, slot, rank, centre, limit)``: the ranked value is the
    ratio, or its distance to ``centre`` when given, counting only ratios within
    ``limit`` of the centre when given. The value is found digit by digit from
    the top: each pass counts the next digit of the values that share the digits
    found so far, inside the tasks, and only the counts are shuffled.
    """
    state = targets.withColumn("prefix", F.lit(0).cast("long"))
    for shift in range(64 - digit, -digit, -digit):
        low = max(shift, 0)
        width = digit if shift >= 0 else digit + shift
        packed = state.groupBy("mission_id").agg(
            F.collect_list(F.struct("slot", "centre", "limit", "prefix", "ranked_distance")).alias("asks")
        )

        def count(pdf: pd.DataFrame) -> pd.DataFrame:
            a, b, same = _two_blocks(pdf)
            ratios = _pair_ratios(a, b, same)
            rows = []
            for ask in pdf["asks"].iloc[0]:
                values = ratios
                if not np.isnan(ask["centre"]):
                    gaps = np.abs(ratios - ask["centre"])
                    within = gaps <= ask["limit"]
                    values = gaps[within] if ask["ranked_distance"] else ratios[within]
                code = _bits(values)
                code = code[(code >> min(low + width, 63)) == ask["prefix"]]
                digits, n = np.unique((code >> low) & ((1 << width) - 1), return_counts=True)
                rows += [(pdf["mission_id"].iloc[0], ask["slot"], int(d), int(c)) for d, c in zip(digits, n)]
            return pd.DataFrame(rows, columns=["mission_id", "slot", "digit", "n"])

        upto = Window.partitionBy("mission_id", "slot").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
        counts = (
            blocks.join(packed, "mission_id").groupBy("mission_id", "block_a", "block_b")
            .applyInPandas(count, "mission_id bigint, slot string, digit bigint, n bigint")
            .groupBy("mission_id", "slot", "digit").agg(F.sum("n").alias("n"))
            .withColumn("_upto", F.sum("n").over(upto))
        )
        state = cut_lineage(
            state.join(counts, ["mission_id", "slot"]).where(
                (F.col("_upto") > F.col("rank")) & (F.col("_upto") - F.col("n") <= F.col("rank"))
            ).select(
                "mission_id", "slot", (F.col("rank") - (F.col("_upto") - F.col("n"))).alias("rank"), "centre", "limit",
                "ranked_distance", (F.col("prefix") * (1 << width) + F.col("digit")).alias("prefix"),
            )
        )
        if low == 0:
            break

    def decode(batches):
        for pdf in batches:
            yield pdf[["mission_id", "slot"]].assign(value=pdf["prefix"].to_numpy(np.int64).view(np.float64))

    return state.mapInPandas(decode, "mission_id bigint, slot string, value double")


def _two_blocks(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, bool]:
    i, j = pdf["block_a"].iloc[0], pdf["block_b"].iloc[0]
    a = pdf.loc[pdf["_block"] == i, _COORDS].to_numpy(float)
    return a, a if i == j else pdf.loc[pdf["_block"] == j, _COORDS].to_numpy(float), i == j


def _large_missions(cams: DataFrame, block: int) -> DataFrame:
    """Robust scale of missions with more than one block of cameras."""
    last = cams.groupBy("mission_id").agg(F.max("_block").alias("_last"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last")))
    paired = cams.join(last, "mission_id").withColumn("_other", other).select(
        "mission_id", F.least("_block", "_other").alias("block_a"), F.greatest("_block", "_other").alias("block_b"),
        "_block", *_COORDS,
    )
    blocks = spread(cut_lineage(paired), "mission_id", "block_a", "block_b")

    def totals(centres: DataFrame | None) -> DataFrame:
        gated = centres is not None
        joined = blocks.join(centres, "mission_id") if gated else blocks

        def count(pdf: pd.DataFrame) -> pd.DataFrame:
            ratios = _pair_ratios(*_two_blocks(pdf))
            if gated:
                ratios = ratios[np.abs(ratios - pdf["centre"].iloc[0]) <= pdf["limit"].iloc[0]]
            mean = ratios.mean() if len(ratios) else 0.0
            return pd.DataFrame({"mission_id": [pdf["mission_id"].iloc[0]], "n": [len(ratios)], "mean": [mean],
                                 "m2": [((ratios - mean) ** 2).sum()]})

        parts = joined.groupBy("mission_id", "block_a", "block_b").applyInPandas(
            count, "mission_id bigint, n bigint, mean double, m2 double"
        )
        grand = parts.groupBy("mission_id").agg(
            F.sum("n").alias("total"), F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n")).alias("_grand")
        )
        merged = parts.join(grand, "mission_id").groupBy("mission_id", "total").agg(
            F.sum(F.col("m2") + F.col("n") * F.pow(F.col("mean") - F.col("_grand"), F.lit(2.0))).alias("_m2")
        )
        return cut_lineage(merged.select(
            "mission_id", "total", F.sqrt(F.col("_m2") / F.greatest("total", F.lit(1))).alias("_std")
        ).where("total > 0"))

    def median(counts: DataFrame, centres: DataFrame | None, distance: bool) -> DataFrame:
        asked = counts.select("mission_id", F.explode(F.array(
            F.struct(F.lit("lo").alias("slot"), F.floor((F.col("total") - 1) / 2).alias("rank")),
            F.struct(F.lit("hi").alias("slot"), F.floor(F.col("total") / 2).alias("rank")),
        )).alias("q")).select("mission_id", "q.*").withColumn("ranked_distance", F.lit(distance))
        asked = (asked.join(centres, "mission_id") if centres is not None else
                 asked.withColumn("centre", F.lit(float("nan"))).withColumn("limit", F.lit(float("inf"))))
        return cut_lineage(_select_ranks(blocks, asked).groupBy("mission_id").agg(F.avg("value").alias("m")))

    everything = totals(None)
    middle = median(everything, None, False)
    around = middle.select("mission_id", F.col("m").alias("centre"), F.lit(float("inf")).alias("limit"))
    deviation = median(everything, around, True)
    gate = cut_lineage(middle.join(deviation.withColumnRenamed("m", "_mad"), "mission_id").select(
        "mission_id", F.col("m").alias("centre"), (2.5 * F.greatest("_mad", F.lit(1e-4))).alias("limit")
    ))
    kept = totals(gate)
    scale = median(kept, gate, False)
    return kept.join(scale, "mission_id").select(
        "mission_id", F.col("m").alias("scale"), F.when(F.col("total") > 1, F.col("_std")).otherwise(0.05 * F.col("m")).alias("std"),
        F.col("total").alias("evaluated"),
    )


def scale_from_positions(cameras: DataFrame, block: int = PAIR_BLOCK) -> DataFrame:
    """Metric scale from all camera pairs of a mission: ``mission_id, idx, rel[3], geo[3], is_rtk``.

    A mission of up to ``block`` cameras is one bounded task. Larger missions
    are cut into blocks and the medians found by counting; no pair leaves a task.
    """
    usable = cameras.where(F.col("geo").isNotNull()).select(
        "mission_id", F.floor(F.col("idx") / block).alias("_block"),
        *[F.col("rel")[i].alias(f"r{i}") for i in range(3)], *[F.col("geo")[i].alias(f"g{i}") for i in range(3)],
    )
    sizes = cameras.groupBy("mission_id").agg(F.max("idx").alias("_most"), F.bool_or("is_rtk").alias("is_rtk"))
    big = sizes.where(F.col("_most") >= block).select("mission_id")

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        a = pdf[_COORDS].to_numpy(float)
        ratios = _pair_ratios(a, a, True)
        if not len(ratios):
            return pd.DataFrame(columns=["mission_id", "scale", "std", "evaluated"])
        scale, std, n = robust_scale(ratios)
        return pd.DataFrame({"mission_id": [pdf["mission_id"].iloc[0]], "scale": [scale], "std": [std], "evaluated": [n]})

    small = usable.join(big, "mission_id", "left_anti").groupBy("mission_id").applyInPandas(
        whole, "mission_id bigint, scale double, std double, evaluated bigint"
    )
    if not big.isEmpty():
        small = small.unionByName(_large_missions(usable.join(big, "mission_id", "left_semi"), block))
    return small.join(sizes.select("mission_id", "is_rtk"), "mission_id").select(
        "mission_id", "scale", "std", "evaluated",
        F.when(F.col("is_rtk"), "RTK_PPK_GNSS_BASELINES").otherwise("STANDALONE_GNSS_BASELINES").alias("source"),
    )


def scale_from_altitude(cameras: DataFrame, missions: DataFrame) -> DataFrame:
    """Flight altitude over the relative height span of the trajectory."""
    span = cameras.groupBy("mission_id").agg(
        F.count(F.lit(1)).alias("_n"), (F.max(F.col("rel")[2]) - F.min(F.col("rel")[2])).alias("_span")
    )
    height = F.greatest(F.lit(0.2), F.when(F.col("_n") > 1, F.col("_span")).otherwise(1.0))
    scale = F.greatest(F.lit(0.01), F.col("flight_altitude_m") / F.greatest(F.lit(1.0), height * 2.0))
    return span.join(missions.select("mission_id", "flight_altitude_m"), "mission_id").select(
        "mission_id", scale.alias("scale"), (0.15 * scale).alias("std"), F.lit(1).cast("long").alias("evaluated"),
        F.lit("BAROMETRIC_LASER_ALTIMETRY").alias("source"),
    )


def choose_scale(missions: DataFrame, candidates: list[DataFrame]) -> DataFrame:
    """The first available candidate per mission, with its confidence and relative error."""
    out = missions.select("mission_id")
    names = []
    for i, c in enumerate(candidates):
        picked = c.select("mission_id", F.struct("scale", "std", "evaluated", "source").alias(f"_c{i}"))
        out = out.join(picked, "mission_id", "left")
        names.append(f"_c{i}")
    s = F.coalesce(*names)
    confidence = F.element_at(F.create_map(*[F.lit(x) for kv in SCALE_CONFIDENCE.items() for x in kv]), F.col("source"))
    return out.withColumn("_s", s).select("mission_id", "_s.*").withColumn("confidence", confidence).withColumn(
        "relative_error_pct", F.when(F.col("scale") > 0, rounded(F.col("std") / F.col("scale") * 100, 2)).otherwise(0.0)
    )


def residual_report(pairs: DataFrame, keys: list[str] = ["mission_id"]) -> DataFrame:
    """RMSE by axis, CE90, LE90 and maxima over ``geo[3]`` against ``moved[3]``."""
    e, n, u = (F.col("geo")[i] - F.col("moved")[i] for i in range(3))
    rms = lambda d: F.sqrt(F.avg(d * d))
    base = pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("stations"), rms(e).alias("_e"), rms(n).alias("_n"), rms(u).alias("_v"),
        F.max(F.sqrt(e * e + n * n)).alias("_mh"), F.max(F.abs(u)).alias("_mv"),
    )
    h = F.sqrt(F.col("_e") * F.col("_e") + F.col("_n") * F.col("_n"))
    v = F.col("_v")
    return base.select(
        *keys, "stations", rounded(F.col("_e"), 3).alias("rmse_east_m"), rounded(F.col("_n"), 3).alias("rmse_north_m"),
        rounded(h, 3).alias("rmse_horizontal_m"), rounded(v, 3).alias("rmse_vertical_m"),
        rounded(F.sqrt(h * h + v * v), 3).alias("rmse_3d_m"), rounded(CE90 * h, 3).alias("ce90_m"),
        rounded(LE90 * v, 3).alias("le90_m"), rounded(F.col("_mh"), 3).alias("max_horizontal_m"),
        rounded(F.col("_mv"), 3).alias("max_vertical_m"),
    )


def checkpoint_errors(checkpoints: DataFrame, transform: DataFrame) -> DataFrame:
    """Error of each ground checkpoint after the similarity of its mission."""
    moved = la.mat_vec(la.arr9("R"), la.arr3("obs"))
    joined = checkpoints.join(transform.select("mission_id", "scale", "R", "t"), "mission_id")
    de, dn, du = (F.col("scale") * moved[i] + F.col("t")[i] - F.col(c) for i, c in enumerate(("east_m", "north_m", "up_m")))
    h = F.sqrt(de * de + dn * dn)
    return joined.select(
        "mission_id", "id", rounded(de, 3).alias("delta_east_m"), rounded(dn, 3).alias("delta_north_m"),
        rounded(du, 3).alias("delta_vertical_m"), rounded(h, 3).alias("horizontal_error_m"),
        rounded(F.sqrt(h * h + du * du), 3).alias("error_3d_m"),
    )


def checkpoint_report(missions: DataFrame, errors: DataFrame) -> DataFrame:
    """Checkpoint RMSE per mission; missions without any stay, with NULL."""
    rms = lambda c: rounded(F.sqrt(F.avg(F.col(c) * F.col(c))), 3)
    sums = errors.groupBy("mission_id").agg(
        F.count(F.lit(1)).alias("_n"), rms("horizontal_error_m").alias("checkpoint_rmse_horizontal_m"),
        rms("delta_vertical_m").alias("checkpoint_rmse_vertical_m"),
    )
    return missions.select("mission_id").join(sums, "mission_id", "left").select(
        "mission_id", F.col("_n").isNotNull().alias("checkpoints_provided"),
        F.coalesce("_n", F.lit(0)).alias("checkpoint_count"), "checkpoint_rmse_horizontal_m", "checkpoint_rmse_vertical_m",
    )


def accuracy_class(missions: DataFrame) -> DataFrame:
    """Class and limitation codes from ``rtk_available, gps_available, checkpoints_provided``."""
    rtk, checked = F.col("rtk_available"), F.col("checkpoints_provided")
    limits = F.array(
        F.lit("GNSS_ATMOSPHERIC_ERROR"), F.lit("SINGLE_FREQUENCY_VERTICAL"), F.lit("VISUAL_SCALE_DRIFT"),
        F.when(~rtk, "NO_RTK_CORRECTION"), F.when(~checked, "NO_GROUND_CHECKPOINTS"),
    )
    return missions.withColumn(
        "accuracy_class",
        F.when(rtk & checked, "SURVEY_GRADE_RTK").when(rtk, "ENGINEERING_PRELIMINARY").otherwise("MAPPING_GRADE_STANDALONE"),
    ).withColumn("limitations", F.filter(limits, lambda v: v.isNotNull()))


def bounding_box(enu: DataFrame, margin: float = 0.0005) -> DataFrame:
    """Geodetic bounds of east/north/up positions around their origin."""
    lat, lon, _ = geo.from_enu(*[F.col("enu")[i] for i in range(3)], F.col("lat0"), F.col("lon0"), F.col("alt0"))
    return enu.withColumn("_la", lat).withColumn("_lo", lon).groupBy("mission_id").agg(
        rounded(F.min("_la") - margin).alias("min_latitude"), rounded(F.max("_la") + margin).alias("max_latitude"),
        rounded(F.min("_lo") - margin).alias("min_longitude"), rounded(F.max("_lo") + margin).alias("max_longitude"),
    )
