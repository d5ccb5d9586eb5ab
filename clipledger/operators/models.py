"""Classifiers on feature tables: class support, linear scores, calibrated probabilities, training and agreement.

A model is a one-row table of arrays: families, mean, scale, weights (one array per class), bias, temperature,
centroids, p99, reject. It enters a plan as a scalar subquery, so nothing is joined or copied per row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipledger.functions import arrays
from clipledger.functions.rules import Rule, apply_gates, failed_codes
from clipledger.operators.aggregates import best_per_bin, clip_features, quantiles
from clipledger.operators.groups import by_group
from clipledger.session import join_same, settle

# Share sizes of the agreement test.
TRIALS, SHARE, MIN_VALID = 16, 0.75, 8
ROTATIONAL = ["cylinder", "bottle", "revolved"]
PRISMATIC = ["planar", "rounded_slab", "rectangular_prism"]


def in_order(key: str, value: str) -> Column:
    """Aggregate: values in the order of a small key (feature positions or class numbers)."""
    return F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda s: s[value])


def support_arrays(support: DataFrame, label: str) -> DataFrame:
    """One row with the class supports as arrays in class order."""
    return support.agg(in_order(label, "centroid").alias("centroids"), in_order(label, "p99").alias("p99"), in_order(label, "reject").alias("reject"))


def feature_scale(vectors: DataFrame, vector: str) -> DataFrame:
    """One row with the mean and population deviation of every feature; near-constant features get scale 1."""
    s = vectors.select(F.posexplode(vector).alias("pos", "v")).groupBy("pos").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("scale"))
    s = s.withColumn("scale", F.when(F.col("scale") < 1e-5, 1.0).otherwise(F.col("scale")))
    return s.agg(in_order("pos", "mean").alias("mean"), in_order("pos", "scale").alias("scale"))


def standardise(vector: Column, mean: Column, scale: Column) -> Column:
    return F.zip_with(F.zip_with(vector, mean, lambda a, b: a.cast("double") - b), scale, lambda a, b: a / b)


def class_support(vectors: DataFrame, label: str, vector: str) -> DataFrame:
    """Per class: centroid, 99th percentile of the mean squared distance to it, and the reject distance."""
    c = vectors.select(label, F.posexplode(vector).alias("pos", "v")).groupBy(label, "pos").agg(F.avg("v").alias("centroid"))
    c = c.groupBy(label).agg(in_order("pos", "centroid").alias("centroid"))
    d = join_same(vectors.select(label, vector), c, [label]).withColumn("_d", arrays.squared_distance(vector, "centroid") / F.size(vector))
    q = quantiles(d, [label], p99=(F.col("_d"), 0.99))
    return join_same(c, q, [label]).withColumn("reject", F.greatest(F.col("p99") * 4.0, F.col("p99") + 5.0))


def score_linear(vectors: DataFrame, vector: str, model: DataFrame) -> DataFrame:
    """Add ``scores``: bias plus the dot product with each class's weights, on standardised features."""
    d = vectors.withColumn("_m", model.select(F.struct("mean", "scale", "weights", "bias")).scalar())
    z = standardise(F.col(vector), F.col("_m.mean"), F.col("_m.scale"))
    d = d.withColumn("_z", z)
    scores = F.zip_with(F.transform("_m.weights", lambda w: arrays.dot("_z", w)), F.col("_m.bias"), lambda a, b: a + b)
    return d.withColumn("scores", scores).drop("_m", "_z")


def model_problems(model: DataFrame) -> DataFrame:
    """Validate a model row: shapes agree, tensors are finite, scales and temperature positive, distances ordered."""
    finite = lambda c: F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    f, k = F.size("mean"), F.size("families")
    shapes = (F.size("scale") != f) | (F.size("bias") != k) | (F.size("weights") != k) | F.exists("weights", lambda w: F.size(w) != f) | (F.size("centroids") != k) | F.exists("centroids", lambda w: F.size(w) != f) | (F.size("p99") != k) | (F.size("reject") != k)
    ok = finite(F.flatten("weights")) & finite(F.col("bias")) & finite(F.col("mean")) & finite(F.col("scale")) & finite(F.flatten("centroids"))
    return apply_gates(model, [
        Rule("shape_mismatch", shapes), Rule("not_finite", ~ok), Rule("scale_not_positive", F.exists("scale", lambda x: x <= 0)),
        Rule("temperature_not_positive", (F.col("temperature") <= 0) | F.isnan("temperature")),
        Rule("distances_not_ordered", F.exists(F.arrays_zip("p99", "reject"), lambda x: (x["p99"] <= 0) | (x["reject"] < x["p99"]))),
    ])


def classify(features: DataFrame, vector: str, thickness: Column, model: DataFrame) -> DataFrame:
    """Add probabilities (thickness-incompatible families zeroed and the rest renormalised), predicted family,
    confidence, margin, the top three, and the distance to the predicted class's training support."""
    d = features.withColumn("_m", model.select(F.struct(*model.columns)).scalar()).withColumn("_t", thickness)
    d = d.withColumn("_z", standardise(F.col(vector), F.col("_m.mean"), F.col("_m.scale")))
    temperature = F.col("_m.temperature")
    logits = F.zip_with(F.transform("_m.weights", lambda w: arrays.dot("_z", w)), F.col("_m.bias"), lambda a, b: (a + b))
    d = d.withColumn("_l", logits).withColumn("_l", F.transform("_l", lambda x: x / temperature)).withColumn("_p", arrays.softmax("_l"))
    t = F.col("_t")
    veto = lambda f: ((f == "planar") & (t > 0.06)) | ((f == "rounded_slab") & ~t.between(0.025, 0.55)) | ((f == "rectangular_prism") & (t < 0.05))
    d = d.withColumn("_p", F.zip_with("_p", F.col("_m.families"), lambda p, f: F.when(F.coalesce(veto(f), F.lit(False)), 0.0).otherwise(p)))
    total = arrays.total("_p")
    d = d.withColumn("_sum", total).withColumn("probabilities", F.when(F.col("_sum") > 0, F.transform("_p", lambda p: p / F.col("_sum"))).otherwise(F.col("_p")))
    # highest first, later classes first among equal ones
    order = F.reverse(F.array_sort(F.transform("probabilities", lambda p, i: F.struct(p.alias("p"), i.alias("i")))))
    d = d.withColumn("_o", order).withColumn("_best", F.col("_o")[0]["i"])
    at = lambda c: F.get(F.col(f"_m.{c}"), F.col("_best"))
    d = d.withColumns({
        "predicted": at("families"), "confidence": F.col("_o")[0]["p"], "margin": F.col("_o")[0]["p"] - F.coalesce(F.get("_o", F.lit(1))["p"], F.lit(0.0)),
        "alternatives": F.transform(F.slice("_o", 1, 3), lambda o: F.struct(F.get(F.col("_m.families"), o["i"]).alias("family"), o["p"].alias("probability"))),
        "training_distance": arrays.squared_distance("_z", at("centroids")) / F.size("_z"), "p99_distance": at("p99"), "reject_distance": at("reject")})
    return d.drop("_m", "_t", "_z", "_l", "_p", "_sum", "_o", "_best")


def evaluate_classifier(df: DataFrame, label_index: Column, predicted_index: Column, probabilities: str, by_label: str) -> DataFrame:
    """Accuracy and negative log-likelihood per class and (null class) overall."""
    p = F.greatest(F.get(probabilities, label_index), F.lit(1e-9))
    d = df.select(F.explode(F.array(F.col(by_label).cast("string"), F.lit(None).cast("string"))).alias("family"), (label_index == predicted_index).cast("double").alias("_ok"), F.log(p).alias("_lp"))
    return d.groupBy("family").agg(F.count("*").alias("rows"), F.avg("_ok").alias("accuracy"), (-F.avg("_lp")).alias("nll"))


def subset_agreement(frames: DataFrame, by: Sequence[str], frame: str, quality: str, aspect: str, features: Sequence[str], rounded: str, predict: Callable[[DataFrame], DataFrame],
                     seed: str = "agreement-1") -> DataFrame:
    """Share of hash-drawn 75 % subsets of a clip's views that are classified like the whole clip.

    ``predict`` adds ``predicted`` to a clip-feature table. Clips with fewer than eight valid frames get 0.
    """
    by = list(by)
    order = [frame]
    valid = settle(frames.where(F.col(quality) >= 0.20).select(*by, frame, quality, aspect, rounded, *[f for f in features if f != aspect]))
    make = lambda d, keys: predict(clip_features(d, keys, features, aspect, F.col(rounded), quality, order))
    whole = make(valid, by).select(*by, F.col("predicted").alias("_whole"))
    reps = best_per_bin(valid, by, F.rint(F.col(aspect) / 0.05), [F.col(quality).desc(), *order]).drop("view_bin")
    n = join_same(valid.groupBy(*by).agg(F.count("*").alias("_valid")), reps.groupBy(*by).agg(F.count("*").alias("_reps")), by)
    use = F.col("_reps") >= 4
    pop = settle(join_same(reps, n.where(use), by).unionByName(join_same(valid, n.where(~use), by)))
    size = F.when(use, F.col("_reps")).otherwise(F.col("_valid"))
    take = F.greatest(F.lit(3), F.ceil(SHARE * size))
    take = F.when(size >= 4, F.least(take, size - 1)).otherwise(take)
    draws = pop.where(F.col("_valid") >= MIN_VALID).withColumn("_take", take).withColumn("_trial", F.explode(F.sequence(F.lit(0), F.lit(TRIALS - 1))))
    draws = draws.withColumn("_key", F.unhex(F.sha2(F.concat_ws("|", F.lit(seed), F.col("_trial").cast("string"), F.col(frame).cast("string")), 256)))
    drawn = by_group(draws, [*by, "_trial"], lambda d, g: g.rank(d, ["_key", frame], "_i")).where("_i <= _take")
    each = make(settle(drawn.drop("_valid", "_reps", "_take", "_key", "_i")), [*by, "_trial"])  # without keys, and drawn once
    match = join_same(each.select(*by, "predicted"), whole, by).groupBy(*by).agg(F.avg(F.col("predicted").eqNullSafe(F.col("_whole")).cast("double")).alias("agreement"))
    return join_same(whole, match, by, "left").select(*by, F.col("_whole").alias("predicted"), F.coalesce("agreement", F.lit(0.0)).alias("agreement"))


# The builder of each family.
BUILDERS = {
    "planar": "planar_extrusion", "rounded_slab": "rounded_slab", "rectangular_prism": "box", "cylinder": "cylinder", "bottle": "lathed_profile", "revolved": "lathed_profile",
    "free_form": "free_form_reconstruction",
}


def route_gate(df: DataFrame, provenance: Column | None = None) -> DataFrame:
    """Decide whether a classified clip may be routed: reasons, warnings, the family, ``unknown`` when it may not, and
    the family's builder, null when it may not. ``provenance`` tells where masks came from (default: unknown).

    Columns: valid_masks, view_clusters, clipped_fraction, confidence, margin, agreement, training_distance,
    p99_distance, reject_distance, face_views, edge_views, aspect_view_range, thickness, maximum_hole_fraction,
    minimum_dominance, jump_fraction, predicted, rotation_confirmed. The decision is always a review.
    """
    c = F.col
    turn, prism = c("predicted").isin(*ROTATIONAL), c("predicted").isin(*PRISMATIC)
    few = c("view_clusters") < 4
    t = c("thickness")
    masks = F.lit("unknown") if provenance is None else F.coalesce(provenance, F.lit("unknown"))
    rules = [
        Rule("too_few_valid_masks", c("valid_masks") < 8),
        Rule("too_few_view_clusters", few & ~turn),
        Rule("rotation_not_confirmed", few & turn & ~c("rotation_confirmed")),
        Rule("masks_touch_border", c("clipped_fraction") > 0.35),
        Rule("low_probability", c("confidence") < 0.72),
        Rule("low_margin", c("margin") < 0.20),
        Rule("low_agreement", c("agreement") < 0.75),
        Rule("outside_training_support", c("training_distance") > c("reject_distance")),
        Rule("missing_face_or_edge_views", prism & ((c("face_views") < 1) | (c("edge_views") < 1) | (c("aspect_view_range") < 0.20))),
        Rule("too_thick_for_planar", (c("predicted") == "planar") & (t > 0.06)),
        Rule("thickness_outside_slab", (c("predicted") == "rounded_slab") & ~t.between(0.025, 0.55)),
        Rule("too_thin_for_prism", (c("predicted") == "rectangular_prism") & (t < 0.05)),
        Rule("significant_holes", c("maximum_hole_fraction") > 0.05),
        Rule("detached_components", c("minimum_dominance") < 0.75),
        Rule("temporal_jumps", c("jump_fraction") > 0.35),
        Rule("beyond_training_p99", (c("training_distance") <= c("reject_distance")) & (c("training_distance") > c("p99_distance")), warning=True),
        Rule("confirm_orbit_coverage", few & turn, warning=True),
        Rule("object_specific_masks", masks.isin("legacy_directory", "object_specific"), warning=True),
        Rule("unknown_mask_provenance", masks == "unknown", warning=True),
        Rule("no_independent_calibration", F.lit(True), warning=True),
    ]
    out = apply_gates(df, rules)
    builder = F.create_map(*[F.lit(x) for pair in BUILDERS.items() for x in pair])
    out = out.withColumn("family", F.when(c("accepted"), c("predicted")).otherwise("unknown")).withColumn("decision", F.lit("review"))
    return out.withColumn("builder", F.when(c("accepted"), F.try_element_at(builder, c("predicted"))))


def train_softmax(rows: DataFrame, label: str, vector: str, families: Sequence[str], validation: DataFrame, l2: float = 2e-3, iterations: int = 100) -> DataFrame:
    """Fit a ridge softmax on standardised features and pick the temperature with the lowest validation loss.

    Labels are class numbers. Returns the one-row model table.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    spark = rows.sparkSession
    scale = settle(feature_scale(rows, vector))
    z = lambda d: d.withColumn("_s", scale.select(F.struct("mean", "scale")).scalar()).withColumn("_z", standardise(F.col(vector), F.col("_s.mean"), F.col("_s.scale"))).drop("_s")
    train = z(rows).select(F.col(label).cast("double").alias("label"), "_z", array_to_vector("_z").alias("features"))
    fit = LogisticRegression(family="multinomial", regParam=l2, elasticNetParam=0.0, standardization=False, maxIter=iterations).fit(train)
    weights = [[float(x) for x in row] for row in fit.coefficientMatrix.toArray()]
    bias = [float(x) for x in fit.interceptVector.toArray()]
    lit = spark.createDataFrame([(weights, bias)], "weights array<array<double>>, bias array<double>")
    logits = z(validation).withColumn("_w", lit.select(F.struct("weights", "bias")).scalar())
    logits = logits.select(F.col(label).cast("int").alias("_y"), F.zip_with(F.transform("_w.weights", lambda w: arrays.dot("_z", w)), F.col("_w.bias"), lambda a, b: a + b).alias("_l"))
    grid = logits.withColumn("temperature", F.explode(F.transform(F.sequence(F.lit(0), F.lit(27)), lambda i: 0.65 + i * (1.35 / 27))))
    loss = F.log(F.greatest(F.get(arrays.softmax(F.transform("_l", lambda x: x / F.col("temperature"))), F.col("_y")), F.lit(1e-9)))
    losses = grid.groupBy("temperature").agg((-F.avg(loss)).alias("loss"))
    best = losses.agg(F.min_by("temperature", F.struct("loss", "temperature")).alias("temperature"))
    sup = class_support(train.select(F.col("label").cast("int").alias("label"), "_z"), "label", "_z")
    sup = support_arrays(sup, "label")
    out = scale.withColumn("families", F.array(*[F.lit(f) for f in families])).withColumn("_w", lit.select(F.struct("weights", "bias")).scalar())
    out = out.withColumn("temperature", best.scalar()).withColumn("_c", sup.select(F.struct("centroids", "p99", "reject")).scalar())
    return out.select("families", "mean", "scale", "_w.weights", "_w.bias", "temperature", "_c.centroids", "_c.p99", "_c.reject")


def cluster_faces(df: DataFrame, vector: str, quality: str, keep: Sequence[str], k: int = 2) -> tuple[DataFrame, DataFrame]:
    """Cluster standardised descriptors and pick each cluster's representative by distance − 0.12·quality."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector, vector_to_array

    scale = settle(feature_scale(df, vector))
    d = df.withColumn("_s", scale.select(F.struct("mean", "scale")).scalar())
    d = d.withColumn("_z", standardise(F.col(vector), F.col("_s.mean"), F.col("_s.scale"))).drop("_s").withColumn("features", array_to_vector("_z"))
    model = KMeans(k=k, seed=0, maxIter=50).fit(d)
    centres = [[float(x) for x in c] for c in model.clusterCenters()]
    out = model.transform(d).withColumnRenamed("prediction", "cluster")
    at = F.get(F.array(*[F.array(*[F.lit(x) for x in c]) for c in centres]), F.col("cluster"))
    out = out.withColumn("distance", F.sqrt(arrays.squared_distance(vector_to_array("features"), at))).drop("_z", "features")
    best = out.groupBy("cluster").agg(F.min(F.struct((F.col("distance") - 0.12 * F.col(quality)).alias("_k"), *keep)).alias("_b"), F.count("*").alias("size"))
    return out, best.select("cluster", "size", *[f"_b.{c}" for c in keep])
