"""Quantities recorded in different units: every score of a percent benchmark in percent.

The unit of a score is the number that stands for 100 percent on its scale (``full_scale``). Some rows tell it in their
``config`` text (or in that of a variant, which is on the scale of its record); for all others bagged trees trained on
the rows that tell it, with its probabilities calibrated, predicts it from magnitude, written decimals, source kind,
category of the benchmark and neighbouring values: the ratio to the usual percentage of the same model and benchmark in
other runs, and the magnitude and decimals of the variants. Confident predictions are converted, others are routed for
review and stay as they are.

Cases: a score that is null, NaN or negative has status 'unusable'; a benchmark of scale rating gives 'rating'; both keep
their score. A null config tells nothing. Repeated rows are treated alike. An empty table gives no rows; with no row that
tells its unit there is nothing to learn from and everything untold is routed for review. Extra columns pass through
unless their name is one of the outputs, which then replace them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions import trees
from rankloom.functions.cleaning import decimals, kind_key, name_key, narrow, usable_score
from rankloom.runtime import small, stash

#: Rows of each class that the forest is trained on, and rows that its calibration is measured on.
TRAIN_ROWS, CALIBRATION_ROWS = 4_000, 2_000
#: Calibrated probability from which a prediction is converted.
CONFIDENT = 0.9
#: Change of a scale's share that ends the search for the shares.
SETTLED = 1e-6
#: Scales that a row without any telling text may be on: percent, fraction, per mille, ten points, basis points, five points.
#: A count of tasks needs its total, which only the text can tell.
SCALES = (100, 1, 1000, 10, 10000, 5)

# How texts tell a scale. The first that fits holds; N is read from the text.
_TELLS = (
    (r"basis points?|\bbps?\b|hundredths of a per ?cent", 10000),
    (r"‰|per ?mille?\b|per thousand|promill|permill|parts per thousand", 1000),
    (r"\b(?:five[- ]star|stars? \(max 5\)|five[- ]point|5[- ]?(?:pt|point)s?\b|out of five)|/ ?5 rubric", 5),
    (r"marks of ten|judge score ?/ ?10|graded 1 ?[-–] ?10|\b10[- ]?(?:pt|point)|ten[- ]point|\bx ?/ ?10\b|out of ten", 10),
    (r"normali[sz]ed to (?:one|1)|max 1\.0|share of items|as (?:a )?decimal|unit interval|0 ?(?:-|–|\.\.|to) ?1\b|as (?:a )?ratio|proportion|fraction", 1),
    (r"%|\bper ?cent(?:age)?\b|\bpct\b|\b100[- ]?(?:pt|point)", 100),
)
_COUNTS = (
    r"\bout of (\d+)", r"\bcorrect out of (\d+)", r"\(of (\d+)\)", r"\bsolved of (\d+)", r"\bresolved ?/ ?(\d+)", r"\bpassed ?, ?total (\d+)",
    r"\braw hits of (\d+)", r"(\d+) tasks ?, ?solved count",
)


def told_scale(config: Column) -> Column:
    """``full_scale`` that a config text tells, null if it tells none.

    'first 500 items', 'full set, n=1000', 'top-10 vote', '10-fold mean' and the like are settings, not scales.
    """
    s = F.regexp_replace(F.lower(config), r"\s+", " ")
    hint = r"\bof\b|/ ?\d|\btotal\b|count|scale|rubric|stars?\b|[%‰–]|percent|per cent|pct|mille?|thousand|bps?\b|basis|one\b|max|items|decimal|interval|ratio|proportion|fraction|graded|-p(?:oin)?ts?|-point"
    out = None
    for pattern in _COUNTS:
        hit = F.regexp_extract(s, pattern, 1)
        out = F.when(hit != "", hit.try_cast("bigint")) if out is None else out.when(hit != "", hit.try_cast("bigint"))
    for pattern, scale in _TELLS:
        out = out.when(s.rlike(pattern), F.lit(scale).cast("bigint"))
    return F.when(s.rlike(hint), F.when(out > 0, out))


def _rating_names(names: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """Which typed benchmark names mean a benchmark of scale rating: (name, is_rating).

    ``names`` are distinct names that no id equals. The nearest catalog entry by edit distance over letters and digits
    decides, if within two edits and alike in digits. They meet by digits and length: an entry stands under its own
    length and the two below and above it.
    """
    tail = r"(?:[\s,]+(?:acc\.?|pass@\d+|\d+-shot)|\s*[\(\[][^()\[\]]*[\)\]]|[\s™®†*]+)+$"
    clean = F.regexp_replace(F.regexp_replace(F.lower(narrow(F.col("name"))), tail, ""), tail, "")
    words = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[^\w.]|_", " "), r"benchmark", "bench"), r"(?:v\.?|version *)(\d)", "$1"), r"(\d)\.0\b", "$1")
    digits = lambda c: F.regexp_replace(c, "[^0-9]", "").alias("_digits")
    catalog = benchmarks.where("id is not null").select("id", "scale", name_key(words(F.col("id"))).alias("entry"))
    catalog = catalog.select("*", digits("entry"), F.explode(F.sequence(F.length("entry") - 2, F.length("entry") + 2)).alias("_length"))
    keyed = names.select("name", name_key(words(clean)).alias("key")).select("*", digits("key"), F.length("key").alias("_length"))
    found = keyed.join(small(catalog), ["_digits", "_length"]).where("levenshtein(key, entry, 2) >= 0")
    return found.groupBy("name").agg(F.min_by(F.col("scale") == "rating", F.struct(F.levenshtein("key", "entry"), "id")).alias("is_rating"))


def _features(df: DataFrame) -> DataFrame:
    v = F.filter("_variant_scores", lambda x: F.coalesce(~F.isnan(x) & (x > 0), F.lit(False)))
    ratio = F.when((F.col("_centre") > 0) & (F.col("score") > 0), F.log10(F.col("score") / F.col("_centre")))
    return df.withColumns({
        "f_log": F.log10(F.greatest(F.col("score"), F.lit(1e-3))),
        "f_dec": decimals(F.col("score")).cast("double"),
        "f_ratio": F.coalesce(ratio, F.lit(-9.0)),
        "f_centre": F.coalesce(F.col("_centre"), F.lit(-1.0)),
        "f_variant": F.coalesce(F.log10(F.array_max(v)), F.lit(-9.0)),
        "f_variant_dec": F.coalesce(F.array_max(F.transform(v, decimals)).cast("double"), F.lit(-1.0)),
        "t_kind": F.coalesce(kind_key(F.col("source.kind")), F.lit("")),
        "t_category": F.coalesce("_category", F.lit("")),
    })


NUMBERS, TEXTS = ("f_log", "f_dec", "f_ratio", "f_centre", "f_variant", "f_variant_dec"), ("t_kind", "t_category")
FEATURES = NUMBERS + TEXTS


def _encoder(sample: pd.DataFrame):
    """Function from a frame with FEATURES to numbers; texts get the places that they have in the sample, others -1."""
    places = {t: {v: i for i, v in enumerate(sorted(sample[t].unique()))} for t in TEXTS}

    def encode(pdf: pd.DataFrame) -> np.ndarray:
        return np.column_stack([*(pdf[c].to_numpy(dtype=float) for c in NUMBERS), *(pdf[t].map(places[t]).fillna(-1).to_numpy(dtype=float) for t in TEXTS)])

    return encode


def _prepared(records: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """Usable rows with what is told and what the neighbours are like; names that no id equals are resolved if it matters."""
    catalog = benchmarks.groupBy(F.col("id").alias("_id")).agg(F.first("scale").alias("_scale"), F.first("category").alias("_category"))
    told = F.coalesce(told_scale(F.col("config")), F.array_max(F.transform(F.coalesce("variants", F.array().cast(records.schema["variants"].dataType)), lambda v: told_scale(v["config"]))))
    rows = records.select("record_id", "run_id", "model_id", "benchmark_id", "config", F.struct(F.col("source.kind").alias("kind")).alias("source"), "score", told.alias("_told"), F.transform("variants", lambda v: v["score"]).alias("_variant_scores")).where(usable_score(F.col("score")))
    rows = rows.join(small(catalog), rows["benchmark_id"] == F.col("_id"), "left").drop("_id")
    # only a score above 100 can be a rating, so only names of such rows are looked up
    unnamed = rows.where("_scale is null and score > 100 and benchmark_id is not null").groupBy(F.col("benchmark_id").alias("name")).agg(F.lit(1).alias("_one")).drop("_one")
    named = _rating_names(unnamed, benchmarks).select(F.col("name").alias("_name"), "is_rating")
    return rows.join(named, rows["benchmark_id"] == F.col("_name"), "left").withColumn("_rating", F.coalesce((F.col("_scale") == "rating") | ((F.col("_scale").isNull()) & (F.col("score") > 100) & F.col("is_rating")), F.lit(False))).drop("_name", "is_rating")


def _centres(rows: DataFrame) -> DataFrame:
    """Usual percentage of a model on a benchmark, from told rows and from those that look like percentages."""
    pct = F.when(F.col("_told").isNotNull(), F.col("score") * 100 / F.col("_told")).when((F.col("score") <= 100) & ~((F.col("score") < 1) & (decimals(F.col("score")) >= 2)), F.col("score"))
    return rows.where(~F.col("_rating")).groupBy("model_id", "benchmark_id").agg(F.avg(F.when(pct <= 100, pct)).alias("_centre"))


def with_scales(records: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """(record_id, score, full_scale, probability, basis): the scale of every usable score.

    basis: 'rating', 'told' (text), 'predicted' (probability at least CONFIDENT) or 'review' (full_scale is the guess).
    """
    rows = _prepared(records, benchmarks)
    centres = _centres(rows).select(F.col("model_id").alias("_m"), F.col("benchmark_id").alias("_b"), "_centre")
    joined = rows.join(centres, F.col("model_id").eqNullSafe(F.col("_m")) & F.col("benchmark_id").eqNullSafe(F.col("_b")), "left")
    data = stash(_features(joined).select("record_id", "score", "_told", "_rating", F.col("_scale").isNotNull().alias("_known"), *[F.col(c).cast("float").alias(c) for c in NUMBERS], *TEXTS), "units")
    place = F.array_position(F.array(*map(F.lit, SCALES)), F.col("_told").cast("int"))
    labelled = data.where(~F.col("_rating") & (place > 0)).withColumn("label", (place - 1).cast("double"))
    counts = {int(r["label"]): r["count"] for r in labelled.groupBy("label").count().collect()}
    told = data.where(F.col("_rating") | F.col("_told").isNotNull()).select("record_id", "score", F.when(~F.col("_rating"), F.col("_told")).alias("full_scale"), F.lit(1.0).alias("probability"), F.when(F.col("_rating"), "rating").otherwise("told").alias("basis"))
    rest = data.where(~F.col("_rating") & F.col("_told").isNull())
    if len(counts) < 2:
        return told.unionByName(rest.select("record_id", "score", F.lit(None).cast("bigint").alias("full_scale"), F.lit(0.0).alias("probability"), F.lit("review").alias("basis")))
    predicted = _predict(labelled, rest, counts)
    return told.unionByName(predicted.select("record_id", "score", "full_scale", "probability", F.when(F.col("probability") >= CONFIDENT, "predicted").otherwise("review").alias("basis")))


def _predict(labelled: DataFrame, rest: DataFrame, counts: dict[int, int]) -> DataFrame:
    """Scale and calibrated probability of the untold rows.

    Each class gives at most TRAIN_ROWS + CALIBRATION_ROWS rows by hash of its id, so the sample is bounded and stable.
    """
    share = F.lit(0.0)
    for k, n in counts.items():
        share = F.when(F.col("label") == k, F.lit(min(1.0, (TRAIN_ROWS + CALIBRATION_ROWS) / n))).otherwise(share)
    draw = F.pmod(F.xxhash64(F.col("record_id")), F.lit(1 << 30)) / float(1 << 30)
    sample = labelled.withColumn("_draw", draw / share).where("_draw < 1").select("label", "score", "_draw", *FEATURES).toPandas()
    classes = max(counts) + 1
    encode = _encoder(sample)
    y, x, score = sample["label"].to_numpy(dtype=int), encode(sample), sample["score"].to_numpy(dtype=float)
    early = sample["_draw"].to_numpy() < TRAIN_ROWS / (TRAIN_ROWS + CALIBRATION_ROWS)
    forest = trees.train(x[early], y[early], classes, trees=24, depth=8, share=0.6)
    scales = np.array(SCALES[:classes], dtype=float)

    def fitting(x: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Probabilities of the scales that a score doesn't exceed, made to sum to 1."""
        p = np.where(score[:, None] <= scales, forest.probabilities(x) + 1e-4, 0.0)
        return p / np.maximum(p.sum(axis=1, keepdims=True), 1e-12)

    ps = [f"p{i}" for i in range(classes)]

    def fit(batches):
        for pdf in batches:
            score = pdf["score"].to_numpy(dtype=float)
            p = fitting(encode(pdf), score)
            yield pd.DataFrame({"record_id": pdf["record_id"], "score": score, "_known": pdf["_known"], **{c: p[:, i] for i, c in enumerate(ps)}})

    # every untold row goes through the forest once; the shares and the decisions both read what it said
    fitted = stash(rest.select("record_id", "score", "_known", *FEATURES).mapInPandas(fit, "record_id bigint, score double, _known boolean, " + ", ".join(f"{c} double" for c in ps)), "fitted")
    weights = _shift(fitted.select(*ps), np.bincount(y[early], minlength=classes).astype(float))

    def decided(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The likeliest scale given the shares, and its probability."""
        p = p * weights
        p = p / np.maximum(p.sum(axis=1, keepdims=True), 1e-12)
        k = p.argmax(axis=1)
        return k, p[np.arange(len(p)), k]

    # calibration on held-out rows, weighted like the untold ones: how often it is right at such a probability, in twentieths
    k, p = decided(fitting(x[~early], score[~early]))
    w, bins = weights[y[~early]], np.minimum(20, np.floor(p * 20).astype(int))
    n_bin, right = np.bincount(bins, weights=w, minlength=21), np.bincount(bins, weights=w * (k == y[~early]), minlength=21)
    sure = np.minimum(1.0, np.maximum.accumulate((right + np.arange(21) / 20) / (n_bin + 1)))

    def run(batches):
        for pdf in batches:
            s = pdf["score"].to_numpy(dtype=float)
            k, p = decided(pdf[ps].to_numpy(dtype=float))
            p = sure[np.minimum(20, np.floor(p * 20).astype(int))]
            p = np.where((s > 1000) & ~pdf["_known"].to_numpy(), 0.0, p)  # may be a rating whose name means nothing
            yield pd.DataFrame({"record_id": pdf["record_id"], "score": s, "full_scale": scales[k].astype(np.int64), "probability": p})

    return fitted.mapInPandas(run, "record_id bigint, score double, full_scale bigint, probability double")


def _shift(probabilities: DataFrame, trained: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Weight of each class: its share among the untold rows, by expectation maximisation, over its share in training.

    ``probabilities`` has a column for each class and all untold rows. A round sums over them where they lie; only the
    sums reach the driver. Rounds end once no share moves by more than SETTLED.
    """
    prior = trained / trained.sum()
    share = prior.copy()
    for _ in range(rounds):
        q = [F.col(c) * float(w) for c, w in zip(probabilities.columns, share / np.maximum(prior, 1e-9))]
        parts = probabilities.select(F.greatest(sum(q[1:], q[0]), F.lit(1e-12)).alias("_all"), *[e.alias(f"q{i}") for i, e in enumerate(q)])
        n, *sums = parts.agg(F.count("*"), *[F.sum(F.col(f"q{i}") / F.col("_all")) for i in range(len(q))]).first()
        if not n:
            break
        before, share = share, np.maximum(np.array(sums, dtype=float) / n, 1e-6)
        if np.abs(share - before).max() < SETTLED:
            break
    return share / np.maximum(prior, 1e-9)


def to_percent(records: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """``records`` with ``score_percent``, ``full_scale``, ``unit_probability`` and ``unit_status``.

    Ratings and scores routed for review keep their number in ``score_percent`` (null for 'review': not known).
    """
    scales = with_scales(records, benchmarks).select(F.col("record_id").alias("_rid"), F.col("full_scale").alias("_fs"), F.col("probability").alias("_p"), "basis")
    keep = [c for c in records.columns if c not in ("score_percent", "full_scale", "unit_probability", "unit_status")]
    j = records.select(*keep).join(scales, records["record_id"] == F.col("_rid"), "left")
    status = F.coalesce(F.col("basis"), F.lit("unusable"))
    percent = F.when(status == "rating", F.col("score")).when(status.isin("told", "predicted"), F.col("score") * 100 / F.col("_fs"))
    return j.select(*keep, percent.alias("score_percent"), F.col("_fs").alias("full_scale"), F.col("_p").alias("unit_probability"), status.alias("unit_status"))


def not_percent(records: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """(record_id, full_scale) of the usable scores that are known not to be in percent."""
    return with_scales(records, benchmarks).where("basis in ('told', 'predicted') and full_scale <> 100").select("record_id", F.col("full_scale").cast("bigint").alias("full_scale"))


__all__ = ["CONFIDENT", "SCALES", "not_percent", "to_percent", "told_scale", "with_scales"]
