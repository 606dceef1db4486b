"""Image signals as tables: palettes, detections, labels, and their fusion with text signals.

Decoding and model inference happen elsewhere; rows of pixels, palette counts, labels and scores
come in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from offermend import fixed_values as V
from offermend.functions.text import casefold, collapse_spaces, norm_text
from offermend.operators.indexes import ReferenceIndex
from offermend.operators.matching import KEY, match_values
from offermend.operators.resolver import map_color
from offermend.session import staged

# ---------------------------------------------------------------- colours


def rgb_to_hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """(hue 0-360, saturation 0-1, value 0-1)."""
    r, g, b = r / 255.0, g / 255.0, b / 255.0
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = top - low
    hue = (
        F.when(span == 0, F.lit(0.0))
        .when(top == r, F.pmod(60.0 * ((g - b) / span) + 360.0, F.lit(360.0)))
        .when(top == g, F.pmod(60.0 * ((b - r) / span) + 120.0, F.lit(360.0)))
        .otherwise(F.pmod(60.0 * ((r - g) / span) + 240.0, F.lit(360.0)))
    )
    return hue, F.when(top == 0, F.lit(0.0)).otherwise(span / top), top


def manhattan(a: Column, b: Column) -> Column:
    return F.abs(a["r"] - b["r"]) + F.abs(a["g"] - b["g"]) + F.abs(a["b"] - b["b"])


def is_neutral(s: Column, v: Column) -> Column:
    return (s < 0.10) | (v < 0.20) | (v > 0.95)


def color_family(h: Column, s: Column, v: Column) -> Column:
    warm = h.between(15, 70)
    return (
        F.when(v < 0.18, "black")
        .when((s < 0.12) & (v > 0.92), "white").when((s < 0.12) & (v > 0.70), "silver").when(s < 0.12, "gray")
        .when(warm & (v > 0.75) & (s < 0.45), "beige")
        .when(warm & (v < 0.55), "brown").when(h.between(35, 65), "yellow").when(warm, "orange")
        .when(((h < 15) | (h >= 345)) & (v < 0.55), "burgundy")
        .when(((h < 15) | (h >= 345)) & (v > 0.75) & (s < 0.75), "pink")
        .when((h < 15) | (h >= 345), "red")
        .when((h >= 330) & (v > 0.65), "pink").when(h >= 330, "purple").when(h >= 290, "purple")
        .when((h <= 105) & (s < 0.35) & (v < 0.75), "khaki").when(h <= 170, "green")
        .when(h <= 200, "turquoise").when(h <= 250, "blue").otherwise("navy")
    )


def palette_families(palette: DataFrame) -> DataFrame:
    """Palette rows (image_id, r, g, b, n) with h, s, v, neutral and family."""
    h, s, v = rgb_to_hsv(F.col("r"), F.col("g"), F.col("b"))
    rows = palette.withColumn("h", h).withColumn("s", s).withColumn("v", v)
    return rows.withColumn("neutral", is_neutral(F.col("s"), F.col("v"))).withColumn("family", color_family(F.col("h"), F.col("s"), F.col("v")))


def _family_name(family: Column) -> Column:
    out = None
    for key, name in V.FAMILY_NAMES.items():
        out = F.when(family == key, F.lit(name)) if out is None else out.when(family == key, F.lit(name))
    return out.otherwise(F.lit(""))


def palette_color(palette: DataFrame) -> DataFrame:
    """image_id -> dominant and secondary colour, confidence and the multicolour flag.

    Counts are added up per colour first. Only the nine most frequent colours can matter (a colour
    with a 12 % share is among the first eight), so a ranked cut precedes the per-image array.
    """
    counts = palette.groupBy("image_id", "r", "g", "b").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("image_id").agg(F.sum("n").alias("total"))
    order = W.partitionBy("image_id").orderBy(F.desc("n"), "r", "g", "b")
    top = palette_families(counts.withColumn("rn", F.row_number().over(order)).where("rn <= 9"))
    item = F.struct("rn", "r", "g", "b", "n", "s", "neutral", "family")
    rows = top.groupBy("image_id").agg(F.sort_array(F.collect_list(item)).alias("c")).join(totals, "image_id")
    first, second, total = F.get("c", F.lit(0)), F.get("c", F.lit(1)), F.col("total")
    chromatic = F.get(F.filter("c", lambda x: (x["rn"] > 1) & (x["n"] / total >= 0.12) & ~x["neutral"]), F.lit(0))
    rows = rows.withColumn("dominant", F.when(first["neutral"] & chromatic.isNotNull(), chromatic).otherwise(first))
    multi = F.coalesce(
        (first["s"] >= 0.18) & (second["n"] / total >= 0.30) & (manhattan(first, second) >= 120), F.lit(False)
    )
    white = F.col("dominant.family") == "white"
    other = F.get(F.filter("c", lambda x: (x["rn"] > 1) & (x["rn"] != F.col("dominant.rn"))), F.lit(0))
    rows = rows.withColumn("is_multicolor", multi & ~white).withColumn("second", F.when(~white, other))
    family = F.when(F.col("is_multicolor"), F.lit("multicolor")).otherwise(F.col("dominant.family"))
    rgb = lambda c: F.concat(F.lit("rgb("), c["r"], F.lit(", "), c["g"], F.lit(", "), c["b"], F.lit(")"))
    return rows.select(
        "image_id", rgb(F.col("dominant")).alias("dominant_raw"), family.alias("family"), _family_name(family).alias("dominant_color"),
        F.coalesce(rgb(F.col("second")), F.lit("")).alias("secondary_raw"),
        F.when(F.col("second").isNull(), F.lit("")).otherwise(_family_name(F.col("second.family"))).alias("secondary_color"),
        F.bround(F.least(F.col("dominant.n") / total, F.lit(1.0)), 3).alias("confidence"), "is_multicolor",
        F.when(white, F.array().cast("array<string>")).otherwise(F.transform(F.slice("c", 1, 5), rgb)).alias("palette"),
    )


def background_filter(pixels: DataFrame) -> DataFrame:
    """Pixels (image_id, r, g, b, border, p_r, p_g, p_b) that belong to the product.

    The background is the commonest border colour in buckets of 24; pixels within 40 of it or
    darker than 35 go. An image left without pixels keeps all whose palette colour is not white.
    """
    bucket = lambda c: (F.floor(F.col(c) / 24) * 24).cast("int")
    counts = pixels.where("border").groupBy("image_id", bucket("r").alias("r"), bucket("g").alias("g"), bucket("b").alias("b")).agg(
        F.count("*").alias("n")
    )
    ground = counts.groupBy("image_id").agg(F.max_by(F.struct("r", "g", "b"), F.struct("n", -F.col("r"), -F.col("g"), -F.col("b"))).alias("bg"))
    far = manhattan(F.struct("r", "g", "b"), F.col("bg")) > 40
    bright = 0.2126 * F.col("r") + 0.7152 * F.col("g") + 0.0722 * F.col("b") >= 35
    marked = pixels.join(ground, "image_id").withColumn("keep", far & bright)
    left = marked.groupBy("image_id").agg(F.max("keep").alias("any_kept"))
    near_white = (F.col("p_r") > 245) & (F.col("p_g") > 245) & (F.col("p_b") > 245)
    return marked.join(left, "image_id").where(F.col("keep") | (~F.col("any_kept") & ~near_white)).select(*pixels.columns)


def pick_accepted_color(requests: DataFrame, allowed: DataFrame, group: list[str]) -> DataFrame:
    """(group, family) -> listed value holding most of the family's terms, ten points per term."""
    spark = requests.sparkSession
    terms = spark.createDataFrame([(f, t) for f, ts in V.FAMILY_TERMS.items() for t in ts], "family string, term string")
    terms = terms.withColumn("term", norm_text("term")).groupBy("family").agg(F.collect_list("term").alias("terms"))
    asked = requests.select(*group, "family").distinct().join(F.broadcast(terms), "family")
    key = collapse_spaces(norm_text("value"))
    scored = asked.join(allowed.select(*group, "value", key.alias("key")).distinct(), group).withColumn(
        "score", F.size(F.filter("terms", lambda t: F.contains(F.col("key"), t))) * 10
    )
    best = scored.where("score > 0").groupBy(*group, "family").agg(
        F.min_by("value", F.struct(-F.col("score"), F.length("value"), F.col("value"))).alias("value")
    )
    return requests.select(*group, "family").distinct().join(best, [*group, "family"], "left")


def multicolor_value(allowed: DataFrame, group: list[str]) -> DataFrame:
    """group -> the list's name for multicolour, by alias order."""
    names = F.array(*[F.lit(n) for n in V.MULTICOLOR_NAMES])
    return allowed.where(F.col("value").isin(*V.MULTICOLOR_NAMES)).groupBy(*group).agg(
        F.min_by("value", F.array_position(names, F.col("value"))).alias("multicolor")
    )


def color_rules(categories: DataFrame, overrides: dict[str, float] | None = None) -> DataFrame:
    """category -> lowest colour confidence: the category's own or the default."""
    spark = categories.sparkSession
    own = spark.createDataFrame(list((overrides or V.CATEGORY_COLOR_CONFIDENCE).items()), "category string, own double")
    return categories.select("category").distinct().join(F.broadcast(own), "category", "left").select(
        "category", F.coalesce("own", F.lit(V.MIN_COLOR_CONFIDENCE)).alias("min_confidence"),
        F.when(F.col("own").isNotNull(), F.concat("category", F.lit(" override"))).otherwise(F.lit("default")).alias("source"),
    )


def missing_color_attribute(offers: DataFrame, filled: DataFrame, index: ReferenceIndex) -> DataFrame:
    """offer_id -> first colour attribute to fill: a mandatory one, else any the category lists."""
    spark = offers.sparkSession
    names = spark.createDataFrame(list(enumerate(V.COLOR_ATTRIBUTES)), "priority int, char_name string")
    mandatory = index.attributes.where("mandatory").select("cat", "char_name", F.lit(0).alias("class"))
    listed = index.values.select("cat", "char_name", F.lit(1).alias("class")).distinct()
    wanted = mandatory.unionByName(listed).join(names, "char_name").groupBy("cat", "char_name").agg(
        F.min(F.struct("class", "priority")).alias("o")
    )
    have = filled.where("value_input <> ''").select("offer_id", F.col("char_input").alias("char_name"))
    rows = offers.select("offer_id", "cat").join(wanted, "cat").join(have, ["offer_id", "char_name"], "left_anti")
    return rows.groupBy("offer_id", "cat").agg(F.min_by("char_name", "o").alias("char_name"))


def apply_color(
    offers: DataFrame, colors: DataFrame, filled: DataFrame, index: ReferenceIndex, synonyms: DataFrame, embeddings: DataFrame | None = None,
    suggestion_only: bool = False,
) -> DataFrame:
    """offer_id -> colour attribute filled from its image, or why it needs review.

    ``offers``: offer_id, cat, category; ``colors``: ``palette_color`` with ``image_id`` = offer_id.
    """
    target = missing_color_attribute(offers, filled, index)
    rules = color_rules(offers)
    lists = index.values.select("cat", "char_name", "value")
    group = ["cat", "char_name"]
    rows = (
        offers.select("offer_id", "cat", "category").join(target, ["offer_id", "cat"])
        .join(colors.withColumnRenamed("image_id", "offer_id"), "offer_id").join(rules, "category", "left")
        .join(lists.groupBy(*group).agg(F.count("*").alias("n_values")), group, "left")
        .join(multicolor_value(lists, group), group, "left")
        .withColumn("n_values", F.coalesce("n_values", F.lit(0)))
    )
    rows = staged(rows)  # read twice: by the colour mapping and by the decision
    mapped = map_color(rows.select(*group, F.col("dominant_color").alias("detected")), lists, group, synonyms, embeddings).select(
        *group, F.col("detected").alias("dominant_color"), "mapped_value"
    )
    rows = rows.join(mapped, [*group, "dominant_color"], "left")
    multi = F.col("is_multicolor") & (F.col("confidence") >= V.MULTICOLOR_THRESHOLD)
    single = ~multi & (F.col("dominant_color") != "") & (F.col("confidence") >= F.col("min_confidence"))
    weak = ~multi & ~single & (F.col("dominant_color") != "")
    value = F.when(multi, F.when(F.col("n_values") > 0, F.col("multicolor")).otherwise(F.lit("Multicolor"))).when(
        single, F.when(F.col("n_values") > 0, F.col("mapped_value")).otherwise(F.col("dominant_color"))
    )
    reason = (
        F.when(multi & value.isNull(), F.lit("Multicolor detected but no multicolor value in marketplace list"))
        .when(single & value.isNull(), F.concat(F.lit("Color '"), F.col("dominant_color"), F.lit("' detected but not in marketplace valid values ("),
                                                F.col("n_values"), F.lit(" values)")))
        .when(weak, F.concat(F.lit("Color detected ("), F.col("dominant_color"), F.lit(") but confidence too low ("),
                             F.format_string("%.2f", "confidence"), F.lit(" < "), F.col("min_confidence").cast("string"),
                             F.lit(" ["), F.col("source"), F.lit("])")))
    )
    return rows.select(
        "offer_id", "char_name", F.lit(None).cast("string").alias("value") if suggestion_only else value.alias("value"),
        reason.isNotNull().alias("needs_review"), reason.alias("review_reason"),
    )


# ---------------------------------------------------------------- detections and labels


def best_detection(detections: DataFrame, labels: list[str] | None = None, min_confidence: float = 0.50) -> DataFrame:
    """image_id -> most confident detection of an accepted label; ``crop`` says if it may be cut out."""
    accepted = [x.lower() for x in (V.DETECTION_LABELS if labels is None else labels)]
    rows = detections.where(F.lower("label").isin(*accepted)) if accepted else detections
    best = rows.groupBy("image_id").agg(F.max_by("label", F.struct("confidence", "label")).alias("label"), F.max("confidence").alias("confidence"))
    return best.withColumn("crop", F.col("confidence") >= min_confidence)


def clip_labels(categories: DataFrame) -> DataFrame:
    """category -> up to 25 candidate labels, the category first, distinct without case."""
    labels = F.concat(F.filter(F.array("category"), lambda c: c != ""), F.array(*[F.lit(x) for x in V.CLIP_LABELS]))
    distinct = F.filter(labels, lambda x, i: (i == 0) | (F.lower(x) != F.lower(F.get(labels, F.lit(0)))))
    return categories.select("category").distinct().withColumn("labels", F.slice(distinct, 1, 25))


def validates_label(scores: DataFrame, detected: DataFrame) -> DataFrame:
    """image_id -> does the detected label agree with the best or second best scored label?

    ``scores``: image_id, label, score; ``detected``: image_id, detected_label.
    """
    order = W.partitionBy("image_id").orderBy(F.desc("score"), "label")
    top = scores.withColumn("rn", F.row_number().over(order)).where("rn <= 2")
    either = F.contains(F.lower("label"), F.lower("detected_label")) | F.contains(F.lower("detected_label"), F.lower("label"))
    return top.join(detected.where("detected_label <> ''"), "image_id").groupBy("image_id").agg(F.max(either).alias("validates"))


def image_strategy(colors: DataFrame, strategy: str = "first_only", max_images: int | None = None) -> DataFrame:
    """offer_id -> colour over its images (offer_id, image_no, dominant_color, confidence).

    ``first_only``; ``best_confidence``; ``aggregate_vote``: most frequent, then most confident. All images
    count unless a caller names the last one, ``max_images``.
    """
    if strategy == "first_only":
        return colors.groupBy("offer_id").agg(F.min_by(F.struct("dominant_color", "confidence"), "image_no").alias("c")).select("offer_id", "c.*")
    rows = colors if max_images is None else colors.where(F.col("image_no") <= max_images)
    if strategy == "best_confidence":
        best = F.max_by(F.struct("dominant_color", "confidence"), F.struct("confidence", -F.col("image_no")))
        return rows.groupBy("offer_id").agg(best.alias("c")).select("offer_id", "c.*")
    votes = rows.groupBy("offer_id", "dominant_color").agg(F.count("*").alias("n"), F.max("confidence").alias("confidence"))
    best = F.max_by(F.struct("dominant_color", "confidence"), F.struct("n", "confidence", "dominant_color"))
    return votes.groupBy("offer_id").agg(best.alias("c")).select("offer_id", "c.*")


# ---------------------------------------------------------------- fusion


def action_confidence(action: Column) -> Column:
    out = F.lit(0.0)
    for name, value in V.ACTION_CONFIDENCE.items():
        out = F.when(action == name, F.lit(value)).otherwise(out)
    return out


def fuse_category(signals: DataFrame, policy: str = "review", min_image: float = 0.25, high: float = 0.75, low: float = 0.30) -> DataFrame:
    """Signals (text_candidate, text_confidence, image_candidate, image_confidence) with
    final_category, final_confidence, rule_applied, needs_review and case_name."""
    text, tc = F.coalesce("text_candidate", F.lit("")), F.coalesce("text_confidence", F.lit(0.0))
    image, ic = F.coalesce("image_candidate", F.lit("")), F.coalesce("image_confidence", F.lit(0.0))
    no_image = image == ""
    text_ok = ~text.isin("", "unknown")
    image_ok = ~no_image & (ic >= min_image)
    same = text_ok & image_ok & (F.lower(F.trim(text)) == F.lower(F.trim(image)))
    mean = (tc + ic) / 2
    case = (
        F.when(no_image, "text_only")
        .when(text_ok & (tc >= high), "high_text")
        .when((~text_ok | (tc < low)) & image_ok & (ic >= high), "strong_image")
        .when(same, "agree")
    )
    if policy == "prefer_text":
        case = case.when(text_ok, "policy_text")
    if policy == "prefer_image":
        case = case.when(image_ok, "policy_image")
    text_part, image_part = F.when(text_ok, tc).otherwise(0.0), F.when(image_ok, ic).otherwise(0.0)
    case = (
        case.when((text_part < 0.20) & (image_part < 0.20), "both_weak")
        .when(text_ok & (tc >= image_part), "conflict_text")
        .when(image_ok, "conflict_image")
        .otherwise("conflict_rest")
    )
    rows = signals.withColumn("case_name", case)
    is_case = lambda *names: F.col("case_name").isin(*names)
    return rows.select(
        *signals.columns, "case_name",
        F.when(is_case("both_weak"), F.lit("")).when(is_case("strong_image", "policy_image", "conflict_image"), image).otherwise(text).alias("final_category"),
        F.when(is_case("text_only", "policy_text"), tc)
        .when(is_case("high_text"), F.least(tc + F.when(same, 0.05).otherwise(0.0), F.lit(1.0)))
        .when(is_case("strong_image", "policy_image"), ic)
        .when(is_case("agree"), F.least(mean + F.when(mean >= 0.50, 0.10).otherwise(0.0), F.lit(1.0)))
        .when(is_case("both_weak"), F.lit(0.0))
        .when(is_case("conflict_image"), ic * 0.80).otherwise(tc * 0.80).alias("final_confidence"),
        F.when(is_case("text_only"), "text_only").when(is_case("high_text", "agree", "policy_text"), "prefer_text")
        .when(is_case("strong_image", "policy_image"), "prefer_image").otherwise("review").alias("rule_applied"),
        (is_case("both_weak", "conflict_text", "conflict_image", "conflict_rest")
         | (is_case("high_text") & image_ok & ~same & (ic >= high))).alias("needs_review"),
    )


def policy_table(spark: SparkSession, policy: dict | None = None) -> DataFrame:
    rows = [(n, c, a) for n, (c, a) in (policy or V.IMAGE_POLICY).items()]
    return spark.createDataFrame(rows, "policy_name string, min_confidence double, conflict_action string")


def fusion_policy(names: DataFrame, table: DataFrame, loose: bool = True) -> DataFrame:
    """char_input -> eligible, min_confidence, conflict_action: exact name, else without case."""
    asked = names.select("char_input").distinct()
    exact = asked.join(table.withColumnRenamed("policy_name", "char_input"), "char_input").withColumn("t", F.lit(0))
    hits = exact
    if loose:
        fold = lambda c: casefold(F.trim(c))
        folded = table.withColumn("k", fold("policy_name")).drop("policy_name")
        near = asked.withColumn("k", fold("char_input")).join(folded, "k").drop("k").withColumn("t", F.lit(1))
        hits = exact.unionByName(near)
    best = hits.groupBy("char_input").agg(F.min_by(F.struct("min_confidence", "conflict_action"), "t").alias("p"))
    return asked.join(best, "char_input", "left").select(
        "char_input", F.col("p").isNotNull().alias("eligible"), "p.min_confidence", "p.conflict_action"
    )


def fuse_attributes(signals: DataFrame, index: ReferenceIndex, table: DataFrame, fuzzy: bool = True) -> DataFrame:
    """Text against image value per attribute.

    ``signals``: offer_id, cat, char_input, text_value, text_confidence, text_source, value_input
    (image), image_confidence, image_source. Adds action, final_value, final_confidence, source,
    needs_review.
    """
    rows = signals.join(fusion_policy(signals, table), "char_input", "left").join(match_values(signals, index, fuzzy), KEY, "left")
    image_value = F.coalesce("found", F.when(~F.col("has_values") & ~F.col("restrictive"), F.col("value_input")))
    rows = rows.withColumn("image_ok", F.when(F.col("value_input") != "", image_value))
    text, seen = F.col("text_value"), F.col("image_ok")
    has_text = F.coalesce(text != "", F.lit(False))
    same = F.coalesce(F.lower(seen) == F.lower(text), F.lit(False))
    strong = F.coalesce(F.col("image_confidence") >= F.col("min_confidence"), F.lit(False)) & seen.isNotNull()
    action = (
        F.when(~F.col("eligible"), F.when(has_text, "keep_text").otherwise("skip"))
        .when(has_text & strong & ~same & (F.col("conflict_action") == "review"), "conflict_review")
        .when(has_text, "keep_text")
        .when(strong, "use_vision")
        .otherwise("skip")
    )
    rows = rows.withColumn("action", action)
    tc = F.coalesce("text_confidence", F.lit(0.0))
    return rows.select(
        *signals.columns, "action",
        F.when(F.col("action") == "use_vision", seen).when(F.col("action") != "skip", text).alias("final_value"),
        F.when(F.col("action") == "use_vision", F.col("image_confidence"))
        .when(F.col("action") == "conflict_review", tc * 0.9)
        .when(F.col("action") == "keep_text", F.when(F.col("eligible") & same, F.least(tc + 0.05, F.lit(1.0))).otherwise(tc))
        .otherwise(F.lit(0.0)).alias("final_confidence"),
        F.when(F.col("action") == "use_vision", F.col("image_source")).when(F.col("action") != "skip", F.col("text_source")).otherwise(F.lit("")).alias("source"),
        (F.col("action") == "conflict_review").alias("needs_review"),
    )


def fuse_all(signals: DataFrame, index: ReferenceIndex, table: DataFrame, fuzzy: bool = True) -> DataFrame:
    """Only the attributes the image contributed to."""
    return fuse_attributes(signals, index, table, fuzzy).where(F.col("action").isin("use_vision", "conflict_review"))


def image_suggestions_filter(rows: DataFrame, requested: DataFrame, filled: DataFrame, index: ReferenceIndex, fuzzy: bool = True) -> DataFrame:
    """Image replies (offer_id, cat, char_input, value_input) that were asked for, pass their list and
    fill a gap; rejected ones keep their reason. Columns: value, accept, reason."""
    wanted = rows.join(requested.select("offer_id", "char_input").distinct(), ["offer_id", "char_input"], "left_semi").where("value_input <> ''")
    have = filled.where("value_input <> ''").select("offer_id", "char_input", F.lit(True).alias("filled"))
    checked = wanted.join(match_values(wanted, index, fuzzy), KEY, "left").join(have, ["offer_id", "char_input"], "left")
    value = F.coalesce("found", F.when(~F.col("has_values") & ~F.col("restrictive"), F.col("value_input")))
    return checked.select(
        "offer_id", "cat", "char_input", "value_input", value.alias("value"),
        (value.isNotNull() & F.col("filled").isNull()).alias("accept"),
        F.when(value.isNull(), F.lit("not_in_allowed_list")).when(F.col("filled"), F.lit("already_filled")).otherwise(F.lit("ok")).alias("reason"),
    )


