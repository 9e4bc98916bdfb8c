"""Why a product has several offers of one shop: causes by the evidence of each group, without pairs of its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelore.operators import matching

# The causes, and words of accessories.
CAUSES = {
    "same_listing": "A", "alias_urls": "B", "color": "C", "memory": "D", "screen": "E", "kit": "F", "laptop_configuration": "G", "accessory": "H", "manual_review": "J",
}
ACCESSORY = r"case|cover|tempered|charger|cable|stand|mount|bag"
SOFT_COLOR = ("headphones", "tws", "audio")
#: Largest differences of screens in inches by category that aren't a conflict; others have no such axis.
SCREENS = {"laptop": matching.SCREEN_TOLERANCE, "television": 0.5}


def cpu_conflicts(rows: DataFrame) -> DataFrame:
    """group_id of the groups in which two processors conflict.

    Names agree if one is the beginning of the other; so all do if all agree with the longest, and no pairs are needed.
    """
    known = rows.where("category = 'laptop' AND cpu IS NOT NULL").select("group_id", "cpu").distinct()
    longest = known.groupBy("group_id").agg(F.max_by("cpu", F.struct(F.length("cpu"), "cpu")).alias("longest"))
    return known.join(longest, "group_id").where(~matching.cpus_agree(F.col("cpu"), F.col("longest"))).select("group_id").distinct()


def code_conflicts(rows: DataFrame) -> DataFrame:
    """group_id of the groups in which two rows have model codes and share none.

    Different sets of codes count once. Where one code is in all of a group's sets there is no conflict; elsewhere there is
    one if a set meets fewer sets, by the codes that it shares with them, than there are.
    """
    sets = rows.where(F.size("model_codes") > 0).select("group_id", F.array_join("model_codes", ",").alias("codes")).distinct()
    posts = sets.select("group_id", "codes", F.explode(F.array_distinct(F.split("codes", ","))).alias("code"))
    total = sets.groupBy("group_id").agg(F.count("*").alias("n"))
    widest = posts.groupBy("group_id", "code").agg(F.count("*").alias("in")).groupBy("group_id").agg(F.max("in").alias("widest"))
    rest = total.join(widest, "group_id").where("widest < n").select("group_id", "n")
    left = posts.join(rest.select("group_id"), "group_id", "left_semi")
    met = left.join(left.withColumnRenamed("codes", "other"), ["group_id", "code"]).select("group_id", "codes", "other").distinct()
    return met.groupBy("group_id", "codes").agg(F.count("*").alias("met")).join(rest, "group_id").where("met < n").select("group_id").distinct()


def causes(rows: DataFrame) -> DataFrame:
    """group_id, category, n, cause (a letter of CAUSES) of groups of offers.

    rows: group_id, category, is_product (the row of the product itself: evidence, not an offer), title, brand, ram_gb,
    storage_gb, screen_inch, cpu, gpu, color, kit, model_codes, native_id, url. Any two rows that differ in a known value conflict,
    screens beyond their tolerance; the first cause that holds counts. Null values are no evidence; groups without offers have no row.
    """
    listed = ~F.col("is_product")
    several = lambda c: F.coalesce(F.min(c) < F.max(c), F.lit(False))
    path = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "/+$", "")
    of = lambda c: F.when(listed, c)
    kept = {c: F.when(listed, F.col(c)) for c in ("ram_gb", "storage_gb", "gpu", "cpu", "color")}
    summary = rows.groupBy("group_id", "category").agg(
        F.count_if(listed).alias("n"), *(several(F.col(c)).alias(f"{c}s") for c in ("ram_gb", "storage_gb", "gpu", "color", "kit", "brand")), (F.max("screen_inch") - F.min("screen_inch")).alias("spread"),
        *(several(c).alias(f"own_{name}s") for name, c in kept.items()), F.bool_or(listed & F.lower("title").rlike(ACCESSORY)).alias("accessory"),
        *(x.alias(f"{end}_{name}") for name, c in (("native", of(F.col("native_id"))), ("url", of(F.col("url"))), ("path", of(path))) for end, x in (("min", F.min(c)), ("max", F.max(c)))),
    )
    flagged = summary.where("n > 0")
    for name, found in (("cpus", cpu_conflicts(rows)), ("codes", code_conflicts(rows))):
        flagged = flagged.join(found.withColumn(name, F.lit(True)), "group_id", "left").fillna(False, [name])
    laptop, phone = F.col("category") == "laptop", F.col("category") == "smartphone"
    memory, c = laptop | phone, F.col
    tolerance = F.lit(None).cast("double")
    for category, most in SCREENS.items():
        tolerance = F.when(c("category") == category, most).otherwise(tolerance)
    one = lambda name: F.coalesce((c(f"min_{name}") == c(f"max_{name}")) & (c("n") > 1), F.lit(False))
    many = lambda name: F.coalesce(c(f"min_{name}") < c(f"max_{name}"), F.lit(False))
    conflict = c("brands") | c("codes")
    plain = ~c("own_colors") & ~c("own_storage_gbs") & ~c("own_ram_gbs")
    cause = (
        F.when(phone & c("colors"), "color").when(memory & (c("storage_gbs") | c("ram_gbs")), "memory").when(F.coalesce(c("spread") > tolerance, F.lit(False)), "screen")
        .when((c("category") == "camera") & c("kits"), "kit").when(laptop & (c("gpus") | c("cpus") | c("codes")), "laptop_configuration").when(conflict & c("accessory"), "accessory")
        .when(one("native") | one("url"), "same_listing").when(one("path"), "alias_urls").when(laptop & (c("own_cpus") | c("own_gpus")), "laptop_configuration")
        .when(plain, F.when(many("native") | many("url"), "alias_urls").otherwise("same_listing"))
        .when(c("category").isin(*SOFT_COLOR) & c("own_colors") & ~c("own_storage_gbs") & ~conflict, "alias_urls").otherwise("manual_review")
    )
    letter = F.create_map(*(F.lit(x) for pair in CAUSES.items() for x in pair))[cause]
    return flagged.select("group_id", "category", "n", letter.alias("cause"))
