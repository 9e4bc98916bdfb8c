"""Listings' completeness, enrichment, merging of specifications, similarity of titles, coverage health, roles, and JSON-LD."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from pricelore.functions import offers, specs, text
from pricelore.operators import browse, matching

MATCH, REVIEW = 82.0, 70.0
#: Texts are compared letter by letter up to this length, which bounds one pair's work.
COMPARED = 2_048
# Thresholds of a platform's coverage of a category, orders of enrichment.
USABLE, PRICED, CONFIDENT, REPEATED = 3, 0.50, 0.40, 0.35
ENRICHED = ("amazon", "flipkart", "croma", "reliancedigital", "vijaysales", "poorvika")
CATEGORY_ORDER = ("laptop", "camera", "television", "refrigerator", "washing_machine", "smartphone", "headphones", "tws")
PLATFORM_ORDER = ("amazon", "flipkart", "reliancedigital", "croma")
SPECS = ("ram_gb", "storage_gb", "screen_inch", "cpu", "gpu")


def completeness(rows: DataFrame) -> DataFrame:
    """Adds flags and needs_enrichment to rows with specifications, n_images, n_stores and price. Null counts are 0."""
    n_images, n_stores = (F.coalesce(c, F.lit(0)) for c in ("n_images", "n_stores"))
    known = sum((F.col(c).isNotNull().cast("int") for c in ("cpu", "gpu", "ram_gb", "storage_gb", "screen_inch")), F.lit(0))
    flags = {
        "has_model_number": F.coalesce(F.size("model_codes"), F.lit(0)) > 0, "has_variant_identity": F.coalesce("ram_gb", "storage_gb", "screen_inch").isNotNull(),
        "has_primary_image": n_images >= 1, "has_gallery": n_images >= 2, "has_key_specs": known >= 2, "has_valid_price": F.col("price").isNotNull(), "has_multi_store": n_stores >= 2,
    }
    out = rows.withColumns(flags)
    return out.withColumn("needs_enrichment", ~(F.col("has_gallery") & F.col("has_model_number") & F.col("has_key_specs")))


def order_of(value: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, names)), value), F.lit(0)) + F.when(value.isin(*names), 0).otherwise(len(names) + 1)


def enrichment_due(listings: DataFrame, open_tasks: DataFrame, as_of: str, hours: int = 72, limit: int = 40) -> DataFrame:
    """The first listings due for enrichment: matched, never enriched or not for some hours, and without an open task.

    Shops are counted per product by hash aggregation; the order is a bounded top-k.
    """
    stores = listings.where("match_status = 'matched'").groupBy("product_id").agg(F.countDistinct("platform").alias("n_stores"))
    old = F.col("enriched_at").isNull() | (F.col("enriched_at") < F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {hours} HOURS"))
    due = listings.where((F.col("match_status") == "matched") & F.col("platform").isin(*ENRICHED) & old)
    due = due.join(open_tasks.select("listing_id").distinct(), "listing_id", "left_anti").join(stores, "product_id", "left")
    order = [order_of(F.col("category"), CATEGORY_ORDER), (F.col("n_images") >= 2).cast("int"), (F.coalesce("n_stores", F.lit(1)) < 2).cast("int"), order_of(F.col("platform"), PLATFORM_ORDER), F.desc("last_seen"), F.col("listing_id")]
    return due.orderBy(*order).limit(limit)


def merged_specs(pairs: DataFrame) -> DataFrame:
    """Specifications of pairs of structs a (kept) and b (incoming): a's where known, else b's, all model codes; conflicts keep a's and are named."""
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    out = {c: F.coalesce(a(c), b(c)) for c in SPECS}
    codes = F.transform(F.array_union(a("model_codes"), b("model_codes")), specs.normal_code)
    out["model_codes"] = F.array_sort(F.array_distinct(F.filter(codes, lambda c: c.isNotNull())))
    out["conflicts"] = F.concat_ws(",", *(F.when(a(c) != b(c), c) for c in SPECS))
    return pairs.withColumns(out)


def variant_key(title: Column) -> Column:
    """A laptop's key of category, brand, identity, processor, sizes, graphics and screen; null with fewer than four of the first five known.

    Over rows of matching.with_specs.
    """
    identity = F.coalesce(F.lower(F.get("model_codes", F.lit(0))), "family")
    strong = sum((c.isNotNull().cast("int") for c in (F.col("brand"), identity, F.col("cpu"), F.col("ram_gb"), F.col("storage_gb"))), F.lit(0))
    size = lambda c: F.concat(F.col(c).cast("string"), F.lit("gb"))
    parts = [F.lit("laptop"), F.col("brand"), F.coalesce(identity, F.substring(text.normalise_title(title), 1, 48)), F.col("cpu"), size("ram_gb"), size("storage_gb"), F.coalesce("gpu", F.lit("integrated_or_unknown")), F.col("screen_inch").cast("string")]
    return F.when(strong >= 4, F.concat_ws("|", *(F.replace(F.trim(F.lower(p)), F.lit(" "), F.lit("_")) for p in parts)))


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the letters of matching blocks over all letters of both texts; null as empty."""
    pairs = zip(a.fillna(""), b.fillna(""))
    return pd.Series([difflib.SequenceMatcher(None, x[:COMPARED], y[:COMPARED], autojunk=False).ratio() for x, y in pairs], dtype="float64")


def similarities(pairs: DataFrame) -> DataFrame:
    """Adds jaccard, sequence, shares_code, n_signals, score and weak to pairs with the flags of matching.conflicts(): a score of -100 where one is set.

    Texts are compared without promotions. Without a shared model code and with fewer than three equal signals a
    score is kept under the threshold of a match, or of a review where the titles differ as well.
    """
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    same = lambda x, y: F.coalesce(x == y, F.lit(False))
    near = lambda c, by: F.coalesce(F.abs(a(c) - b(c)) <= by, F.lit(False))
    plain = lambda c: text.normalise_title(offers.without_promotions(c))
    words = lambda c: F.array_distinct(F.filter(F.split(plain(c), " "), lambda t: F.length(t) >= 2))
    both = F.size(F.array_union(words(a("title")), words(b("title"))))
    jaccard = F.when(both > 0, F.size(F.array_intersect(words(a("title")), words(b("title")))) / both).otherwise(0.0)
    out = pairs.withColumns({"jaccard": jaccard, "sequence": sequence_ratio(plain(a("title")), plain(b("title")))})
    series = lambda c: F.regexp_extract(c, "^([^:]*(?::[^:]*)?(?::[^:]*)?)", 1)
    model = F.arrays_overlap(a("model_codes"), b("model_codes"))
    cpu = same(a("cpu"), b("cpu"))
    signals = [same(a("family"), b("family")), model, cpu, near("ram_gb", 0), near("storage_gb", 8), near("screen_inch", 0.3)]
    weights = [(same(a("brand"), b("brand")), 12), *zip(signals, (32, 58, 32, 14, 12, 8)), (~cpu & same(series(a("cpu")), series(b("cpu"))), 15), (same(a("gpu"), b("gpu")), 8)]
    score = sum((F.when(hit, float(weight)).otherwise(0.0) for hit, weight in weights), F.lit(0.0)) + 22 * F.col("jaccard") + 12 * F.col("sequence")
    n = sum((s.cast("int") for s in signals), F.lit(0))
    conflict = F.greatest(*(F.col(f"{c}_conflict") for c in ("brand", "model", "ram", "storage", "screen", "cpu", "gpu")))
    thin, alike = ~model & (n < 3), (n >= 2) & (F.col("jaccard") >= 0.58) & (F.col("sequence") >= 0.67)
    out = out.withColumns({"raw": score, "thin": thin, "alike": alike, "conflict": conflict})
    capped = F.when(F.col("alike"), F.least(F.greatest("raw", F.lit(REVIEW + 2)), F.lit(MATCH - 0.5))).when(F.col("raw") < 92, F.least("raw", F.lit(REVIEW - 1))).otherwise(F.col("raw"))
    final = F.when(F.col("conflict"), -100.0).otherwise(F.round(F.when(F.col("thin"), capped).otherwise(F.col("raw")), 2))
    out = out.withColumns({"shares_code": model, "n_signals": n + same(a("gpu"), b("gpu")).cast("int")})
    return out.withColumns({"score": final, "weak": F.col("thin") & ~F.col("alike") & (F.col("raw") < 92) & ~F.col("conflict")}).drop("raw", "thin", "alike", "conflict")


def assessments(pairs: DataFrame) -> DataFrame:
    """Adds verdict (exact, variant, related, conflict), points, merge_allowed and needs_review to pairs with relation, score and weak.

    Incompatible kinds of product never merge; identities decide next; related pairs by their score.
    """
    kinds = offers.types_compatible(*(offers.product_type(F.col(f"{x}.title"), F.col(f"{x}.category")) for x in "ab"))
    matched = (F.col("score") >= MATCH) & ~F.col("weak")
    verdict = F.when(~kinds, "conflict").when(F.col("relation") != "related", F.col("relation")).when(F.col("score") == -100, "conflict").when(matched, "exact").otherwise("related")
    points = F.when(~kinds, 0.0).when(F.col("relation") == "exact", 1000.0).when(F.col("relation").isin("variant", "conflict"), -100.0).otherwise(F.col("score"))
    out = pairs.withColumns({"verdict": verdict, "points": points})
    return out.withColumns({"merge_allowed": F.col("verdict") == "exact", "needs_review": (F.col("verdict") == "related") & (F.col("points") >= REVIEW)})


def safe_pairs(pairs: DataFrame) -> DataFrame:
    """The assessed pairs that may merge unseen.

    Safe are exact identities, and pairs of 92 points or more of one category and brand, not weak, with an equal
    variant_key, a shared code and another signal, or many signals and like titles.
    """
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    kin = (a("category") == b("category")) & (F.coalesce(a("brand"), F.lit("")) == F.coalesce(b("brand"), F.lit("")))
    many = ((F.col("n_signals") >= 5) & (F.col("jaccard") >= 0.38)) | ((F.col("points") >= 98) & (F.col("n_signals") >= 4) & (F.col("sequence") >= 0.55))
    strong = F.coalesce(a("variant_key") == b("variant_key"), F.lit(False)) | (F.col("shares_code") & (F.col("n_signals") >= 2)) | many
    return pairs.where((F.col("verdict") != "conflict") & (F.col("points") >= 92) & ((F.col("relation") == "exact") | (~F.col("weak") & kin & strong)))


def suggestions(text_: str, ranked: DataFrame, categories: DataFrame, limit: int = 6, most_categories: int = 4) -> DataFrame:
    """kind, position, value: the first products of a ranked search and the categories (place, slug, words) that a query's text or words occur in.

    A declared top-k. A query under two characters has all categories and no products.
    """
    asked = text_.strip().lower()
    top = lambda rows, order, kind, value: browse.page(rows, order, limit if kind == "product" else most_categories).select(F.lit(kind).alias("kind"), F.col("position").cast("long").alias("position"), F.col(value).cast("string").alias("value"))
    if len(asked) < 2:
        return categories.select(F.lit("category").alias("kind"), F.col("place").cast("long").alias("position"), F.col("slug").alias("value"))
    named = F.lower("words").contains(asked)
    for word in (w for w in asked.split() if len(w) > 1):
        named = named | F.lower("words").contains(word)
    return top(ranked, [F.desc("score"), F.asc("product_id")], "product", "product_id").unionByName(top(categories.where(named), [F.asc("place")], "category", "slug"))


def same_identity(rows: DataFrame, key: str) -> DataFrame:
    """head, the row of a key with most shops, then most listings, then smallest title_id; and n, its rows. Null keys stay alone.

    One aggregation and one join: no group is collected.
    """
    best = F.struct(F.col("n_stores"), F.col("n_listings"), (-F.col("title_id")).alias("title_id"))
    heads = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(best).alias("best"), F.count("*").alias("n"))
    heads = heads.select(key, (-F.col("best.title_id")).alias("head"), "n")
    return rows.join(heads, key, "left").withColumns({"head": F.coalesce("head", "title_id"), "n": F.coalesce("n", F.lit(1).cast("long"))})


def repointed(children: DataFrame, roots: DataFrame, key: str = "product_id") -> DataFrame:
    """Children of merged products under their roots (product_id, root); those of others stay. was is the key before."""
    moved = roots.where(F.col("root") != F.col(key)).select(F.col(key), "root")
    return children.join(moved, key, "left").withColumns({"was": F.col(key), key: F.coalesce("root", key)}).drop("root")


def dates_to_rebuild(children: DataFrame, key: str = "product_id") -> DataFrame:
    """Different keys and days whose rollups a merge changed: those left and those entered. Over rows of repointed()."""
    moved = children.where(F.col("was") != F.col(key))
    return moved.select(F.explode(F.array("was", key)).alias(key), "day").distinct()


def coverage_health(listings: DataFrame, supported: DataFrame) -> DataFrame:
    """Counts, rates and a status for each platform and category, of supported ones also where nothing is found."""
    found = listings.groupBy("platform", "category").agg(
        F.count("*").alias("discovered"), F.count_if(F.col("match_status") == "matched").alias("accepted"), F.avg((F.col("price") > 0).cast("double")).alias("priced"),
        (1 - F.countDistinct("product_id") / F.count("*")).alias("repeated"), F.avg((F.coalesce("category", F.lit("unknown")) != "unknown").cast("double")).alias("confident"),
    )
    rows = found.join(supported.select("platform", "category", F.lit(True).alias("supported")), ["platform", "category"], "full").na.fill(0, ["discovered", "accepted"])
    good = (F.col("discovered") >= USABLE) & (F.col("accepted") >= USABLE) & (F.col("priced") >= PRICED) & (F.col("confident") >= CONFIDENT) & (F.col("repeated") <= REPEATED)
    status = F.when(F.col("supported").isNull(), "unsupported").when(F.col("discovered") == 0, "empty").when(good, "healthy").when((F.col("accepted") >= 1) & (F.col("accepted") < USABLE), "partial").otherwise("degraded")
    return rows.select("platform", "category", "discovered", "accepted", F.round("priced", 3).alias("price_rate"), F.round("repeated", 3).alias("duplicate_rate"), status.alias("status"))


def listing_roles(listings: DataFrame) -> DataFrame:
    """primary or alias for matched listings of a product and platform with several: the primary is in stock, cheapest, of smallest id.

    exact_clone: all of them have one native id. By aggregation and a join, so that a hot product isn't one task's sort.
    """
    rows = listings.where("match_status = 'matched'")
    first = F.struct((F.col("stock") != "in_stock").alias("out"), "price", "listing_id")
    groups = rows.groupBy("product_id", "platform").agg(F.count("*").alias("n"), F.min(first).alias("first"), F.countDistinct("native_id").alias("n_native"))
    groups = groups.where("n > 1").select("product_id", "platform", "n", F.col("first.listing_id").alias("primary_id"), (F.col("n_native") <= 1).alias("exact_clone"))
    return rows.join(groups, ["product_id", "platform"]).withColumn("role", F.when(F.col("listing_id") == F.col("primary_id"), "primary").otherwise("alias"))


def code_relations(found: DataFrame) -> DataFrame:
    """Pairs of identities that share a code, with conflicts, relation and similarities."""
    return assessments(similarities(matching.relations(matching.conflicts(matching.code_pairs(found)))))
