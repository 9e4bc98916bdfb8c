"""Product identities out of titles' specifications, their conflicts and relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelore.functions import specs

#: Largest difference of screens in inches that isn't a conflict.
SCREEN_TOLERANCE = 0.25


def with_specs(titles: DataFrame) -> DataFrame:
    """Adds brand, ram_gb, storage_gb, screen_inch, cpu, gpu, family and model_codes to titles (title)."""
    t = F.col("title")
    return titles.withColumns({
        "brand": specs.brand(t), "ram_gb": specs.ram_gb(t), "storage_gb": specs.storage_gb(t), "screen_inch": specs.screen_inch(t),
        "cpu": specs.cpu(t), "gpu": specs.gpu(t), "family": specs.family(t), "model_codes": specs.model_codes(t),
    })


def fingerprint(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("?")) for p in parts)), 256)


def identities(titles: DataFrame) -> DataFrame:
    """with_specs(titles), with exact_fingerprint and family_fingerprint (null without brand, or without family and codes).

    Without model codes, the title itself is part of the exact identity.
    """
    return with_fingerprints(with_specs(titles))


def with_fingerprints(rows: DataFrame) -> DataFrame:
    """Adds exact_fingerprint and family_fingerprint to titles (category, title) with specifications."""
    codes = F.array_join("model_codes", ",")
    own = F.when(F.size("model_codes") == 0, specs.folded(F.col("title"))).otherwise("")
    screen = F.round(F.col("screen_inch") * 10).cast("int")
    line = F.coalesce("family", F.lower(F.regexp_extract(F.get("model_codes", F.lit(0)), "^([^-_/]*)", 1)))
    exact = fingerprint(F.col("category"), F.col("brand"), codes, F.col("cpu"), F.col("ram_gb"), F.col("storage_gb"), screen, F.col("gpu"), own)
    return rows.withColumns({"exact_fingerprint": exact, "family_fingerprint": F.when(F.col("brand").isNotNull() & line.isNotNull(), fingerprint(F.col("category"), F.col("brand"), line))})


def differ(a: Column, b: Column, tolerance: float = 0.0) -> Column:
    """Both are known, and further apart than the tolerance."""
    return F.coalesce(F.abs(a - b) > tolerance, F.lit(False))


def cpus_agree(a: Column, b: Column) -> Column:
    """One is unknown, or they are equal, or one names the other's model; the generations' spellings count as one.

    A chip's tier (pro, max, ultra) isn't a model of the chip without one.
    """
    a, b = (F.regexp_replace(x, "^intel_core_(?:i|new)(:|$)", "intel_core$1") for x in (a, b))
    tier = lambda x: F.regexp_extract(x, "(?:^|:)(pro|max|ultra)$", 1)
    inside = (tier(a) == tier(b)) & (F.startswith(a, F.concat(b, F.lit(":"))) | F.startswith(b, F.concat(a, F.lit(":"))))
    return F.coalesce((a == b) | inside, F.lit(True))


def conflicts(pairs: DataFrame) -> DataFrame:
    """Adds a flag for each kind of conflict to pairs of structs a and b (identities); unknown values are in no conflict."""
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    return pairs.withColumns({
        "brand_conflict": F.coalesce(a("brand") != b("brand"), F.lit(False)),
        "model_conflict": (F.size(a("model_codes")) > 0) & (F.size(b("model_codes")) > 0) & ~F.arrays_overlap(a("model_codes"), b("model_codes")),
        "ram_conflict": differ(a("ram_gb"), b("ram_gb")), "storage_conflict": differ(a("storage_gb"), b("storage_gb")),
        "screen_conflict": differ(a("screen_inch"), b("screen_inch"), SCREEN_TOLERANCE),
        "cpu_conflict": ~cpus_agree(a("cpu"), b("cpu")), "gpu_conflict": F.coalesce(a("gpu") != b("gpu"), F.lit(False)),
    })


def relations(pairs: DataFrame) -> DataFrame:
    """Adds relation (exact, variant, related, conflict) to pairs with the flags of conflicts().

    A shared strong code makes two products one unless their specifications conflict; a short series code does so only
    with equal graphics; a shared family makes variants where something conflicts.
    """
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    shared = F.array_intersect(a("model_codes"), b("model_codes"))
    strong = F.exists(shared, lambda c: ~c.rlike(specs.WEAK_CODE))
    specs_differ = F.col("ram_conflict") | F.col("storage_conflict") | F.col("screen_conflict")
    clear = ~specs_differ & ~F.col("cpu_conflict") & ~F.col("gpu_conflict")
    any_conflict = ~clear | F.col("model_conflict")
    same_gpu = F.coalesce(a("gpu") == b("gpu"), F.lit(False))
    series = lambda c: F.regexp_extract(c, "^([^:]*(?::[^:]*)?(?::[^:]*)?)", 1)
    akin = F.coalesce(a("brand") == b("brand"), F.lit(False)) & (a("family").eqNullSafe(b("family")) | series(a("cpu")).eqNullSafe(series(b("cpu"))))
    relation = (
        F.when(F.col("brand_conflict"), "conflict").when(strong & clear, "exact")
        .when((F.size(shared) > 0) & ~strong & clear, F.when(same_gpu, "exact").otherwise("related"))
        .when(a("exact_fingerprint") == b("exact_fingerprint"), "exact")
        .when(a("family_fingerprint") == b("family_fingerprint"), F.when(any_conflict, "variant").otherwise("exact"))
        .when(akin, "related").when(F.col("model_conflict") & F.col("cpu_conflict"), "conflict").otherwise("related")
    )
    return pairs.withColumn("relation", relation)


def code_pairs(found: DataFrame) -> DataFrame:
    """Pairs a, b of different identities (exact fingerprints, each by its smallest title_id) that share a model code.

    Titles of one identity are one row before they meet, so that copies of a title don't meet each other.
    """
    one = found.groupBy("exact_fingerprint").agg(F.min_by(F.struct(*(c for c in found.columns)), "title_id").alias("x"))
    coded = one.select(F.col("x.title_id").alias("i"), F.explode("x.model_codes").alias("code"))
    ids = coded.join(coded.withColumnRenamed("i", "j"), "code").where("i < j").select("i", "j").distinct()  # ids only, until each pair is there once
    a, b = (one.select(F.col("x.title_id").alias(k), F.col("x").alias(side)) for k, side in (("i", "a"), ("j", "b")))
    return ids.join(a, "i").join(b, "j").select("a", "b")
