"""Rules on shapes, texts, metadata, errors and sessions (F-20 to F-49, V-01 to V-03)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnower.functions.exprs import clamp, col, contains_any, present, ratio, tokens

# Word lists and patterns of the text rules.
BRANDS = [
    "nike", "adidas", "apple", "google", "microsoft", "coca-cola", "pepsi", "mcdonalds", "starbucks", "amazon",
    "facebook", "twitter", "instagram", "youtube", "netflix", "disney", "marvel", "dc comics", "batman", "superman",
]
GRADED_BRANDS = [
    "nike", "adidas", "apple", "google", "microsoft", "coca-cola", "pepsi", "mcdonalds", "starbucks", "amazon",
    "facebook", "twitter", "instagram", "youtube", "netflix", "disney", "marvel", "sony", "samsung", "lg",
]
HIGH_RISK_BRANDS = ["nike", "adidas", "apple", "google", "microsoft", "disney", "marvel"]
INAPPROPRIATE = [
    "nude", "naked", "sex", "porn", "adult", "explicit", "violence", "weapon", "gun", "knife", "blood",
    "drug", "alcohol", "cigarette", "smoking", "hate", "racist", "discrimination",
]
HARSH = ["damn", "hell", "stupid", "idiot", "hate", "kill", "die", "death"]
COMMERCIAL = ["business", "professional", "corporate", "marketing", "advertising"]
PLATES = [r"[A-Z]{2,3}[-\s]?\d{3,4}", r"\d{3}[-\s]?[A-Z]{3}", r"[A-Z]\d{3}[-\s]?[A-Z]{3}", r"\d{1,3}[-\s]?[A-Z]{1,3}[-\s]?\d{1,4}"]
STRICT_PLATES = ["[A-Z]{2,3}[0-9]{3,4}", "[0-9]{3}[A-Z]{3}", "[A-Z][0-9]{3}[A-Z]{3}", "[0-9]{1,3}[A-Z]{1,3}[0-9]{1,4}", "[A-Z]{1,2}[0-9]{1,4}[A-Z]{1,2}", "[0-9]{1,3}[A-Z]{1,3}[0-9]{1,4}"]
PII = {
    "phone": r"(\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}",
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "national_id": r"\b\d{13}\b",
    "card": r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b",
}
NETWORK_ERRORS = ["ConnectionError", "TimeoutError", "HTTPError", "URLError", "ConnectionResetError", "ConnectionRefusedError"]
MEMORY_ERRORS = ["MemoryError", "OutOfMemoryError"]
FILE_ERRORS = ["FileNotFoundError", "PermissionError", "OSError", "IOError", "IsADirectoryError", "NotADirectoryError"]
VALUE_ERRORS = ["ValueError", "TypeError"]
VALIDATION_ERRORS = ["ValueError", "TypeError", "AttributeError", "KeyError", "IndexError"]
CRITICAL_ERRORS = ["SystemError", "KeyboardInterrupt", "SystemExit"]
MAX_RETRIES = {"processing": 2, "file_system": 3, "memory": 1, "network": 5, "configuration": 0, "critical": 0}


def edge_defect_class(area="area", aspect="aspect", solidity="solidity") -> dict[str, Column]:
    """Type and confidence of a contour; null below 100 of area or at a confidence of 0.3 or less."""
    a, s, big = col(aspect), col(solidity), col(area) >= 100
    crack, broken, scratch = (a > 3) & (s < 0.7), (s < 0.8) & (a > 1.5), (a > 2) & (s > 0.7)
    kind = F.when(crack, "crack").when(broken, "break").when(scratch, "scratch").otherwise("edge_anomaly")
    conf = F.when(crack, F.least(F.lit(0.9), a / 10 + 1 - s)).when(broken, F.least(F.lit(0.8), 2 * (1 - s))).when(scratch, F.least(F.lit(0.7), a / 5)).otherwise(0.4)
    return {"defect": F.when(big & (conf > 0.3), kind), "confidence": F.when(big & (conf > 0.3), conf)}


def edge_severity(area="area", aspect="aspect", solidity="solidity") -> Column:
    return F.when((col(area) > 5000) | (col(aspect) > 10), "high").when((col(area) > 1000) | (col(aspect) > 5) | (col(solidity) < 0.5), "medium").otherwise("low")


def object_shape(area, perimeter, width, height) -> Column:
    round_ = 4 * 3.141592653589793 * col(area) / F.nullif(col(perimeter) * col(perimeter), F.lit(0.0))
    aspect = ratio(col(width), col(height))
    return F.when(col(perimeter) == 0, "unknown").when(round_ > 0.7, "circular").when(aspect > 2, "elongated").when(aspect < 0.5, "tall").otherwise("rectangular")


def region_anomalies(std, channels_std) -> Column:
    make = lambda kind, conf: F.struct(F.lit(kind).alias("kind"), conf.alias("confidence"))
    texture, color = F.least(F.lit(0.9), col(std) / 100), F.least(F.lit(0.8), col(channels_std) / 50)
    return F.array_compact(F.array(F.when((col(std) > 50) & (texture >= 0.5), make("texture", texture)), F.when((col(channels_std) > 30) & (color >= 0.5), make("color", color))))


def brand_match(text, confidence=1.0, brands: Sequence[str] = BRANDS) -> Column:
    """The first listed brand that the text contains, at 0.7 confidence or more."""
    low = F.lower(F.trim(col(text)))
    found = F.filter(F.array(*map(F.lit, brands)), lambda b: F.contains(low, b))
    conf = F.lit(confidence) if isinstance(confidence, float) else col(confidence)
    return F.when(conf >= 0.7, F.get(found, 0))


def brand_class(text, brands: Sequence[str] = GRADED_BRANDS) -> dict[str, Column]:
    low = F.lower(F.trim(col(text)))
    exact, within, mark = low.isin(*brands), contains_any(low, brands), col(text).rlike("[®™©]")
    return {"brand_kind": F.when(exact | within, "brand").when(mark, "trademark").otherwise("not_brand"), "brand_confidence": F.when(exact, 0.9).when(within, 0.7).when(mark, 0.8).otherwise(0.1)}


def logo_risk(brand, confidence) -> Column:
    return F.when(col(brand).isin(*HIGH_RISK_BRANDS) & (col(confidence) > 0.8), "critical").when(col(brand).isNotNull() & (col(confidence) > 0.7), "high").when(col(confidence) > 0.5, "medium").otherwise("low")


def plate_matches(text, patterns: Sequence[str] = PLATES) -> Column:
    """Every match of every pattern, whatever the case."""
    return F.concat(*(F.regexp_extract_all(col(text), F.lit("(?i)" + p), F.lit(0)) for p in patterns))


def plate_strict(text, width=None, height=None, patterns: Sequence[str] = STRICT_PLATES) -> Column:
    """The bare plate if the text is one of five or more characters, in a box of aspect 2 to 6 where a box is given."""
    bare = F.upper(F.regexp_replace(col(text), r"[\s-]", ""))
    fits = F.lit(True) if width is None else ratio(col(width), col(height)).between(2, 6)
    return F.when((F.length(bare) >= 5) & bare.rlike("^(" + "|".join(patterns) + ")$") & fits, bare)


def pii_matches(text, patterns: Mapping[str, str] = PII) -> Column:
    return present(*((col(text).rlike(p), kind) for kind, p in patterns.items()))


def face_severity(face_area, image_area) -> Column:
    share = ratio(col(face_area), col(image_area))
    return F.when(share > 0.15, "critical").when(share > 0.05, "high").when(share > 0.01, "medium").otherwise("low")


def _field(m: Column, *names: str) -> Column:
    """The first non-empty value of the names."""
    return F.coalesce(*(F.nullif(F.try_element_at(m, F.lit(n)), F.lit("")) for n in names))


def metadata_issues(metadata) -> Column:
    m = col(metadata)
    text = F.array_join(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"])), "\n")
    device = F.lower(F.concat_ws(" ", _field(m, "Make", "make"), _field(m, "Model", "model")))
    return present(
        (_field(m, "description", "title").isNull(), "missing_description"),
        (F.contains(text, F.lit("GPS")), "gps_data"),
        (device.rlike("iphone|samsung|pixel"), "device_info"),
        (F.lower(F.coalesce(_field(m, "Software", "software"), F.lit(""))).rlike("watermark|trial|demo"), "software_mark"),
    )


def metadata_issues_strict(metadata) -> Column:
    m, brand = col(metadata), "iphone|samsung|pixel"
    has = lambda n: F.lower(F.coalesce(_field(m, n, n.lower()), F.lit(""))).rlike(brand)
    return present(
        (_field(m, "description").isNull(), "missing_description"),
        (_field(m, "title").isNull(), "missing_title"),
        (F.exists(F.map_keys(m), lambda k: F.contains(F.lower(k), F.lit("gps"))), "gps_data"),
        *((has(n), f"device_in_{n.lower()}") for n in ("Make", "Model", "Software")),
    )


def keyword_relevance(words: Column, brands: Sequence[str] = BRANDS, bad: Sequence[str] = INAPPROPRIATE) -> Column:
    """From all tokens of the keyword fields: none 0, else 1 less the share of listed tokens."""
    n, hit = F.size(words), F.size(F.filter(words, lambda t: t.isin(*bad))) + F.size(F.filter(words, lambda t: t.isin(*brands)))
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - hit / n))


def keyword_quality(words: Column, bad: Sequence[str] = INAPPROPRIATE[:11]) -> Column:
    own = F.array_distinct(words)
    return F.when(F.size(own) == 0, 0.0).otherwise(1 - F.size(F.array_intersect(own, F.array(*map(F.lit, bad)))) / F.size(own))


def description_quality(text) -> Column:
    n = F.size(tokens(col(text)))
    return F.when(n == 0, 0.0).when(n < 3, 0.3).when(n < 10, 0.6).otherwise(0.9)


def language_appropriateness(text, words: Sequence[str] = HARSH) -> Column:
    low = F.lower(F.coalesce(col(text), F.lit("")))
    return F.greatest(F.lit(0.0), 1 - 0.2 * F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))))


def commercial_viability(title, description, keywords) -> Column:
    full = lambda c: F.when(F.coalesce(col(c), F.lit("")) != "", 0.1).otherwise(0.0)
    trade = F.when(contains_any(F.lower(F.coalesce(col(description), F.lit(""))), COMMERCIAL), 0.2).otherwise(0.0)
    return F.least(F.lit(1.0), 0.5 + trade + full(title) + full(description) + full(keywords))


def age_rating(score) -> Column:
    return F.when(col(score) >= 0.9, "all_ages").when(col(score) >= 0.7, "teen").when(col(score) >= 0.5, "adult").otherwise("restricted")


def graded_compliance_score(logo_risks, privacy_risks, content, viability) -> Column:
    cost = lambda c, w: F.aggregate(col(c), F.lit(0.0), lambda s, r: s + F.when(r == "critical", w[0]).when(r == "high", w[1]).when(r == "medium", w[2]).otherwise(w[3]))
    return clamp(F.greatest(F.lit(0.0), 1 - cost(logo_risks, (0.4, 0.3, 0.2, 0.1)) - cost(privacy_risks, (0.5, 0.3, 0.2, 0.1))) * col(content) * (0.7 + 0.3 * col(viability)))


def graded_compliance_confidence(confidences, content) -> Column:
    c = F.array_append(col(confidences), col(content))
    return F.aggregate(c, F.lit(0.0), lambda s, x: s + x) / F.size(c)


def graded_compliance_reasons(score, logo_risks, privacy_risks, content) -> Column:
    grave = F.size(F.filter(col(privacy_risks), lambda r: r.isin("high", "critical")))
    return present((col(score) < 0.6, "low_compliance_score"), (F.array_contains(col(logo_risks), "critical"), "critical_logo"), (F.array_contains(col(privacy_risks), "critical"), "critical_privacy"), (col(content) < 0.5, "inappropriate_content"), (grave > 2, "multiple_privacy_violations"))


def error_category(kind="exception_type", component="component") -> Column:
    k, config = col(kind), F.contains(F.lower(F.coalesce(col(component), F.lit(""))), F.lit("config"))
    return (
        F.when(k.isin(*NETWORK_ERRORS), "network").when(k.isin(*MEMORY_ERRORS), "memory").when(k.isin(*FILE_ERRORS), "file_system")
        .when(k.isin(*VALUE_ERRORS) & config, "configuration").when(k.isin(*VALIDATION_ERRORS), "validation").when(k.isin(*CRITICAL_ERRORS), "critical").otherwise("processing")
    )


def error_severity(kind="exception_type", category="category") -> Column:
    c = col(category)
    return F.when(c == "critical", "critical").when(c == "memory", "high").when(col(kind) == "PermissionError", "high").when(c.isin("configuration", "network"), "medium").when(c == "validation", "low").otherwise("medium")


def error_id(kind="exception_type", message="message", component="component") -> Column:
    return F.substring(F.md5(F.concat_ws("_", col(kind), col(message), F.coalesce(col(component), F.lit("unknown")))), 1, 12)


def retry_delay(attempt, base: float = 1.0, most: float = 60.0) -> Column:
    return F.least(F.lit(float(base)) * F.pow(F.lit(2.0), col(attempt)), F.lit(float(most)))


def max_retries(category) -> Column:
    out = F
    for kind, n in MAX_RETRIES.items():
        out = out.when(col(category) == kind, n)
    return out.otherwise(0)


def _seconds(since: str | Column, now: Column) -> Column:
    return F.unix_timestamp(now) - F.unix_timestamp(col(since))


def crash_type(message, updated_at, now: Column) -> Column:
    low, idle = F.lower(F.coalesce(col(message), F.lit(""))), _seconds(updated_at, now)
    return (
        F.when(low.rlike("memory|oom"), "out_of_memory").when(low.rlike("network|connection"), "network_failure").when(low.rlike("crash|exception"), "application_crash")
        .when(idle > 3600, "power_failure").when(idle > 600, "system_crash").otherwise("application_crash")
    )


def data_loss_risk(created_at, rate, now: Column) -> Column:
    lost = F.floor(_seconds(created_at, now) * col(rate))
    return F.when(lost < 10, "low").when(lost < 50, "medium").otherwise("high")


def recovery_action(processed, errors, created_at, now: Column) -> Column:
    return F.when(col(processed) < 10, "fresh_start").when(_seconds(created_at, now) < 120, "continue").when(col(errors) > 0, "restart_batch").otherwise("continue")


def recovery_confidence(errors, memory_mb, created_at, now: Column) -> Column:
    old = _seconds(created_at, now)
    less = F.when(old > 300, 0.2).otherwise(0.0) + F.when(old > 900, 0.3).otherwise(0.0) + 0.1 * col(errors) + F.when(col(memory_mb) > 8000, 0.1).otherwise(0.0)
    return clamp(1 - less)


def resume_options(processed, batch) -> Column:
    return present((F.lit(True), "fresh_start"), (col(processed) > 0, "continue"), (col(batch) > 0, "restart_batch"))


def resume_points(processed, batch_start, total=None, rate=None) -> Column:
    """The options to resume as structs (option, start_index, seconds_left): what is left after the start, at ``rate`` items a second (null without a rate)."""
    done, start = col(processed).cast("long"), col(batch_start).cast("long")
    left = lambda at: F.when(F.lit(None).cast("double").isNotNull(), 0.0) if total is None or rate is None else F.when(col(rate) > 0, F.greatest(F.lit(0), col(total) - at) / col(rate))
    point = lambda option, at: F.struct(F.lit(option).alias("option"), at.alias("start_index"), left(at).cast("double").alias("seconds_left"))
    return F.array_compact(F.array(point("fresh_start", F.lit(0).cast("long")), F.when(done > 0, point("continue", done)), F.when(start > 0, point("restart_batch", start))))


def state_valid(states: DataFrame, sessions: DataFrame, stored: str, *fields: str) -> DataFrame:
    """``states`` with column valid: its stored hash is that of its fields, and its session (session_id) exists."""
    known = sessions.select(F.col("id").alias("_known")).distinct()
    right = F.coalesce(F.col(stored) == state_hash(*fields), F.lit(False))
    return states.join(known, F.col("session_id") == F.col("_known"), "left").withColumn("valid", right & F.col("_known").isNotNull()).drop("_known")


def state_hash(*fields: str) -> Column:
    """sha256 of the JSON of the fields in order of their names; null fields are kept."""
    return F.sha2(F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"}), 256)


def validate_decisions(scores: Sequence[str] = ("quality_score", "defect_score", "similarity_score", "compliance_score", "technical_score")) -> Column:
    """Violations of a decided item with item columns image_path, filename, decision, confidence, reasons and scores."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    outside = lambda c: ~F.coalesce(F.col(c).between(0, 1), F.lit(False))
    few = F.size("reasons") == 0
    grave = F.exists("reasons", lambda r: ~r["severity"].isin("low", "medium", "high", "critical"))
    return present(
        (blank("image_path"), "missing_path"), (blank("filename"), "missing_filename"), (~F.col("decision").isin("approved", "rejected", "review_required"), "invalid_decision"),
        (outside("confidence"), "confidence_out_of_range"), *((outside(s), f"{s}_out_of_range") for s in scores),
        ((F.col("decision") == "rejected") & few, "rejected_without_reasons"), ((F.col("decision") == "approved") & ~few, "approved_with_reasons"), (grave, "invalid_severity"),
    )


def validate_thresholds(params: Mapping[str, object]) -> list[str]:
    """Problems of decision parameters: numbers in 0 to 1, and five weights that add up to 1 within 0.01."""
    bad = []
    weights = params.get("weights", (0.35, 0.25, 0.20, 0.15, 0.05))
    for name, value in params.items():
        if name != "weights" and (isinstance(value, bool) or not isinstance(value, int | float) or not 0 <= value <= 1):
            bad.append(f"{name}: {value!r} is not a number from 0 to 1")
    if len(weights) != 5 or any(isinstance(w, bool) or not isinstance(w, int | float) or not 0 <= w <= 1 for w in weights):
        return [*bad, "weights: five numbers from 0 to 1 are needed"]
    return bad + ([f"weights: their sum is {sum(weights):.4f}"] if abs(sum(weights) - 1) > 0.01 else [])


def validate_ranges(ranges: Mapping[str, tuple[float | None, float | None]], domains: Mapping[str, Sequence[str]]) -> Column:
    """Names of columns outside of their range or domain, nulls excepted."""
    checks = [((F.col(c) < lo) if lo is not None else F.lit(False), c) for c, (lo, _) in ranges.items()]
    checks = [(bad | (F.col(c) > ranges[c][1]) if ranges[c][1] is not None else bad, c) for bad, c in checks]
    return present(*checks, *((~F.col(c).isin(*values), c) for c, values in domains.items()))
