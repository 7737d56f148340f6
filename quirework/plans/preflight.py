"""Pre-flight: may a job of this size run here, and what is known about it.

Verdicts rest on runs that were measured. One run has to cover a job in pages
and in size at once; runs are never added up. What was not measured is unknown,
and null stays null: no time without a rate, no memory verdict without a band.
The tables are small and fixed, and become literals in the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.functions.text import classify_error, fmt_bytes, human_error, plural_pages, round_half_up

# Measured runs by device class, operation, pages, MB (null: size did not matter), and name.
RUNS = (
    ("desktop", "raster-export", 1000, 396.72, "scan-1000p"),
    ("desktop", "editor", 1000, 396.72, "scan-1000p"),
    ("desktop", "requant", 1000, 396.72, "scan-1000p"),
    ("desktop", "multi-doc", 1600, 634.60, "600p+1000p merge"),
    ("desktop", "structural", 3000, None, "text-3000p"),
    ("desktop", "ocr", 300, 118.99, "scan-300p"),
    ("mobile", "requant", 300, 118.99, "scan-300p"),
    ("mobile", "raster-export", 100, 39.77, "scan-100p"),
    ("mobile", "editor", 100, 39.77, "scan-100p"),
    ("mobile", "editor", 1000, 2.32, "text-1000p"),
)
# Seconds by page and by MB, least and most.
RATES = (
    ("desktop", "raster-export", 0.074, 0.108, 0.180, 0.272),
    ("desktop", "editor", 0.073, 0.090, 0.120, 0.185),
    ("desktop", "requant", 0.071, 0.086, 0.120, 0.179),
    ("desktop", "ocr", 1.489, 1.489, 3.754, 3.754),
    ("desktop", "multi-doc", 0.003, 0.004, 0.008, 0.009),
    ("mobile", "raster-export", 0.10, 1.20, 0.25, 3.00),
    ("mobile", "editor", 0.10, 0.40, 0.25, 1.00),
    ("mobile", "requant", 0.10, 0.34, 0.25, 0.84),
)
# Peak memory in MB by operation, least and most.
BANDS = (("raster-export", 1807, 2721), ("editor", 1347, 2074), ("ocr", 1279, 1669), ("requant", 720, 1359), ("multi-doc", 767, 2143), ("structural", 688, 721))
# Reports from two phones: device, browser, operation, run, pages, MB, outcome, seconds at least and at most.
PHONES = (
    ("iphone-14", "safari", "editor", "scan-100p", 100, 39.76, "complete", 10, 20),
    ("iphone-14", "safari", "requant", "scan-100p", 100, 39.76, "complete", None, None),
    ("iphone-14", "safari", "requant", "scan-300p", 300, 118.99, "complete", 30, 40),
    ("iphone-14", "safari", "raster-export", "scan-100p", 100, 39.76, "complete", 10, 20),
    ("iphone-14", "safari", "editor", "text-1000p", 1000, 2.31, "complete-degraded", None, None),
    ("mi-generic", "chrome", "editor", "scan-100p", 100, 39.76, "complete", 30, 40),
    ("mi-generic", "chrome", "requant", "scan-100p", 100, 39.76, "complete", 40, 60),
    ("mi-generic", "chrome", "requant", "scan-300p", 300, 118.99, "complete", 60, 100),
    ("mi-generic", "chrome", "raster-export", "scan-100p", 100, 39.76, "complete", None, 120),
    ("mi-generic", "chrome", "editor", "text-1000p", 1000, 2.31, "complete-degraded", 10, 20),
)
# Operation by tool; all others are structural.
TOOLS = {
    "pdf-to-jpg": "raster-export", "extract-images": "raster-export", "deskew-pdf": "raster-export", "html-to-pdf": "raster-export", "flatten-pdf": "raster-export", "redact-pdf": "raster-export",
    "ocr-pdf": "ocr", "merge-pdf": "multi-doc", "compress-pdf": "requant", "pdf-editor": "editor", "fill-sign": "editor", "sign-pdf": "editor", "passport-photo": "raster-export",
    "remove-background": "raster-export", "resize-image": "raster-export", "heic-convert": "raster-export", "email-to-pdf": "raster-export", "split-book-scan": "raster-export", "remove-blank-pages": "raster-export",
}
RANGE_TOOLS = ("split-pdf", "rotate-pdf", "split-by-bookmarks", "pdf-to-jpg", "add-page-numbers")
ZIP_ENTRIES, ZIP_BYTES, ZIP_MB_A_PAGE, MB = 65_535, 4_294_967_295, 0.1834, 1_048_576
LONG_ON_PHONE = 300
#: Mode to pages in a batch, pages in the cache, area of a canvas, and previews.
SHAPES = {"standard": (8, 3, 16_000_000, True), "low": (4, 1, 4_000_000, False)}

MODE_TEXT = {
    "standard": "This runs as usual here.",
    "low-memory": "Memory is spared: smaller batches and fewer previews, at some cost in time.",
    "selected-pages": "Choose a range of pages and run it as often as needed; memory is spared.",
    "desktop-recommended": "No phone has been tried with this much. A desktop is the better place; it can be tried here all the same.",
    "unsupported-safely": "No valid file of this size can be made, so nothing is started. The input is unchanged.",
}
SAID = {
    "chosen": "Low memory was chosen: smaller batches and fewer previews.",
    "signal": "The device reports little memory, and none like it has been measured; memory is spared.",
    "precaution": "This has not been tried on a phone at this size, so memory is spared to be safe.",
    "pages-precaution": "This has not been tried on a phone at this size. Choose a range of pages; memory is spared to be safe.",
    "unknown": "No device like this has been measured; the input is never changed.",
    "private": "All work is done locally.",
    "zip": "An archive this large may not open everywhere; export in ranges.",
    "beyond": "This is more than has been tested; how long it takes is not known.",
    "scroll": "A document this long opens on a phone but scrolls slowly.",
}


def evidence(spark: SparkSession, name: str) -> DataFrame:
    """A table of evidence: runs, rates, bands or phones."""
    tables = {
        "runs": (RUNS, "device string, op string, pages long, mb double, run string"),
        "rates": (RATES, "device string, op string, page_lo double, page_hi double, mb_lo double, mb_hi double"),
        "bands": (BANDS, "op string, lo_mb long, hi_mb long"),
        "phones": (PHONES, "device string, browser string, op string, run string, pages long, mb double, outcome string, lo_s long, hi_s long"),
    }
    return spark.createDataFrame(*tables[name])


def op_class(tool: Column) -> Column:
    out = F.lit("structural")
    for name, op in TOOLS.items():
        out = F.when(tool == name, op).otherwise(out)
    return out


def covering_run(device: Column, op: Column, pages: Column, mb: Column) -> Column:
    """The name of the first run that covers a job in pages and in size; null without one."""
    out = F.lit(None).cast("string")
    for d, o, p, m, run in reversed(RUNS):
        fits = (device == d) & (op == o) & (pages <= p)
        out = F.when(fits & (mb <= m) if m is not None else fits, run).otherwise(out)
    return out


def estimate_seconds(device: Column, op: Column, pages: Column, mb: Column) -> Column:
    """(lo, hi): the greater of what pages and size ask for; null without a rate, or for nothing."""
    out = F.lit(None).cast("struct<lo:double,hi:double>")
    for d, o, p0, p1, m0, m1 in RATES:
        both = F.struct(F.greatest(pages * p0, mb * m0).cast("double").alias("lo"), F.greatest(pages * p1, mb * m1).cast("double").alias("hi"))
        out = F.when((device == d) & (op == o) & (both["hi"] > 0), both).otherwise(out)
    return out


def content_type(pages: Column, size: Column) -> Column:
    kb = size / 1024 / pages
    return F.when(~((pages > 0) & (size > 0)) | pages.isNull() | size.isNull(), "unknown").when(kb > 150, "scanned").when(kb < 20, "text").otherwise("mixed")


def detect_type(text_runs: Column, sampled: Column, pages: Column, size: Column) -> Column:
    """From the text runs on the sampled pages: without text scanned, else by the size of a page. Null where the text could not be read."""
    many = text_runs > 8 * sampled
    kb = F.when(pages > 0, size / 1024 / pages).otherwise(0)
    return F.when(many & (kb > 150), "mixed").when(many, "text").when(~many, "scanned")


def device_profile(user_agent: Column, memory: Column) -> Column:
    """(device, low_signal, known). A phone that reports nothing is unknown, not bad."""
    mobile = F.coalesce(F.rlike(user_agent, F.lit("(?i)Android|iPhone|iPad|iPod|Mobile Safari|Windows Phone")), F.lit(False))
    low = F.coalesce((memory > 0) & (memory <= 2), F.lit(False))
    return F.struct(F.when(mobile, "mobile").otherwise("desktop").alias("device"), low.alias("low_signal"), ((~mobile | F.coalesce(memory >= 4, F.lit(False))) & ~low).alias("known"))


def preflight(jobs: DataFrame) -> DataFrame:
    """A plan for each job: jobs with columns tool, op, device, low_signal, known, pages, size, force; one projection, no join."""
    op, device, pages = F.col("op"), F.col("device"), F.coalesce("pages", F.lit(0))
    mb = F.coalesce("size", F.lit(0)) / MB
    run = covering_run(device, op, pages, mb)
    on_desktop = covering_run(F.lit("desktop"), op, pages, mb)
    capped = (op == "raster-export") & (pages > ZIP_ENTRIES)
    ranged = F.coalesce(F.col("tool").isin(*RANGE_TOOLS), F.lit(False))
    mode = (
        F.when(capped, "unsupported-safely")
        .when(F.col("low_signal"), "low-memory")
        .when(run.isNotNull() | (device == "desktop"), "standard")
        .when(on_desktop.isNotNull(), F.when(ranged, "selected-pages").otherwise("low-memory"))
        .otherwise("desktop-recommended")
    )
    force = F.col("force")
    mode = F.when(force == "low-memory", "low-memory").when((force == "standard") & ~capped, "standard").otherwise(mode)
    measured = op.isin(*(b[0] for b in BANDS))
    memory = (
        F.when(capped | F.col("low_signal"), "unknown")
        .when((device == "desktop") & measured, F.when(run.isNotNull(), "within-measured-envelope").otherwise("beyond-measured-envelope"))
        .when((device == "mobile") & run.isNotNull(), "within-observed-envelope")
        .otherwise("unknown")
    )
    cautions = F.array_compact(
        F.array(
            F.when(~capped & (op == "raster-export") & (pages * ZIP_MB_A_PAGE * MB > ZIP_BYTES), "zip"),
            F.when(~capped & ~F.col("low_signal") & run.isNull() & (device == "desktop"), "beyond"),
            F.when(~capped & (device == "mobile") & (op == "editor") & (pages > LONG_ON_PHONE), "scroll"),
        )
    )
    plan = jobs.withColumns({"mode": mode, "run": run, "memory": memory, "cautions": cautions, "time": F.when(~capped, estimate_seconds(device, op, pages, mb)), "content": content_type(F.col("pages"), F.col("size"))})
    small = F.col("mode").isin("low-memory", "selected-pages")
    chosen = F.when(force.isin("low-memory", "standard"), force)
    shape = lambda i: F.when(small, F.lit(SHAPES["low"][i])).otherwise(F.lit(SHAPES["standard"][i]))
    return plan.withColumns(
        {
            "precaution": small & (F.col("memory") == "unknown") & ~F.col("low_signal") & chosen.isNull(),
            "chosen": chosen,
            "calibrated": (device == "desktop") & measured,
            "blocked": F.col("mode") == "unsupported-safely",
            "offer_low_memory": ~F.col("mode").isin("low-memory", "selected-pages", "unsupported-safely"),
            "offer_standard": (F.col("mode") == "low-memory") & ~F.col("low_signal"),
            "offer_pages": ranged & (F.col("mode") != "standard"),
            "offer_desktop": F.col("mode").isin("desktop-recommended", "unsupported-safely"),
            "batch": shape(0), "page_cache": shape(1), "canvas_area": shape(2), "previews": shape(3),
        }
    )


def fmt_duration(s: Column) -> Column:
    """In steps of five seconds, then about a minute, minutes, and hours with one decimal where it is not zero."""
    n = lambda x: x.cast("long").cast("string")
    tenths = round_half_up(s / 360)
    hours = F.when(tenths % 10 == 0, n(tenths / 10)).otherwise(F.concat(n(F.floor(tenths / 10)), F.lit("."), n(tenths % 10)))
    return (
        F.when(s < 45, F.concat(n(F.greatest(F.lit(5), round_half_up(s / 5) * 5)), F.lit(" seconds")))
        .when(s < 90, "about a minute")
        .when(s < 3600, F.concat(n(round_half_up(s / 60)), F.lit(" minutes")))
        .otherwise(F.concat(hours, F.lit(" hours")))
    )


def time_sentence(time: Column) -> Column:
    lo, hi = fmt_duration(time["lo"]), fmt_duration(time["hi"])
    return F.when(time.isNotNull(), F.concat(F.lit("Measured devices take "), F.when(lo == hi, F.concat(F.lit("about "), lo)).otherwise(F.concat(lo, F.lit(" to "), hi)), F.lit(".")))


def sentences(plans: DataFrame) -> DataFrame:
    """plans with facts (a line on the file) and prose (sentences in order)."""
    mode = F.col("mode")
    text = F.create_map(*(F.lit(x) for k, v in MODE_TEXT.items() for x in (k, v)))[mode]
    own = (
        F.when((mode == "low-memory") & (F.col("chosen") == "low-memory"), SAID["chosen"])
        .when((mode == "low-memory") & F.col("low_signal"), SAID["signal"])
        .when((mode == "low-memory") & F.col("precaution"), SAID["precaution"])
        .when((mode == "selected-pages") & F.col("precaution"), SAID["pages-precaution"])
    )
    unknown = F.when(~F.col("known") & ~F.col("blocked") & own.isNull(), SAID["unknown"])
    limit = F.when(F.col("blocked"), f"The archive format holds {ZIP_ENTRIES} files at most.")
    warned = [F.when(F.array_contains("cautions", k), SAID[k]) for k in ("zip", "beyond", "scroll")]
    prose = F.array_compact(F.array(F.coalesce(own, text), limit, unknown, *warned, time_sentence(F.col("time")), F.lit(SAID["private"])))
    facts = F.concat_ws(" · ", fmt_bytes(F.coalesce("size", F.lit(0))), plural_pages(F.coalesce("pages", F.lit(0))), F.col("content"))
    return plans.withColumns({"facts": facts, "prose": prose})


def progress(done: Column, total: Column) -> Column:
    return F.least(F.lit(100), F.greatest(F.lit(0), round_half_up(100 * done / total))).cast("int")


def run_receipts(runs: DataFrame) -> DataFrame:
    """Receipts of runs: outcome from the error, its kind, and what to tell. runs: error, phase."""
    kind = F.when(F.col("error").isNotNull(), classify_error(F.col("error")))
    outcome = F.when(kind.isNull(), "ok").when(kind == "cancelled", "cancelled").otherwise("failed")
    told = F.when(outcome == "failed", F.concat_ws(" ", human_error(F.col("error")), F.concat(F.lit("It happened while "), F.col("phase"), F.lit(".")), F.lit("The input is unchanged.")))
    return runs.withColumns({"outcome": outcome, "failure": kind, "message": told})
