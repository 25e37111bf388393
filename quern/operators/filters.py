"""Row filters: ordered ignore patterns, used scripts, frames in which a flow can't happen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.scalars import ignore_glob_regex, is_ignored_pattern, normal_path, pattern_host


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether the last of the ordered patterns that fits says to ignore the path; `!` negates. One expression for all patterns, without a join."""
    p, out = normal_path(path), F.lit(False)
    for pattern in patterns:
        pattern = pattern.strip()
        if not pattern or pattern.startswith("#"):
            continue
        out = F.when(p.rlike(ignore_glob_regex(pattern.removeprefix("!"))), F.lit(not pattern.startswith("!"))).otherwise(out)
    return F.coalesce(out, F.lit(False))


def used_only(scripts: DataFrame, used: DataFrame, key: str) -> DataFrame:
    return scripts.join(used.select(key).distinct(), key, "left_semi")


def feasible(flows: DataFrame) -> DataFrame:
    """Drops flows that can't happen where they were found: reads of a page's content inside the extension's own pages, web events in backgrounds, and web events that only go from page to page storage. Columns: source_type, sink_type, source_families, sink_families (arrays)."""
    source = lambda f: F.array_contains("source_families", f)
    content, event = F.col("source_type").isin(V.DOCUMENT_SOURCES), F.col("source_type").isin(V.WEB_EVENT_SOURCES)
    own_page = source("EX") | source("DT") | source("OF")
    drop = (content & own_page & ~source("CS")) | (event & (source("BG") | source("OF")) & ~source("CS")) | (event & source("CS") & F.array_contains("sink_families", "CS") & F.col("sink_type").isin(V.WEB_STORAGE_SINKS))
    return flows.filter(~F.coalesce(drop, F.lit(False)))


def string_interpreting(sink_type: Column) -> Column:
    """Whether a sink reads text as code or markup."""
    return sink_type.isin(*V.CODE_SINKS, *V.DOM_SINKS)


def host_restricted(patterns: Column) -> Column:
    """Whether every pattern that counts names a host; true for none."""
    return F.forall(F.filter(patterns, lambda p: ~is_ignored_pattern(p)), lambda p: F.coalesce((p != "<all_urls>") & (pattern_host(p) != "*"), F.lit(False)))
