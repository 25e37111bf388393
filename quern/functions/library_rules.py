"""Which files are libraries, by their names or by marks in their code, and which calls are sensitive by their syntax alone."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

# Libraries by file name (without .js), in order; the pattern of most is a stem and a version.
_STEMS = """
jQuery jquery ignore
Lodash lodash|underscore keep
Axios axios keep
CryptoJS crypto[-_]?js keep
Base64 (?:js-)?base64 keep
""".strip().split("\n")
_STEMS_AFTER = """
Moment moment ignore
DateFns date-fns ignore
Dayjs dayjs ignore
VConsole vconsole ignore
MeScroll mescroll ignore
ECharts echarts ignore
""".strip().split("\n")
_STEMS_LAST = """
D3 d3 ignore
UUID uuid ignore
""".strip().split("\n")
#: Frameworks, their stems, and the words that may stand behind a stem.
_FRAMEWORKS = (("React", "react react-dom react-router react-is"), ("Vue", "vue vue-router vuex"), ("Angular", "angular zone polyfills"), ("MathJS", "mathjs math.js"))
_MARKERS = "min production development runtime global common esm cjs slim prod dev browser umd".split()
#: Marks of libraries in the first 64 Ki characters of code, in order.
CONTENT_MARKS = (
    ("React", r"__reactInternalInstance|_reactRootContainer|react\.production\.min|__SECRET_INTERNALS_DO_NOT_USE"),
    ("Vue", r"__vue__|__VUE_DEVTOOLS_GLOBAL_HOOK__|__VUE_HMR_RUNTIME__"),
    ("Angular", r"platformBrowserDynamic|ng\.probe\b|ɵ[a-zA-Z]|__NG_DEVTOOLS_GLOBAL_HOOK__"),
    ("jQuery", r"(?i)/\*!\s*jQuery(?:\s+JavaScript\s+Library)?\s+v?\d+\.\d+(?:\.\d+)?|(?i)jQuery\s+JavaScript\s+Library\s+v?\d+\.\d+(?:\.\d+)?"),
)
#: Calls and constructions that are sensitive by name.
SINK_CALLS = """
CallExpression fetch
NewExpression XMLHttpRequest
CallExpression $.get
CallExpression $.post
CallExpression $.ajax
CallExpression axios.get
CallExpression axios.post
CallExpression axios.put
CallExpression axios.delete
CallExpression axios.patch
CallExpression navigator.sendBeacon
CallExpression http.request
CallExpression https.request
CallExpression got
CallExpression superagent.get
CallExpression superagent.post
NewExpression WebSocket
NewExpression EventSource
CallExpression eval
NewExpression Function
CallExpression setTimeout
CallExpression setInterval
CallExpression execScript
CallExpression exec
CallExpression spawn
CallExpression fork
CallExpression chrome.runtime.sendMessage
CallExpression chrome.runtime.onMessage.addListener
""".strip().split("\n")


def framework_pattern(stems: list[str]) -> str:
    """A file name that is one of the stems, with a version before or behind any number of markers."""
    version, marker = r"(?:[-@]\d[\w.]*)?", f"(?:[.](?:{'|'.join(_MARKERS)}))*"
    return rf"(?i)(^|[/\\])(?:{'|'.join(map(re.escape, stems))}){version}{marker}{version}$"


def name_rules() -> list[tuple[int, str, str, bool]]:
    """(ord, library, pattern, ignore) of file names."""
    plain = lambda lines: [(n, rf"(?i)(^|[/\\])(?:{stem})([-.][\w.]*)?(\.min)?$", do == "ignore") for n, stem, do in map(str.split, lines)]
    all_ = [
        *plain(_STEMS),
        ("CoreJS", r"(?i)(^|[/\\])core-js([/.-].*)?$", True),
        *plain(_STEMS_AFTER),
        ("ChartJS", r"(?i)(^|[/\\])chart(\.?js)?([-.]\d[\w.]*)?(\.min)?$", True),
        *plain(_STEMS_LAST),
        *((n, framework_pattern(stems.split()), True) for n, stems in _FRAMEWORKS),
    ]
    return [(k, *x) for k, x in enumerate(all_)]


def name_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(name_rules(), "ord int, name string, pattern string, ignore boolean")


def content_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, n, p) for k, (n, p) in enumerate(CONTENT_MARKS)], "ord int, name string, pattern string")


def sink_table(spark: SparkSession) -> DataFrame:
    """type, callee, sink_type: a row for each rule."""
    return spark.createDataFrame([(t, c, c) for t, c in map(str.split, SINK_CALLS)], "type string, callee string, sink_type string")
