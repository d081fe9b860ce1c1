"""Text guardrails as batch audits.

Every check is a Column producing a ``struct<passed, severity, rule, message,
detail>`` per row; ``*_eval`` gathers the checks of one row into an array and
explodes it to long form. Patterns are matched by the JVM regex engine inside
codegen; no text leaves the executors and texts are always processed whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.functions import lexicons as L
from churnlens.functions.lexicons import MESSAGES
from churnlens.functions.rules import first_characters


def result(passed: Column, severity: Column, rule: str, message: Column, detail: Column | None = None) -> Column:
    return F.struct(passed.alias("passed"), severity.alias("severity"), F.lit(rule).alias("rule"),
                    message.alias("message"),
                    (detail if detail is not None else F.lit(None).cast("string")).alias("detail"))


# -- input checks -----------------------------------------------------------------------------
def input_schema(text: Column) -> Column:
    """G1: a missing (non-string) value blocks; the empty string passes."""
    ok = text.isNotNull()
    return result(ok, F.when(ok, "pass").otherwise("block"), "input_schema",
                  F.when(ok, F.lit(MESSAGES["input_ok"])).otherwise(F.lit(MESSAGES["input_missing"])),
                  F.when(~ok, F.lit("type=NoneType")))


def length_cap(text: Column, max_chars: int = L.MAX_INPUT_CHARS) -> Column:
    """More than ``max_chars`` characters blocks."""
    n = F.length(text)
    ok = n <= max_chars
    return result(ok, F.when(ok, "pass").otherwise("block"), "length_cap",
                  F.when(ok, F.format_string(MESSAGES["length_ok"].format(cap=max_chars), n))
                  .otherwise(F.format_string(MESSAGES["length_over"].format(cap=max_chars), n)),
                  F.when(~ok, F.format_string(f"length=%d;cap={max_chars}", n)))


def _matched(text: Column, patterns: list[str]) -> Column:
    return F.filter(F.array(*[F.when(text.rlike("(?i)" + p), F.lit(p)) for p in patterns]),
                    lambda x: x.isNotNull())


def any_of(patterns: list[str]) -> str:
    """One pattern that matches where any of them does. The engine tries the alternatives only at a
    character that one of them can start with."""
    first = "".join(sorted(set().union(*map(first_characters, patterns))))
    return f"(?i)(?=[{first}])(?:" + "|".join(f"(?:{p})" for p in patterns) + ")"


def with_injection_matches(df: DataFrame, text: str = "text") -> DataFrame:
    """Matched pattern lists as materialised columns ``_inj_high``/``_inj_sus``.

    One pass over the text decides whether any pattern of either list matches; the lists themselves (for
    severity and detail) are tried on the rare texts where one does. The separate projections keep each
    regex evaluated once per row."""
    t, empty = F.col(text), F.array().cast("array<string>")
    flagged = df.select("*", t.rlike(any_of(L.INJECTION_HIGH + L.INJECTION_SUSPICIOUS)).alias("_any"))
    high = flagged.select("*", F.when(F.col("_any"), _matched(t, L.INJECTION_HIGH)).otherwise(empty).alias("_inj_high"))
    sus = F.when(F.col("_any") & (F.size("_inj_high") == 0), _matched(t, L.INJECTION_SUSPICIOUS)).otherwise(empty)
    return high.select(*df.columns, "_inj_high", sus.alias("_inj_sus"))


def injection_result(high: Column, sus: Column) -> Column:
    """G3 result from the matched lists."""
    is_high, is_sus = F.size(high) > 0, F.size(sus) > 0
    return result(~(is_high | is_sus),
                  F.when(is_high, "block").when(is_sus, "flag").otherwise("pass"), "prompt_injection",
                  F.when(is_high, F.lit(MESSAGES["injection_block"]))
                  .when(is_sus, F.lit(MESSAGES["injection_flag"]))
                  .otherwise(F.lit(MESSAGES["injection_ok"])),
                  F.when(is_high, F.concat(F.lit("high_confidence="), F.array_join(high, "|")))
                  .when(is_sus, F.concat(F.lit("suspicious="), F.array_join(sus, "|"))))


def prompt_injection_df(df: DataFrame, text: str = "text", keys: list[str] | None = None) -> DataFrame:
    """G3 over a table: keys + the result columns."""
    m = with_injection_matches(df, text)
    return m.select(*(keys or []), injection_result(F.col("_inj_high"), F.col("_inj_sus")).alias("r")) \
        .select(*(keys or []), "r.*")


def prompt_injection(text: Column) -> Column:
    """Any high-confidence pattern blocks; else any suspicious one flags."""
    return injection_result(_matched(text, L.INJECTION_HIGH), _matched(text, L.INJECTION_SUSPICIOUS))


def moderation(verdict: Column, enabled: bool = True, model: str = "labels.toxic") -> Column:
    """Pluggable verdict column (True = unsafe). Fail-open: a NULL verdict
    (scorer unavailable / no label) passes with a 'skipped' message."""
    if not enabled:
        return result(F.lit(True), F.lit("pass"), "moderation",
                      F.lit(MESSAGES["moderation_off"]), F.lit("enabled=false"))
    unsafe = F.coalesce(verdict, F.lit(False))
    return result(~unsafe, F.when(unsafe, "block").otherwise("pass"), "moderation",
                  F.when(verdict.isNull(),
                         F.lit(MESSAGES["moderation_skipped"]))
                  .when(unsafe, F.lit(MESSAGES["moderation_block"]))
                  .otherwise(F.lit(MESSAGES["moderation_ok"])),
                  F.when(verdict.isNull(), F.lit("error=no verdict")).otherwise(F.lit("model=" + model)))


def input_eval(df: DataFrame, text: str = "text", keys: list[str] | None = None,
               verdicts: DataFrame | None = None) -> DataFrame:
    """All input checks per text in long form; a non-string stops after G1.
    ``any_block`` is computed on the row's own array before the explode.

    ``verdicts`` (the keys and ``unsafe``) join the results of the other checks: the
    checks run on the scan, and no text crosses a shuffle."""
    keys = keys or []
    m = with_injection_matches(df.select(*keys, F.col(text).alias("_t")), "_t")
    tt = F.col("_t")
    checks = [input_schema(tt), length_cap(tt), injection_result(F.col("_inj_high"), F.col("_inj_sus"))]
    block = tt.isNull() | (F.length(tt) > L.MAX_INPUT_CHARS) | (F.size("_inj_high") > 0)
    own = F.when(tt.isNull(), F.array(checks[0])).otherwise(F.array(*checks))
    m = m.select(*keys, tt.isNull().alias("_null"), block.alias("any_block"), own.alias("_checks"))
    if verdicts is not None:
        m = m.join(verdicts.select(*keys, F.col("unsafe").alias("_v")), keys, "left")
        m = m.withColumns({"any_block": F.col("any_block") | F.coalesce(F.col("_v"), F.lit(False)),
                           "_checks": F.when(F.col("_null"), F.col("_checks")).otherwise(
                               F.concat("_checks", F.array(moderation(F.col("_v")))))})
    # each row has checks; the outer form infers no filter on them, which would run them all on the scan once more
    return (m.select(*keys, "any_block", F.posexplode_outer("_checks").alias("check_order", "r"))
              .select(*keys, "check_order", "r.*", "any_block"))


# -- answer checks ----------------------------------------------------------------------------
SECTION = "array<struct<heading:string,content:string,citations:array<string>>>"
ANSWER_SCHEMA = (f"struct<summary:string,confidence:string,facts:{SECTION},interpretation:{SECTION},"
                 f"recommendation:{SECTION},other_sections:{SECTION},"
                 f"render_hint:struct<kind:string,payload:struct<kind:string>>>")


def parse_answer(answer_json: Column) -> Column:
    return F.from_json(answer_json, ANSWER_SCHEMA, {"mode": "PERMISSIVE"})


def _kind(a: Column) -> Column:
    return F.coalesce(a["render_hint"]["kind"], F.lit("markdown"))


def answer_schema(a: Column) -> Column:
    """Facts present, confidence one of 3, render kind one of 5."""
    facts_ok = a.isNotNull() & a["facts"].isNotNull() & F.forall(
        F.coalesce(a["facts"], F.array()), lambda s: s["heading"].isNotNull() & s["content"].isNotNull())
    conf_ok = a["confidence"].isin(L.CONFIDENCE_LEVELS)
    kind_ok = _kind(a).isin(L.RENDER_KINDS)
    ok = F.coalesce(facts_ok & conf_ok & kind_ok, F.lit(False))
    msg = (F.when(a.isNull(), "invalid JSON").when(~facts_ok, "facts: Field required")
           .when(~F.coalesce(conf_ok, F.lit(False)), "confidence: Input should be 'high', 'medium' or 'low'")
           .otherwise("render_hint.kind: unknown kind"))
    return result(ok, F.when(ok, "pass").otherwise("flag"), "answer_schema",
                  F.when(ok, F.lit(MESSAGES["schema_ok"]))
                  .otherwise(F.concat(F.lit(MESSAGES["schema_bad"]), msg, F.lit("."))))


def confidence(has_sources: Column, has_tool_results: Column) -> Column:
    """No sources and no tool results -> flag, confidence forced to low."""
    bad = ~has_sources & ~has_tool_results
    return result(~bad, F.when(bad, "flag").otherwise("pass"), "confidence",
                  F.when(bad, F.lit(MESSAGES["confidence_low"]))
                  .otherwise(F.lit(MESSAGES["confidence_ok"])), F.when(bad, F.lit("forced=low")))


def citations(a: Column) -> Column:
    """Facts sections without citations are flagged, headings listed."""
    uncited = F.transform(F.filter(F.coalesce(a["facts"], F.array()),
                                   lambda s: F.coalesce(F.size(s["citations"]), F.lit(0)) <= 0),
                          lambda s: s["heading"])
    bad = F.size(uncited) > 0
    return result(~bad, F.when(bad, "flag").otherwise("pass"), "citations",
                  F.when(bad, F.lit(MESSAGES["citations_bad"]))
                  .otherwise(F.lit(MESSAGES["citations_ok"])),
                  F.when(bad, F.array_join(uncited, "|")))


# every PII kind needs one of these characters; a byte search skips the regex
# for texts that cannot match (an email needs '@', a phone or card number a digit)
PII_PREFILTER = {"email": "@", "phone": "[0-9]", "credit_card": "[0-9]"}


def pii_matches(text: Column, kind: str) -> Column:
    """Up to 3 whole matches of one PII kind in one text."""
    pattern = dict(L.PII_PATTERNS)[kind]
    t = F.coalesce(text, F.lit(""))
    need = PII_PREFILTER[kind]
    possible = t.contains(need) if len(need) == 1 else t.rlike(need)
    return F.when(possible, F.slice(F.regexp_extract_all(t, F.lit(pattern), 0), 1, 3)) \
        .otherwise(F.array().cast("array<string>"))


def answer_texts(a: Column) -> Column:
    secs = F.concat(*[F.coalesce(a[s], F.array()) for s in ("facts", "interpretation", "recommendation",
                                                           "other_sections")])
    return F.concat(F.array(a["summary"]), F.transform(secs, lambda s: s["content"]))


def pii(texts: Column) -> Column:
    """G9 over an array of texts: per kind, up to 3 matches per text, concatenated."""
    def per_text(kind):
        return lambda t: pii_matches(t, kind)

    found = {k: F.flatten(F.transform(texts, per_text(k))) for k, _ in L.PII_PATTERNS}
    any_hit = sum((F.size(v) for v in found.values()), F.lit(0)) > 0
    detail = F.concat_ws(";", *[F.when(F.size(v) > 0, F.concat(F.lit(k + "="), F.array_join(v, "|")))
                                for k, v in found.items()])
    return result(~any_hit, F.when(any_hit, "flag").otherwise("pass"), "pii",
                  F.when(any_hit, F.lit(MESSAGES["pii_bad"])).otherwise(F.lit(MESSAGES["pii_ok"])),
                  F.when(any_hit, detail))


def render_safety(a: Column) -> Column:
    """Unknown render kind -> flag (fall back to markdown)."""
    k = _kind(a)
    ok = k.isin(L.RENDER_KINDS)
    return result(ok, F.when(ok, "pass").otherwise("flag"), "render_safety",
                  F.when(ok, F.concat(F.lit("render_hint.kind="), k, F.lit(" allowed.")))
                  .otherwise(F.lit(MESSAGES["render_bad"])),
                  F.when(~ok, F.concat(F.lit("kind="), k)))


def output_eval(df: DataFrame, answer: str = "answer", keys: list[str] | None = None,
                has_sources: Column | None = None, has_tool_results: Column | None = None) -> DataFrame:
    """G6..G10 per answer; an invalid answer stops after G6."""
    a = F.col(answer)
    hs = has_sources if has_sources is not None else F.lit(True)
    ht = has_tool_results if has_tool_results is not None else F.lit(True)
    first = answer_schema(a)
    rest = [confidence(hs, ht), citations(a), pii(answer_texts(a)), render_safety(a)]
    arr = F.when(first["passed"], F.array(first, *rest)).otherwise(F.array(first))
    keys = keys or []
    # as in input_eval
    return (df.select(*keys, F.posexplode_outer(arr).alias("check_order", "r"))
              .select(*keys, "check_order", "r.*"))


# -- tool-call checks -------------------------------------------------------------------------
def tool_registry(spark) -> DataFrame:
    return spark.createDataFrame([(n, a) for n, a in L.TOOL_REGISTRY], "tool string, allowed_args array<string>")


def tool_calls_check(calls: DataFrame, spark) -> DataFrame:
    """Tool must be registered (else block); unknown argument keys block.
    The registry is a fixed 19-row literal, so broadcasting it is bounded."""
    reg = F.broadcast(tool_registry(spark))
    j = calls.join(reg, "tool", "left")
    known = F.col("allowed_args").isNotNull()
    unknown = F.array_sort(F.array_except(F.coalesce(F.map_keys("args"), F.array().cast("array<string>")),
                                          F.coalesce(F.col("allowed_args"), F.array().cast("array<string>"))))
    allowed = result(known, F.when(known, "pass").otherwise("block"), "allowed_tools",
                     F.when(known, F.concat(F.lit("Tool '"), F.col("tool"), F.lit("' is registered.")))
                     .otherwise(F.concat(F.lit("Tool '"), F.col("tool"), F.lit("' is not in the registry."))))
    args_ok = known & (F.size(unknown) == 0)
    args = result(args_ok, F.when(args_ok, "pass").otherwise("block"), "tool_arguments",
                  F.when(args_ok, F.concat(F.lit("Args for '"), F.col("tool"), F.lit("' are valid.")))
                  .when(known, F.concat(F.lit("Invalid arguments for tool '"), F.col("tool"), F.lit("'.")))
                  .otherwise(F.concat(F.lit("Tool '"), F.col("tool"), F.lit("' is not in the registry."))),
                  F.when(known & ~args_ok, F.concat(F.lit("extra_forbidden="), F.array_join(unknown, "|"))))
    keys = [c for c in calls.columns if c != "args"]
    return j.select(*keys, F.posexplode(F.array(allowed, args)).alias("check_order", "r")).select(
        *keys, "check_order", "r.*")
