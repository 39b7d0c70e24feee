"""Visual-QA answers: the JSON object in free text, and its normalisation."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The named checks, and how long a reason may be.
CHECKS = ["image_clear", "text_readable", "node_visible", "edge_visible", "arrow_clear", "legend_clear", "overlap_acceptable"]
REASON_CHARS = 240


def first_json_object(text: str | None) -> tuple[str | None, str | None]:
    """(object's text, error): the first balanced {...}, braces in strings not counted."""
    start = (text or "").find("{")
    if start < 0:
        return None, "missing_json_object"
    depth, quoted, skip = 0, False, False
    for i, c in enumerate(text[start:], start):
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if not depth:
                found = text[start : i + 1]
                try:
                    json.loads(found)
                except json.JSONDecodeError as e:
                    return None, f"json_decode_error:{e.msg}"
                return found, None
    return None, "truncated_json_object"


_EXTRACTED = T.StructType([T.StructField("json", T.StringType()), T.StructField("parse_error", T.StringType())])


@F.pandas_udf(_EXTRACTED)
def extract_json_object(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([first_json_object(t) for t in text], columns=["json", "parse_error"])


def normalize_result(obj: Column) -> Column:
    """struct(overall, checks, failure_reasons, quality_score, warnings) of an answer's JSON text; rules run in a fixed order."""
    get = lambda path: F.get_json_object(obj, path)
    upper = lambda path: F.upper(F.coalesce(get(path), F.lit("")))
    valid = lambda c: c.isin("PASS", "FAIL")
    raw = {n: upper(f"$.checks.{n}") for n in CHECKS}
    checks = {n: F.when(valid(c), c).otherwise("FAIL") for n, c in raw.items()}
    all_pass = F.forall(F.array(*checks.values()), lambda c: c == "PASS")
    said = upper("$.overall")
    overall0 = F.when(valid(said), said).otherwise(F.when(all_pass, "PASS").otherwise("FAIL"))
    kinds = F.from_json(obj, "map<string,string>")
    score_text = F.trim(get("$.quality_score"))
    quoted = obj.rlike(r'"quality_score"\s*:\s*"')
    number = F.when(quoted, F.when(score_text.rlike(r"^[+-]?\d+$"), score_text.try_cast("double"))).otherwise(F.when(score_text == "true", F.lit(1.0)).when(score_text == "false", F.lit(0.0)).otherwise(score_text.try_cast("double")))
    invalid_score = number.isNull()
    score0 = F.when(invalid_score, F.when(overall0 == "PASS", 3).otherwise(2)).otherwise(F.greatest(F.lit(1), F.least(F.lit(5), F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)).cast("int"))))
    check_failed = (overall0 == "PASS") & ~all_pass
    overall1 = F.when(check_failed, "FAIL").otherwise(overall0)
    low = (overall1 == "PASS") & (score0 < 3)
    overall2 = F.when(low, "FAIL").otherwise(overall1)
    high = (overall2 == "FAIL") & (score0 > 2)
    score1 = F.when(high, 2).otherwise(score0)
    reasons_text = get("$.failure_reasons")
    listed = F.coalesce(reasons_text.startswith("["), F.lit(False)) & F.coalesce(kinds["failure_reasons"].startswith("["), F.lit(False))
    reasons0 = F.when(listed, F.transform(F.from_json(reasons_text, "array<string>"), lambda r: F.substring(r, 1, REASON_CHARS))).otherwise(F.array().cast("array<string>"))
    missing = ~listed & (overall2 == "FAIL")
    cleared = (overall2 == "PASS") & (F.size(reasons0) > 0)
    reasons = F.when(overall2 == "PASS", F.array().cast("array<string>")).otherwise(reasons0)
    flags = [(~valid(c), f"invalid_check:{n}") for n, c in raw.items()]
    flags += [(~valid(said), "invalid_overall"), (invalid_score, "invalid_quality_score"), (check_failed, "overall_pass_but_check_failed"), (low, "overall_pass_but_low_score")]
    flags += [(high, "overall_fail_but_high_score"), (missing, "missing_failure_reasons"), (cleared, "pass_with_failure_reasons")]
    warnings = F.array_compact(F.array(*(F.when(c, F.lit(n)) for c, n in flags)))
    check_map = F.create_map(*(x for n, c in checks.items() for x in (F.lit(n), c)))
    return F.struct(overall2.alias("overall"), check_map.alias("checks"), reasons.alias("failure_reasons"), score1.cast("int").alias("quality_score"), warnings.alias("warnings"))


def qa_records(answers: DataFrame, text_col: str = "text") -> DataFrame:
    """Answers with ``result``, ``status`` and ``parse_error``; texts without a whole JSON object are PARSE_ERROR."""
    got = answers.withColumn("_x", extract_json_object(F.col(text_col)))
    ok = F.col("_x.json").isNotNull()
    return got.withColumns({"result": F.when(ok, normalize_result(F.col("_x.json"))), "status": F.when(ok, "OK").otherwise("PARSE_ERROR"), "parse_error": F.col("_x.parse_error")}).drop("_x")
