"""Sensitive-data rules: regular expressions and keywords over file names and contents.

All rules are evaluated in one pass over the text, each with its literal pattern, as an array of
hits per document that is then unfolded.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papersluice.functions.text import CONTEXT, lower, window

MAX_HITS = 1000
RISKS = ("low", "medium", "high", "critical")


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    type: str = "regex"
    risk: str = "medium"
    match_filename: bool = False
    match_content: bool = True
    id: str = field(default_factory=lambda: f"rule_{uuid.uuid4().hex}")

    def normalised(self) -> Rule:
        """Trimmed; an unknown type becomes regex, an unknown risk medium. The id stays."""
        kind, risk = self.type.strip().lower(), self.risk.strip().lower()
        return replace(self, name=self.name.strip(), pattern=self.pattern.strip(), type=kind if kind in ("regex", "keyword") else "regex", risk=risk if risk in RISKS else "medium")


#: The rules that apply when none are stored.
DEFAULT_RULES = (
    Rule("身份证号", r"\d{17}[\dXx]", "regex", "high", False, True, "rule_idcard"),
    Rule("手机号码", r"1[3-9]\d{9}", "regex", "medium", False, True, "rule_mobile"),
    Rule("IP 地址", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "regex", "low", False, True, "rule_ipv4"),
    Rule("机密字样", "机密", "keyword", "high", True, True, "rule_confidential"),
    Rule("内部资料", "内部资料", "keyword", "medium", True, True, "rule_internal"),
)


def usable(rules: Iterable[Rule], spark: SparkSession | None = None) -> list[tuple[int, Rule]]:
    """Rules with their place in the list, without those of an empty or invalid pattern.

    Any type but regex is taken as a keyword. With a session the JVM judges expressions, since it
    runs them; else Python does.
    """
    out = []
    for i, r in enumerate(rules):
        if not r.pattern:
            continue
        if r.type.lower() == "regex":
            try:
                if spark is not None:
                    spark.sparkContext._jvm.java.util.regex.Pattern.compile(_unicode(r.pattern))
                else:
                    re.compile(r.pattern)
            except Exception:  # the JVM's or Python's syntax error: such a rule is skipped, the others go on
                continue
        out.append((i, r))
    return out


def _unicode(pattern: str) -> str:
    return f"(?U){pattern}"


def _first(text: Column, rule: Rule) -> tuple[Column, Column, Column]:
    """Whether ``rule`` matches, the 1-based place and the length of its first match."""
    if rule.type.lower() == "regex":
        lead = rf"(?s)^(.*?)({_unicode(_shift_backreferences(rule.pattern, 2))})"
        hit = text.rlike(_unicode(rule.pattern))
        return hit, F.length(F.regexp_extract(text, lead, 1)) + 1, F.length(F.regexp_extract(text, lead, 2))
    at = F.instr(lower(text), F.lit(rule.pattern.replace("İ", "i").lower()))
    return at > 0, at, F.lit(len(rule.pattern))


def _shift_backreferences(pattern: str, by: int) -> str:
    return re.sub(r"(?<!\\)((?:\\\\)*)\\([1-9])", lambda m: f"{m[1]}\\{int(m[2]) + by}", pattern)


def detect(docs: DataFrame, rules: Iterable[Rule] = DEFAULT_RULES, include_content: bool = True, cap: int | None = MAX_HITS, max_bytes: int | None = None) -> DataFrame:
    """Hits: path, phase (0 filename, 1 content), rule_ord, rule_name, risk, match_type, matched.

    ``docs``: path, filename, content [, size]. One hit per rule, document and place: the first. A
    file name's hit shows the matched value, or the keyword as the rule has it; a content's shows 40
    characters either side, line ends and tabs as spaces, ``…`` where cut. ``cap`` keeps the first
    hits by path, phase and rule; None keeps all. Null texts match nothing, nor does content of
    documents larger than ``max_bytes``; no usable rule, no rows.
    """
    spark = docs.sparkSession
    name, content = F.coalesce("filename", F.lit("")), F.coalesce("content", F.lit(""))
    if max_bytes is not None:
        content = F.when(F.col("size") > max_bytes, F.lit("")).otherwise(content)
    found = []
    for i, r in usable(rules, spark):
        places = [("filename", 0, name)] * r.match_filename + [("content", 1, content)] * (r.match_content and include_content)
        for kind, phase, text in places:
            hit, at, size = _first(text, r)
            if kind == "content":
                shown = F.translate(window(text, at, size, CONTEXT), "\n\r\t", "   ")
            else:
                shown = F.substr(text, at, size) if r.type.lower() == "regex" else F.lit(r.pattern)
            found.append(F.when(hit & (F.length(text) > 0), F.struct(F.lit(phase).alias("phase"), F.lit(i).alias("rule_ord"), F.lit(r.name).alias("rule_name"), F.lit(r.risk).alias("risk"), F.lit(kind).alias("match_type"), shown.alias("matched"))))
    schema = "array<struct<phase:int,rule_ord:int,rule_name:string,risk:string,match_type:string,matched:string>>"
    hits = docs.select("path", F.inline(F.array_compact(F.array(*found)) if found else F.array().cast(schema)))
    return hits if cap is None else hits.orderBy("path", "phase", "rule_ord").limit(cap)


def severity(risk: Column) -> Column:
    """0 low to 3 critical; null for anything else."""
    out = F.lit(None).cast("int")
    for i, r in enumerate(RISKS):
        out = F.when(risk == r, F.lit(i)).otherwise(out)
    return out


def rollup(hits: DataFrame) -> DataFrame:
    """Hits and files per risk, with its severity."""
    return hits.groupBy("risk").agg(F.count("*").alias("n_hits"), F.countDistinct("path").alias("n_files")).withColumn("severity", severity(F.col("risk")))


def as_frame(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    """Rules as a table, in order."""
    return spark.createDataFrame([{"rule_ord": i, **asdict(r)} for i, r in enumerate(rules)], "rule_ord int, id string, name string, pattern string, type string, risk string, match_filename boolean, match_content boolean")
