"""Checks on summary documents and rules on statements."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.functions.text import strip
from themeloom.operators.scale import once

# Texts of the issues.
EMPTY = "文件内容为空"
SHORT = "内容过短，可能数据不完整"
NO_TITLE = "缺少标准标题格式 '# 股票代码 股票名称'"
NO_SECTION = "缺少必需章节: ## "
# Issues that only the newer layout knows.
NO_INTRO = "缺少引言"
LONG = "内容过长"
NO_NEW_TITLE = "缺少标准标题格式 '# 股票名称 (股票代码)'"


@dataclass(frozen=True)
class Profile:
    """What a valid summary looks like."""

    title: str
    title_issue: str
    sections: tuple[str, ...]
    min_chars: int
    max_chars: int | None = None
    intro: str | None = None


# The two layouts, told apart by title, sections and length.
LEGACY = Profile(
    title=r"(?mdU)^#\s+\d{6}\s+",
    title_issue=NO_TITLE,
    sections=("所属板块", "主营业务", "题材标签"),
    min_chars=50,
)
CURRENT = Profile(
    title=r"(?mdU)^#\s+.+\(\d{6}\)",
    title_issue=NO_NEW_TITLE,
    sections=("核心题材", "业务亮点"),
    min_chars=200,
    max_chars=500,
    intro=r"(?mdU)^#\s+.+\(\d{6}\)\s*\n\s*[^#\s]",
)


def validate_summaries(df: DataFrame, profile: Profile = LEGACY) -> DataFrame:
    """(file_name, issues): an empty array is a pass.

    An empty file has that single issue; any other file is checked for title,
    sections and length, in this order.
    """
    content = F.col("content")
    checks = [F.when(~F.rlike(content, F.lit(profile.title)), profile.title_issue)]
    if profile.intro:
        checks.append(F.when(~F.rlike(content, F.lit(profile.intro)), NO_INTRO))
    checks += [
        F.when(~content.contains(f"## {s}"), NO_SECTION + s) for s in profile.sections
    ]
    checks.append(F.when(F.char_length(content) < profile.min_chars, SHORT))
    if profile.max_chars:
        checks.append(F.when(F.char_length(content) > profile.max_chars, LONG))
    issues = F.when(strip(content) == "", F.array(F.lit(EMPTY))).otherwise(
        F.array_compact(F.array(*checks))
    )
    return once(df.select("file_name", "content"), "issues", issues).drop("content")


def validation_report(issues: DataFrame) -> DataFrame:
    """(total, passed, failed)."""
    return issues.agg(
        F.count("*").alias("total"),
        F.count_if(F.size("issues") == 0).alias("passed"),
        F.count_if(F.size("issues") > 0).alias("failed"),
    )


def failing_files(issues: DataFrame) -> DataFrame:
    return issues.where(F.size("issues") > 0)


@dataclass(frozen=True)
class Rule:
    """A pattern that marks a statement; ``drop`` removes it, ``tag`` keeps it as non-core."""

    name: str
    pattern: str
    action: str


# Words of a denial, and tags that describe trading, not business.
DENIAL_WORDS = ("澄清", "否认", "无关", "不涉及", "未参与")
TRADING_TAGS = ("融资融券", "深股通", "沪股通")

_NUMBER = r"[+-]?\d+(?:\.\d+)?"
_PERIOD = r"(?:\d{4}年)?(?:Q[1-4]|[一二三四]季度|前三季度|上半年|全年|年报)?"
_FIGURE = r"(?:营收|营业收入|净利润|归母净利润|毛利率|每股收益)"
_MOVE = r"(?:股价)?(?:上涨|下跌|涨停|跌停|涨幅|跌幅)"

RULES = (
    Rule("denial", "|".join(DENIAL_WORDS), "drop"),
    Rule(
        "figure",
        rf"^\s*{_PERIOD}{_FIGURE}(?:为|约|达|同比增长|同比下降)*{_NUMBER}(?:万|亿)?(?:元|%)?[。]?\s*$",
        "drop",
    ),
    Rule("price", rf"^\s*(?:今日|当日|盘中|收盘)?{_MOVE}(?:{_NUMBER}%?)?[。]?\s*$", "drop"),
    Rule("trading", rf"^\s*(?:{'|'.join(TRADING_TAGS)})\s*$", "tag"),
)


def flag_statements(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Add ``flags``, ``keep`` and ``core`` to each statement.

    The rules are part of the plan, so a statement is judged where it is read.
    """
    def hits(action: str):
        return F.array_compact(F.array(*[
            F.when(F.rlike(F.col(text), F.lit(r.pattern)), F.lit(r.name))
            for r in rules if r.action == action
        ])).cast("array<string>")

    return (
        once(once(df, "_drop", hits("drop")), "_tag", hits("tag"))
        .withColumn("flags", F.concat("_drop", "_tag"))
        .withColumn("keep", F.size("_drop") == 0)
        .withColumn("core", (F.size("_drop") == 0) & (F.size("_tag") == 0))
        .drop("_drop", "_tag")
    )


def kept_statements(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    return flag_statements(df, rules, text).where("keep")
