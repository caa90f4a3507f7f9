"""Questions that compare: whether one does, what it compares, and how many subtasks a question needs at least."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorebase.functions.text import one_of

# Markers and patterns of the rules.
COMPARISON = ["对比", "区别", "差异", "优缺点", "利弊", "取舍", "选型", "哪个更好", "哪一个更好", " versus ", " vs "]
COMPLEX = ["全面", "深入", "系统分析", "研究报告", "技术方案", "实施方案", "架构设计", "文献综述", "根因", "诊断并修复"]
COMPOUND = ["以及", "同时", "分别", "并分析", "并比较", "原因和", "原因、", "影响和", "影响、", "现状和", "现状、", "问题和解决", "问题、解决"]
INTERROGATIVE = ["为什么", "为何", "如何", "怎么", "哪些", "是否"]
PREFIX = "(?i)^(?:(?:请|请你|帮我|分析一下|分析|说明一下|说明)\\s*)?(?:比较|对比)\\s*"
SUFFIX = "(?i)(?:之间)?(?:有(?:什么|何))?(?:区别|差异|优缺点|利弊|取舍)(?:是(?:什么|哪些))?[？?。.！!]*$"
CONNECTOR = "(?i)\\s*(?:和|与|跟|及|vs\\.?|versus)\\s*"
DECISION = "(?i)(?:应该)?(?:怎么|如何)选(?:择)?|(?:应该)?选(?:择)?(?:哪一个|哪个)|(?:哪一个|哪个)(?:更|最)?(?:合适|适合|好)[？?。.！!]*$"
CRITERIA = "(?i)\\s*(?:(?:在|用于|应用于).+?)?的?(?:选型|选择)(?:依据|标准|条件|建议|策略|原则)?[？?。.！!]*$"
USE = "\\s*(?:在|用于|应用于).+$"
EDGE, EDGE_OF = " ，,、:：", " ，,、:：的"


def _flat(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "\\s+", " "))


def _strip(text: Column, chars: str) -> Column:
    return F.trim(text, F.lit(chars))


def _without(text: Column, pattern: str) -> Column:
    return F.trim(F.regexp_replace(text, pattern, ""))


def comparison_subjects(task: Column) -> Column:
    """Struct of left and right, up to 200 characters each, or null if the text isn't two different things and a word between them."""
    text = _without(F.regexp_replace(_flat(task), PREFIX, ""), SUFFIX)
    decides = text.rlike(DECISION)
    parts = F.split(_without(_without(text, DECISION), CRITERIA), CONNECTOR, 2)
    second = F.trim(F.coalesce(F.get(parts, F.lit(1)), F.lit("")))
    left, right = _strip(F.get(parts, F.lit(0)), EDGE), _strip(second, EDGE_OF)
    right = F.when(decides, _strip(F.regexp_replace(right, USE, ""), EDGE_OF)).otherwise(right)
    shared = F.regexp_extract(second, "(的[^，,、:：]+)$", 1)
    share = (shared != "") & ~left.contains("的")
    a, b = F.when(share, F.concat(left, shared)).otherwise(left), F.when(share, _strip(second, EDGE)).otherwise(right)
    return F.when((F.size(parts) == 2) & (left != "") & (right != "") & (F.lower(a) != F.lower(b)), F.struct(F.substring(a, 1, 200).alias("left"), F.substring(b, 1, 200).alias("right")))


def is_comparison(task: Column) -> Column:
    low = F.concat(F.lit(" "), F.lower(_flat(task)), F.lit(" "))
    named = F.trim(low).startswith("比较 ") | F.trim(low).startswith("比较一下 ")
    joins = F.coalesce(task, F.lit("")).rlike(CONNECTOR)
    decides = joins & F.trim(F.coalesce(task, F.lit(""))).rlike(DECISION)
    return named | decides | one_of(low, COMPARISON) | (low.contains("比较") & joins & comparison_subjects(task).isNotNull())


def least_subtasks(task: Column) -> Column:
    """Two for a comparison, three for a complex task, else by the number of questions, goals and lists in it."""
    low, text = F.lower(_flat(task)), F.coalesce(task, F.lit(""))
    times = lambda s: F.length(text) - F.length(F.replace(text, F.lit(s)))
    asked = F.greatest(times("？") + times("?"), sum((text.contains(m).cast("int") for m in INTERROGATIVE), F.lit(0)))
    listed = ((times("、") >= 1) & text.rlike("以及|和|及")) | (times("、") >= 2)
    return F.when(is_comparison(task), 2).when(one_of(low, COMPLEX), 3).when(asked > 1, F.least(asked, F.lit(3))).when(listed, 3).when(one_of(low, COMPOUND), 2).otherwise(1)
