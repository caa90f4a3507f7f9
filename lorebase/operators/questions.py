"""What a question asks for: small talk, sources, depth, category, and whether a hit is relevant."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorebase.functions.text import coverage, identifiers, one_of, query_terms

# Words and patterns of the rules.
EDGE = "[\\s,，.。!！?？~～…·、;；:：\"'“”‘’()（）\\[\\]【】{}<>《》]+"
GREETINGS = ["hi", "hello", "hey", "你好", "你好啊", "你好呀", "您好", "嗨", "哈喽", "早上好", "上午好", "下午好", "晚上好"]
THANKS = ["谢谢", "多谢", "感谢", "谢了", "thanks", "thank you"]
FAREWELLS = ["再见", "拜拜", "回头见", "晚安", "bye", "goodbye"]
PRESENCE = ["在吗", "在不在", "你在吗", "有人吗", "干嘛呢", "干啥呢"]
STATUS = ["咋了", "怎么了", "咋回事", "什么情况", "干嘛", "干啥"]
IDENTITY = ["你是谁", "你叫什么", "你叫什么名字", "你是干什么的", "你能干什么", "你能干啥"]
APOLOGIES = ["抱歉", "对不起", "不好意思", "sorry"]
REACTION = "^(?:哈{1,12}|嘿{2,12}|呵{2,12}|嘻{2,12}|笑死(?:我了)?|绷不住了|乐了|6{2,8})$"
ACKNOWLEDGEMENT = "^(?:[嗯唔哦噢喔啊]{1,6}|好(?:的|吧|嘞|呀|啊)?|行(?:吧|啊|呀)?|可以|知道了|明白了|明白|懂了|收到|没问题|ok(?:ay)?|got it|fine)$"
WEB_ONLY = ["只使用联网", "仅使用联网", "仅联网", "只查官网", "仅查官网", "web only", "online sources only"]
WEB_FIRST = ["联网", "官网", "官方网站", "最新", "目前", "现在的", "当前版本", "发布日期", "实时", "today", "latest", "current", "official website"]
TASK_RULES = [
    ("comparison", ["compare", "vs", "versus", "difference", "better", "trade-off"]),
    ("howto", ["how", "how to", "steps", "guide", "tutorial", "implement", "setup"]),
    ("analysis", ["analyze", "analysis", "deep dive", "evaluate", "review", "investigate"]),
    ("concept", ["what is", "explain", "define", "overview", "introduction", "concept"]),
]
MODES = ["factual", "conceptual", "comparative", "procedural", "analytical", "graph"]
SENTENCE_BREAK = "[。！？!?；;\\n]"


def normalized(text: Column) -> Column:
    """Lower case, single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), "\\s+", " "))


def surface(text: Column) -> Column:
    """A turn without punctuation and brackets at its ends."""
    return F.regexp_replace(F.regexp_replace(normalized(text), "^" + EDGE, ""), EDGE + "$", "")


def small_talk(text: Column) -> Column:
    """The kind of a short social turn of up to 24 characters, else null."""
    t = surface(text)
    sets = [("greeting", GREETINGS), ("thanks", THANKS), ("farewell", FAREWELLS), ("presence", PRESENCE), ("status", STATUS), ("identity", IDENTITY), ("apology", APOLOGIES)]
    kind = F.coalesce(*[F.when(t.isin(words), name) for name, words in sets], F.when(t.rlike(REACTION), "reaction"), F.when(t.rlike(ACKNOWLEDGEMENT), "acknowledgement"))
    return F.when((t != "") & (F.length(t) <= 24), kind)


def may_answer_directly(text: Column, research_words: list[str], most: int = 320) -> Column:
    """Whether a question is short, without URL or research words, and of at most three breaks."""
    t = normalized(text)
    return (t != "") & (F.length(t) <= most) & ~t.rlike("https?://|www\\.") & ~one_of(t, research_words) & (F.regexp_count(t, F.lit(SENTENCE_BREAK)) <= 3)


def source_requirement(text: Column, task_type: Column, policy: Column, no_sources: str, required_words: list[str]) -> Column:
    """not_required, preferred or required: by task type, pattern of tasks without sources, policy, words."""
    t = normalized(text)
    free = (t == "") | small_talk(text).isNotNull() | (task_type == "code") | t.rlike(no_sources)
    return F.when(free, "not_required").when(F.lower(F.trim(policy)).isin("web", "knowledge_base") | (task_type == "verify") | one_of(t, required_words), "required").otherwise("preferred")


def tool_order(text: Column) -> Column:
    """Source tools in the order to try: the web alone, the web first, or the knowledge base first."""
    t, web, base = normalized(text), F.lit("web_search"), F.lit("search_knowledge_base")
    return F.when(one_of(t, WEB_ONLY), F.array(web)).when(one_of(t, WEB_FIRST), F.array(web, base)).otherwise(F.array(base, web))


def is_simple(text: Column, research_words: list[str], comparison: Column, most: int = 120) -> Column:
    """A short task that neither researches in depth nor compares, of at most two breaks."""
    t = normalized(text)
    return (t != "") & (F.length(t) <= most) & ~one_of(t, research_words) & ~comparison & (F.regexp_count(t, F.lit("[。！？!?;\\n]")) <= 2)


def task_category(text: Column) -> Column:
    """comparison, howto, analysis, concept or unknown: the first rule with a word in the text."""
    low = F.lower(text)
    return F.coalesce(*[F.when(one_of(low, words), name) for name, words in TASK_RULES], F.lit("unknown"))


def response_depth(text: Column, concise: list[str], deep: list[str], decision: list[str], subtasks: Column) -> Column:
    """concise, deep, standard or focused, by words, length, breaks and number of subtasks."""
    t = normalized(text)
    breaks = F.regexp_count(t, F.lit(SENTENCE_BREAK))
    compound = (subtasks >= 3) | (F.length(t) > 180) | (breaks >= 3)
    return (
        F.when((t == "") | small_talk(text).isNotNull() | one_of(t, concise), "concise")
        .when(one_of(t, deep) | compound, "deep")
        .when((subtasks >= 2) | one_of(t, decision), "standard")
        .when((F.length(t) <= 100) & (breaks <= 1), "focused")
        .otherwise("standard")
    )


def depth_budget(depth: Column, final: Column, subtasks: Column) -> tuple[Column, Column]:
    """Least and most characters of an answer of a depth."""
    big = final & (subtasks >= 2)
    least = F.when(depth == "concise", 100).when(depth == "focused", 500).when(depth == "standard", F.when(big, 2400).otherwise(1600)).when(depth == "deep", F.when(final, 4000).otherwise(3200))
    most = F.when(depth == "concise", 500).when(depth == "focused", 1200).when(depth == "standard", F.when(big, 4200).otherwise(2800)).when(depth == "deep", F.when(final, 8000).otherwise(6000))
    return least, most


def falls_short(text: Column, least: Column, depth: Column) -> Column:
    """Whether a deep answer is under three quarters of its least length, or 1,600 characters."""
    return (depth == "deep") & least.isNotNull() & (F.length(F.trim(text)) < F.greatest(F.lit(1600), F.floor(least * F.lit(0.75))))


def query_mode(answer: Column) -> Column:
    """The first mode, in fixed order, that is a word of a classifier's answer; else factual."""
    words = F.regexp_extract_all(F.lower(answer), F.lit("[a-z]+"), F.lit(0))
    return F.coalesce(*[F.when(F.array_contains(words, m), m) for m in MODES], F.lit("factual"))


def expanded_queries(answer: Column) -> Column:
    """Up to three queries of an expansion's lines; a number before them goes if its dot is among the first three characters."""
    lines = F.filter(F.transform(F.split(answer, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    clean = F.transform(lines, lambda x: F.when(F.locate(".", F.substring(x, 1, 3)) > 0, F.trim(F.regexp_replace(x, "^[^.]*\\.", ""))).otherwise(x))
    return F.slice(F.filter(clean, lambda x: x != ""), 1, 3)


def is_relevant(query: Column, text: Column, score: Column, keyword_score: Column, sources: Column, least: float = 0.6, least_coverage: float = 0.6) -> Column:
    """Whether a hit answers a query: identifiers, then score with some term, or keywords with enough terms.

    Two identifiers or more must all be in the text.  A hit of enough score needs one of two
    terms or more; any other needs a keyword score of BM25 or of an expanded query, and
    ``least_coverage`` of the terms.
    """
    low, terms, named = F.lower(text), query_terms(query), identifiers(query)
    share = coverage(terms, text)
    has_all = (F.size(named) < 2) | F.forall(named, lambda i: F.contains(low, i))
    some = (F.size(terms) < 2) | (share >= 1 / F.size(terms))
    keywords = F.arrays_overlap(sources, F.array(F.lit("bm25"), F.lit("multi_query"))) & (keyword_score > 0)
    return has_all & F.when(score >= least, some).otherwise(keywords & (share >= least_coverage))


def candidate_k(retrieval_k: Column, final_k: Column, most: int = 50) -> Column:
    """How many candidates to fetch: twice the final number at least, ``most`` at most."""
    return F.least(F.lit(most), F.greatest(retrieval_k, 2 * final_k))
