"""Classification of questions and small rules over them, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and patterns by which questions are told apart.
CHITCHAT = ["你好", "您好", "嗨", "hello", "hi", "hey", "谢谢", "感谢", "多谢", "thanks", "thank", "再见", "拜拜", "bye", "晚安", "早安", "你是谁", "你叫什么", "你能做什么", "介绍一下自己", "今天天气", "讲个笑话", "聊聊天"]
INTENT_WORDS = ["怎么", "如何", "什么", "为什么", "问题", "问一下", "请问", "部署", "配置", "安装", "文档", "规范", "查", "找", "搜"]
COMPLEX = ["对比", "比较", "区别", "优缺点", "分别", "综合", "分析", "评估", "为什么", "如何评估", "原因", "多个", "各个方面", "全面", "同时", "各有什么", "有什么不同", "有何不同", "异同", "两者", "二者", "两种", "各自的"]
QUESTION_WORDS = ["怎么", "如何", "什么", "为什么", "怎样", "是否", "能不能", "可以", "多少"]
ACTIONS = ["部署", "安装", "配置", "排查", "优化", "迁移", "升级", "设计", "实现"]
LISTING = ["包含哪些", "包含哪几", "有哪些", "有哪几", "列出", "列举", "几个方面", "几个层次", "哪几个", "哪六", "哪三", "哪五", "分别是", "分别是什么", "分别有"]
ABSTRACT = ["价值观", "文化", "原则", "理念", "精神", "准则"]
MARKERS = ["怎么", "如何", "为什么", "怎样", "?", "？", "吗", "呢"]
EXPLAINS = ["介绍", "说明", "解释", "分析", "查询", "搜索"]
TEMPORAL = ["最近", "本周", "上周", "这个月", "上个月", "今年", "去年", "今天", "昨天", "明天"]
PERSONAL = ["我的", "我们", "我部门", "我个人", "我"]
STOPWORDS = "的 了 在 是 我 有 和 就 不 人 都 一 一个 上 也 很 到 说 要 去 你 会 着 没有 看 好 自己 这 他 她 它 们 那 些 什么 怎么 如何 怎样 哪个 哪些 为什么 可以 能 能够 应该 需要 还是 或者 以及 并且 但是 因为 所以 如果 虽然 然后 之后 之前 之 吗 呢 吧 啊 哦 嗯 请 帮 给 把 被 让 从 对 向 与 及 其 等 或 且 而 所 该 此 将 已 正 再 又 才 刚 还 便 只 没 更 最 较 非常 十分 特别 相当 这个 那个 这里 那里 这样 那样 各种 其他 使用 进行 通过 根据 按照 关于 对于 为了 一些 一下 一点 一种 一部分".split()
ENTITIES = [r"(?:v|V)?\d+(?:\.\d+)+(?:-[a-zA-Z0-9]+)?", r"(?:[A-Z]{2,}[-\s]?)?\d{3,}", r"[a-zA-Z][a-zA-Z0-9._-]*\.[a-zA-Z]{1,10}", r"[A-Z][a-z]+(?:[A-Z][a-z]+)+"]
BETWEEN_WORDS = r"""[\s,，。！？、；：""''（）【】《》]+"""
COMPARED = r"\s*(?:和|与|vs\.?|VS\.?)\s*"
ASPECTS = {
    "installation": ["安装", "部署", "配置环境"],
    "configuration": ["配置", "设置", "参数"],
    "troubleshooting": ["故障", "报错", "错误", "排查", "解决"],
    "api_reference": ["API", "接口", "参数说明", "返回值"],
    "best_practices": ["最佳实践", "推荐", "建议方案"],
    "security": ["安全", "权限", "认证", "加密"],
    "version_history": ["版本", "更新日志", "changelog", "变更"],
}
NAMED = [r"[A-Za-z]+[0-9]+|[0-9]+[A-Za-z]+", "['\"'「『].+?['\"'」』]"]


def words(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def any_of(q: Column, values: list[str]) -> Column:
    return F.exists(words(values), lambda w: F.contains(q, w))


def split_compare(q: Column) -> Column:
    """The things that a question compares; none if there are fewer than two."""
    parts = F.filter(F.transform(F.split(q, COMPARED, -1), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(parts) >= 2, parts).otherwise(F.array().cast("array<string>"))


def is_chitchat(query: Column) -> Column:
    """Short, matches a greeting, asks for nothing, and the greetings make up two fifths of it."""
    q = F.lower(F.trim(query))
    covered = F.aggregate(F.filter(words(CHITCHAT), lambda w: F.contains(q, w)), F.lit(0), lambda n, w: n + F.length(w))
    return (F.length(q) <= 15) & (covered > 0) & ~any_of(q, INTENT_WORDS) & ~((F.length(q) > 6) & (covered < F.length(q) * 0.4))


def plan_reason(query: Column) -> Column:
    """Why a question goes to the planner or not; complex_marker and default do. A null question is empty."""
    q = F.trim(F.coalesce(query, F.lit("")))
    marked, plain = any_of(q, COMPLEX), ~any_of(q, QUESTION_WORDS) & ~any_of(q, ACTIONS) & (F.length(q) <= 30)
    return F.when(q == "", "empty_query").when((F.length(q) <= 15) & ~marked, "short_query_no_marker").when(marked, "complex_marker").when(plain, "noun_phrase").otherwise("default")


def should_plan(query: Column) -> Column:
    return plan_reason(query).isin("complex_marker", "default")


def use_hyde(q: Column, keywords: Column) -> Column:
    weak = (F.size(keywords) < 3) | F.forall(keywords, lambda k: F.length(k) <= 2)
    return any_of(q, LISTING) | (any_of(q, ABSTRACT) & weak)


def is_concrete(q: Column) -> Column:
    return q.rlike(NAMED[0]) | q.rlike(NAMED[1]) | (F.length(q) > 80)


def should_rewrite(q: Column, history: Column, since_last: Column, cool_down: int = 60) -> Column:
    """since_last: seconds since the last rewrite, null if there was none."""
    return (history > 0) & ~((F.length(q) > 50) & is_concrete(q)) & ~F.coalesce(since_last < cool_down, F.lit(False))


def validate_rewrite(original: Column, new: Column, ratio: float = 1.5, least: int = 20) -> Column:
    """The rewritten question, or the original if it is next to nothing, much too long, or no question any more."""
    empty = F.coalesce(F.length(F.trim(new)) < 2, F.lit(True))
    long = (F.length(new) > F.length(original) * ratio) & (F.length(new) - F.length(original) > least)
    lost = any_of(original, MARKERS) & ~any_of(new, MARKERS) & ~any_of(new, EXPLAINS)
    return F.when(empty | long | lost, original).otherwise(new)


def is_cacheable(q: Column, is_complex: Column) -> Column:
    return ~is_complex & ~any_of(q, TEMPORAL) & ~any_of(q, PERSONAL)


def fill_template(template: Column, values: Column) -> Column:
    """template with {{extracted.key}} replaced from a map; keys that are left go; an empty result becomes the values."""
    filled = F.aggregate(F.map_entries(values), template, lambda t, e: F.replace(t, F.concat(F.lit("{{extracted."), e.key, F.lit("}}")), e.value))
    text = F.trim(F.regexp_replace(filled, r"\{\{extracted\.\w+\}\}", ""))
    return F.when(text != "", text).otherwise(F.array_join(F.map_values(values), " "))


def extract_keywords(q: Column, most: int = 10) -> Column:
    """Versions, codes, file names and compound names first, then words of two characters or more that aren't stop words; in order, once."""
    named = [F.transform(F.regexp_extract_all(q, F.lit(p), F.lit(0)), lambda x: F.trim(x)) for p in ENTITIES]
    plain = F.filter(F.split(q, BETWEEN_WORDS, -1), lambda w: (F.length(w) >= 2) & ~w.isin(STOPWORDS))
    return F.slice(F.array_distinct(F.concat(*named, plain)), 1, most)


def expand_aspects(aspects: Column) -> Column:
    known = F.create_map(*[x for k, v in ASPECTS.items() for x in (F.lit(k), words(v))])
    return F.flatten(F.transform(aspects, lambda a: F.coalesce(F.try_element_at(known, a), F.array().cast("array<string>"))))


#: Intents in order, their words, and how many hits they take; anything else is factoid with 5.
ROUTES = [
    ("compare", r"对比|区别|比较|vs\.?|哪一个更好|哪个更|有什么不同|有什么差别|差异|A和B|和.+相比|相较于", 8),
    ("summary", r"总结|概述|概览|介绍一下|什么是|是什么|综合.*情况|整体.*情况|说一?下|讲一?下|介绍一?下", 15),
    ("howto", r"怎么|如何|怎样|步骤|流程|方法|怎么做|怎么办|指南", 8),
]


def route(q: Column) -> list[Column]:
    """intent and top_k of a question; a null one is factoid."""
    intent, top_k = F.lit("factoid"), F.lit(5)
    for name, pattern, k in reversed(ROUTES):
        found = F.coalesce(q.rlike(pattern), F.lit(False))
        intent, top_k = F.when(found, name).otherwise(intent), F.when(found, k).otherwise(top_k)
    return [intent.alias("intent"), top_k.alias("top_k")]


def cache_key_with_history(q: Column, history: Column) -> Column:
    """The key of a question, and the start of its history's hash where there is one."""
    return F.concat(F.substring(F.md5(F.trim(q)), 1, 16), F.when(F.coalesce(history, F.lit("")) != "", F.concat(F.lit(":"), F.left(history, F.lit(8)))).otherwise(""))
