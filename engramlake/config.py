"""Every default of the engine in one place. Times are epoch seconds; the clock is always an argument."""

from __future__ import annotations

from dataclasses import dataclass, field

AS_OF = 1711929600.0  # 2024-04-01T00:00:00Z, after the last row of the test tables
DAY = 86400.0

# Terms that tell the intent of a query.
RELATION_TERMS = ["谁", "和谁", "关系", "认识", "朋友", "同事", "家人", "父母", "妈妈", "爸爸", "老师", "同学", "partner", "friend", "relationship", "with whom"]
TEMPORAL_TERMS = ["上次", "昨天", "前天", "刚才", "之前", "什么时候", "哪天", "最近", "last time", "yesterday", "recently", "when"]
FACTUAL_TERMS = ["是什么", "什么是", "解释", "定义", "怎么", "如何", "why", "what is", "explain", "define", "how to"]

# Words that tell the class of an atom (times, actions, states, relations, preferences).
ATOM_PATTERNS = {
    "time": r"明天|后天|大后天|昨天|前天|今天|(?:上周|本周|下下周|下周)?周[一二三四五六日天]|上周|本周|下下周|下周|下个?月|上个?月|明年|后年|去年|前年|[0-9]{1,2}月[0-9]{1,2}[日号]|[0-9]{4}年[0-9]{1,2}月|上午|下午|晚上|凌晨|早上|中午|傍晚|[0-9]{1,2}[点时：:][0-9]{1,2}",
    "action": r"开会|讨论|参加|组织|安排|举办|进行|执行|完成|提交|发送|发布|去|来|到|做|要|准备|计划|打算",
    "stative": r"是|有|属于|等于|代表|意味|包含|包括|位于",
    "relation": r"同事|朋友|同学|家人|亲戚|队友|搭档|伙伴|老板|上司|下属|合作|合伙|夫妻|情侣|邻居|室友|老乡",
    "preference": r"喜欢|讨厌|爱|不爱|偏好|最爱|不喜欢|热衷于|沉迷|爱吃|爱喝|喜欢喝|喜欢去|讨厌吃|讨厌去",
}
# Confidence of each class, base days to live and kind of decay, states of an atom.
ATOM_CONFIDENCE = {"planned": 0.85, "preference": 0.82, "relational": 0.80, "factual": 0.78, "episodic": 0.75, "unknown": 0.60}
TTL_BASE = {"episodic": (7.0, "exponential"), "planned": (2.0, "step"), "factual": (180.0, "exponential"), "relational": (90.0, "linear"), "preference": (60.0, "exponential"), "unknown": (30.0, "exponential")}
ATOM_STATUSES = ["active", "dormant", "expired", "forgotten", "superseded"]
STOP_WORDS = "the a an of to and or in on at is are was for with that this it as by from".split()
FOLD_FROM = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
FOLD_TO = "aaaaaaceeeeiiiinooooouuuuyy"


@dataclass(frozen=True)
class Recall:
    """Parameters of recall; the defaults are those of the published behaviour."""

    k: int = 10
    rrf_k: int = 60
    k1: float = 1.2
    b: float = 0.75
    weight_rrf: float = 0.5
    weight_importance: float = 0.25
    weight_recency: float = 0.25
    decay_rate: float = 0.01
    doc_route: float = 0.65
    graph_route: float = 0.35
    both_bonus: float = 0.08
    graph_rrf: float = 0.55
    graph_importance: float = 0.2
    graph_recency: float = 0.15
    graph_confidence: float = 0.1
    recent_slots: int = 2
    recent_hours: float = 72.0
    mmr_lambda: float = 0.7
    expansion_limit: int = 24
    decays: dict = field(default_factory=dict)
