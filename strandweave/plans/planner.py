"""From a question to a retrieval plan: rules over a column of questions, and a policy over them."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What questions are told by, in the order the rules are tried.
DOCUMENT_ID = r"\b([A-Za-z]{2,}-\d{4}-\d{3,})\b"
ENTITY_ID = r"\b([A-Za-z][A-Za-z0-9_]*-\d{2,})\b"
PROVISION = r"(?:มาตรา|ข้อ|article|section|clause)\s*[0-9๐-๙]+"
IMPACT = ("impact", "affected", "ผลกระทบ", "หยุดทำงาน", "กระทบ", "ล่ม")
NEWS = ("ข่าว", "news")
OVERVIEW = ("ภาพรวม",)
RELATED = ("สัมพันธ์", "relationship", "หน่วยงาน", "organization")
CAUSE = ("ปัจจัย", "สาเหตุ", "ล่าช้า", "delay", "cause", "root cause")
CONNECT = ("depend", "relationship", "เชื่อม", "สัมพันธ์", "เกี่ยวข้อง", "connect")
HOW = ("vpn", "ขั้นตอน", "วิธี", "ทำอย่างไร", "ต้องทำอย่างไร", "ดำเนินการอย่างไร", "how to", "procedure")
MONTHS = {
    1: ("มกราคม", "january"), 2: ("กุมภาพันธ์", "february"), 3: ("มีนาคม", "march"), 4: ("เมษายน", "april"), 5: ("พฤษภาคม", "may"), 6: ("มิถุนายน", "june"),
    7: ("กรกฎาคม", "july"), 8: ("สิงหาคม", "august"), 9: ("กันยายน", "september"), 10: ("ตุลาคม", "october"), 11: ("พฤศจิกายน", "november"), 12: ("ธันวาคม", "december"),
}
#: Channels, scope and depth of an intent; depth 0 stands for the policy's largest.
CHANNELS = {
    "how_to": (("vector", "full_text"), "none", 1),
    "relationship_local": (("graph",), "local", 1),
    "entity_lookup": (("vector", "full_text", "graph"), "local", 1),
    "impact_analysis": (("graph", "vector"), "local", 0),
    "semantic_global": (("graph", "vector"), "global", 1),
    "graph_global": (("graph", "vector"), "global", 1),
    "news_by_date": (("full_text", "vector"), "none", 1),
    "document_exact": (("exact_document", "full_text"), "none", 1),
    "legal_provision": (("vector", "full_text", "graph", "external"), "local", 1),
    "semantic_hybrid": (("vector", "full_text", "external"), "none", 1),
}


#: The switch of a policy that a channel hangs on; looking for a document by its id hangs on none.
SWITCH = {"vector": "enable_vector", "full_text": "enable_fulltext", "graph": "enable_graph", "external": "enable_lightrag"}
BOUNDS = {"default_top_k": (1, 30), "maximum_top_k": (1, 50), "maximum_graph_depth": (1, 3), "authority_weight": (0, 1), "recency_weight": (0, 1), "status_weight": (0, 1), "version": (1, None)}
MODES = ("auto", "balanced", "precision", "recall")


@dataclass(frozen=True)
class Policy:
    """What a corpus allows, by the names its stored settings have; a value out of range is an error."""

    version: int = 1
    retrieval_mode: str = "auto"
    enable_vector: bool = True
    enable_fulltext: bool = True
    enable_graph: bool = True
    enable_lightrag: bool = True
    enable_reranker: bool = True
    planner_llm_fallback: bool = True
    default_top_k: int = 12
    maximum_top_k: int = 30
    maximum_graph_depth: int = 3
    citation_required: bool = True
    legal_awareness: bool = True
    exclude_invalid: bool = True
    authority_weight: float = 0.30
    recency_weight: float = 0.15
    status_weight: float = 0.35

    def __post_init__(self):
        for name, (low, high) in BOUNDS.items():
            value = getattr(self, name)
            if isinstance(value, bool) or not low <= value <= (value if high is None else high):
                raise ValueError(f"{name} is out of range")
        if self.retrieval_mode not in MODES:
            raise ValueError("retrieval_mode must be one of " + ", ".join(MODES))

    def allows(self, channel: str) -> bool:
        return channel == "exact_document" or bool(getattr(self, SWITCH.get(channel, ""), False))

    @classmethod
    def parse(cls, config: dict | None) -> Policy:
        """A policy from a stored setting; all defaults where anything in it does not parse."""
        try:
            known = {f.name: type(f.default) for f in fields(cls)}
            return cls(**{k: known[k](v) if known[k] in (int, float) and not isinstance(v, bool) else v for k, v in (config or {}).items() if k in known})
        except (TypeError, ValueError):
            return cls()


def meet(policies: list[Policy]) -> Policy:
    """What all policies allow: flags must agree, numbers are the least. Mode and version are the first one's."""
    if not policies:
        return Policy()
    out = policies[0]
    for p in policies[1:]:
        both = {f.name: (getattr(out, f.name), getattr(p, f.name)) for f in fields(Policy) if f.name not in ("retrieval_mode", "version")}
        out = replace(out, **{k: (a and b) if isinstance(a, bool) else min(a, b) for k, (a, b) in both.items()})
    return out


def _any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def document_ids(question: Column) -> Column:
    return F.regexp_extract_all(question, F.lit(DOCUMENT_ID), F.lit(1))


def entity_ids(question: Column, documents: Column | None = None) -> Column:
    """Identifiers that are no part of a document id."""
    docs = document_ids(question) if documents is None else documents
    return F.filter(F.regexp_extract_all(question, F.lit(ENTITY_ID), F.lit(1)), lambda e: ~F.exists(docs, lambda d: F.contains(d, e)))


def month_start(question: Column) -> Column:
    """The first day of the month a question names, if it names a year of this century too."""
    low = F.lower(question)
    year = F.nullif(F.regexp_extract(low, r"\b(20\d{2})\b", 1), F.lit("")).cast("int")
    month = F.lit(None).cast("int")
    for n in sorted(MONTHS, reverse=True):
        month = F.when(F.contains(low, F.lit(MONTHS[n][1])), n).otherwise(month)
    for n in sorted(MONTHS, reverse=True):
        month = F.when(F.contains(low, F.lit(MONTHS[n][0])), n).otherwise(month)
    return F.when(year.isNotNull() & month.isNotNull(), F.make_date(year, month, F.lit(1)))


def _rule(low: Column, docs: Column, entities: Column, month: Column) -> Column:
    has_entity = F.size(entities) > 0
    return (
        F.when(F.size(docs) > 0, "document_exact")
        .when(_any(low, IMPACT), "impact_analysis")
        .when(_any(low, NEWS) & month.isNotNull(), "news_by_date")
        .when(_any(low, OVERVIEW) & _any(low, RELATED), "graph_global")
        .when(_any(low, CAUSE), "semantic_global")
        .when(has_entity & _any(low, CONNECT), "relationship_local")
        .when(low.rlike(PROVISION), "legal_provision")
        .when(_any(low, HOW), "how_to")
        .when(has_entity, "entity_lookup")
        .otherwise("semantic_hybrid")
    )


def with_intent(questions: DataFrame, question: str) -> DataFrame:
    """Adds ``intent`` (the first rule that holds names it), ``document_ids``, ``entity_ids`` and ``published_from``; what rules share is worked out once."""
    q = F.col(question)
    out = questions.withColumn("document_ids", document_ids(q)).withColumn("published_from", month_start(q))
    out = out.withColumn("entity_ids", entity_ids(q, F.col("document_ids")))
    return out.withColumn("intent", _rule(F.lower(F.trim(q)), F.col("document_ids"), F.col("entity_ids"), F.col("published_from")))


def plan(questions: DataFrame, question: str, policy: Policy, wanted: int | None = None) -> DataFrame:
    """Adds intent, whether the rules left it ambiguous, channels, graph_scope, graph_depth, max_sources and the window of publication to every question."""
    channels, scope, depth = F.when(F.lit(False), F.array(F.lit(""))), F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(0))
    for name, (names, where, deep) in CHANNELS.items():
        kept = [c for c in names if policy.allows(c)]
        if policy.retrieval_mode == "precision":
            kept = [c for c in kept if c != "full_text"]
        elif policy.retrieval_mode == "recall" and policy.enable_fulltext and "full_text" not in kept:
            kept.append("full_text")
        is_ = F.col("intent") == name
        channels = channels.when(is_, F.array(*[F.lit(c) for c in kept]) if kept else F.array().cast("array<string>"))
        scope, depth = scope.when(is_, where), depth.when(is_, deep or policy.maximum_graph_depth)
    out = with_intent(questions, question)
    return out.withColumns({
        "channels": channels, "graph_scope": scope, "graph_depth": depth, "max_sources": F.lit(min(wanted or policy.default_top_k, policy.maximum_top_k)),
        "published_to": F.add_months("published_from", 1), "ambiguous": F.col("intent") == "semantic_hybrid",
    })


def clamp(proposed: dict, base: dict, policy: Policy, question: str, wanted: int | None = None) -> dict:
    """A plan proposed from outside, held to the policy: allowed channels only, the vector channel kept for Thai questions, numbers within bounds."""
    channels = [c for c in proposed.get("channels", []) if policy.allows(c)]
    thai = sum("฀" <= c <= "๿" for c in question) / max(1, len(question))
    if thai >= 0.2 and policy.enable_vector and "vector" not in channels:
        channels.append("vector")
    most = min(wanted or policy.default_top_k, policy.maximum_top_k)
    return base | {
        "intent": str(proposed.get("intent") or base.get("intent"))[:80], "channels": channels, "max_sources": min(int(proposed.get("max_sources", most)), most),
        "graph_depth": min(max(1, int(proposed.get("graph_depth", 1))), policy.maximum_graph_depth), "planner": "external",
    }
