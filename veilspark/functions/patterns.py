"""Recognizer patterns for Spark's regex engine.

Digits and white space are spelled out as Unicode classes, and word borders as
look-arounds, because the engine's own shorthands are ASCII by default.
"""

from __future__ import annotations

from dataclasses import dataclass

from veilspark.functions.tables import GAZETTEER, ORG_SUFFIXES, ORG_VERBS, ORG_WORDS_EN

D = r"\p{Nd}"
S = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
W = r"[\p{L}\p{N}_]"
CJK = r"\x{4e00}-\x{9fff}"
_SUFFIX = "(?:" + "|".join(ORG_SUFFIXES) + ")"


@dataclass(frozen=True)
class Recognizer:
    """One generator; ``group`` 1 means that the span is the first group, which ends where the match ends."""

    key: str
    entity_type: str
    pattern: str
    score: float
    source: str
    group: int = 0
    language: str = "all"
    #: What every text with a match has; cheaper to look for than the match.
    needs: str | None = None
    #: What matches are not looked for within: where this matches, the search goes on behind it.
    outside: str | None = None


_EMAIL = r"(?iu)(?<![A-Za-z0-9_.+-])[A-Za-z0-9_.+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"

RULES = (
    Recognizer("email", "EMAIL", _EMAIL, 0.99, "RULE", needs="@"),
    Recognizer("phone_cn", "PHONE", rf"(?<!{D})(?:\+?86[- ]?)?1[3-9]{D}{{9}}(?!{D})", 0.99, "RULE", needs=f"1[3-9]{D}{{9}}"),
    Recognizer("phone_intl", "PHONE", rf"(?<!{D})(?:\+?(?:1|44|61|81|82|65)[-. ]?)?\(?{D}{{2,4}}\)?[-. ]{D}{{3,4}}[-. ]{D}{{4}}(?!{D})", 0.94, "RULE", needs=f"{D}[-. ]{D}{{4}}"),
    Recognizer("id_card", "ID_CARD", rf"(?<!{D}){D}{{17}}[0-9Xx](?!{D})", 0.995, "RULE", needs=f"{D}{{17}}"),
    Recognizer("passport", "PASSPORT", rf"(?iu)(?<![A-Z0-9])(?:[EGDSP]{D}{{8}}|[A-Z]{{1,2}}{D}{{6,9}})(?![A-Z0-9])", 0.94, "RULE", needs=f"{D}{{6}}", outside=_EMAIL),
    Recognizer("bank_card", "BANK_CARD", rf"(?<!{D})(?:{D}[ -]?){{12,19}}(?!{D})", 0.97, "RULE", needs=f"(?:{D}[ -]?){{12}}"),
)
LITE = (
    Recognizer("org_zh_context", "ORG", rf"(?:{'|'.join(ORG_VERBS)}|在){S}*([{CJK}·&]{{2,30}}{_SUFFIX})", 0.90, "NER-LITE", 1, "zh", f"[{CJK}]"),
    Recognizer("org_zh", "ORG", rf"(?<![{CJK}])([{CJK}·&]{{2,30}}{_SUFFIX})", 0.88, "NER-LITE", 1, "zh", f"[{CJK}]"),
    Recognizer("org_en", "ORG", rf"(?<![A-Za-z])((?:[A-Z][A-Za-z&.-]*{S}+){{1,5}}(?:{'|'.join(ORG_WORDS_EN)}|Corp\.?|Ltd\.?))(?![A-Za-z])", 0.88, "NER-LITE", 1, "en", "|".join((*ORG_WORDS_EN, "Corp", "Ltd"))),
    Recognizer(
        "address",
        "ADDRESS",
        rf"(?:(?:北京市|上海市|天津市|重庆市|[{CJK}]{{2,7}}省[{CJK}]{{2,7}}市)?(?:海淀区|朝阳区|浦东新区|[{CJK}]{{2,5}}(?:区|县)))[{CJK}0-9]{{1,25}}(?:路|街|道|巷|号|栋|单元|室)(?:[{CJK}0-9-]{{0,12}})",
        0.91,
        "NER-LITE",
        0,
        "zh",
        f"[{CJK}]",
    ),
    Recognizer("location", "LOCATION", "(?iu)(?=[" + "".join(sorted({g[0] for g in GAZETTEER})) + "])(?:" + "|".join(GAZETTEER) + ")", 0.83, "NER-LITE"),
    Recognizer("person_zh", "PERSON", rf"(?:(?:我叫){S}*|(?:姓名|联系人|采访对象(?:姓名)?)[：:]{S}*)([{CJK}·]{{2,5}})", 0.86, "NER-LITE", 1, "zh", f"[{CJK}]"),
    Recognizer("person_en", "PERSON", rf"(?=[A-Z])(?:(?<!{W})|(?<=(?<!{W})(?:Mr|Ms|Dr)))([A-Z][a-z]{{2,}}{S}+[A-Z][a-z]{{2,}})(?!{W})", 0.78, "NER-LITE", 1, "en"),
)
ALL = {r.key: r for r in RULES + LITE}
