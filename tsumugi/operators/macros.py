"""Named patterns, written out before a pattern is compiled."""

from __future__ import annotations


def tok(*specs: str) -> dict:
    return {"token": list(specs)}


def seq(*nodes: dict) -> dict:
    return {"sequence": list(nodes)}


def alt(*nodes: dict) -> dict:
    return {"alt": list(nodes)}


def opt(node: dict) -> dict:
    return {"optional": node}


def rep(node: dict, low: int, high: int, until: dict | None = None) -> dict:
    return {"repeat": {"pattern": node, "min": low, "max": high} | ({"until": until} if until else {})}


def cap(label: str, node: dict) -> dict:
    return {"capture": label, "pattern": node}


def no(node: dict) -> dict:
    return {"not": node}


def mac(name: str) -> dict:
    return {"macro": name}


def words(*texts: str) -> dict:
    """The texts, each a token of its own."""
    return tok(f"text:{texts[0]}") if len(texts) == 1 else seq(*[tok(f"text:{t}") for t in texts])


NA, KU = tok("isNaAdjective"), tok("isIAdjKuForm")
NI = tok("text:に", "isParticle")
MAYBE_WA = opt(words("は"))
TOPIC = alt(words("で", "は"), words("では"), words("じゃ"))

# What each named pattern stands for.
MACROS = {
    "NP": seq(opt(rep(alt(tok("isNominalHead"), tok("isNounModifier"), mac("AttributiveClause"), tok("isNounConnector"), tok("pos:pref")), 1, 10)), tok("isNounPhrase")),
    "NPCase": seq(mac("NP"), tok("isCaseParticle")),
    "NPTopic": seq(mac("NP"), tok("isTopicMarker")),
    "ClauseAdjunct": alt(tok("isAdverbModifier"), mac("NPCase"), seq(mac("NPCase"), tok("isTopicMarker")), mac("NPTopic"), tok("pos:exp")),
    "PrePredicateAdjuncts": rep(mac("ClauseAdjunct"), 0, 8),
    "AttributiveClause": rep(tok("isPredicate"), 1, 10, until=tok("isNounPhrase")),
    "NaAdjDe": seq(NA, tok("isCopulaDe"), no(tok("lemma:ある"))),
    "NaAdjDeshite": seq(NA, alt(words("でして"), words("で", "して"))),
    "NaAdjNegativeConnective": seq(NA, alt(words("ではなくて"), words("では", "なくて"), words("で", "は", "なくて"), words("じゃなくて"), words("じゃ", "なくて"))),
    "IAdjKu": KU,
    "IAdjKute": alt(tok("isIAdjKuteForm"), seq(KU, words("て"))),
    "IAdjKunai": alt(tok("isIAdjKunaiForm"), seq(KU, MAYBE_WA, tok("lemma:ない"))),
    "IAdjKunakute": alt(seq(KU, words("なくて")), seq(KU, MAYBE_WA, alt(tok("lemma:ない"), words("なく")), words("て"))),
    "IAdjPoliteNegative": alt(seq(mac("IAdjKunai"), opt(alt(tok("lemma:です"), tok("lemmaNeg:ある")))), seq(KU, MAYBE_WA, tok("lemmaNeg:ある"))),
    "IAdjKuSuru": seq(KU, tok("lemma:する")),
    "IAdjKuNaru": alt(seq(KU, tok("isNaruVerb")), tok("isIAdjKuVerbCompound", "isNaruVerb")),
    "NaAdjNi": seq(NA, NI),
    "NaAdjNiNaru": alt(seq(NA, NI, tok("isNaruVerb")), tok("pos:exp", "prefixHasPos:になる:adj-na")),
    "NaAdjNiSuru": alt(seq(NA, NI, tok("isSuruVerb")), tok("isSuruVerb", "prefixHasPos:にする:adj-na")),
    "NPDeWaTopic": seq(cap("np", mac("NP")), cap("contrastMarker", TOPIC)),
    "CopulaNegative": cap("copulaNegative", alt(words("ではない"), words("じゃない"), words("ではありません"), words("じゃありません"), seq(TOPIC, alt(seq(no(words("なく")), no(words("なくて")), tok("lemma:ない")), tok("lemmaNeg:ある"))))),
    "DeWaFrame": seq(
        no(alt(words("それ", "で", "は"), words("それ", "では"), words("それ", "じゃ"), words("それでは"), words("それじゃ"))),
        mac("NPDeWaTopic"),
        no(alt(words("ではなく"), words("じゃなく"), words("ではなくて"), words("じゃなくて"), words("なく"), words("なくて"), tok("lemma:ない"), tok("lemma:ある"), words("ではある"))),
    ),
}


def expanded(node: dict) -> dict:
    """The pattern with every macro written out."""
    if "macro" in node:
        if node["macro"] not in MACROS:
            raise ValueError(f"no such macro: {node['macro']}")
        return expanded(MACROS[node["macro"]])
    if "token" in node or "anchor" in node:
        return node
    if "repeat" in node:
        body = node["repeat"]
        return {"repeat": body | {k: expanded(body[k]) for k in ("pattern", "until") if body.get(k)}}
    if "mapCaptures" in node:
        return {"mapCaptures": node["mapCaptures"] | {"pattern": expanded(node["mapCaptures"]["pattern"])}}
    inner = {k: [expanded(x) for x in v] if isinstance(v, list) else expanded(v) for k, v in node.items() if k != "capture"}
    return node | inner
