"""Token patterns: predicates as columns, a small matcher over their bits.

A pattern is JSON.  Spark evaluates each distinct token test as a boolean column; the matcher
sees a sentence as an array of bit arrays, so no text travels to Python.  A node maps a place to
outcomes (end, captures, preference).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsumugi.functions import predicates
from tsumugi.operators.macros import expanded

Outcome = tuple[int, tuple, int]
Match = Callable[[int], list[Outcome]]
#: The longest repeat where a pattern names none.
REPEATS = 4
COMMA = "、"


def tests_of(node) -> Iterator[str]:
    """The token tests below a node: a predicate's spec, or field and value as JSON."""
    if isinstance(node, list):
        for x in node:
            yield from tests_of(x)
    elif isinstance(node, dict):
        if "token" in node:
            yield from tests_in(node["token"])
        else:
            for x in node.values():
                yield from tests_of(x)


def tests_in(body: list | dict) -> list[str]:
    return list(body) if isinstance(body, list) else [json.dumps([f, v], ensure_ascii=False) for f, v in body.items()]


def column_of(test: str) -> Column:
    if not test.startswith("["):
        return predicates.predicate(test)
    field, value = json.loads(test)
    return predicates.yes(F.col(field).isin(value) if isinstance(value, list) else F.col(field) == value)


def least_tokens(node: dict) -> int:
    """A lower bound of the tokens that a match takes."""
    match node:
        case {"token": _}:
            return 1
        case {"sequence": parts}:
            return sum(map(least_tokens, parts))
        case {"alt": parts}:
            return min(map(least_tokens, parts), default=0)
        case {"repeat": body}:
            return body.get("min", 0) * least_tokens(body["pattern"])
        case {"mapCaptures": {"pattern": inner}} | {"capture": _, "pattern": inner}:
            return least_tokens(inner)
    return 0


def best_of_each(outcomes: list[Outcome]) -> list[Outcome]:
    """One outcome of each end and captures: the best preference, at the first one's place."""
    kept: dict[tuple, Outcome] = {}
    for o in outcomes:
        if o[:2] not in kept or o[2] > kept[o[:2]][2]:
            kept[o[:2]] = o
    return list(kept.values())


def best_outcome(outcomes: list[Outcome], start: int) -> Outcome | None:
    """The longest outcome that advances; then preference, then captures, then the first."""
    return max((o for o in outcomes if o[0] > start), key=lambda o: (o[0], o[2], len(o[1])), default=None)


def matcher(node: dict, holds: dict[str, list[bool]], n: int, commas: list[bool]) -> Match:
    """A node's matcher over one sentence of ``n`` tokens; each place is worked out once."""
    build = lambda x: matcher(x, holds, n, commas)
    match node:
        case {"token": body}:
            tests = [holds[t] for t in tests_in(body)]
            run = lambda i: [(i + 1, (), 0)] if i < n and all(t[i] for t in tests) else []
        case {"sequence": body}:
            run = in_sequence([build(x) for x in body], n, commas)
        case {"alt": body}:
            parts = [build(x) for x in body]
            run = lambda i: best_of_each([o for p in parts for o in p(i)])
        case {"repeat": body}:
            run = repeated(build(body["pattern"]), build(body["until"]) if body.get("until") else None, body)
        case {"optional": body}:
            inner = build(body)
            run = lambda i: [(i, (), 0), *inner(i)]
        case {"capture": label, "pattern": body}:
            inner = build(body)
            run = lambda i: [(end, (*own, (label, i, end)), p) for end, own, p in inner(i)]
        case {"mapCaptures": {"pattern": body, "map": names}}:
            inner = build(body)
            run = lambda i: [(end, tuple((names.get(x, x), s, e) for x, s, e in own), p) for end, own, p in inner(i)]
        case {"peek": body}:
            inner = build(body)
            run = lambda i: [(i, (), 0)] if inner(i) else []
        case {"not": body}:
            inner = build(body)
            run = lambda i: [] if inner(i) else [(i, (), 0)]
        case {"anchor": edge}:
            place = {"start": 0, "end": n}.get(edge, -1)
            run = lambda i: [(i, (), 0)] if i == place else []
        case _:
            raise ValueError(f"no such node: {node}")
    return cache(run)


def in_sequence(parts: list[Match], n: int, commas: list[bool]) -> Match:
    """One part after the other; commas are passed over before every part but the first."""

    def run(i: int) -> list[Outcome]:
        open_: list[Outcome] = [(i, (), 0)]
        for k, part in enumerate(parts):
            grown = []
            for end, own, preference in open_:
                while k and end < n and commas[end]:
                    end += 1
                grown += [(e, own + more, preference + p) for e, more, p in part(end)]
            open_ = grown
        return open_

    return run


def repeated(inner: Match, until: Match | None, body: dict) -> Match:
    """``min`` to ``max`` rounds, each of which advances; greedy repeats list the longest first."""
    low, high, greedy = body.get("min", 0), body.get("max", REPEATS), body.get("greedy", True)

    def run(i: int) -> list[Outcome]:
        found: list[Outcome] = []
        stack = [(i, 0, (), 1 if greedy else -1)]
        while stack:
            place, rounds, own, preference = stack.pop()
            if rounds >= low:
                found.append((place, own, preference))
            if rounds == high or (until and until(place)):
                continue
            stack += [(e, rounds + 1, own + more, preference + p) for e, more, p in reversed(inner(place)) if e != place]
        found.sort(key=lambda o: (o[0], len(o[1])), reverse=greedy)
        return best_of_each(found)

    return run


def open_gates(rule: dict, holds: dict[str, list[bool]], n: int) -> list[bool]:
    """The places where a rule's ``startGate`` lets a match start."""
    gate = rule.get("startGate") or {}
    either = lambda specs, i: any(holds[s][i] for s in specs)
    if gate.get("anyToken") and not any(either(gate["anyToken"], i) for i in range(n)):
        return [False] * n
    near = gate.get("near") or {}
    left, right, specs = near.get("left", 0), near.get("right", 0), near.get("predicates") or []
    return [
        all(holds[s][i] for s in gate.get("firstToken") or [])
        and (not specs or any(either(specs, j) for j in range(max(0, i - left), min(n, i + right + 1))))
        for i in range(n)
    ]


def gate_tests(rule: dict) -> list[str]:
    gate = rule.get("startGate") or {}
    return [*(gate.get("firstToken") or []), *(gate.get("anyToken") or []), *((gate.get("near") or {}).get("predicates") or [])]


def hits_of(rules: list[dict], holds: dict[str, list[bool]], n: int, commas: list[bool]) -> Iterator[tuple[str, int, int, tuple]]:
    """(id, start, end, captures): hits of one rule don't overlap, those of two may."""
    for rule in rules:
        find, least, gates = matcher(rule["pattern"], holds, n, commas), least_tokens(rule["pattern"]), open_gates(rule, holds, n)
        i = 0
        while i <= n - max(least, 1):
            best = best_outcome(find(i), i) if gates[i] else None
            if best:
                yield rule["id"], i, best[0], tuple(c for c in best[1] if c[2] > c[1])
            i = best[0] if best else i + 1


def empty(node: dict) -> bool:
    """A pattern that can't hit, as catalogues hold for rules not written yet."""
    return any(k in node and not node[k] for k in ("sequence", "alt", "token")) or not node


def find_patterns(tokens: DataFrame, rules: list[dict], *, key: str, order: str, lexicon: DataFrame | None = None) -> DataFrame:
    """(key, pattern, level, priority, start, end, captures) of all hits.

    ``tokens``: a row a token, with the columns of ``predicates.TOKEN`` or those the tests name;
    ``rules``: {"id", "pattern", "level", "priority", "startGate"}.  Rules with empty patterns are
    dropped.  ``lexicon`` (text, pos) serves prefixHasPos.  One sentence's bits are one row on their
    way to Python; its length bounds them.  Nulls fail every test; an empty table has no hits.
    """
    rules = [r | {"pattern": expanded(r["pattern"])} for r in rules if r.get("pattern") and not empty(r["pattern"])]
    tests = list(dict.fromkeys(t for r in rules for t in [*tests_of(r["pattern"]), *gate_tests(r)]))
    rows = predicates.complete(tokens, key, order)
    flags = []
    for i, test in enumerate(tests):
        if test.startswith("prefixHasPos:"):
            if lexicon is None:
                raise ValueError("prefixHasPos needs a lexicon")
            rows = predicates.with_prefix_pos(rows, lexicon, f"__flag{i}", test.partition(":")[2])
            flags.append(F.col(f"__flag{i}"))
        else:
            flags.append(column_of(test))
    bits = F.array(predicates.yes(F.col("text") == COMMA), *flags)
    sentences = rows.select(F.col(key), F.struct(F.col(order).alias("o"), bits.alias("b")).alias("x")).groupBy(key).agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["b"]).alias("bits"))
    text, names = json.dumps(rules), ["id", "pattern", "level", "priority", "start", "end", "captures"]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = json.loads(text)
        described = {r["id"]: (r.get("level"), r.get("priority", 0)) for r in own}
        for batch in batches:
            out = []
            for name, flagged in zip(batch[key], batch["bits"], strict=True):
                commas, *columns = (list(c) for c in zip(*flagged, strict=True))
                for rule, start, end, captures in hits_of(own, dict(zip(tests, columns, strict=True)), len(flagged), commas):
                    out.append((name, rule, *described[rule], start, end, [{"label": a, "start": s, "end": e} for a, s, e in captures]))
            yield pd.DataFrame(out, columns=[key, *names[1:]])

    kind = tokens.schema[key].dataType.simpleString()
    return sentences.mapInPandas(scan, f"`{key}` {kind}, pattern string, level string, priority int, start int, end int, captures array<struct<label: string, start: int, end: int>>")


def display_segments(texts: list[str], captures: list[dict]) -> list[dict]:
    """Captures in order of their start with the raw text between them; overlaps repeat their text."""
    out, place = [], 0
    for c in sorted(captures, key=lambda c: (c["start"], c["end"])):
        if c["start"] > place:
            out.append({"type": "raw", "text": "".join(texts[place : c["start"]])})
        out.append({"type": "capture", "label": c["label"], "text": "".join(texts[c["start"] : c["end"]])})
        place = max(place, c["end"])
    return out + ([{"type": "raw", "text": "".join(texts[place:])}] if place < len(texts) else [])
