"""What style sheets and style attributes say of display, visibility and white space.

Selectors of type, class, id and attribute, joined by descendant and child combinators, in lists; rules for screens.
Rules with pseudo-classes or other combinators are left out, as are all other properties.
"""

from __future__ import annotations

import re

PROPERTIES = ("display", "visibility", "white-space")
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_SIMPLE = re.compile(r"""\*|[a-z][\w-]*|\.[\w-]+|\#[\w-]+|\[\s*[\w-]+\s*(?:=\s*(?:"[^"]*"|'[^']*'|[\w-]+)\s*)?\]""", re.I)
_COMPOUND = re.compile(rf"(?:{_SIMPLE.pattern})+", re.I | re.X)


def declarations(text: str) -> dict[str, tuple[bool, str]]:
    """(important, value) by property; of several the last counts, an important one before others."""
    out: dict[str, tuple[bool, str]] = {}
    for part in text.lower().split(";"):
        name, colon, value = part.partition(":")
        name = name.strip()
        if not colon or name not in PROPERTIES:
            continue
        value, mark, _ = value.partition("!")
        important = bool(mark) and part.rpartition("!")[2].strip() == "important"
        if (mark and not important) or (out.get(name, (False,))[0] and not important):
            continue
        out[name] = (important, value.strip())
    return out


def _on_screen(query: str) -> bool:
    kinds = [q.split() for q in query.lower().split(",")]
    return not query.strip() or any(k[:1] in (["screen"], ["all"]) or k[:2] == ["only", "screen"] for k in kinds if len(k) < 3)


def _blocks(text: str):
    """(prelude, body) of rules, those of screen media unfolded."""
    at = 0
    while (opened := text.find("{", at)) >= 0:
        prelude = text[at:opened].rpartition(";")[2] if text[at:opened].lstrip().startswith("@") else text[at:opened]
        depth, end = 1, opened + 1
        for m in re.finditer(r"[{}]", text[end:]):
            depth += 1 if m[0] == "{" else -1
            if not depth:
                end += m.start()
                break
        else:
            end = len(text)
        body, at = text[opened + 1 : end], end + 1
        name = prelude.strip().lower()
        if name.startswith("@media"):
            if _on_screen(name[6:]):
                yield from _blocks(body)
        elif not name.startswith("@"):
            yield prelude, body


def _selector(text: str):
    """[(combinator, [simple selectors])] from the element outwards, and its specificity; None if it isn't understood."""
    steps, at, joined = [], 0, ""
    text = text.strip()
    while at < len(text):
        m = _COMPOUND.match(text, at)
        if m is None:
            return None
        steps.append((joined, _SIMPLE.findall(m[0])))
        at = m.end()
        gap = re.compile(r"\s*>\s*|\s+|\Z").match(text, at)
        if gap is None:
            return None
        joined, at = (">" if ">" in gap[0] else " "), gap.end()
        if at >= len(text) and ">" in gap[0]:
            return None
    if not steps:
        return None
    simple = [s for _, parts in steps for s in parts]
    rank = (sum(s[0] == "#" for s in simple), sum(s[0] in ".[" for s in simple), sum(s[0] not in "#.[*" for s in simple))
    inward = [(steps[k + 1][0] if k + 1 < len(steps) else "", parts) for k, (_, parts) in enumerate(steps)]
    return inward[::-1], rank


def rules_of(sheets: list[str]) -> list:
    """(selector, specificity, order, declarations) of the rules that set one of PROPERTIES."""
    out = []
    for sheet in sheets:
        if not any(p in sheet.lower() for p in PROPERTIES):
            continue
        for prelude, body in _blocks(_COMMENT.sub(" ", sheet)):
            said = declarations(body)
            for one in prelude.split(",") if said else ():
                known = _selector(one)
                if known:
                    out.append((*known, len(out), said))
    return out


def _fits(node, parts: list[str]) -> bool:
    for s in parts:
        if s == "*":
            continue
        if s[0] == ".":
            ok = s[1:] in (node.get("class") or "").split()
        elif s[0] == "#":
            ok = (node.get("id") or "") == s[1:]
        elif s[0] == "[":
            name, equals, value = s[1:-1].partition("=")
            have = node.get(name.strip().lower())
            ok = have is not None and (not equals or have == value.strip().strip("\"'"))
        else:
            ok = node.tag == s.lower()
        if not ok:
            return False
    return True


def matches(node, ancestors: list, steps: list) -> bool:
    """Whether an element with these ancestors (outermost first) fits a selector."""
    if not _fits(node, steps[0][1]):
        return False
    return _outward(ancestors, len(ancestors), steps, 1)


def _outward(ancestors: list, upto: int, steps: list, k: int) -> bool:
    if k == len(steps):
        return True
    combinator, parts = steps[k]
    for at in range(upto - 1, -1, -1):
        if _fits(ancestors[at], parts):
            if combinator != ">" or at == upto - 1:
                # the nearest ancestor serves a descendant unless a child step follows
                if _outward(ancestors, at, steps, k + 1):
                    return True
                if not any(c == ">" for c, _ in steps[k + 1 :]):
                    return False
        if combinator == ">":
            return False
    return False


def computed(node, ancestors: list, rules: list) -> dict[str, str]:
    """The values that win for an element: important ones first, then the style attribute, then by specificity and order."""
    best: dict[str, tuple] = {}
    for steps, rank, order, said in rules:
        if matches(node, ancestors, steps):
            for name, (important, value) in said.items():
                key = (important, False, rank, order)
                if name not in best or key > best[name][0]:
                    best[name] = (key, value)
    inline = node.get("style") if "style" in node.attrs.lower() else None
    for name, (important, value) in declarations(inline or "").items():
        key = (important, True, (0, 0, 0), 0)
        if name not in best or key > best[name][0]:
            best[name] = (key, value)
    return {name: value for name, (_, value) in best.items()}
