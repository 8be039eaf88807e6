"""A check of single-file components: their blocks, the tags of templates, the scripts."""

from __future__ import annotations

import re

from loomdex.llm.syntax.base import CONFLICT, Fault
from loomdex.llm.syntax.ecma import check_ecma

_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
_TAG = re.compile(r"<(/?)([A-Za-z][\w:.-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*?)(/?)>")
_TOP = re.compile(r"<(template|script|style|i18n|docs|[a-z][\w-]*)\b((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


def check_vue(text: str) -> list[Fault]:
    """Faults of a component; without a template and without a script it is none."""
    faults: list[Fault] = []
    line = lambda at: text.count("\n", 0, at) + 1
    at, seen = 0, set()
    while True:
        comment, top = _COMMENT.search(text, at), _TOP.search(text, at)
        if top is None:
            break
        if comment and comment.start() < top.start():
            if not text[at : comment.start()].strip():
                at = comment.end()
                continue
        between = text[at : top.start()]
        if between.strip():
            faults.append(Fault(line(at + len(between) - len(between.lstrip())), "text outside the blocks"))
        name = top[1].lower()
        seen.add(name)
        if top[2].rstrip().endswith("/"):
            at = top.end()
            continue
        end = _end_of_block(text, top.end(), name)
        if end is None:
            faults.append(Fault(line(top.start()), f"the {name} block does not end"))
            at = len(text)
            if name == "script":
                faults += check_ecma(text, True, top.end())
            break
        body_end, at = end
        if name == "script":
            lang = re.search(r"lang\s*=\s*[\"']?(\w+)", top[2])
            if lang is None or lang[1] in ("js", "ts", "jsx", "tsx"):
                faults += check_ecma(text, bool(lang and lang[1].startswith("ts")), top.end(), body_end)
        elif name == "template" and not re.search(r"lang\s*=\s*[\"']?(?!html)\w", top[2]):
            faults += [Fault(line(top.end() + o), cause) for o, cause in _tags(text[top.end() : body_end])]
    rest = _COMMENT.sub("", text[at:])
    if rest.strip() and at < len(text):
        faults.append(Fault(line(at), "text outside the blocks"))
    if not seen & {"template", "script"}:
        faults.append(Fault(1, "neither a template nor a script block"))
    if "<<<<<<<" in text and (m := CONFLICT.search(text)) and not any(f.cause == "merge conflict" for f in faults):
        inside = any(c.start() < m.start() < c.end() for c in _COMMENT.finditer(text)) or re.search(r"/\*(?:(?!\*/)[\s\S])*\Z", text[: m.start()])
        if not inside:
            faults.append(Fault(line(m.start()), "merge conflict"))
    return sorted(faults)


def _end_of_block(text: str, at: int, name: str) -> tuple[int, int] | None:
    """(end of the body, end of the closing tag) of a top block; templates nest."""
    depth = 1
    for m in re.compile(rf"<(/?){name}\b((?:[^<>\"']|\"[^\"]*\"|'[^']*')*?)>", re.I).finditer(text, at):
        if name != "template":
            if m[1]:
                return m.start(), m.end()
            continue
        if m[1]:
            depth -= 1
        elif not m[2].rstrip().endswith("/"):
            depth += 1
        if depth == 0:
            return m.start(), m.end()
    return None


def _tags(body: str) -> list[tuple[int, str]]:
    body = _COMMENT.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), body)
    body = re.sub(r"\{\{.*?\}\}", lambda m: re.sub(r"[^\n]", " ", m[0]), body, flags=re.S)
    stack: list[tuple[str, int]] = []
    out = []
    for m in _TAG.finditer(body):
        name = m[2]
        if m[1]:
            if name.lower() in _VOID:
                continue
            if not stack or stack[-1][0] != name:
                out.append((m.start(), f"</{name}> closes nothing"))
                if any(s == name for s, _ in stack):
                    while stack and stack.pop()[0] != name:
                        pass
            else:
                stack.pop()
        elif not m[4] and name.lower() not in _VOID:
            stack.append((name, m.start()))
    return out + [(o, f"<{name}> does not end") for name, o in stack if name.lower() not in ("p", "li")]
