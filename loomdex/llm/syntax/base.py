"""What the parsers share: faults, a token cursor, recovery."""

from __future__ import annotations

import re
import sys
from typing import NamedTuple

sys.setrecursionlimit(max(sys.getrecursionlimit(), 6000))

CONFLICT = re.compile(r"^<{7}(?: .*)?\r?$[\s\S]*?^={7}\r?$[\s\S]*?^>{7}(?: .*)?\r?$", re.M)


TOO_DEEP = "too deep"  # cause where nesting goes deeper than the parser can follow, which is no fault of the text


class Fault(NamedTuple):
    line: int
    cause: str


class Trouble(Exception):
    """A token that fits nothing; statement loops catch it and recover."""

    def __init__(self, at: int, cause: str):
        super().__init__(cause)
        self.at, self.cause = at, cause


class Cursor:
    """Tokens as two lists: kinds (a sign or keyword stands for itself) and offsets. The last kind is "end"."""

    def __init__(self, text: str, kinds: list[str], offsets: list[int]):
        self.text, self.k, self.o, self.i = text, kinds, offsets, 0
        self.faults: list[tuple[int, str]] = []

    def need(self, kind: str) -> None:
        if self.k[self.i] != kind:
            self.fail(f"expected {kind}")
        self.i += 1

    def take(self, kind: str) -> bool:
        if self.k[self.i] == kind:
            self.i += 1
            return True
        return False

    def fail(self, cause: str) -> None:
        found = self.k[self.i]
        raise Trouble(self.i, f"{cause}, found {'the end of the file' if found == 'end' else found}")

    def note(self, trouble: Trouble) -> None:
        if trouble.cause:
            self.faults.append((self.o[trouble.at], trouble.cause))

    def recover(self, start: int) -> None:
        """Skip to after the next semicolon, or to a closing brace, of this level; at least one token from `start`."""
        k, depth = self.k, 0
        i = max(self.i, start)
        while k[i] != "end":
            t = k[i]
            if t in "([{" and len(t) == 1:
                depth += 1
            elif t in ")]" and len(t) == 1:
                depth = max(0, depth - 1)
            elif t == "}":
                if depth <= 0:
                    break
                depth -= 1
                if depth == 0:
                    i += 1
                    break
            elif t in (";", "html") and depth == 0:
                i += 1
                break
            i += 1
        self.i = i if i > start else min(start + 1, len(k) - 1)

    def result(self) -> list[Fault]:
        out, line, at = [], 1, 0
        for offset, cause in sorted(self.faults):
            line += self.text.count("\n", at, offset)
            at = max(at, offset)
            out.append(Fault(line, cause))
        return out
