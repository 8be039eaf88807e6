"""A syntax checker for PHP 8."""

from __future__ import annotations

import bisect
import re

from loomdex.llm.syntax.base import CONFLICT, TOO_DEEP, Cursor, Fault, Trouble

# The language's reserved words, operators and their precedence.
RESERVED = frozenset(
    "abstract and array as break callable case catch class clone const continue declare default do echo else elseif empty enddeclare endfor endforeach endif endswitch endwhile exit die eval extends final finally fn for foreach function global goto if implements include include_once instanceof insteadof interface isset list match namespace new or print private protected public require require_once return static switch throw trait try unset use var while xor yield __halt_compiler".split()
)
BINARY = {
    "or": 1, "xor": 2, "and": 3, "?": 6, "??": 7, "||": 8, "&&": 9, "|": 10, "^": 11, "&": 12,
    "==": 13, "!=": 13, "===": 13, "!==": 13, "<>": 13, "<=>": 13, "<": 14, ">": 14, "<=": 14, ">=": 14,
    "|>": 15, ".": 16, "<<": 17, ">>": 17, "+": 18, "-": 18, "*": 19, "/": 19, "%": 19, "instanceof": 21, "**": 23,
}
ASSIGN = frozenset("= += -= *= /= .= %= **= &= |= ^= <<= >>= ??=".split())
_OPEN = re.compile(r"<\?(?:php(?=\s|$)|=|(?=\s))", re.I)
_TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n?]*(?:\?(?!>)[^\n?]*)*|\#(?!\[)[^\n?]*(?:\?(?!>)[^\n?]*)*|/\*.*?\*/)
    |(?P<var>\$[A-Za-z_\x80-\U0010ffff][\w\x80-\U0010ffff]*)
    |(?P<word>\\?[A-Za-z_\x80-\U0010ffff][\w\x80-\U0010ffff]*(?:\\[A-Za-z_\x80-\U0010ffff][\w\x80-\U0010ffff]*)*)
    |(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\{$]|\\.|\{(?!\$)|\$(?!\{)|\{\$(?:[^{}"]|"(?:[^"\\]|\\.)*"|\{[^{}]*\})*\}|\$\{[^}]*\})*"|`(?:[^`\\]|\\.)*`|<<<[ \t]*(?P<q>["']?)(?P<label>[A-Za-z_]\w*)(?P=q)\r?\n(?:[^\n]*\n)*?[ \t]*(?P=label)\b)
    |(?P<num>0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*)?\.\d[\d_]*(?:[eE][+-]?\d+)?|\d[\d_]*\.?(?:[eE][+-]?\d+)?)
    |(?P<html>\?>[^<]*(?:<(?!\?(?:php\b|=))[^<]*)*(?:<\?(?:php\b|=)|\Z))
    |(?P<cast>\(\s*(?:int|integer|float|double|real|string|binary|bool|boolean|array|object|unset)\s*\))
    |(?P<op>\\\{|<=>|\*\*=|\.\.\.|<<=|>>=|===|!==|\?\?=|\?->|\+\+|--|->|=>|::|==|!=|<>|<=|>=|&&|\|\||\?\?|\+=|-=|\*=|/=|\.=|%=|&=|\|=|\^=|<<|>>|\*\*|\|>|\#\[|[-+*/%=<>!.,;:?()\[\]{}&|^~@$])""",
    re.X | re.S | re.I,
)


def tokens(text: str) -> tuple[list[str], list[int], tuple[int, str] | None]:
    """Kinds, offsets, and the first place where no token fits."""
    kinds, offsets = [], []
    opened = _OPEN.search(text)
    if not opened:
        return ["end"] * 3, [0] * 3, (0, "PHP is never opened")
    kinds_add, offsets_add, match = kinds.append, offsets.append, _TOKEN.match
    if opened[0] == "<?=":
        kinds_add("echo")
        offsets_add(opened.start())
    at, end, wrong = opened.end(), len(text), None
    while at < end:
        m = match(text, at)
        if m is None:
            wrong = wrong or (at, "a string or comment does not end" if text[at] in "'\"`/<" else "a sign that PHP does not know")
            at += 1
            if text[at - 1] in "'\"`" or text.startswith("*", at):
                break
            continue
        kind = m.lastgroup
        if kind != "skip":
            if kind == "word":
                word = text[at : m.end()].lower()
                kind = word if word in RESERVED else "id"
                if kind == "__halt_compiler":
                    break
            elif kind == "op":
                kind = m[0]
            elif kind == "var":
                kind = "var$"
            kinds_add(kind)
            offsets_add(at)
            if kind == "html" and text.endswith("<?=", at, m.end()):
                kinds_add("echo")
                offsets_add(m.end())
        at = m.end()
    return [*kinds, "end", "end", "end"], [*offsets, *[min(at, end)] * 3], wrong


class Php(Cursor):
    def file(self) -> None:
        self.statements(("end",))

    def statements(self, ends: tuple[str, ...]) -> None:
        k = self.k
        while k[self.i] not in ends:
            start = self.i
            if k[start] == "end":
                self.fail("a block does not end")
            try:
                self.statement()
            except Trouble as t:
                self.note(t)
                if k[t.at] == "end":
                    self.i = t.at
                    if "end" in ends:
                        return
                    raise Trouble(t.at, "") from None
                self.recover(start)
                if k[self.i] == "}" and "}" not in ends:
                    self.i += 1

    def semicolon(self) -> None:
        t = self.k[self.i]
        if t == ";" or t == "html":
            self.i += 1
        elif t != "end" or self.k[self.i - 1] != ";":
            self.fail("expected ;")

    def block(self) -> None:
        self.need("{")
        self.statements(("}",))
        self.i += 1

    def body(self, *ends: str) -> None:
        """A statement, or with a colon statements up to one of `ends`; the end word is left."""
        if self.take(":"):
            self.statements(ends)
        else:
            self.statement()

    def statement(self) -> None:
        k = self.k[self.i]
        handler = self.STATEMENTS.get(k)
        if handler is not None:
            handler(self)
            return
        if k == "id":
            nxt = self.k[self.i + 1]
            if nxt == ":" and self.k[self.i + 2] != ":":
                self.i += 2
                return
            if nxt == "id" and self.word() == "enum":
                self.class_like()
                return
            if self.word() == "readonly" and nxt in ("class", "final", "abstract"):
                self.class_like()
                return
        self.expression()
        self.semicolon()

    def word(self) -> str:
        o = self.o[self.i]
        m = re.compile(r"\w+").match(self.text, o)
        return m[0].lower() if m else ""

    def empty(self) -> None:
        self.i += 1

    def attribute(self) -> None:
        while self.take("#["):
            while True:
                self.name()
                if self.k[self.i] == "(":
                    self.arguments()
                if not self.take(",") or self.k[self.i] == "]":
                    break
            self.need("]")

    def attributed(self) -> None:
        self.attribute()
        self.statement()

    def name(self) -> None:
        if self.k[self.i] in ("id", "static", "namespace", "enum"):
            self.i += 1
        else:
            self.fail("expected a name")

    def any_word(self) -> None:
        k = self.k[self.i]
        if k == "id" or k in RESERVED:
            self.i += 1
        else:
            self.fail("expected a name")

    def if_(self) -> None:
        self.i += 1
        self.parenthesis()
        if self.take(":"):
            while True:
                self.statements(("elseif", "else", "endif"))
                if self.take("elseif"):
                    self.parenthesis()
                    self.need(":")
                elif self.take("else"):
                    if self.take("if"):
                        self.parenthesis()
                    self.need(":")
                else:
                    break
            self.need("endif")
            self.semicolon()
            return
        self.statement()
        while self.k[self.i] == "elseif" or (self.k[self.i] == "else" and self.k[self.i + 1] == "if"):
            self.i += 1 if self.k[self.i] == "elseif" else 2
            self.parenthesis()
            self.statement()
        if self.take("else"):
            self.statement()

    def parenthesis(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def while_(self) -> None:
        self.i += 1
        self.parenthesis()
        self.looped("endwhile")

    def looped(self, end: str) -> None:
        if self.take(":"):
            self.statements((end,))
            self.i += 1
            self.semicolon()
        else:
            self.statement()

    def do_(self) -> None:
        self.i += 1
        self.statement()
        self.need("while")
        self.parenthesis()
        self.semicolon()

    def for_(self) -> None:
        self.i += 1
        self.need("(")
        for end in (";", ";", ")"):
            while self.k[self.i] != end:
                self.expression()
                if not self.take(","):
                    break
            self.need(end)
        self.looped("endfor")

    def foreach_(self) -> None:
        self.i += 1
        self.need("(")
        self.expression()
        self.need("as")
        self.take("&")
        self.expression()
        if self.take("=>"):
            self.take("&")
            self.expression()
        self.need(")")
        self.looped("endforeach")

    def switch_(self) -> None:
        self.i += 1
        self.parenthesis()
        end = "}"
        if self.take(":"):
            end = "endswitch"
        else:
            self.need("{")
        while self.k[self.i] in ("html", ";"):
            self.i += 1
        while self.k[self.i] != end:
            if self.take("case"):
                self.expression()
            elif not self.take("default"):
                self.fail("expected case")
            if not self.take(":"):
                self.need(";")
            self.statements(("case", "default", end))
        self.i += 1
        if end == "endswitch":
            self.semicolon()

    def try_(self) -> None:
        self.i += 1
        self.block()
        caught = 0
        while self.take("catch"):
            caught += 1
            self.need("(")
            self.name()
            while self.take("|"):
                self.name()
            self.take("var$")
            self.need(")")
            self.block()
        if self.take("finally"):
            self.block()
        elif not caught:
            self.fail("expected catch")

    def return_(self) -> None:
        self.i += 1
        if self.k[self.i] not in (";", "html", "end"):
            self.expression()
        self.semicolon()

    def echo_(self) -> None:
        self.i += 1
        self.expression()
        while self.take(","):
            self.expression()
        self.semicolon()

    def global_(self) -> None:
        self.i += 1
        self.variable()
        while self.take(","):
            self.variable()
        self.semicolon()

    def variable(self) -> None:
        if self.take("$"):
            if self.take("{"):
                self.expression()
                self.need("}")
            else:
                self.variable()
            return
        self.need("var$")

    def static_(self) -> None:
        if self.k[self.i + 1] == "var$":
            self.i += 1
            while True:
                self.need("var$")
                if self.take("="):
                    self.expression()
                if not self.take(","):
                    break
            self.semicolon()
        else:
            self.expression()
            self.semicolon()

    def unset_(self) -> None:
        self.i += 1
        self.arguments()
        self.semicolon()

    def const_(self) -> None:
        self.i += 1
        while True:
            self.any_word()
            self.need("=")
            self.expression()
            if not self.take(","):
                break
        self.semicolon()

    def use_(self) -> None:
        self.i += 1
        if self.k[self.i] in ("function", "const"):
            self.i += 1
        while True:
            self.name()
            if self.take("\\{"):
                while self.k[self.i] != "}":
                    if self.k[self.i] in ("function", "const"):
                        self.i += 1
                    self.name()
                    if self.take("as"):
                        self.name()
                    if not self.take(","):
                        break
                self.need("}")
            if self.take("as"):
                self.name()
            if not self.take(","):
                break
        self.semicolon()

    def namespace_(self) -> None:
        if self.k[self.i + 1] not in ("id", "{", "enum"):
            self.expression()
            self.semicolon()
            return
        self.i += 1
        if self.k[self.i] != "{":
            self.name()
        if self.k[self.i] == "{":
            self.block()
        else:
            self.semicolon()

    def declare_(self) -> None:
        self.i += 1
        self.need("(")
        while True:
            self.name()
            self.need("=")
            self.expression()
            if not self.take(","):
                break
        self.need(")")
        if self.k[self.i] in (";", "html"):
            self.i += 1
        else:
            self.looped("enddeclare")

    def break_(self) -> None:
        self.i += 1
        self.take("num")
        self.semicolon()

    def goto_(self) -> None:
        self.i += 1
        self.name()
        self.semicolon()

    def function_(self) -> None:
        nxt = self.k[self.i + 1]
        if nxt == "(" or (nxt == "&" and self.k[self.i + 2] == "("):
            self.expression()
            self.semicolon()
            return
        self.i += 1
        self.take("&")
        self.any_word()
        self.parameters()
        if self.take(":"):
            self.type()
        self.block()

    def type(self) -> None:
        self.take("?")
        while True:
            if self.take("("):
                self.type()
                self.need(")")
            elif self.k[self.i] in ("id", "array", "callable", "static", "namespace"):
                self.i += 1
            else:
                self.fail("expected a type")
            k = self.k[self.i]
            if k == "|" or (k == "&" and self.k[self.i + 1] not in ("var$", "...", "&")):
                self.i += 1
            else:
                return

    def parameters(self) -> None:
        self.need("(")
        k = self.k
        while k[self.i] != ")":
            if k[self.i] == "#[":
                self.attribute()
            while k[self.i] in ("public", "protected", "private") or (k[self.i] == "id" and k[self.i + 1] in ("id", "var$", "array", "?", "callable", "public", "private", "protected", "&", "...") and self.word() == "readonly"):
                self.i += 1
            if k[self.i] not in ("var$", "&", "..."):
                self.type()
            self.take("&")
            self.take("...")
            self.need("var$")
            if self.take("="):
                self.expression()
            if k[self.i] == "{":  # property hooks
                self.hooks()
            if not self.take(","):
                break
        self.need(")")

    def hooks(self) -> None:
        self.need("{")
        while self.k[self.i] != "}":
            if self.k[self.i] == "#[":
                self.attribute()
            self.take("final")
            self.take("&")
            self.name()
            if self.k[self.i] == "(":
                self.parameters()
            if self.take("=>"):
                self.expression()
                self.semicolon()
            elif not self.take(";"):
                self.block()
        self.i += 1

    def class_like(self) -> None:
        k = self.k
        while k[self.i] in ("abstract", "final") or (k[self.i] == "id" and self.word() == "readonly"):
            self.i += 1
        if k[self.i] in ("class", "trait", "interface") or (k[self.i] == "id" and self.word() == "enum"):
            self.i += 1
        else:
            self.fail("expected class")
        self.name()
        if self.take(":"):
            self.type()
        self.heritage()
        self.members()

    def heritage(self) -> None:
        for word in ("extends", "implements"):
            if self.take(word):
                self.name()
                while self.take(","):
                    self.name()

    def members(self) -> None:
        self.need("{")
        k = self.k
        while k[self.i] != "}":
            start = self.i
            if k[start] == "end":
                self.fail("a class does not end")
            try:
                self.member()
            except Trouble as t:
                if k[t.at] == "end":
                    raise
                self.note(t)
                self.recover(start)
        self.i += 1

    def member(self) -> None:
        k = self.k
        if k[self.i] == "#[":
            self.attribute()
        if k[self.i] == "use":
            self.i += 1
            self.name()
            while self.take(","):
                self.name()
            if self.take("{"):
                while k[self.i] != "}":
                    self.any_word()
                    if self.take("::"):
                        self.any_word()
                    if self.take("insteadof"):
                        self.name()
                        while self.take(","):
                            self.name()
                    else:
                        self.need("as")
                        if k[self.i] in ("public", "protected", "private"):
                            self.i += 1
                        if k[self.i] != ";":
                            self.any_word()
                    self.need(";")
                self.i += 1
            else:
                self.need(";")
            return
        if k[self.i] == "case":
            self.i += 1
            self.any_word()
            if self.take("="):
                self.expression()
            self.need(";")
            return
        modified = False
        while k[self.i] in ("public", "protected", "private", "static", "abstract", "final", "var") or (k[self.i] == "id" and self.word() == "readonly" and k[self.i + 1] != "("):
            if k[self.i] in ("public", "protected", "private") and k[self.i + 1] == "(":  # public(set)
                self.i += 4
            else:
                self.i += 1
            modified = True
        if k[self.i] == "function":
            self.i += 1
            self.take("&")
            self.any_word()
            self.parameters()
            if self.take(":"):
                self.type()
            if not self.take(";"):
                self.block()
            return
        if k[self.i] == "const":
            self.i += 1
            if k[self.i + 1] != "=":
                self.type()
            while True:
                self.any_word()
                self.need("=")
                self.expression()
                if not self.take(","):
                    break
            self.need(";")
            return
        if not modified:
            self.fail("expected a member of a class")
        if k[self.i] != "var$":
            self.type()
        while True:
            self.need("var$")
            if self.take("="):
                self.expression()
            if k[self.i] == "{":
                self.hooks()
                return
            if not self.take(","):
                break
        self.need(";")

    # expressions

    def expression(self, least: int = 0) -> None:
        self.unary()
        k = self.k
        while True:
            op = k[self.i]
            p = BINARY.get(op)
            if p is None or p < least:
                return
            self.i += 1
            if op == "?":
                if not self.take(":"):
                    self.expression()
                    self.need(":")
                self.expression(7)
            elif op == "instanceof":
                if k[self.i] in ("id", "static"):
                    self.i += 1
                else:
                    self.unary()
            else:
                self.expression(p if op in ("**", "??") else p + 1)

    def unary(self) -> None:
        k = self.k
        t = k[self.i]
        if t == "var$":
            self.i += 1
            self.postfix(True)
            return
        if t in ("!", "-", "+", "~", "@", "cast", "&"):
            self.i += 1
            self.unary()
            if k[self.i] == "**":
                self.i += 1
                self.expression(23)
            return
        if t in ("++", "--"):
            self.i += 1
            self.unary()
            return
        self.primary(t)

    def primary(self, t: str) -> None:
        k = self.k
        if t == "str" or t == "num":
            self.i += 1
            self.postfix(False)
        elif t == "id" or t == "enum":
            self.i += 1
            self.postfix(False)
        elif t == "(":
            self.i += 1
            self.expression()
            self.need(")")
            self.postfix(True)
        elif t == "[":
            self.array("[", "]")
            self.postfix(True)
        elif t in ("array", "list"):
            self.i += 1
            self.array("(", ")")
            self.postfix(True)
        elif t == "$":
            self.variable()
            self.postfix(True)
        elif t == "new":
            self.i += 1
            if k[self.i] == "#[":
                self.attribute()
            if k[self.i] == "id" and self.word() == "readonly":
                self.i += 1
            if self.take("class"):
                if k[self.i] == "(":
                    self.arguments()
                self.heritage()
                self.members()
            else:
                if k[self.i] in ("id", "static", "enum"):
                    self.i += 1
                elif k[self.i] == "(":
                    self.parenthesis()
                elif k[self.i] in ("var$", "$"):
                    self.variable()
                    while k[self.i] in ("->", "?->", "::", "["):
                        if k[self.i] == "[":
                            self.i += 1
                            self.expression()
                            self.need("]")
                        else:
                            self.i += 1
                            self.member_name()
                else:
                    self.fail("expected a class")
                if k[self.i] == "(":
                    self.arguments()
            self.postfix(True)
        elif t == "clone" or t in ("include", "include_once", "require", "require_once", "print", "throw"):
            self.i += 1
            self.expression(0 if t != "clone" else 22)
        elif t == "yield":
            self.i += 1
            if k[self.i] == "id" and self.word() == "from":
                self.i += 1
                self.expression()
            elif k[self.i] not in (";", ")", ",", "]", "html"):
                self.expression()
                if self.take("=>"):
                    self.expression()
        elif t in ("isset", "empty", "eval"):
            self.i += 1
            self.arguments()
            self.postfix(False)
        elif t in ("exit", "die"):
            self.i += 1
            if k[self.i] == "(":
                self.arguments()
        elif t == "static":
            if k[self.i + 1] in ("function", "fn"):
                self.i += 1
                self.primary(k[self.i])
            else:
                self.i += 1
                self.postfix(False)
        elif t == "function":
            self.i += 1
            self.take("&")
            self.parameters()
            if self.take("use"):
                self.need("(")
                while k[self.i] != ")":
                    self.take("&")
                    self.need("var$")
                    if not self.take(","):
                        break
                self.need(")")
            if self.take(":"):
                self.type()
            self.block()
            self.postfix(False)
        elif t == "fn":
            self.i += 1
            self.take("&")
            self.parameters()
            if self.take(":"):
                self.type()
            self.need("=>")
            self.expression(4)
        elif t == "match":
            self.i += 1
            self.parenthesis()
            self.need("{")
            while k[self.i] != "}":
                if not (k[self.i] == "default" and k[self.i + 1] in ("=>", ",") and (self.take("default") or True)):
                    self.expression()
                while self.take(","):
                    if k[self.i] == "=>":
                        break
                    self.expression()
                self.need("=>")
                self.expression()
                if not self.take(","):
                    break
            self.need("}")
            self.postfix(False)
        elif t == "#[":
            self.attribute()
            self.unary()
        elif t == "namespace":
            self.i += 1
            self.postfix(False)
        else:
            self.fail("expected an expression")

    def array(self, start: str, end: str) -> None:
        self.need(start)
        k = self.k
        while k[self.i] != end:
            if self.take(","):
                continue
            self.take("...")
            self.take("&")
            self.expression()
            if self.take("=>"):
                self.take("&")
                self.expression()
            if k[self.i] != end:
                self.need(",")
        self.i += 1

    def arguments(self) -> None:
        self.need("(")
        k = self.k
        while k[self.i] != ")":
            if k[self.i + 1] == ":" and (k[self.i] == "id" or k[self.i] in RESERVED) and k[self.i + 2] != ":":
                self.i += 2
            elif self.take("..."):
                if k[self.i] == ")":
                    break
            self.expression()
            if not self.take(","):
                break
        self.need(")")

    def member_name(self) -> None:
        k = self.k[self.i]
        if k in ("id", "var$") or k in RESERVED:
            self.i += 1
        elif k == "{":
            self.i += 1
            self.expression()
            self.need("}")
        elif k == "$":
            self.variable()
        else:
            self.fail("expected a member's name")

    def postfix(self, assignable: bool) -> None:
        k = self.k
        while True:
            t = k[self.i]
            if t == "->" or t == "?->":
                self.i += 1
                self.member_name()
                assignable = True
            elif t == "::":
                self.i += 1
                self.member_name()
                assignable = True
            elif t == "(":
                self.arguments()
                assignable = True
            elif t == "[":
                self.i += 1
                if not self.take("]"):
                    self.expression()
                    self.need("]")
                assignable = True
            elif t in ASSIGN:
                if not assignable:
                    self.fail("the left side takes no value")
                self.i += 1
                self.take("&")
                self.expression(4)
                return
            elif t == "++" or t == "--":
                self.i += 1
                return
            else:
                return

    STATEMENTS = {
        "{": block, ";": empty, "html": empty, "#[": attributed, "if": if_, "while": while_, "do": do_, "for": for_, "foreach": foreach_, "switch": switch_, "try": try_,
        "return": return_, "echo": echo_, "global": global_, "static": static_, "unset": unset_, "const": const_, "use": use_, "namespace": namespace_, "declare": declare_,
        "break": break_, "continue": break_, "goto": goto_, "function": function_, "abstract": class_like, "final": class_like, "class": class_like, "trait": class_like, "interface": class_like,
    }


def check_php(text: str) -> list[Fault]:
    kinds, offsets, wrong = tokens(text)
    parser = Php(text, kinds, offsets)
    if wrong:
        parser.faults.append(wrong)
    if "<<<<<<<" in text and (m := CONFLICT.search(text)) and _outside(text, m, kinds, offsets):
        parser.faults.append((m.start(), "merge conflict"))
    try:
        parser.file()
    except Trouble as t:
        if t.cause:
            parser.note(t)
    except RecursionError:
        parser.faults.append((parser.o[parser.i], TOO_DEEP))  # nothing is known of what follows
    return parser.result()


def _outside(text: str, m: re.Match, kinds: list[str], offsets: list[int]) -> bool:
    """Whether the markers stand in no comment or string: some token of code begins within the first one."""
    at = bisect.bisect_left(offsets, m.start())
    if at < len(offsets) and offsets[at] < m.start() + 7:
        return True
    return at > 0 and kinds[at - 1] == "html"
