"""A syntax checker for JavaScript modules and scripts, and for TypeScript."""

from __future__ import annotations

import bisect
import re

from loomdex.llm.syntax.base import CONFLICT, TOO_DEEP, Cursor, Fault, Trouble

# The language's reserved words, operators and their precedence.
RESERVED = frozenset(
    "await break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with yield".split()
)
BINARY = {
    "??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8,
    "instanceof": 8, "in": 8, "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 13,
}
ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
_BEFORE_REGEX = frozenset("return typeof case in of delete void throw new else do instanceof yield await".split())
_TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?\*/|\A\#![^\n]*|<!--[^\n]*)
    |(?P<word>[A-Za-z_$\x80-\U0010ffff][\w$\x80-\U0010ffff]*)
    |(?P<private>\#[A-Za-z_$][\w$]*)
    |(?P<num>0[xX][0-9a-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:\d[\d_]*)?\.\d[\d_]*(?:[eE][+-]?\d+)?|\d[\d_]*\.?(?:[eE][+-]?\d+)?n?)
    |(?P<str>'(?:[^'\\\n]|\\.)*'|"(?:[^"\\\n]|\\.)*")
    |(?P<op>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|\*\*|[-+*/%=<>!.,;:?()\[\]{}&|^~@])""",
    re.X | re.S,
)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[A-Za-z]*")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*(`|\$\{)", re.S)


def tokens(text: str, start: int, stop: int) -> tuple[list[str], list[int], list[bool], tuple[int, str] | None]:
    """Kinds, offsets, whether a line break stands before, and the first place where no token fits."""
    kinds: list[str] = []
    offsets: list[int] = []
    breaks: list[bool] = []
    at, wrong, broken = start, None, False
    templates: list[int] = []  # depth of braces at which each open template goes on
    depth = 0
    match = _TOKEN.match
    while at < stop:
        c = text[at]
        kind = None
        if c == "/" and not text.startswith(("//", "/*"), at):
            last = kinds[-1] if kinds else ";"
            if last in _BEFORE_REGEX or last not in ("id", "num", "str", "template", ")", "]", "}", "this", "super", "null", "true", "false", "regex", "++", "--", "private"):
                m = _REGEX.match(text, at, stop)
                if m:
                    kind = "regex"
        if kind is None and (c == "`" or (c == "}" and templates and templates[-1] == depth)):
            m = _TEMPLATE.match(text, at + 1, stop)
            if m is None:
                wrong = wrong or (at, "a template does not end")
                break
            if c == "`":
                kind = "template" if m[1] == "`" else "template{"
            else:
                templates.pop()
                kind = "}template" if m[1] == "`" else "}template{"
            if m[1] == "${":
                templates.append(depth)
        if kind is None:
            m = match(text, at, stop)
            if m is None:
                if c == "#" and at == 0:
                    at = text.find("\n", at)
                    continue
                wrong = wrong or (at, "a string or comment does not end" if c in "'\"/" else "a sign that the language does not know")
                at += 1
                if c in "'\"":
                    end = text.find("\n", at)
                    at = stop if end < 0 else end
                continue
            kind = m.lastgroup
            if kind == "skip":
                if not broken and "\n" in m[0]:
                    broken = True
                at = m.end()
                continue
            if kind == "word":
                kind = m[0] if m[0] in RESERVED else "id"
            elif kind == "op":
                kind = m[0]
                if kind == "{":
                    depth += 1
                elif kind == "}":
                    depth -= 1
        kinds.append(kind)
        offsets.append(at)
        breaks.append(broken)
        broken = False
        at = m.end()
    if templates and wrong is None:
        wrong = (min(at, len(text)), "a template does not end")
    kinds += ["end", "end", "end"]
    offsets += [min(stop, len(text))] * 3
    breaks += [True] * 3
    return kinds, offsets, breaks, wrong


class Ecma(Cursor):
    def __init__(self, text: str, kinds: list[str], offsets: list[int], breaks: list[bool], typed: bool):
        super().__init__(text, kinds, offsets)
        self.b, self.typed = breaks, typed
        self.no_in = False
        self.pairs: dict[int, int] = {}
        stack: list[int] = []
        for i, k in enumerate(kinds):
            if k == "(":
                stack.append(i)
            elif k == ")" and stack:
                self.pairs[stack.pop()] = i

    def word(self, i: int | None = None) -> str:
        i = self.i if i is None else i
        if self.k[i] != "id":
            return ""
        o = self.o[i]
        m = _TOKEN.match(self.text, o)
        return m[0] if m else ""

    def is_word(self, *words: str) -> bool:
        return self.k[self.i] == "id" and self.word() in words

    def file(self) -> None:
        self.statements("end")

    def statements(self, end: str) -> None:
        k = self.k
        while k[self.i] != end:
            start = self.i
            if k[start] == "end":
                self.fail("a block does not end")
            try:
                self.statement()
            except Trouble as t:
                if k[t.at] == "end":
                    raise
                self.note(t)
                self.recover(start)
                if k[self.i] == "}" and end == "end":
                    self.i += 1

    def semicolon(self) -> None:
        if self.take(";") or self.k[self.i] in ("}", "end") or self.b[self.i]:
            return
        self.fail("expected ;")

    def block(self) -> None:
        self.need("{")
        self.statements("}")
        self.i += 1

    def statement(self) -> None:
        k = self.k[self.i]
        handler = self.STATEMENTS.get(k)
        if handler is not None:
            handler(self)
            return
        nxt = self.k[self.i + 1]
        if k == "id":
            if nxt == ":":
                self.i += 2
                self.statement()
                return
            word = self.word()
            if word == "async" and nxt == "function" and not self.b[self.i + 1]:
                self.i += 1
                self.function_()
                return
            if word == "let" and (nxt in ("id", "[", "{", "yield", "await")):
                self.variables()
                return
            if self.typed and self.declaration(word, nxt):
                return
        self.expression()
        self.semicolon()

    def declaration(self, word: str, nxt: str) -> bool:
        if word == "interface" and nxt == "id":
            self.i += 2
            self.type_parameters()
            if self.take("extends"):
                self.type()
                while self.take(","):
                    self.type()
            self.object_type()
            return True
        if word == "type" and nxt == "id" and self.k[self.i + 2] in ("=", "<"):
            self.i += 2
            self.type_parameters()
            self.need("=")
            self.type()
            self.semicolon()
            return True
        if word in ("namespace", "module") and nxt in ("id", "str") and not self.b[self.i + 1]:
            self.i += 2
            while self.take("."):
                self.any_word()
            if self.k[self.i] == "{":
                self.block()
            else:
                self.semicolon()
            return True
        if word == "declare" and nxt in ("id", "function", "class", "const", "var", "enum") and not self.b[self.i + 1]:
            self.i += 1
            if self.is_word("global") and self.k[self.i + 1] == "{":
                self.i += 1
                self.block()
            else:
                self.statement()
            return True
        if word == "abstract" and nxt == "class":
            self.i += 1
            self.class_()
            return True
        return False

    def empty(self) -> None:
        self.i += 1

    def variables(self) -> None:
        const = self.k[self.i] == "const"
        self.i += 1
        if const and self.typed and self.k[self.i] == "enum":
            self.enum_()
            return
        self.declarators(const)
        self.semicolon()

    def declarators(self, const: bool = False, loop: bool = False) -> None:
        while True:
            pattern = self.k[self.i] in ("[", "{")
            self.binding()
            if self.typed:
                self.take("!")
                if self.take(":"):
                    self.type()
            if self.take("="):
                self.assignment()
            elif not loop and (const or pattern) and not self.typed:
                self.fail("expected a value")
            if not self.take(","):
                return

    def binding(self) -> None:
        k = self.k
        t = k[self.i]
        if t in ("id", "yield", "await"):
            self.i += 1
        elif t == "[":
            self.i += 1
            while k[self.i] != "]":
                if self.take(","):
                    continue
                self.take("...")
                self.element()
                if k[self.i] != "]":
                    self.need(",")
            self.i += 1
        elif t == "{":
            self.i += 1
            while k[self.i] != "}":
                if self.take("..."):
                    self.binding()
                elif k[self.i] == "id" and k[self.i + 1] in (",", "}", "="):
                    self.i += 1
                    if self.take("="):
                        self.assignment()
                else:
                    self.property_name()
                    self.need(":")
                    self.element()
                if k[self.i] != "}":
                    self.need(",")
            self.i += 1
        else:
            self.fail("expected a name")

    def element(self) -> None:
        self.binding()
        if self.take("="):
            self.assignment()

    def any_word(self) -> None:
        if self.k[self.i] == "id" or self.k[self.i] in RESERVED:
            self.i += 1
        else:
            self.fail("expected a name")

    def property_name(self) -> None:
        t = self.k[self.i]
        if t in ("id", "str", "num", "private") or t in RESERVED:
            self.i += 1
        elif t == "[":
            self.i += 1
            self.assignment()
            self.need("]")
        else:
            self.fail("expected a property's name")

    def if_(self) -> None:
        self.i += 1
        self.parenthesis()
        self.statement()
        if self.take("else"):
            self.statement()

    def parenthesis(self) -> None:
        self.need("(")
        held, self.no_in = self.no_in, False
        self.expression()
        self.no_in = held
        self.need(")")

    def while_(self) -> None:
        self.i += 1
        self.parenthesis()
        self.statement()

    def do_(self) -> None:
        self.i += 1
        self.statement()
        self.need("while")
        self.parenthesis()
        self.take(";")

    def for_(self) -> None:
        self.i += 1
        self.take("await")
        self.need("(")
        k = self.k
        if not self.take(";"):
            self.no_in = True
            if k[self.i] in ("var", "const") or (self.is_word("let") and k[self.i + 1] in ("id", "[", "{")):
                self.i += 1
                self.declarators(loop=True)
            else:
                self.expression()
            self.no_in = False
            if self.take("in") or self.is_word("of"):
                if k[self.i - 1] != "in":
                    self.i += 1
                self.expression()
                self.need(")")
                self.statement()
                return
            self.need(";")
        if k[self.i] != ";":
            self.expression()
        self.need(";")
        if k[self.i] != ")":
            self.expression()
        self.need(")")
        self.statement()

    def jump(self) -> None:
        self.i += 1
        if self.k[self.i] == "id" and not self.b[self.i]:
            self.i += 1
        self.semicolon()

    def return_(self) -> None:
        self.i += 1
        if self.k[self.i] not in (";", "}", "end") and not self.b[self.i]:
            self.expression()
        self.semicolon()

    def throw_(self) -> None:
        self.i += 1
        if self.b[self.i]:
            self.fail("expected a value on the line")
        self.expression()
        self.semicolon()

    def try_(self) -> None:
        self.i += 1
        self.block()
        done = False
        if self.take("catch"):
            done = True
            if self.take("("):
                self.binding()
                if self.typed and self.take(":"):
                    self.type()
                self.need(")")
            self.block()
        if self.take("finally"):
            done = True
            self.block()
        if not done:
            self.fail("expected catch")

    def switch_(self) -> None:
        self.i += 1
        self.parenthesis()
        self.need("{")
        k = self.k
        while not self.take("}"):
            if self.take("case"):
                self.expression()
            elif not self.take("default"):
                self.fail("expected case")
            self.need(":")
            while k[self.i] not in ("case", "default", "}"):
                self.statement()

    def with_(self) -> None:
        self.i += 1
        self.parenthesis()
        self.statement()

    def debugger_(self) -> None:
        self.i += 1
        self.semicolon()

    def import_(self) -> None:
        k = self.k
        if k[self.i + 1] in ("(", "."):
            self.expression()
            self.semicolon()
            return
        self.i += 1
        if not self.take("str"):
            if self.typed and self.is_word("type") and k[self.i + 1] in ("id", "{", "*") and self.word(self.i + 1) != "from":
                self.i += 1
            if k[self.i] == "id":
                self.i += 1
                if self.typed and self.take("="):
                    self.expression()
                    self.semicolon()
                    return
                if not self.take(","):
                    self.from_()
                    return
            if self.take("*"):
                self.keyword("as")
                self.binding()
            else:
                self.specifiers()
            self.from_()
            return
        self.semicolon()

    def keyword(self, word: str) -> None:
        if not self.is_word(word):
            self.fail(f"expected {word}")
        self.i += 1

    def from_(self) -> None:
        self.keyword("from")
        self.need("str")
        if self.k[self.i] == "with" or (self.is_word("assert") and not self.b[self.i]):
            self.i += 1
            self.object()
        self.semicolon()

    def specifiers(self) -> None:
        self.need("{")
        while self.k[self.i] != "}":
            if self.k[self.i] == "str":
                self.i += 1
            else:
                if self.typed and self.is_word("type") and self.k[self.i + 1] not in (",", "}") and self.word(self.i + 1) != "as":
                    self.i += 1
                self.any_word()
            if self.is_word("as"):
                self.i += 1
                if not self.take("str"):
                    self.any_word()
            if not self.take(","):
                break
        self.need("}")

    def export_(self) -> None:
        k = self.k
        self.i += 1
        if self.take("default"):
            if k[self.i] in ("function", "class") or (self.is_word("async") and k[self.i + 1] == "function") or (self.typed and self.is_word("abstract", "interface") and k[self.i + 1] in ("class", "id")):
                if self.is_word("interface"):
                    self.declaration("interface", "id")
                    return
                if self.is_word("async", "abstract"):
                    self.i += 1
                if k[self.i] == "class":
                    self.class_(named=False)
                else:
                    self.function_(named=False)
                return
            self.assignment()
            self.semicolon()
        elif self.take("*"):
            if self.is_word("as"):
                self.i += 1
                self.any_word()
            self.from_()
        elif k[self.i] == "{" or (self.typed and self.is_word("type") and k[self.i + 1] == "{"):
            if k[self.i] != "{":
                self.i += 1
            self.specifiers()
            if self.is_word("from"):
                self.from_()
            else:
                self.semicolon()
        elif self.typed and k[self.i] == "=":
            self.i += 1
            self.expression()
            self.semicolon()
        elif k[self.i] in ("var", "const", "function", "class", "enum", "@", "import") or k[self.i] == "id":
            if k[self.i] == "id" and not (self.is_word("let", "async") or (self.typed and self.is_word("type", "interface", "namespace", "declare", "abstract", "module", "as"))):
                self.fail("expected a declaration")
            self.statement()
        else:
            self.fail("expected a declaration")

    def enum_(self) -> None:
        if not self.typed:
            self.fail("a word of TypeScript")
        self.need("enum")
        self.any_word()
        self.need("{")
        while self.k[self.i] != "}":
            self.property_name()
            if self.take("="):
                self.assignment()
            if not self.take(","):
                break
        self.need("}")

    def function_(self, named: bool = True) -> None:
        self.i += 1
        self.take("*")
        if self.k[self.i] in ("id", "yield", "await"):
            self.i += 1
        elif named:
            self.fail("expected a name")
        self.signature()
        if self.typed and self.k[self.i] != "{":
            self.semicolon()
        else:
            self.block()

    def signature(self) -> None:
        if self.typed:
            self.type_parameters()
        self.parameters()
        if self.typed and self.take(":"):
            self.type(returned=True)

    def parameters(self) -> None:
        self.need("(")
        k = self.k
        held, self.no_in = self.no_in, False
        while k[self.i] != ")":
            while k[self.i] == "@":
                self.decorator()
            if self.typed:
                while self.is_word("public", "private", "protected", "readonly", "override") and k[self.i + 1] in ("id", "{", "["):
                    self.i += 1
            self.take("...")
            if self.typed and k[self.i] == "this":
                self.i += 1
            else:
                self.binding()
            if self.typed:
                self.take("?")
                if self.take(":"):
                    self.type()
            if self.take("="):
                self.assignment()
            if not self.take(","):
                break
        self.no_in = held
        self.need(")")

    def decorator(self) -> None:
        self.need("@")
        if self.k[self.i] == "(":
            self.parenthesis()
            return
        self.any_word()
        while self.take("."):
            self.any_word()
        if self.k[self.i] == "(":
            self.arguments()

    def decorated(self) -> None:
        while self.k[self.i] == "@":
            self.decorator()
        self.statement()

    def class_(self, named: bool = True) -> None:
        self.need("class")
        k = self.k
        if k[self.i] == "id" and not (self.typed and self.is_word("implements")):
            self.i += 1
        elif named:
            self.fail("expected a name")
        if self.typed:
            self.type_parameters()
        if self.take("extends"):
            self.unary()
            if self.typed and k[self.i] == "<":
                self.type_arguments()
        if self.typed and self.is_word("implements"):
            self.i += 1
            self.type()
            while self.take(","):
                self.type()
        self.need("{")
        while not self.take("}"):
            start = self.i
            if k[start] == "end":
                self.fail("a class does not end")
            if not self.take(";"):
                self.member()

    def member(self) -> None:
        k = self.k
        while k[self.i] == "@":
            self.decorator()
        follows = (";", "=", "(", "}", ":", "?", "!", ",", "<")
        if self.is_word("static") and k[self.i + 1] == "{":
            self.i += 1
            self.block()
            return
        words = ("static", "async", "get", "set", "accessor") + (("public", "private", "protected", "readonly", "abstract", "override", "declare") if self.typed else ())
        while k[self.i] == "id" and k[self.i + 1] not in follows and not (self.b[self.i + 1] and self.word() not in ("static",)) and self.word() in words:
            self.i += 1
        self.take("*")
        if self.typed and k[self.i] == "[" and k[self.i + 1] == "id" and k[self.i + 2] == ":":
            self.i += 3
            self.type()
            self.need("]")
            self.need(":")
            self.type()
            self.semicolon()
            return
        self.property_name()
        if self.typed and not self.take("?"):
            self.take("!")
        if k[self.i] == "(" or (self.typed and k[self.i] == "<"):
            self.signature()
            if self.typed and k[self.i] != "{":
                self.semicolon()
            else:
                self.block()
            return
        if self.typed and self.take(":"):
            self.type()
        if self.take("="):
            self.assignment()
        self.semicolon()

    # types

    def type_parameters(self) -> None:
        if not self.take("<"):
            return
        while self.k[self.i] != ">":
            while self.k[self.i] in ("const", "in") or (self.is_word("out") and self.k[self.i + 1] == "id"):
                self.i += 1
            self.any_word()
            if self.take("extends"):
                self.type()
            if self.take("="):
                self.type()
            if not self.take(","):
                break
        self.need(">")

    def type_arguments(self) -> None:
        self.need("<")
        self.type()
        while self.take(","):
            self.type()
        self.need(">")

    def type(self, returned: bool = False) -> None:
        k = self.k
        if returned and k[self.i] in ("id", "this") and k[self.i + 1] == "id" and not self.b[self.i + 1]:
            if self.word(self.i + 1) == "is":
                self.i += 2
                self.type()
                return
            if self.word() == "asserts":
                self.i += 2
                if self.is_word("is"):
                    self.i += 1
                    self.type()
                return
        self.take("|")
        self.take("&")
        self.one_type()
        while k[self.i] in ("|", "&"):
            self.i += 1
            self.one_type()
        if k[self.i] == "extends" and not self.b[self.i]:
            self.i += 1
            self.type()
            if self.take("?"):
                self.type()
                self.need(":")
                self.type()

    def one_type(self) -> None:
        k = self.k
        t = k[self.i]
        if self.is_word("keyof", "unique", "readonly", "infer", "abstract") and k[self.i + 1] not in (",", ")", ";", "=", ">", "|", "&", "}", "]", "end"):
            self.i += 1
            if k[self.i] == "new":
                self.one_type()
                return
            self.one_type()
            return
        if t == "new":
            self.i += 1
            self.type_parameters()
            self.parameters()
            self.need("=>")
            self.type()
            return
        if t == "<" or (t == "(" and k[self.pairs.get(self.i, len(k) - 3) + 1] == "=>"):
            self.type_parameters()
            self.parameters()
            self.need("=>")
            self.type(returned=True)
            return
        if t == "(":
            self.i += 1
            self.type()
            self.need(")")
        elif t == "{":
            self.object_type()
        elif t == "[":
            self.i += 1
            while k[self.i] != "]":
                self.take("...")
                if k[self.i] == "id" and k[self.i + 1] == ":" or (k[self.i] == "id" and k[self.i + 1] == "?" and k[self.i + 2] == ":"):
                    self.i += 1
                    self.take("?")
                    self.i += 1
                self.type()
                self.take("?")
                if not self.take(","):
                    break
            self.need("]")
        elif t == "typeof":
            self.i += 1
            if self.take("import"):
                self.arguments()
            else:
                self.any_word()
            while self.take("."):
                self.any_word()
            if k[self.i] == "<":
                self.type_arguments()
        elif t == "import":
            self.i += 1
            self.arguments()
            while self.take("."):
                self.any_word()
            if k[self.i] == "<":
                self.type_arguments()
        elif t in ("str", "num", "template", "true", "false", "null", "void", "this"):
            self.i += 1
        elif t == "template{":
            self.template(types=True)
        elif t == "-":
            self.i += 1
            self.need("num")
        elif t == "id":
            self.i += 1
            while self.take("."):
                self.any_word()
            if k[self.i] == "<" and not self.b[self.i]:
                self.type_arguments()
        else:
            self.fail("expected a type")
        while k[self.i] == "[" and not self.b[self.i]:
            self.i += 1
            if k[self.i] != "]":
                self.type()
            self.need("]")

    def object_type(self) -> None:
        self.need("{")
        k = self.k
        while k[self.i] != "}":
            for sign in ("+", "-"):
                if k[self.i] == sign:
                    self.i += 1
            while self.is_word("readonly", "get", "set") and k[self.i + 1] not in (":", "?", "(", ";", ",", "}", "<"):
                self.i += 1
            if k[self.i] == "new":
                self.i += 1
            if k[self.i] in ("(", "<"):
                self.type_parameters()
                self.parameters()
            elif k[self.i] == "[" and k[self.i + 1] == "id" and k[self.i + 2] in (":", "in"):
                self.i += 3
                self.type()
                if self.is_word("as"):
                    self.i += 1
                    self.type()
                self.need("]")
                if k[self.i] in ("+", "-"):
                    self.i += 1
                self.take("?")
            else:
                self.property_name()
                self.take("?")
                if k[self.i] in ("(", "<"):
                    self.type_parameters()
                    self.parameters()
            if self.take(":"):
                self.type(returned=True)
            if not (self.take(";") or self.take(",")) and k[self.i] != "}" and not self.b[self.i]:
                self.fail("expected ;")
        self.i += 1

    # expressions

    def expression(self) -> None:
        self.assignment()
        while self.take(","):
            self.assignment()

    def arrow_ahead(self) -> bool:
        """At "(": whether it opens the parameters of an arrow function."""
        close = self.pairs.get(self.i)
        if close is None:
            return False
        after = self.k[close + 1]
        if after == "=>":
            return True
        return self.typed and after == ":" and self.typed_arrow(close + 1)

    def typed_arrow(self, colon: int) -> bool:
        held = self.i
        try:
            self.parameters()
            self.i = colon + 1
            self.type(returned=True)
            return self.k[self.i] == "=>"
        except Trouble:
            return False
        finally:
            self.i = held

    def arrow(self) -> None:
        k = self.k
        if k[self.i] == "(":
            self.parameters()
            if self.typed and self.take(":"):
                self.type(returned=True)
        else:
            self.i += 1
        self.need("=>")
        if k[self.i] == "{":
            held, self.no_in = self.no_in, False
            self.block()
            self.no_in = held
        else:
            self.assignment()

    def assignment(self) -> None:
        k = self.k
        t = k[self.i]
        if t == "id":
            nxt = k[self.i + 1]
            if nxt == "=>" and not self.b[self.i + 1]:
                self.arrow()
                return
            if (nxt == "id" or nxt == "(") and self.word() == "async" and not self.b[self.i + 1]:
                if nxt == "id" and k[self.i + 2] == "=>":
                    self.i += 1
                    self.arrow()
                    return
                if nxt == "(":
                    self.i += 1
                    if self.arrow_ahead():
                        self.arrow()
                        return
                    self.i -= 1
        elif t == "(" and self.arrow_ahead():
            self.arrow()
            return
        elif t == "yield":
            self.i += 1
            self.take("*")
            if k[self.i] not in (")", "]", "}", ",", ";", ":", "end") and not self.b[self.i]:
                self.assignment()
            return
        elif t == "<" and self.typed:
            held = self.i
            try:
                self.type_parameters()
                if k[self.i] == "(" and self.arrow_ahead():
                    self.arrow()
                    return
            except Trouble:
                pass
            self.i = held
        target = self.binary(0)
        op = k[self.i]
        if op == "?":
            self.i += 1
            held, self.no_in = self.no_in, False
            self.assignment()
            self.no_in = held
            self.need(":")
            self.assignment()
        elif op in ASSIGN:
            if not target:
                self.fail("the left side takes no value")
            self.i += 1
            self.assignment()
        elif op == ">" and self.k[self.i + 1] in (">=", ">") and self.o[self.i + 1] == self.o[self.i] + 1:
            self.fail("expected an expression")

    def binary(self, least: int) -> bool:
        k = self.k
        target = self.unary()
        while True:
            op = k[self.i]
            if op == ">" and self.o[self.i + 1] == self.o[self.i] + 1 and k[self.i + 1] in (">", ">="):  # > is lexed alone, for types
                width = 2
                if k[self.i + 1] == ">" and k[self.i + 2] in (">", ">=") and self.o[self.i + 2] == self.o[self.i] + 2:
                    width = 3
                if k[self.i + width - 1] == ">=":
                    if not target:
                        self.fail("the left side takes no value")
                    self.i += width
                    self.assignment()
                    return False
                if least > 9:
                    return target
                self.i += width
                self.binary(10)
                target = False
                continue
            if self.typed and op == "id" and not self.b[self.i] and self.word() in ("as", "satisfies"):
                self.i += 1
                if k[self.i] == "const":
                    self.i += 1
                else:
                    self.type()
                continue
            p = BINARY.get(op)
            if p is None or p < least or (op == "in" and self.no_in):
                return target
            self.i += 1
            self.binary(p if op == "**" else p + 1)
            target = False

    def unary(self) -> bool:
        k = self.k
        t = k[self.i]
        if t in ("!", "-", "+", "~", "typeof", "void", "delete", "await"):
            self.i += 1
            if t == "await" and k[self.i] in (")", ",", ";", "=", ".", "end"):
                return True
            self.unary()
            return False
        if t in ("++", "--"):
            self.i += 1
            if not self.unary():
                self.fail("the operand takes no value")
            return False
        target = self.postfix(self.primary(t))
        if k[self.i] in ("++", "--") and not self.b[self.i]:
            if not target:
                self.fail("the operand takes no value")
            self.i += 1
            return False
        return target

    def primary(self, t: str) -> bool:
        k = self.k
        if t == "id":
            if k[self.i + 1] == "function" and self.word() == "async" and not self.b[self.i + 1]:
                self.i += 1
                self.function_(named=False)
                return False
            self.i += 1
            return True
        if t in ("str", "num", "regex", "template", "this", "null", "true", "false"):
            self.i += 1
            return False
        if t == "super":
            self.i += 1
            if k[self.i] not in ("(", ".", "["):
                self.fail("expected a member")
            return False
        if t == "template{":
            self.template()
            return False
        if t == "(":
            self.i += 1
            held, self.no_in = self.no_in, False
            self.expression()
            self.no_in = held
            self.need(")")
            return True
        if t == "[":
            self.i += 1
            held, self.no_in = self.no_in, False
            while k[self.i] != "]":
                if self.take(","):
                    continue
                self.take("...")
                self.assignment()
                if k[self.i] != "]":
                    self.need(",")
            self.i += 1
            self.no_in = held
            return True
        if t == "{":
            self.object()
            return True
        if t == "function":
            self.function_(named=False)
            return False
        if t == "class":
            self.class_(named=False)
            return False
        if t == "@":
            self.decorator()
            return self.primary(k[self.i])
        if t == "new":
            self.i += 1
            if self.take("."):
                self.keyword("target")
                return False
            if k[self.i] == "new":
                self.primary("new")
            else:
                if k[self.i] == "import":
                    self.fail("expected a class")
                self.primary(k[self.i])
            while k[self.i] in (".", "["):
                self.access()
            if self.typed and k[self.i] == "<":
                self.maybe_arguments()
            if k[self.i] == "(":
                self.arguments()
            return False
        if t == "import":
            self.i += 1
            if self.take("."):
                self.any_word()
            else:
                self.arguments()
            return False
        if t == "private" and k[self.i + 1] == "in":
            self.i += 1
            return False
        if t == "<" and self.typed:
            if k[self.i + 1] == "const":
                self.i += 2
                self.need(">")
            else:
                self.type_arguments()
            self.unary()
            return False
        self.fail("expected an expression")
        return False

    def template(self, types: bool = False) -> None:
        self.need("template{")
        held, self.no_in = self.no_in, False
        while True:
            if types:
                self.type()
            else:
                self.expression()
            if self.take("}template"):
                self.no_in = held
                return
            self.need("}template{")

    def object(self) -> None:
        self.need("{")
        k = self.k
        held, self.no_in = self.no_in, False
        while k[self.i] != "}":
            if self.take("..."):
                self.assignment()
            else:
                ends = (",", ":", "(", "}", "=", "<")
                while k[self.i] == "id" and k[self.i + 1] not in ends and self.word() in ("get", "set", "async"):
                    self.i += 1
                star = self.take("*")
                plain = k[self.i] == "id" or k[self.i] in ("yield", "await")
                self.property_name()
                if k[self.i] == "(" or (self.typed and k[self.i] == "<"):
                    self.signature()
                    self.block()
                elif star:
                    self.fail("expected (")
                elif self.take(":"):
                    self.assignment()
                elif plain:
                    if self.take("="):
                        self.assignment()
                else:
                    self.fail("expected :")
            if k[self.i] != "}":
                self.need(",")
        self.i += 1
        self.no_in = held

    def arguments(self) -> None:
        self.need("(")
        k = self.k
        held, self.no_in = self.no_in, False
        while k[self.i] != ")":
            self.take("...")
            self.assignment()
            if not self.take(","):
                break
        self.no_in = held
        self.need(")")

    def access(self) -> None:
        if self.take("["):
            held, self.no_in = self.no_in, False
            self.expression()
            self.no_in = held
            self.need("]")
        else:
            self.i += 1
            if not self.take("private"):
                self.any_word()

    def maybe_arguments(self) -> bool:
        """Type arguments before a call, or nothing if "<" is less-than."""
        held = self.i
        try:
            self.type_arguments()
            if self.k[self.i] in ("(", "template", "template{", ")", "]", ",", ";", ":", ".", "?.", "end"):
                return True
        except Trouble:
            pass
        self.i = held
        return False

    def postfix(self, target: bool) -> bool:
        k = self.k
        while True:
            t = k[self.i]
            if t == "." or t == "[":
                self.access()
                target = True
            elif t == "(":
                self.arguments()
                target = False
            elif t == "?.":
                self.i += 1
                if k[self.i] == "(":
                    self.arguments()
                elif k[self.i] == "[":
                    self.access()
                elif k[self.i] == "private":
                    self.i += 1
                else:
                    self.any_word()
                target = False
            elif t == "template":
                self.i += 1
                target = False
            elif t == "template{":
                self.template()
                target = False
            elif self.typed and t == "!" and not self.b[self.i]:
                self.i += 1
            elif self.typed and t == "<" and self.maybe_arguments():
                pass
            else:
                return target

    STATEMENTS = {
        "{": block, ";": empty, "var": variables, "const": variables, "if": if_, "while": while_, "do": do_, "for": for_, "break": jump, "continue": jump, "return": return_,
        "throw": throw_, "try": try_, "switch": switch_, "with": with_, "debugger": debugger_, "import": import_, "export": export_, "function": function_, "class": class_, "enum": enum_, "@": decorated,
    }


def check_ecma(text: str, typed: bool = False, start: int = 0, stop: int | None = None) -> list[Fault]:
    """Faults of text[start:stop]; lines count from the start of the text."""
    stop = len(text) if stop is None else stop
    kinds, offsets, breaks, wrong = tokens(text, start, stop)
    parser = Ecma(text, kinds, offsets, breaks, typed)
    if wrong:
        parser.faults.append(wrong)
    if "<<<<<<<" in text and (m := CONFLICT.search(text, start, stop)):
        at = bisect.bisect_left(offsets, m.start())
        if at < len(offsets) and offsets[at] < m.start() + 7:
            parser.faults.append((m.start(), "merge conflict"))
    try:
        parser.file()
    except Trouble as t:
        parser.note(t)
    except RecursionError:
        parser.faults.append((parser.o[parser.i], TOO_DEEP))  # nothing is known of what follows
    return parser.result()
