"""Lexers of the judged languages, and the verdict on one file."""

from __future__ import annotations

import functools
import re

from corvane.llm import grammars
from corvane.llm.grammar import Automaton, Grammar

EXTENSIONS = {"py": "python", "js": "javascript", "java": "java", "go": "go", "json": "json"}


class Kinds(dict):
    """Token text -> terminal, learnt as tokens come; dropped when it grows large, which changes speed only."""

    def __init__(self, rule, limit: int = 500_000):
        super().__init__()
        self.rule, self.limit = rule, limit

    def __missing__(self, token):
        if len(self) > self.limit:
            self.clear()
        k = self[token] = self.rule(token)
        return k


def words(text: str) -> frozenset:
    return frozenset(text.split())


# Python

PY_KEYWORDS = words("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield match case type")
_FIELD3 = r"\{(?:[^{}'\"]|\"[^\"\n]*\"|'[^'\n]*'|\{[^{}]*\})*\}"
_FIELD = r"\{(?:[^{}'\"\n]|\"[^\"\n]*\"|'[^'\n]*'|\{[^{}\n]*\})*\}"
_DEC, _EXP = r"[0-9](?:_?[0-9])*", r"[eE][-+]?[0-9](?:_?[0-9])*"
PY_NUMBER = rf"(?:0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:{_DEC}\.(?:{_DEC})?|\.{_DEC})(?:{_EXP})?[jJ]?|{_DEC}{_EXP}[jJ]?|{_DEC}[jJ]|[1-9](?:_?[0-9])*|0(?:_?0)*)(?![\w.])"
PY_TOKEN = re.compile(
    r"[ \t\f]*(?:\\\r?\n[ \t\f]*)*("
    r"(?:\r?\n|\r)[ \t\f]*|#[^\r\n]*"
    r"|(?:[fF][rR]?|[rR][fF])(?:\"\"\"(?:[^\\{}\"]|\\.|\{\{|\}\}|" + _FIELD3 + r"|\"(?!\"\"))*\"\"\"|'''(?:[^\\{}']|\\.|\{\{|\}\}|" + _FIELD3 + r"|'(?!''))*'''"
    r"|\"(?:[^\\{}\"\n]|\\.|\{\{|\}\}|" + _FIELD + r")*\"|'(?:[^\\{}'\n]|\\.|\{\{|\}\}|" + _FIELD + r")*')"
    r"|(?:[bB][rR]?|[rR][bB]?|[uU])?(?:\"\"\"(?:[^\\\"]|\\.|\"(?!\"\"))*\"\"\"|'''(?:[^\\']|\\.|'(?!''))*'''|\"(?:[^\\\"\n]|\\.)*\"|'(?:[^\\'\n]|\\.)*')"
    r"|" + PY_NUMBER + r"|[^\W\d]\w*|\*\*=|//=|<<=|>>=|\.\.\.|:=|->|[-+*/%&|^@]=|[=!<>]=|\*\*|//|<<|>>|[-+*/%@&|^~<>()\[\]{},:.;=]|[^ \t\f]|\Z)", re.S)  # fmt: skip
_PY_OP = {**dict.fromkeys(("+=", "-=", "*=", "/=", "//=", "%=", "@=", "&=", "|=", "^=", ">>=", "<<=", "**="), "AUG"), **dict.fromkeys(("==", "!=", "<", ">", "<=", ">="), "CMP"), **dict.fromkeys(("//", "%", "&", "^", "<<", ">>"), "BOP")}
_PY_SIGNS = words("( ) [ ] { } , : . ; = + - * / ** @ | ~ ... := ->")


def _py_kind(t: str) -> str:
    if t in PY_KEYWORDS or t in _PY_SIGNS:
        return t
    if t in _PY_OP:
        return _PY_OP[t]
    c = t[:1]
    if c in "\r\n":
        return "NL"
    if c == "#":
        return "#"
    if c in "\"'" and len(t) > 1:
        return "STRING"
    if c.isdigit() or c == "." and len(t) > 1:
        return "NUMBER"
    if t[-1:] in "\"'" and len(t) > 2 and c.isalpha():
        if "f" in t[:2].lower():
            return "STRING" if fstring(t) else "ERROR"
        if "b" in t[:2].lower() and not t.isascii():
            return "ERROR"
        return "STRING"
    if t.isidentifier():
        return "NAME"
    return "" if t == "" else "ERROR"


PY_KINDS = Kinds(_py_kind)


def fstring(token: str) -> bool:
    """Whether every replacement field of an f-string literal holds an expression."""
    start = re.match(r"[a-zA-Z]+(\"\"\"|'''|\"|')", token)
    body = token[start.end() : -len(start.group(1))]
    return _spec(body, nested=False)


def _spec(body: str, nested: bool) -> bool:
    i, n = 0, len(body)
    while i < n:
        c = body[i]
        if c == "\\" and not nested:
            i += 2
            if body[i - 1 : i] == "N" and body[i : i + 1] == "{":
                i = body.find("}", i) + 1 or n
            continue
        if c in "{}" and body[i + 1 : i + 2] == c and not nested:
            i += 2
            continue
        if c == "}":
            return False
        if c != "{":
            i += 1
            continue
        depth, j, quote = 1, i + 1, ""
        while j < n and depth:
            d = body[j]
            if quote:
                quote = "" if d == quote else quote
            elif d in "\"'":
                quote = d
            else:
                depth += (d == "{") - (d == "}")
            j += 1
        if depth or not _field(body[i + 1 : j - 1]):
            return False
        i = j
    return True


@functools.lru_cache(100_000)
def _field(text: str) -> bool:
    kinds, depth = [], 0
    for m in PY_TOKEN.finditer(text):
        k = PY_KINDS[m.group(1)]
        if k in ("", "NL"):
            continue
        if k in ("ERROR", "#"):
            if m.group(1) == "!" and depth == 0:
                rest = re.match(r"![rsa]\s*(?::(.*))?\Z", text[m.start(1) :], re.S)
                return bool(rest) and _expression(kinds) and _spec(rest.group(1) or "", True)
            return False
        if depth == 0 and k == ":":
            return _expression(kinds) and _spec(text[m.end() :], True)
        depth += (k in "([{") - (k in ")]}")
        kinds.append(k)
    return _expression(kinds)


def _expression(kinds: list[str]) -> bool:
    return bool(kinds) and automaton("python").parse(kinds, "field") < 0


class Lexed(Exception):
    """A token error at a position, with the terminals before it."""

    def __init__(self, at: int, tokens: list[str] = (), where: list[int] = ()):
        self.at, self.tokens, self.where = at, tokens, where


def python_tokens(text: str) -> tuple[list[str], list[int]]:
    """(terminals, index of the source token of each)."""
    out, where, depth, indents, alt = [], [], 0, [0], [0]
    source = PY_TOKEN.findall(text)
    kinds = PY_KINDS
    begin = True  # at the beginning of a logical line
    lead = re.match(r"[ \t\f]*", text).group()
    last = len(source) - 1
    for i, t in enumerate(source):
        k = kinds[t]
        if k == "NL":
            if depth:
                continue
            if not begin:
                out.append("NEWLINE")
                where.append(i)
                begin = True
            lead = t.lstrip("\r\n")
            continue
        if k == "#" or k == "":
            if k == "" and i < last:
                continue
            if k == "#":
                continue
            break
        if begin:
            begin = False
            lead = lead.rsplit("\f", 1)[-1]
            if "\t" in lead:
                width, narrow = len(lead.expandtabs(8)), len(lead.replace("\t", " "))
            else:
                width = narrow = len(lead)
            if width == indents[-1]:
                if narrow != alt[-1]:
                    raise Lexed(i, out, where)
            elif width > indents[-1]:
                if narrow <= alt[-1]:
                    raise Lexed(i, out, where)
                indents.append(width)
                alt.append(narrow)
                out.append("INDENT")
                where.append(i)
            else:
                while width < indents[-1]:
                    indents.pop()
                    alt.pop()
                    out.append("DEDENT")
                    where.append(i)
                if width != indents[-1] or narrow != alt[-1]:
                    raise Lexed(i, out, where)
        if k == "ERROR":
            raise Lexed(i, out, where)
        if k in "([{":
            depth += 1
        elif k in ")]}":
            depth -= 1
            if depth < 0:
                raise Lexed(i, out, where)
        out.append(k)
        where.append(i)
    if depth:
        raise Lexed(last, out, where)
    if not begin:
        out.append("NEWLINE")
        where.append(last)
    for _ in indents[1:]:
        out.append("DEDENT")
        where.append(last)
    return out, where


# JavaScript

JS_KEYWORDS = words("async of get set static let await yield break case catch class const continue debugger default delete do else extends finally for function if import in instanceof new null return super switch this throw true false try typeof var void while with")
JS_OTHER = words("enum export")
_JS_RE = r"/(?![*/])(?:[^\\/\[\r\n]|\\[^\r\n]|\[(?:[^\]\\\r\n]|\\[^\r\n])*\])+/[A-Za-z]*"
_JS_CHUNK = re.compile(r"(?:[^`\\$]++|\\.|\$(?!\{))*+", re.S)
_JS_OPS = r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?![0-9])|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@]"
JS_TOKEN = re.compile(
    r"(?:[ \t\f\v\xa0\ufeff]|/\*[^\r\n*]*(?:\*(?!/)[^\r\n*]*)*\*/)*("
    r"[\r\n\u2028\u2029]|//[^\r\n]*|/\*[\s\S]*?\*/"
    r"|\"(?:[^\"\\\r\n]|\\(?:\r\n|[\s\S]))*\"|'(?:[^'\\\r\n]|\\(?:\r\n|[\s\S]))*'"
    r"|(?:0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*n?|0[oO][0-7](?:_?[0-7])*n?|0[bB][01](?:_?[01])*n?|(?:[0-9](?:_?[0-9])*\.?(?:[0-9](?:_?[0-9])*)?|\.[0-9](?:_?[0-9])*)(?:[eE][-+]?[0-9](?:_?[0-9])*)?n?)(?![\w$])"
    r"|(?:===|!==|==|!=|=>|&&|\|\||\?\?|<<|>>>?|[-+*%&|^]?=|(?<!\+)\+(?!\+)|(?<!-)-(?!-)|[(,;:!?{\[*%<>~^&|]|\b(?:return|typeof|case|in|of|delete|void|throw|else|do)\b)\s*" + _JS_RE +
    r"|#?(?:[A-Za-z_$\x80-\U0010ffff]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:[\w$\x80-\U0010ffff]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*"
    r"|" + _JS_OPS + r"|[^ \t\f\v\xa0\ufeff]|\Z)", re.S)  # fmt: skip
_JS_LEAD = re.compile(r"(" + _JS_OPS + r"|[a-z]+)\s*(?=/)")
_JS_OP = {**dict.fromkeys("+= -= *= /= %= &= |= ^= <<= >>= >>>= **= &&= ||= ??=".split(), "ASG"), **dict.fromkeys("== != === !== < > <= >= && || ?? << >> >>> ** / % & | ^".split(), "BOP"), "~": "!", "++": "INC", "--": "INC"}
_JS_SIGNS = words("{ } ( ) [ ] ; , + - * ! ? : = . => ?. ...")


def _js_kind(t: str):
    if t in JS_KEYWORDS or t in _JS_SIGNS:
        return t
    if t in _JS_OP:
        return _JS_OP[t]
    if t in JS_OTHER:
        return "KEYWORD"
    c = t[:1]
    if t == "":
        return ""
    if c in "\r\n\u2028\u2029":
        return "NL"
    if t[:2] == "//" or t[:2] == "/*":
        return "NL" if t[:2] == "/*" and ("\n" in t or "\r" in t) else "#"
    if c in "\"'":
        return "STRING" if len(t) > 1 else "ERROR"
    if c.isdigit() or c == "." and len(t) > 1:
        return "NUMBER"
    if t[-1:] == "/" or re.search(r"/[a-z]*$", t, re.I):
        m = _JS_LEAD.match(t)
        if m and re.fullmatch(_JS_RE, t[m.end() :]) and re.fullmatch(r"(?!.*(.).*\1)[dgimsuvy]*", t.rsplit("/", 1)[1]):
            return (_js_kind(m.group(1)), "REGEX", "\n" in t[: m.end()])
        return "ERROR"
    if c == "#":
        return "PRIVATE" if len(t) > 1 else "ERROR"
    return "NAME" if re.match(r"[\w$\\\x80-\U0010ffff]", t) else "ERROR"


JS_KINDS = Kinds(_js_kind)


def javascript_tokens(text: str) -> tuple[list, list[int], set[int]]:
    """(terminals, offset of each, terminals that begin a line). A template literal is one terminal, ERROR if it doesn't
    end or a substitution holds no expression; `held` has what surrounds the open ones, so they nest to any depth."""
    out, where, lines, kinds, new = [], [], set(), JS_KINDS, False
    held, depth, at = [], 0, 0
    while True:
        m = JS_TOKEN.match(text, at)
        t, i, at = m.group(1), m.start(1), m.end()
        k = kinds[t]
        if t == "`" or t == "}" and held and depth == 1:
            if t == "`":
                held.append([out, where, lines, new, depth, i, True])
            elif "ERROR" in out or automaton("javascript").parse(out, "inner", _ends(out, lines)) >= 0:
                held[-1][6] = False
            at = _JS_CHUNK.match(text, at).end()
            if text.startswith("${", at):
                out, where, lines, new, depth = [], [], set(), False, 0
                at += 1
                continue
            closed = text.startswith("`", at)
            at += 1
            out, where, lines, new, depth, i, good = held.pop() if closed else held[0]
            if not closed:
                return out + ["ERROR"], where + [i], lines
            k = "TEMPLATE" if good else "ERROR"
        elif t == "" and held:
            out, where, lines, _, _, i, _ = held[0]
            return out + ["ERROR"], where + [i], lines
        elif t == "":
            return out, where, lines
        elif held and t[0] in "{}":  # a brace, or one before a regular expression
            depth += 1 if t[0] == "{" else -1
            if depth == 1 and not out and t[0] == "{":  # the one that opens the substitution
                if type(k) is not tuple:
                    continue
                k = k[1]
        if k == "NL":
            new = True
            continue
        if k == "#":
            continue
        if new:
            lines.add(len(out))
            new = False
            if k == "INC":
                k = "NLINC"
        if type(k) is tuple:
            out.append(k[0])
            where.append(i)
            if k[2]:
                lines.add(len(out))
            k = k[1]
        out.append(k)
        where.append(i)


def _ends(tokens: list, lines: set[int]):
    """Whether a semicolon may be supplied before a terminal."""
    return lambda i: i >= len(tokens) or i in lines or tokens[i] == "}"


# Java and Go

JAVA_WORDS = words("record sealed permits yield when package import static synchronized default class interface enum extends implements throws throw this super void if else assert switch case while do for break continue return try catch finally new instanceof true false null")
JAVA_TOKEN = re.compile(
    r"\s*(//[^\r\n]*|/\*[\s\S]*?\*/|\"\"\"[ \t\f]*\r?\n(?:[^\\\"]|\\[\s\S]|\"(?!\"\"))*\"\"\"|\"(?:[^\"\\\r\n]|\\[btnfrs\"'\\0-7u])*\"|'(?:[^'\\\r\n]|\\(?:u+[0-9a-fA-F]{4}|[0-3]?[0-7]?[0-7]|[btnfrs\"'\\]))'"
    r"|(?:0[xX][0-9a-fA-F_]+[lL]?|0[bB][01_]+[lL]?|(?:[0-9][0-9_]*\.?(?:[0-9][0-9_]*)?|\.[0-9][0-9_]*)(?:[eE][-+]?[0-9]+)?[lLfFdD]?)(?![\w$])|non-sealed\b|(?:[^\W\d]|\$)[\w$]*"
    r"|>>>=|>>=|<<=|\.\.\.|->|::|\+\+|--|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|&=|\|=|\^=|%=|[-+*/&|^%!~<>=?:;,.@(){}\[\]]|\S|\Z)")  # fmt: skip
_JAVA_OP = {**dict.fromkeys("+= -= *= /= %= &= |= ^= <<= >>= >>>=".split(), "ASG"), **dict.fromkeys("== != <= >= && || / % ^".split(), "BOP"), "~": "!", "++": "INC", "--": "INC"}
_JAVA_SIGNS = words("( ) { } [ ] ; , . ... @ :: -> = < > ! ? : + - * & |")
_JAVA_MOD, _JAVA_PRIM = words("public protected private abstract final native strictfp transient volatile"), words("boolean byte short int long char float double")


def _java_kind(t: str) -> str:
    if t in JAVA_WORDS or t in _JAVA_SIGNS:
        return t
    if t in _JAVA_OP:
        return _JAVA_OP[t]
    if t in _JAVA_MOD:
        return "MOD"
    if t in _JAVA_PRIM:
        return "PRIM"
    if t in ("goto", "const", "_"):
        return "ERROR" if t != "_" else "NAME"
    if t == "non-sealed":
        return "NONSEALED"
    c = t[:1]
    if t == "" or t[:2] in ("//", "/*"):
        return ""
    if c == '"':
        return "STRING" if len(t) > 1 else "ERROR"
    if c == "'":
        return "CHAR" if len(t) > 1 else "ERROR"
    if c.isdigit() or c == "." and len(t) > 1:
        return "NUMBER"
    return "NAME" if c.isalpha() or c in "_$" else "ERROR"


GO_WORDS = words("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var")
GO_TOKEN = re.compile(
    r"[ \t\r]*(\n|//[^\n]*|/\*[\s\S]*?\*/|\"(?:[^\"\\\n]|\\(?:[abfnrtv\\\"]|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{3}))*\"|`[^`]*`|'(?:[^'\\\n]|\\(?:[abfnrtv\\']|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{3}))'"
    r"|(?:0[xX][0-9a-fA-F_]+|0[oO]?[0-7_]+|0[bB][01_]+|(?:[0-9][0-9_]*\.?(?:[0-9][0-9_]*)?|\.[0-9][0-9_]*)(?:[eE][-+]?[0-9]+)?)i?(?!\w)|[^\W\d]\w*"
    r"|<<=|>>=|&\^=|\.\.\.|&\^|<-|&&|\|\||\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|[-+*/%&|^<>=!~()\[\]{},;.:]|\S|\Z)")  # fmt: skip
_GO_OP = {**dict.fromkeys("+= -= *= /= %= &= |= ^= <<= >>= &^=".split(), "ASG"), **dict.fromkeys("== != < <= > >= && || / % << >> &^".split(), "BOP"), "++": "INC", "--": "INC"}
_GO_SIGNS = words("( ) [ ] { } , ; . : = := ... <- + - * & ^ | ! ~")


def _go_kind(t: str) -> str:
    if t in GO_WORDS or t in _GO_SIGNS:
        return t
    if t in _GO_OP:
        return _GO_OP[t]
    c = t[:1]
    if t == "":
        return ""
    if t == "\n" or t[:2] == "//":
        return "NL" if t == "\n" else "#"
    if t[:2] == "/*":
        return "NL" if "\n" in t else "#"
    if c in "\"`":
        return "STRING" if len(t) > 1 else "ERROR"
    if c == "'":
        return "CHAR" if len(t) > 1 else "ERROR"
    if c.isdigit() or c == "." and len(t) > 1:
        return "NUMBER"
    return "NAME" if c.isalpha() or c == "_" else "ERROR"


JSON_TOKEN = re.compile(r"[ \t\r\n]*(\"(?:[^\"\\\x00-\x1f]|\\(?:[\"\\/bfnrt]|u[0-9a-fA-F]{4}))*\"|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?|true\b|false\b|null\b|[{}\[\]:,]|\S|\Z)")


def _json_kind(t: str) -> str:
    c = t[:1]
    if t in ("true", "false", "null") or t in ("{", "}", "[", "]", ":", ","):
        return t
    if t == "":
        return ""
    if c == '"' and len(t) > 1:
        return "STRING"
    return "NUMBER" if c.isdigit() or c == "-" and len(t) > 1 else "ERROR"


JAVA_KINDS, GO_KINDS, JSON_KINDS = Kinds(_java_kind), Kinds(_go_kind), Kinds(_json_kind)
_GO_ENDS = frozenset(["NAME", "NUMBER", "STRING", "CHAR", "break", "continue", "fallthrough", "return", "INC", ")", "]", "}"])


def plain_tokens(text: str, token: re.Pattern, kinds: Kinds) -> tuple[list[str], list[int]]:
    out, where = [], []
    for i, t in enumerate(token.findall(text)):
        k = kinds[t]
        if k:
            out.append(k)
            where.append(i)
    return out, where


def go_tokens(text: str) -> tuple[list[str], list[int]]:
    """With the semicolons that line ends stand for."""
    out, where, kinds, i = [], [], GO_KINDS, -1
    for i, t in enumerate(GO_TOKEN.findall(text)):
        k = kinds[t]
        if k == "NL":
            if out and out[-1] in _GO_ENDS:
                out.append(";")
                where.append(i)
        elif k and k != "#":
            out.append(k)
            where.append(i)
    if out and out[-1] in _GO_ENDS:
        out.append(";")
        where.append(i)
    return out, where


_PAIRS = ({"(", "[", "{", "INDENT"}, {")", "]", "}", "DEDENT"})
_BANS = {"stmt": {"{", "function", "class"}, "brace": {"{"}}
_MADE: dict[str, Automaton] = {}


def automaton(language: str) -> Automaton:
    """The worker's automaton of a language."""
    a = _MADE.get(language)
    if a is None:
        a = _MADE[language] = Automaton(Grammar(getattr(grammars, language.upper()), _BANS), *_PAIRS)
    return a


def first_error(language: str, text: str) -> int:
    """The 1-based line of a file's first unrecoverable error, 0 if it parses."""
    if language in ("python", "javascript", "go") and text[:1] == "\ufeff":
        text = text[1:]
    if language == "javascript" and text.startswith("#!"):
        text = "//" + text[2:]
    pattern = {"python": PY_TOKEN, "javascript": JS_TOKEN, "java": JAVA_TOKEN, "go": GO_TOKEN, "json": JSON_TOKEN}[language]
    a, where = automaton(language), []
    try:
        if language == "python":
            if "\x00" in text:
                raise Lexed(0)
            tokens, where = python_tokens(text)
            at = a.parse(tokens, "file") if tokens else -1
        elif language == "javascript":
            tokens, where, lines = javascript_tokens(text)
            at = a.parse(tokens, "file", _ends(tokens, lines)) if tokens else -1
        elif language == "go":
            tokens, where = go_tokens(text)
            at = a.parse(tokens, "file")
        else:
            tokens, where = plain_tokens(text, pattern, JAVA_KINDS if language == "java" else JSON_KINDS)
            at = a.parse(tokens, "file") if tokens or language == "json" else -1
        if at < 0:
            return 0
        index = where[at] if at < len(where) else -1
    except Lexed as e:
        at = a.parse(e.tokens, "file") if e.tokens else -1
        index = e.where[at] if 0 <= at < len(e.where) else e.at
    if index < 0:
        return text.count("\n") + 1
    if language == "javascript":
        return text.count("\n", 0, index) + 1
    for k, m in enumerate(pattern.finditer(text)):
        if k == index:
            return text.count("\n", 0, m.start(1)) + 1
    return text.count("\n") + 1
