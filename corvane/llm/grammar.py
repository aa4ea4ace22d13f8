"""Recognition by a table-driven generalised LR automaton that is built and determinised as texts reach it.

A grammar is text: `name: alternatives ;` with quoted terminals, UPPER-CASE terminal classes, and ? * + and groups. It
becomes productions without empty ones, so a reduction always consumes. LR(0) item sets are made on demand, with FOLLOW
sets as lookahead. Where the table has several actions, all are followed: a configuration is the set of live stacks,
shared as hash-consed cells. A step from one configuration over a token to the next is computed once and kept, so known
paths cost a dictionary look-up per token, and nothing is lost by ambiguity.

A bracket's inside never depends on what lies below it. At an opening token the outer stacks are set aside and the inside
starts from a configuration with holes; at the closing token they are put back. So inner steps are shared by all
nestings. When the tables reach `max_cells` they are dropped between two texts, which changes speed only.
"""

from __future__ import annotations

import re
from collections import defaultdict

_TOKEN = re.compile(r"\s*(?:#[^\n]*\n\s*)*('[^']+'|[A-Za-z_][A-Za-z_0-9~]*|[:;|()?*+])")


def _symbol(token: str) -> str:
    """Quoted terminals lose their quotes, marks of the notation get a backslash, names of rules angle brackets."""
    if token[0] == "'":
        return token[1:-1]
    if not (token[0].isalpha() or token[0] == "_"):
        return "\\" + token
    if token.isupper():
        return token
    name, _, tag = token.partition("~")
    return f"<{name}>" + (f"@@{tag}" if tag else "")


class Grammar:
    """Productions, FIRST and FOLLOW of a grammar text. `x~tag` is x without alternatives that begin with a terminal
    listed in bans[tag], at any depth of the leftmost path."""

    def __init__(self, text: str, bans: dict[str, set[str]] | None = None):
        self.bans = bans or {}
        raw: dict[str, list[list]] = {}
        tokens = [_symbol(t) for t in _TOKEN.findall(text)]
        i, fresh = 0, 0

        def alternatives(i):
            """Parses alternatives up to ; or ) into lists of (symbol, repetition)."""
            nonlocal fresh
            out, seq = [], []
            while True:
                t = tokens[i]
                if t in ("\\;", "\\)"):
                    out.append(seq)
                    return out, i
                if t == "\\|":
                    out.append(seq)
                    seq = []
                    i += 1
                    continue
                if t == "\\(":
                    inner, i = alternatives(i + 1)
                    fresh += 1
                    t = f"<group {fresh}>"
                    raw[t] = inner
                i += 1
                mark = tokens[i][1:] if tokens[i] in ("\\?", "\\*", "\\+") else ""
                i += bool(mark)
                seq.append((t, mark))

        while i < len(tokens):
            name = tokens[i]
            if i == 0:
                self.first_rule = name
            assert tokens[i + 1] == "\\:", tokens[i : i + 3]
            raw[name], i = alternatives(i + 2)
            i += 1
        rules: dict[str, set[tuple]] = defaultdict(set)
        for name, alts in raw.items():
            for alt in alts:
                seqs = [()]
                for sym, mark in alt:
                    if mark in ("*", "+"):
                        plus = f"<{sym} more>"
                        rules[plus] |= {(sym,), (plus, sym)}
                        own = plus
                    else:
                        own = sym
                    seqs = [s + (own,) for s in seqs] + ([s for s in seqs] if mark in ("?", "*") else [])
                rules[name] |= set(seqs)
        nullable: set[str] = set()
        while True:
            new = {n for n, ps in rules.items() if () in ps and n not in nullable}
            nullable |= new
            for n in new:
                rules[n].discard(())
            changed = bool(new)
            for n, ps in rules.items():
                for p in list(ps):
                    for k, s in enumerate(p):
                        if s in nullable and (q := p[:k] + p[k + 1 :]) not in ps and not (q == () and n in nullable):
                            ps.add(q)
                            changed = True
            if not changed:
                break
        for n in rules:
            rules[n] = {p for p in rules[n] if p != (n,)}
        self.rules = dict(rules)
        self.nullable = nullable
        todo = [s for ps in list(self.rules.values()) for p in ps for s in p if "@@" in s]
        while todo:
            name = todo.pop()
            if name in self.rules:
                continue
            base, tag = name.split("@@")
            made = set()
            for p in self.rules[base]:
                if p[0] in self.rules:
                    made.add((f"{p[0]}@@{tag}", *p[1:]))
                elif p[0] not in self.bans[tag]:
                    made.add(p)
            self.rules[name] = made
            todo += [s for p in made for s in p if "@@" in s and s not in self.rules]
        self.productions = [(n, p) for n, ps in sorted(self.rules.items()) for p in sorted(ps)]
        self.by_name = defaultdict(list)
        for k, (n, _) in enumerate(self.productions):
            self.by_name[n].append(k)
        self._sets()

    def _sets(self) -> None:
        first: dict[str, set] = defaultdict(set)
        changed = True
        while changed:
            changed = False
            for n, p in self.productions:
                add = first[p[0]] if p[0] in self.rules else {p[0]}
                if not add <= first[n]:
                    first[n] |= add
                    changed = True
        follow: dict[str, set] = defaultdict(set)
        follow[self.first_rule].add("EOF")
        changed = True
        while changed:
            changed = False
            for n, p in self.productions:
                for k, s in enumerate(p):
                    if s in self.rules:
                        add = follow[n] if k + 1 == len(p) else first[p[k + 1]] if p[k + 1] in self.rules else {p[k + 1]}
                        if not add <= follow[s]:
                            follow[s] |= add
                            changed = True
        self.follow = follow


class Automaton:
    """The lazily built tables of one grammar with bracket pairs. `start` names the rule that a whole text must be."""

    def __init__(self, grammar: Grammar, openers: set[str], closers: set[str], max_cells: int = 1_000_000):
        self.g, self.openers, self.closers, self.max_cells = grammar, openers, closers, max_cells
        self.items: dict[tuple, int] = {}
        self.kernels: list[tuple] = []
        self.shifts: list[dict] = []
        self.reduces: list[dict] = []
        self.reset()

    def reset(self) -> None:
        self.cell_ids: dict[tuple[int, int], int] = {}
        self.cells: list[tuple[int, int]] = []
        self.config_ids: dict[tuple, int] = {}
        self.configs: list[tuple] = []
        self.steps: list[dict] = []
        self.outer_ids: dict[tuple, int] = {}
        self.outers: list[tuple] = []
        self.joined: dict[tuple[int, int], int] = {}
        self.starts: dict[str, int] = {}

    # item sets

    def _state(self, kernel: tuple) -> int:
        k = self.items.get(kernel)
        if k is None:
            k = self.items[kernel] = len(self.kernels)
            self.kernels.append(kernel)
            self.shifts.append(None)
            self.reduces.append(None)
        return k

    def _build(self, state: int) -> None:
        g, todo, seen = self.g, list(self.kernels[state]), set(self.kernels[state])
        moves, done = defaultdict(set), defaultdict(list)
        while todo:
            prod, dot = todo.pop()
            if prod < 0:  # the augmented start: -1 - k stands for S' -> rule k
                name = self.start_rules[-1 - prod]
                if dot:
                    continue
                sym = name
            else:
                body = g.productions[prod][1]
                if dot == len(body):
                    for t in g.follow[g.productions[prod][0]]:
                        done[t].append((g.productions[prod][0], len(body)))
                    continue
                sym = body[dot]
            moves[sym].add((prod, dot + 1))
            if sym in g.rules:
                for p in g.by_name[sym]:
                    if (p, 0) not in seen:
                        seen.add((p, 0))
                        todo.append((p, 0))
        self.shifts[state] = {s: self._state(tuple(sorted(ks))) for s, ks in moves.items()}
        self.reduces[state] = dict(done)

    start_rules: list[str] = []

    def _goto(self, state: int, sym: str):
        if self.shifts[state] is None:
            self._build(state)
        return self.shifts[state].get(sym)

    # stacks

    def _cell(self, state: int, below: int) -> int:
        key = (state, below)
        k = self.cell_ids.get(key)
        if k is None:
            k = self.cell_ids[key] = len(self.cells)
            self.cells.append(key)
        return k

    def _config(self, cells) -> int:
        key = tuple(sorted(cells))
        k = self.config_ids.get(key)
        if k is None:
            k = self.config_ids[key] = len(self.configs)
            self.configs.append(key)
            self.steps.append({})
        return k

    def begin(self, rule: str) -> int:
        if len(self.cells) > self.max_cells:
            self.reset()
        k = self.starts.get(rule)
        if k is None:
            if rule not in self.start_rules:
                self.start_rules = [*self.start_rules, rule]
                self.g.follow[rule].add("EOF")
                self._refollow(rule)
            s = self._state(((-1 - self.start_rules.index(rule), 0),))
            k = self.starts[rule] = self._config([self._cell(s, -1)])
        return k

    def _refollow(self, rule: str) -> None:
        """EOF may follow the rule, and so whatever ends it; item sets made before are made anew."""
        todo, seen = [rule], {rule}
        while todo:
            n = todo.pop()
            for k in self.g.by_name[n]:
                s = self.g.productions[k][1][-1]
                if s in self.g.rules and s not in seen:
                    seen.add(s)
                    self.g.follow[s].add("EOF")
                    todo.append(s)
        self.shifts = [None] * len(self.kernels)
        self.reduces = [None] * len(self.kernels)

    def _advance(self, config: int, token: str) -> set[int]:
        todo, seen, out = list(self.configs[config]), set(self.configs[config]), set()
        while todo:
            c = todo.pop()
            state, _ = self.cells[c]
            if self.shifts[state] is None:
                self._build(state)
            for name, size in self.reduces[state].get(token, ()):
                base = c
                for _ in range(size):
                    base = self.cells[base][1]
                    if base < 0:
                        break
                if base < 0:
                    continue
                to = self._goto(self.cells[base][0], name)
                if to is not None:
                    n = self._cell(to, base)
                    if n not in seen:
                        seen.add(n)
                        todo.append(n)
            to = self.shifts[state].get(token)
            if to is not None:
                out.add(self._cell(to, c))
        return out

    def step(self, config: int, token: str):
        """-1 if no stack survives; for an opener (outer, inner); else the next configuration."""
        out = self._advance(config, token)
        if not out:
            r = -1
        elif token in self.openers:
            below = sorted({self.cells[c][1] for c in out})
            holes = {b: -2 - k for k, b in enumerate(below)}
            key = tuple(below)
            outer = self.outer_ids.setdefault(key, len(self.outers))
            if outer == len(self.outers):
                self.outers.append(key)
            r = (outer, self._config({self._cell(self.cells[c][0], holes[self.cells[c][1]]) for c in out}))
        else:
            r = self._config(out)
        self.steps[config][token] = r
        return r

    def join(self, inner: int, outer: int) -> int:
        """The inside's configuration, put back on the outer stacks."""
        key = (inner, outer)
        r = self.joined.get(key)
        if r is None:
            below = self.outers[outer]

            def fill(c):
                trail = []
                while c >= 0:
                    state, c = self.cells[c]
                    trail.append(state)
                c = below[-2 - c]
                for state in reversed(trail):
                    c = self._cell(state, c)
                return c

            r = self.joined[key] = self._config({fill(c) for c in self.configs[inner]})
        return r

    def accepts(self, config: int, rule: str) -> bool:
        """Whether the text read so far is the start rule."""
        d = self.steps[config]
        key = ("EOF", rule)
        if key not in d:
            self._advance(config, "EOF")
            todo, seen, ok = list(self.configs[config]), set(), False
            goal = ((-1 - self.start_rules.index(rule), 1),)
            while todo and not ok:
                c = todo.pop()
                if c in seen:
                    continue
                seen.add(c)
                state = self.cells[c][0]
                if self.kernels[state] == goal or goal[0] in self.kernels[state]:
                    ok = True
                if self.shifts[state] is None:
                    self._build(state)
                for name, size in self.reduces[state].get("EOF", ()):
                    base = c
                    for _ in range(size):
                        base = self.cells[base][1]
                        if base < 0:
                            break
                    if base >= 0 and (to := self._goto(self.cells[base][0], name)) is not None:
                        todo.append(self._cell(to, base))
            d[key] = ok
        return d[key]

    def parse(self, tokens, rule: str, insert=None) -> int:
        """The index of the first token at which no parse survives, len(tokens) at a premature end, -1 if the tokens
        are the rule. `insert(i)` says whether a missing statement end (the token ';') may be supplied before token i."""
        rule = f"<{rule}>"
        config, stack = self.begin(rule), []
        steps = self.steps
        openers, closers = self.openers, self.closers
        for i, t in enumerate(tokens):
            r = steps[config].get(t)
            if r is None:
                r = self.step(config, t)
            if r == -1:
                if insert is None or not insert(i):
                    return i
                r = steps[config].get(";") or self.step(config, ";")
                if r == -1:
                    return i
                config = r
                r = steps[config].get(t) or self.step(config, t)
                if r == -1:
                    return i
            if t in openers:
                stack.append(r[0])
                config = r[1]
            elif t in closers:
                if not stack:
                    return i
                config = self.join(r, stack.pop())
            else:
                config = r
        if stack:
            return len(tokens)
        if self.accepts(config, rule):
            return -1
        if insert is not None and insert(len(tokens)):
            r = steps[config].get(";") or self.step(config, ";")
            if r != -1 and self.accepts(r, rule):
                return -1
        return len(tokens)
