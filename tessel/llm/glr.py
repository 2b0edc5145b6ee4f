"""Generalised LR recognition from a grammar text.

``compile_grammar`` builds an SLR(1) automaton; conflicts stay in the table. ``Recognizer`` runs it on all readings at once: a reading
is a stack, stacks are nodes of a shared trie, so equal stacks are one object, and readings that agree again merge. Since a stack is an
object, what a chunk of tokens (a source line) does to a set of stacks is remembered: lines of the same token kinds in the same context
are parsed once. Tokens are single characters, so a chunk is a string.

Grammar text: ``name: alternative | alternative`` per rule, a rule may continue on indented lines. ``'x'`` and capitalised words are terminals; ``?``,
``*`` and ``+`` follow an item or a parenthesised group. An alternative that starts with ``@feature`` exists only with that feature.
``%prefer a > b``: where a and b begin with the same terminal at one point, b is dropped. ``%copy f a b c``: each rule named has a copy a_f whose
references to the others are to their copies too, and only the copies have the alternatives marked with @f.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_ITEM = re.compile(r"\s*('[^']+'|@\w+|\w+|[()?*+|])")
END = "\x03"
KEPT = 400_000


@dataclass
class Table:
    terminals: dict[str, str]
    action: list[dict[str, tuple[int, tuple[tuple[int, int], ...]]]]
    goto: list[dict[int, int]]


@dataclass
class _Rules:
    features: set[str]
    rules: dict[str, list[tuple[str, ...]]] = field(default_factory=dict)
    helpers: dict[tuple, str] = field(default_factory=dict)

    def helper(self, key: tuple, alternatives) -> str:
        if key not in self.helpers:
            name = self.helpers[key] = f"_{len(self.helpers)}"
            self.rules[name] = alternatives(name)
        return self.helpers[key]

    def alternatives(self, items: list[str]) -> list[tuple[str, ...]]:
        """Parse alternatives up to the closing parenthesis or the end; consumes ``items``."""
        out, now, wanted = [], [], True
        while items and items[0] != ")":
            x = items.pop(0)
            if x == "|":
                out.append((wanted, tuple(now)))
                now, wanted = [], True
                continue
            if x[0] == "@":
                wanted = x[1:] in self.features
                continue
            if x == "(":
                inner = tuple(self.alternatives(items))
                items.pop(0)
                x = inner[0][0] if len(inner) == 1 and len(inner[0]) == 1 else self.helper(("group", inner), lambda _, inner=inner: list(inner))
            if items and items[0] in "?*+":
                x = self.repeated(x, items.pop(0))
            now.append(x)
        out.append((wanted, tuple(now)))
        return [a for keep, a in out if keep]

    def repeated(self, x: str, how: str) -> str:
        if how == "?":
            return self.helper((how, x), lambda _: [(), (x,)])
        return self.helper((how, x), lambda name: [() if how == "*" else (x,), (name, x)])


def compile_grammar(text: str, features: set[str] = frozenset()) -> Table:
    made, prefer = _Rules(set(features)), []
    texts = re.split(r"\n(?=\S)", re.sub(r"(?m)^#.*\n", "", text.strip() + "\n"))
    for line in [x for x in texts if x.startswith("%copy")]:
        mark, *copied = line.split()[1:]
        inside = re.compile(rf"(?<![\w'@%])({'|'.join(copied)})\b(?!')")
        texts += [inside.sub(rf"\1_{mark}", x).replace(f"@{mark} ", "") for x in texts if x.split(":")[0] in copied]
    for rule in [x for x in texts if not x.startswith("%copy")]:
        if not rule.strip():
            continue
        if rule.startswith("%prefer"):
            prefer.append(tuple(x.strip() for x in rule[7:].split(">")))
            continue
        name, body = rule.split(":", 1)
        items = _ITEM.findall(body)
        made.rules.setdefault(name.strip(), []).extend(made.alternatives(items))
    rules = made.rules
    start = next(n for n in rules if n[0] != "_")
    # rules that a feature has emptied vanish with the alternatives that use them
    terminal = lambda x: x[0] == "'" or x.isupper()
    while True:
        for alts in rules.values():
            for a in alts:
                for x in a:
                    if not terminal(x) and x not in rules:
                        raise ValueError(f"no rule for {x}")
        empty = {n for n, alts in rules.items() if not alts}
        if not empty:
            break
        rules = {n: [a for a in alts if not empty & set(a)] for n, alts in rules.items() if n not in empty}
    # only what the start rule reaches
    reached, todo = {start}, [start]
    while todo:
        for a in rules[todo.pop()]:
            for x in a:
                if not terminal(x) and x not in reached:
                    reached.add(x)
                    todo.append(x)
    rules = {n: alts for n, alts in rules.items() if n in reached}
    names = {n: i for i, n in enumerate(rules)}
    words = sorted({x for alts in rules.values() for a in alts for x in a if terminal(x)})
    code = {w: chr(0x100 + i) for i, w in enumerate(words)}
    prods: list[tuple[int, tuple]] = [(-1, (names[start],))]
    of: dict[int, list[int]] = {}
    for n, alts in rules.items():
        for a in dict.fromkeys(alts):
            of.setdefault(names[n], []).append(len(prods))
            prods.append((names[n], tuple(code[x] if terminal(x) else names[x] for x in a)))
    first, nullable, follow = _sets(prods, len(names))
    lower = {}
    for high, low in prefer:
        if high in names and low in names:
            lower.setdefault(names[high], set()).add(names[low])
    # LR(0) automaton over items (production, dot)
    closures: dict[int, frozenset[int]] = {}
    for n in names.values():
        seen, todo = set(), [n]
        while todo:
            m = todo.pop()
            for p in of.get(m, ()):
                if p not in seen:
                    seen.add(p)
                    rhs = prods[p][1]
                    if rhs and isinstance(rhs[0], int):
                        todo.append(rhs[0])
        closures[n] = frozenset(seen)
    kernels, queue, action, goto = {frozenset([(0, 0)]): 0}, [frozenset([(0, 0)])], [], []
    for kernel in queue:
        fresh: set[int] = set()
        for p, d in kernel:
            rhs = prods[p][1]
            if d < len(rhs) and isinstance(rhs[d], int):
                fresh |= closures[rhs[d]]
        moves: dict = {}
        reduce: dict[str, list] = {}
        for p, d in [*kernel, *((p, 0) for p in fresh)]:
            lhs, rhs = prods[p]
            if d < len(rhs):
                moves.setdefault(rhs[d], []).append((p, d + 1))
            elif p == 0:
                reduce.setdefault(END, []).append((-1, 0))
            else:
                for ch in follow[lhs]:
                    reduce.setdefault(ch, []).append((lhs, len(rhs)))
        row: dict[str, tuple] = {}
        jumps: dict[int, int] = {}
        for x, items in moves.items():
            if isinstance(x, str):
                begun = {prods[p][0] for p, d in items if d == 1}
                dropped = {low for high in begun for low in lower.get(high, ())}
                if dropped:
                    items = [(p, d) for p, d in items if d > 1 or prods[p][0] not in dropped]
            target = frozenset(items)
            if target not in kernels:
                kernels[target] = len(queue)
                queue.append(target)
            if isinstance(x, str):
                row[x] = (kernels[target], tuple(reduce.pop(x, ())))
            else:
                jumps[x] = kernels[target]
        for ch, reds in reduce.items():
            row[ch] = (-1, tuple(reds))
        action.append(row)
        goto.append(jumps)
    return Table({w.strip("'"): c for w, c in code.items()}, action, goto)


def _sets(prods, n):
    nullable: set[int] = set()
    first: list[set[str]] = [set() for _ in range(n)]
    follow: list[set[str]] = [set() for _ in range(n)]
    changed = True
    while changed:
        changed = False
        for lhs, rhs in prods[1:]:
            size = len(first[lhs])
            for x in rhs:
                if isinstance(x, str):
                    first[lhs].add(x)
                    break
                first[lhs] |= first[x]
                if x not in nullable:
                    break
            else:
                if lhs not in nullable:
                    nullable.add(lhs)
                    changed = True
            changed |= len(first[lhs]) > size
    follow[prods[0][1][0]].add(END)
    changed = True
    while changed:
        changed = False
        for lhs, rhs in prods[1:]:
            after = follow[lhs]
            for x in reversed(rhs):
                if isinstance(x, str):
                    after = {x}
                    continue
                size = len(follow[x])
                follow[x] |= after
                changed |= len(follow[x]) > size
                after = after | first[x] if x in nullable else first[x]
    return first, nullable, follow


class Stack:
    __slots__ = ("state", "below", "above")

    def __init__(self, state: int, below: Stack | None):
        self.state, self.below, self.above = state, below, {}


class Recognizer:
    """``inserted`` is a terminal that may be put before a token that does not fit, if a ``newline`` mark or a token of ``closing`` says so."""

    def __init__(self, table: Table, newline: str = "", inserted: str = "", closing: str = ""):
        self.table, self.newline, self.inserted, self.closing = table, newline, inserted, closing + END
        self.reset()

    def reset(self) -> None:
        self.start = (Stack(0, None),)
        self.memo: dict[tuple, tuple | int] = {}

    def step(self, stacks: tuple[Stack, ...], token: str) -> tuple[Stack, ...]:
        action, goto = self.table.action, self.table.goto
        out, seen, work = [], set(stacks), list(stacks)
        while work:
            node = work.pop()
            found = action[node.state].get(token)
            if found is None:
                continue
            shift, reductions = found
            if shift >= 0:
                above = node.above.get(shift)
                if above is None:
                    above = node.above[shift] = Stack(shift, node)
                out.append(above)
            for lhs, n in reductions:
                if lhs < 0:
                    out.append(node)
                    continue
                base = node
                for _ in range(n):
                    base = base.below
                state = goto[base.state][lhs]
                above = base.above.get(state)
                if above is None:
                    above = base.above[state] = Stack(state, base)
                if above not in seen:
                    seen.add(above)
                    work.append(above)
        return tuple(sorted(set(out), key=id)) if len(out) > 1 else tuple(out)

    def advance(self, stacks: tuple[Stack, ...], chunk: str) -> tuple[Stack, ...] | int:
        """The stacks after the chunk, or the index of the first token that no reading takes."""
        key = (stacks, chunk)
        done = self.memo.get(key)
        if done is None:
            done = self.memo[key] = self._advance(stacks, chunk)
        return done

    def _advance(self, stacks, chunk):
        fresh = False
        for i, token in enumerate(chunk):
            if token == self.newline:
                fresh = True
                continue
            after = self.step(stacks, token)
            if not after and self.inserted and (fresh or token in self.closing):
                middle = self.step(stacks, self.inserted)
                after = self.step(middle, token) if middle else ()
            if not after:
                return i
            stacks, fresh = after, False
        return stacks

    def run(self, chunks: list[str]) -> tuple[int, int] | None:
        """None if the chunks are a sentence, else (chunk, token in it) where the first error is; the end counts as one more chunk."""
        if len(self.memo) > KEPT:
            self.reset()
        stacks = self.start
        for n, chunk in enumerate(chunks):
            stacks = self.advance(stacks, chunk)
            if stacks.__class__ is int:
                return n, stacks
        return None if self.advance(stacks, END).__class__ is tuple else (len(chunks), 0)
