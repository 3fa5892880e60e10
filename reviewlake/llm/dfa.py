"""A compiler from byte regexes to one minimal transition table, and a vectorised scan.

Supported syntax: literals, escapes (``\\n \\t \\xHH`` and escaped punctuation),
classes with ranges and negation, groups, ``|``, and the suffixes ``* + ?`` and
``{n}``, ``{n,m}``, ``{n,}``. Patterns match bytes.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass
from functools import cached_property

import numpy as np

ANY = frozenset(range(256))


class Nfa:
    """Thompson construction; state numbers index ``eps`` and ``arcs``."""

    def __init__(self) -> None:
        self.eps: list[list[int]] = []
        self.arcs: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.eps.append([])
        self.arcs.append([])
        return len(self.eps) - 1

    def build(self, node: tuple, start: int) -> int:
        """Add a parsed expression after ``start``; returns its end."""
        kind, *args = node
        if kind == "set":
            end = self.state()
            self.arcs[start].append((args[0], end))
            return end
        if kind == "cat":
            for part in args[0]:
                start = self.build(part, start)
            return start
        if kind == "alt":
            end = self.state()
            for part in args[0]:
                first = self.state()
                self.eps[start].append(first)
                self.eps[self.build(part, first)].append(end)
            return end
        part, low, high = args
        for _ in range(low):
            start = self.build(part, start)
        end = self.state()
        if high is None:
            loop = self.state()
            self.eps[start].append(loop)
            self.eps[self.build(part, loop)].append(loop)
            self.eps[loop].append(end)
            return end
        for _ in range(high - low):
            self.eps[start].append(end)
            start = self.build(part, start)
        self.eps[start].append(end)
        return end


def parse(pattern: str) -> tuple:
    """The syntax tree of a pattern."""
    pos = 0

    def peek() -> str:
        return pattern[pos] if pos < len(pattern) else ""

    def take() -> str:
        nonlocal pos
        pos += 1
        return pattern[pos - 1]

    def escape() -> int:
        c = take()
        if c == "x":
            return int(take() + take(), 16)
        return {"n": 10, "t": 9, "r": 13}.get(c, ord(c))

    def one() -> int:
        c = take()
        return escape() if c == "\\" else ord(c)

    def bracket() -> frozenset[int]:
        negated = peek() == "^"
        if negated:
            take()
        members: set[int] = set()
        while peek() != "]":
            low = one()
            high = low
            if peek() == "-" and pattern[pos + 1] != "]":
                take()
                high = one()
            members.update(range(low, high + 1))
        take()
        return ANY - members if negated else frozenset(members)

    def atom() -> tuple:
        c = take()
        if c == "(":
            inner = choice()
            take()
            return inner
        if c == "[":
            return ("set", bracket())
        return ("set", frozenset([escape() if c == "\\" else ord(c)]))

    def piece() -> tuple:
        node = atom()
        while peek() and peek() in "*+?{":
            c = take()
            if c == "{":
                text = ""
                while peek() != "}":
                    text += take()
                take()
                low, _, high = text.partition(",")
                bounds = (int(low), int(low) if "," not in text else int(high) if high else None)
            else:
                bounds = {"*": (0, None), "+": (1, None), "?": (0, 1)}[c]
            node = ("rep", node, *bounds)
        return node

    def sequence() -> tuple:
        parts = []
        while peek() and peek() not in "|)":
            parts.append(piece())
        return ("cat", parts)

    def choice() -> tuple:
        options = [sequence()]
        while peek() == "|":
            take()
            options.append(sequence())
        return options[0] if len(options) == 1 else ("alt", options)

    return choice()


def reverse(node: tuple) -> tuple:
    kind, *args = node
    if kind == "set":
        return node
    if kind == "cat":
        return ("cat", [reverse(x) for x in reversed(args[0])])
    if kind == "alt":
        return ("alt", [reverse(x) for x in args[0]])
    return ("rep", reverse(args[0]), args[1], args[2])


@dataclass
class Dfa:
    """``table[state, class]`` with ``classes[byte]``; ``accept`` has a bit per rule; state 0 starts."""

    table: np.ndarray
    classes: np.ndarray
    accept: np.ndarray
    dead: int

    def longest(self, data: bytes, positions: range) -> int:
        """Bytes of the longest match over the bytes at these positions, or -1."""
        table, classes, accept = self.lists
        state, best = 0, 0 if accept[0] else -1
        for n, i in enumerate(positions, 1):
            state = table[state][classes[data[i]]]
            if state == self.dead:
                break
            if accept[state]:
                best = n
        return best

    @cached_property
    def lists(self) -> tuple[list[list[int]], list[int], list[int]]:
        """The same arrays as lists, which a byte-by-byte walk reads faster."""
        return self.table.tolist(), self.classes.tolist(), self.accept.tolist()


def compile_rules(trees: list[tuple], search: bool) -> Dfa:
    """Subset construction over all rules at once, then minimisation.

    With ``search`` a match may begin at any byte, so one pass finds the ends of
    the matches of every rule.
    """
    nfa = Nfa()
    root = nfa.state()
    final: dict[int, int] = {}
    for k, tree in enumerate(trees):
        first = nfa.state()
        nfa.eps[root].append(first)
        end = nfa.build(tree, first)
        final[end] = 1 << k

    signature = np.zeros((256, 0), dtype=bool)
    sets = list({s for arcs in nfa.arcs for s, _ in arcs})
    signature = np.array([[b in s for s in sets] for b in range(256)], dtype=bool).reshape(256, len(sets))
    _, first_byte, classes = np.unique(signature, axis=0, return_index=True, return_inverse=True)
    classes = classes.reshape(-1)

    def closure(states: frozenset[int]) -> frozenset[int]:
        seen, stack = set(states), list(states)
        while stack:
            for t in nfa.eps[stack.pop()]:
                if t not in seen:
                    seen.add(t)
                    stack.append(t)
        return frozenset(seen)

    begin = closure(frozenset([root]))
    numbers, rows, queue = {begin: 0}, [], deque([begin])
    while queue:
        current = queue.popleft()
        row = []
        for b in first_byte:
            target = frozenset(t for s in current for chars, t in nfa.arcs[s] if int(b) in chars)
            target = closure(target | {root}) if search else closure(target)
            if target not in numbers:
                numbers[target] = len(numbers)
                queue.append(target)
            row.append(numbers[target])
        rows.append(row)
    table = np.array(rows, dtype=np.int64)
    accept = np.array([sum(final.get(s, 0) for s in members) for members in numbers], dtype=np.int64)
    return minimise(table, accept, classes, numbers.get(frozenset(), -1))


def minimise(table: np.ndarray, accept: np.ndarray, classes: np.ndarray, dead: int) -> Dfa:
    """Refine the partition by accepted rules until successors agree."""
    _, block = np.unique(accept, return_inverse=True)
    block = block.reshape(-1)
    while True:
        rows = np.column_stack([block, block[table]])
        _, refined = np.unique(rows, axis=0, return_inverse=True)
        refined = refined.reshape(-1)
        if refined.max() == block.max():
            break
        block = refined
    order = {int(block[0]): 0}
    for b in block:
        order.setdefault(int(b), len(order))
    number = np.array([order[int(b)] for b in block])
    first = [int(np.flatnonzero(number == k)[0]) for k in range(len(order))]
    return Dfa(
        number[table[first]].astype(np.int32),
        classes.astype(np.int32),
        accept[first],
        int(number[dead]) if dead >= 0 else -1,
    )


def scan(dfa: Dfa, data: np.ndarray, lanes: int = 2048) -> np.ndarray:
    """State after each byte, the data read once from the start state.

    The bytes are cut into lanes that advance together. A lane other than the
    first guesses that it begins in the start state; lanes whose guess was wrong
    are read again from the state their neighbour ended in until nothing
    changes, so the states are exactly those of a sequential pass.
    """
    n = len(data)
    if not n:
        return np.zeros(0, dtype=np.int32)
    width = dfa.table.shape[1]
    flat = np.ascontiguousarray(dfa.table).reshape(-1) * width
    lanes = max(1, min(lanes, n // 64))
    steps = -(-n // lanes)
    codes = np.zeros(lanes * steps, dtype=np.int32)
    codes[:n] = dfa.classes[data]
    codes = np.ascontiguousarray(codes.reshape(lanes, steps).T)
    states = np.empty_like(codes)
    current = np.zeros(lanes, dtype=np.int32)
    for i in range(steps):
        current = flat[current + codes[i]]
        states[i] = current
    begun = np.zeros(lanes, dtype=np.int32)
    while True:
        due = np.r_[np.int32(0), states[-1, :-1]]
        wrong = np.flatnonzero(due != begun)
        if not len(wrong):
            break
        begun[wrong] = due[wrong]
        current = due[wrong]
        for i in range(steps):
            current = flat[current + codes[i, wrong]]
            differ = states[i, wrong] != current
            if not differ.any():
                break
            states[i, wrong] = current
            wrong, current = wrong[differ], current[differ]
    return (states.T.reshape(-1)[:n]) // width
