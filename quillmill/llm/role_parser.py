"""Least-cost repair of a row of roles by a generalised LR parser.

The grammar says which role initials make a conversation: nothing, or an optional ``s`` and one or more
``ua``. Its LR(0) automaton is built here. The parser reads rows and keeps all stacks that some edits of
the rows so far lead to: a row is kept or reroled (its symbol is shifted and what can be reduced is),
or deleted (the stack stays), and before a kept or reroled row symbols may be inserted (shifted without a
row). Stacks share their lower nodes, equal stack tops over equal nodes are merged, and the merged one has
the minimum of (cost, audit), where the audit spells the edits.

Audits are not kept as strings. After a row every audit ends in the edit that consumed this row, so of
two different ones at the same row none begins with the other, and their order among the few live stacks
is a rank. A set of stacks with costs relative to the cheapest and ranks is a *front*; there are few
different ones, so what a row does to a front is computed once and looked up afterwards, and a row
costs one look-up and a back pointer.

Stacks after a stretch of rows, from each stack before it, compose: stretches are parsed apart
and joined by the same minimum.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import product

PRODUCTIONS = [("chat", ()), ("chat", ("turns",)), ("chat", ("s", "turns")), ("turns", ("pair",)), ("turns", ("turns", "pair")), ("pair", ("u", "a"))]
GOAL, INSERTED, REROLED = "chat", "ua", "ua"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
# Two insertions bring any stack in step with any other, and then it lacks at most the keeping of one
# leading s, whose row can be deleted: what costs more than that above the least can never be a least one.
HOPELESS = 2 * INSERT + DELETE

Item = tuple[int, int]  # production and how much of it has been read


def _closed(items: Iterable[Item]) -> frozenset[Item]:
    todo = list(items)
    out = set(todo)
    while todo:
        rule, at = todo.pop()
        body = PRODUCTIONS[rule][1]
        if at < len(body):
            for other, (head, _) in enumerate(PRODUCTIONS):
                if head == body[at] and (other, 0) not in out:
                    out.add((other, 0))
                    todo.append((other, 0))
    return frozenset(out)


def automaton() -> tuple[list[dict[str, int]], list[list[int]]]:
    """Of every LR(0) state where a symbol leads and which productions end in it."""
    start = _closed((rule, 0) for rule, (head, _) in enumerate(PRODUCTIONS) if head == GOAL)
    states, moves = [start], []
    for items in states:
        step: dict[str, int] = {}
        for symbol in sorted({PRODUCTIONS[r][1][at] for r, at in items if at < len(PRODUCTIONS[r][1])}):
            to = _closed((r, at + 1) for r, at in items if PRODUCTIONS[r][1][at : at + 1] == (symbol,))
            if to not in states:
                states.append(to)
            step[symbol] = states.index(to)
        moves.append(step)
    return moves, [[r for r, at in items if at == len(PRODUCTIONS[r][1])] for items in states]


Front = tuple[tuple[int, int, int], ...]  # (stack, cost above the least, rank of the audit), by stack
Back = dict[int, tuple[int, str]]  # of a stack the one before the row, and the edits


class RoleParser:
    def __init__(self):
        self.moves, self.ends = automaton()
        self.nodes: list[tuple[int, int]] = [(0, -1)]  # LR state and the node below
        self.numbers = {self.nodes[0]: 0}
        self.shifts: dict[tuple[int, str], list[int]] = {}
        self.steps: dict[tuple[Front, str, bool, bool], tuple[Front, int, Back]] = {}
        self.stacks()  # nodes get the same numbers in every worker

    def node(self, state: int, below: int) -> int:
        """The node of a state over another node; equal stacks are one node."""
        if (state, below) not in self.numbers:
            self.numbers[state, below] = len(self.nodes)
            self.nodes.append((state, below))
        return self.numbers[state, below]

    def reduced(self, top: int) -> list[int]:
        """Stacks that reductions lead to, the given one first. The goal itself is no stack."""
        out = [top]
        for at in out:
            for rule in self.ends[self.nodes[at][0]]:
                head, body = PRODUCTIONS[rule]
                below = at
                for _ in body:
                    below = self.nodes[below][1]
                to = self.moves[self.nodes[below][0]].get(head)
                if to is not None and (new := self.node(to, below)) not in out:
                    out.append(new)
        return out

    def shift(self, top: int, symbol: str) -> list[int]:
        """Stacks after a symbol: those that can read on. Others only lead to them."""
        if (top, symbol) not in self.shifts:
            to = self.moves[self.nodes[top][0]].get(symbol)
            found = [] if to is None else self.reduced(self.node(to, top))
            self.shifts[top, symbol] = [n for n in found if any(len(s) == 1 for s in self.moves[self.nodes[n][0]])]
        return self.shifts[top, symbol]

    def accepts(self, top: int) -> bool:
        """Whether reductions lead from a stack to the goal over the empty stack."""
        for at in self.reduced(top):
            for rule in self.ends[self.nodes[at][0]]:
                head, body = PRODUCTIONS[rule]
                below = at
                for _ in body:
                    below = self.nodes[below][1]
                if head == GOAL and below == 0:
                    return True
        return False

    def inserted(self, top: int) -> dict[int, int]:
        """Stacks that insertions lead to, and how many it takes at least."""
        found, todo = {top: 0}, [top]
        for at in todo:
            for symbol in INSERTED:
                for new in self.shift(at, symbol):
                    if new not in found:
                        found[new] = found[at] + 1
                        todo.append(new)
        return found

    def step(self, front: Front, initial: str, must_delete: bool, truncated: bool) -> tuple[Front, int, Back]:
        """The front after a row, what the least cost rises by, and the back pointers."""
        key = (front, initial, must_delete, truncated)
        if key in self.steps:
            return self.steps[key]
        best: dict[int, tuple[int, tuple[int, str], int]] = {}  # stack: (cost, audit, stack before)

        def offer(stack: int, cost: int, audit: tuple[int, str], before: int) -> None:
            if stack not in best or (cost, audit) < best[stack][:2]:
                best[stack] = (cost, audit, before)

        for top, cost, rank in front:
            # Insertions before a deletion would stand behind it in a lesser audit.
            offer(top, cost + DELETE, (rank, "D"), top)
            if must_delete:
                continue
            more = TRUNCATED if truncated else 0
            for at, n in self.inserted(top).items():
                for stack in self.shift(at, initial):
                    offer(stack, cost + n * INSERT + KEEP + more, (rank, "I" * n + "K"), top)
                for symbol in REROLED:
                    if symbol != initial:
                        for stack in self.shift(at, symbol):
                            offer(stack, cost + n * INSERT + REROLE + more, (rank, "I" * n + "R"), top)
        least = min(cost for cost, _, _ in best.values())
        best = {stack: found for stack, found in best.items() if found[0] - least <= HOPELESS}
        order = {audit: i for i, audit in enumerate(sorted({audit for _, audit, _ in best.values()}))}
        new = tuple(sorted((stack, cost - least, order[audit]) for stack, (cost, audit, _) in best.items()))
        back = {stack: (before, audit[1]) for stack, (_, audit, before) in best.items()}
        self.steps[key] = (new, least, back)
        return self.steps[key]

    def parse(self, rows: list[tuple[str, bool, bool]], start: int = 0) -> dict[int, tuple[int, str]]:
        """(cost, audit) of every stack after the rows (initial, must be deleted, truncated) from one stack."""
        front, total, backs = ((start, 0, 0),), 0, []
        for row in rows:
            front, rise, back = self.step(front, *row)
            total += rise
            backs.append(back)
        out = {}
        for stack, cost, _ in front:
            parts, at = [], stack
            for back in reversed(backs):
                at, edits = back[at]
                parts.append(edits)
            out[stack] = (total + cost, "".join(reversed(parts)))
        return out

    def stacks(self) -> list[int]:
        """All stacks that rows may leave."""
        found = [0]
        for at in found:
            for symbol in "sua":
                found += [n for n in self.shift(at, symbol) if n not in found]
        return found

    def finish(self, fronts: dict[int, tuple[int, str]]) -> tuple[int, str]:
        """The least (cost, audit) of a whole conversation."""
        ends = []
        for stack, (cost, audit) in fronts.items():
            ends += [(cost + n * INSERT, audit + "I" * n) for at, n in self.inserted(stack).items() if self.accepts(at)]
        return min(ends)


def joined(before: dict[int, tuple[int, str]], stretch: dict[tuple[int, int], tuple[int, str]]) -> dict[int, tuple[int, str]]:
    """Fronts after a stretch that was parsed from every stack: (start, end) to (cost, audit)."""
    out: dict[int, tuple[int, str]] = {}
    for (stack, (cost, audit)), ((start, end), (more, edits)) in product(before.items(), stretch.items()):
        if start == stack:
            new = (cost + more, audit + edits)
            out[end] = min(out.get(end, new), new)
    return out


class Replay:
    """Lines of the repaired conversation, from an audit and its rows one after another."""

    def __init__(self, audit: str):
        self.audit, self.at, self.last = audit, 0, ""

    def _line(self, role: str, text: str) -> str:
        self.last = role[:1]
        return f"{role}:{text}"

    def _due(self) -> str:
        return "assistant" if self.last == "u" else "user"

    def inserted(self) -> list[str]:
        out = []
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            out.append(self._line(self._due(), ""))
        return out

    def row(self, role: str, text: str) -> list[str]:
        out = self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            out.append(self._line(role if edit == "K" else self._due(), text))
        return out
