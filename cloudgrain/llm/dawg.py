"""Suffix-shared automaton of conversation signatures: cheapest edits from every node.

A signature has one symbol per turn: ``D`` for a turn that must be deleted, else the role's class ``s``, ``u``,
``a`` or ``x`` (any other), in upper case where the turn is truncated. Read from the end, equal suffixes of all
signatures are one node. A node holds, for each grammar state before its turn, the cost to go, the edits at its turn and the
state (of the next node) that they lead to: the best suffix is a chain of links and is shared like the node.

Grammar ``(s?(ua)+)?``: state 0 nothing yet, 1 after s, 2 after u, 3 after a. Edits are written as ``u`` and ``a``
(insert), ``K`` (keep), ``D`` (delete), ``U`` and ``A`` (change the role). In the audit they are I, K, D and R; among
cheapest edits the audit that sorts first is taken. The first letter decides that, as from one state a letter leads to one state only.
"""

from __future__ import annotations

from collections.abc import Iterator

START, STATES = 0, 4
INSERT, RENAME, DELETE, TRUNCATED = 3, 3, 4, 3
FAR = 1 << 40
#: What a role class leads to when kept, by state.
_KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The role that fits a state and the state after it.
_FITS = (("u", 2), ("u", 2), ("a", 3), ("u", 2))
#: Cost and insertions after the last turn, by state.
END_COST, END_EDITS = (0, 2 * INSERT, INSERT, 0), ("", "ua", "a", "")
AUDIT = str.maketrans("uaUA", "IIRR")
_ORDER = {"D": 0, "I": 1, "K": 2, "R": 3}

Node = tuple  # of (cost, edits, next state) by state


def exit_node(costs) -> Node:
    """The node after a signature, with the cost to go from each state."""
    return tuple((c, "", q) for q, c in enumerate(costs))


def before(symbol: str, after: Node) -> Node:
    """The node of a turn that ``after`` follows."""
    role, late = symbol.lower(), TRUNCATED * (symbol.isupper())
    own = []
    for q in range(STATES):
        best = (DELETE + after[q][0], 0, "D", q)
        if symbol != "D":
            if (to := _KEPT[q].get(role)) is not None:
                best = min(best, (late + after[to][0], _ORDER["K"], "K", to))
            fit, to = _FITS[q]
            best = min(best, (RENAME + late + after[to][0], _ORDER["R"], fit.upper(), to))
        own.append(best)
    found = own
    for _ in range(2):  # a third insertion would only come back to a state
        found = [min(own[q], (INSERT + found[to][0], _ORDER["I"], fit + found[to][2], found[to][3])) for q, (fit, to) in enumerate(_FITS)]
    return tuple((cost, edits, to) for cost, _, edits, to in found)


class Suffixes:
    """Nodes along the signature read last; the next one shares those of their common suffix."""

    def __init__(self) -> None:
        self.exit, self.read, self.nodes, self.made = None, "", [], 0

    def walk(self, backwards: str, exit_costs: tuple) -> list[Node]:
        """Nodes from the exit to the first turn of a signature given from its end. Cheap if calls come in sorted order."""
        if exit_costs != self.exit:
            self.exit, self.read, self.nodes = exit_costs, "", [exit_node(exit_costs)]
        same = 0
        for a, b in zip(self.read, backwards):
            if a != b:
                break
            same += 1
        del self.nodes[same + 1:]
        for symbol in backwards[same:]:
            self.nodes.append(before(symbol, self.nodes[-1]))
            self.made += 1
        self.read = backwards
        return self.nodes


def edits_from(nodes: list[Node], state: int) -> tuple[str, int, int]:
    """(edits of all turns, cost of them alone, state after the last turn) of the best way from ``state``."""
    total, parts = nodes[-1][state][0], []
    for node in reversed(nodes[1:]):
        _, edits, state = node[state]
        parts.append(edits)
    return "".join(parts), total - nodes[0][state][0], state


def costs_between(walkers: list[Suffixes], backwards: str) -> Iterator[int]:
    """Cost from each state before a signature to each state after it, row by row. One walker per state after it."""
    ways = [walker.walk(backwards, tuple(0 if q == out else FAR for q in range(STATES)))[-1] for out, walker in enumerate(walkers)]
    for state in range(STATES):
        for way in ways:
            yield way[state][0]
