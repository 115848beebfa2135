"""Cheapest repairs of role and fault signatures on an automaton that shares suffixes.

A signature has a symbol for each row: ``X`` must be deleted; ``s u a o`` is a row with that role
initial (``o``: any other), the capital letter one whose end is cut off. The repaired initials
must match ``(s?(ua)+)?``, read by four grammar states: 0 nothing yet, 1 after s, 2 after u, 3
after a. A node is a symbol and the node that follows, so signatures with one ending share its
nodes whatever comes before; cost to go and best edits are found once for a node and state.
"""

from __future__ import annotations

#: What edits cost, and what a row that stays costs if its end is cut off.
REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
#: State after the next row of the alternation, and that row's role.
NEXT = (2, 2, 3, 2)
ROLE = {2: "user", 3: "assistant"}
_KEEPS = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("a", 2): 3, ("u", 3): 2}
#: At the end of a conversation: what completes it from each state.
END = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))

Option = tuple[int, str, int]  # cost to go, edits up to and with the row, state after them


class Automaton:
    """All signatures with one continuation: cost and edits by state after the last row."""

    def __init__(self, ending: tuple[tuple[int, str], ...] = END) -> None:
        self.nodes: dict[tuple[str, int], int] = {}
        self.after = [-1]
        self.best: list[tuple[Option, ...]] = [tuple((cost, edits, q) for q, (cost, edits) in enumerate(ending))]

    def add(self, signature: str) -> int:
        """The node of the signature's first row."""
        node = 0
        for symbol in reversed(signature):
            node = self._node(symbol, node)
        return node

    def _node(self, symbol: str, after: int) -> int:
        found = self.nodes.get((symbol, after))
        if found is None:
            found = self.nodes[symbol, after] = len(self.best)
            self.best.append(self._options(symbol, self.best[after]))
            self.after.append(after)
        return found

    def _options(self, symbol: str, rest: tuple[Option, ...]) -> tuple[Option, ...]:
        """Of each state the cheapest edits of the row and what follows, ties to the least letter.

        Each letter leads to one state, so letters decide ties of whole edit strings.
        """
        best = []
        for q in range(4):
            options = [(rest[q][0] + DELETE, "D", q)]
            if symbol != "X":
                extra = CUT_OFF if symbol.isupper() else 0
                kept = _KEEPS.get((symbol.lower(), q))
                if kept is not None:
                    options.append((rest[kept][0] + extra, "K", kept))
                options.append((rest[NEXT[q]][0] + extra + REROLE, "R", NEXT[q]))
            best.append(min(options))
        plain = list(best)
        for q in (2, 3):
            best[q] = min(best[q], self._inserted(plain[NEXT[q]]))
        for q in (0, 1):
            best[q] = min(best[q], self._inserted(best[2]))
        return tuple(best)

    @staticmethod
    def _inserted(option: Option) -> Option:
        return option[0] + INSERT, "I" + option[1], option[2]

    def costs(self, node: int) -> tuple[int, ...]:
        return tuple(option[0] for option in self.best[node])

    def audit(self, node: int, state: int) -> tuple[str, int]:
        """All edits from a state on, and the state after the last row."""
        edits = []
        while node > 0:
            _, own, state = self.best[node][state]
            edits.append(own)
            node = self.after[node]
        _, own, state = self.best[0][state]
        return "".join(edits) + own, state


def continued(costs: tuple[int, ...]) -> tuple[tuple[int, str], ...]:
    """The ending of a signature that goes on elsewhere, from the costs to go there."""
    return tuple((x - min(costs), "") for x in costs)


def replay(signature: str, edits: str, state: int, roles: list[str], texts: list[str]) -> tuple[int, list[tuple[str, str]]]:
    """Cost of the edits, and the rows they give; roles and texts are those of rows not ``X``."""
    cost, at, kept, out = 0, 0, 0, []
    for edit in edits:
        if edit == "I":
            state = NEXT[state]
            cost += INSERT
            out.append((ROLE[state], ""))
            continue
        symbol = signature[at]
        at += 1
        if edit == "D":
            cost += DELETE
        else:
            cost += (REROLE if edit == "R" else 0) + (CUT_OFF if symbol.isupper() else 0)
            state = NEXT[state] if edit == "R" else _KEEPS[symbol.lower(), state]
            out.append((ROLE[state] if edit == "R" else roles[kept], texts[kept]))
        kept += symbol != "X"
    return cost, out
