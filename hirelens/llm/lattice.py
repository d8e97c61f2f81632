"""The edit lattice of a conversation: bidirectional Dijkstra for the cheapest edits that make its roles alternate.

A node is (steps done, state of the roles written so far). States: 0 nothing, 1 a system
turn, 2 a user turn is open, 3 closed by an assistant. Roles are legal if they end in 0 or 3.
"""

from __future__ import annotations

from functools import lru_cache
from heapq import heappop, heappush

STATES = range(4)
#: Costs of the edits, and what an undeleted truncated row adds.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
LEGAL_ENDS = (0, 3)
#: The state after a user or an assistant turn is written.
AFTER = {("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3, ("s", 0): 1}
#: Turns without a row: a user turn where one may begin, an assistant turn where one is open.
STILL = tuple((q, AFTER[turn, q], INSERT, "I") for q in STATES for turn in "ua" if (turn, q) in AFTER)
Edge = tuple[int, int, int, str]


def row_edges(initial: str, truncated: bool) -> tuple[Edge, ...]:
    """(from, to, cost, letters) of a row that may stay."""
    more = TRUNCATED if truncated else 0
    kept = [(q, AFTER[initial, q], KEEP + more, "K") for q in STATES if (initial, q) in AFTER]
    told = [(q, AFTER[turn, q], REROLE + more, "R") for q in STATES for turn in "ua" if (turn, q) in AFTER]
    return tuple(kept + told + [(q, q, DELETE, "D") for q in STATES])


def deleted_edges(times: int) -> tuple[Edge, ...]:
    """Edges of rows that have to go. An insertion between them is never ASCII-less than one after them."""
    return tuple((q, q, DELETE * times, "D" * times) for q in STATES)


def cheapest(steps: tuple[tuple[Edge, ...], ...], start: int, ends: tuple[int, ...], still: tuple[Edge, ...] = ()) -> tuple[int, str] | None:
    """(cost, letters) of the cheapest way from (0, start) to (len(steps), one of ends), the ASCII-least of equal cost; None if there is none.

    Heaps are ordered by cost, then steps done, then letters. Of two ways of equal cost to one
    node none begins with the other (what one has more would be insertions, which cost), so the
    lesser way stays the lesser one whatever follows, and each node is settled once. The heaps
    have met when the sum of their least costs exceeds the best crossing; up to there all
    crossings of equal cost are seen, and the least joint string is taken.
    """
    n = len(steps)
    out = [[[] for _ in STATES] for _ in range(n + 1)]
    into = [[[] for _ in STATES] for _ in range(n + 1)]
    for i in range(n + 1):
        for a, b, cost, letters in still:
            out[i][a].append((i, b, cost, letters))
            into[i][b].append((i, a, cost, letters))
        if i < n:
            for a, b, cost, letters in steps[i]:
                out[i][a].append((i + 1, b, cost, letters))
                into[i + 1][b].append((i, a, cost, letters))
    ahead, back = {(0, start): (0, "")}, {(n, q): (0, "") for q in ends}
    heaps = ([(0, 0, "", start)], [(0, 0, "", q) for q in sorted(ends)])
    best = min((back[key] for key in ahead if key in back), default=None)
    done = (set(), set())
    while heaps[0] and heaps[1] and (best is None or heaps[0][0][0] + heaps[1][0][0] <= best[0]):
        side = 0 if heaps[0][0][0] <= heaps[1][0][0] else 1
        cost, far, letters, q = heappop(heaps[side])
        i = n - far if side else far
        if (i, q) in done[side]:
            continue
        done[side].add((i, q))
        mine, other = (back, ahead) if side else (ahead, back)
        for j, p, more, edge in (into if side else out)[i][q]:
            label = (cost + more, edge + letters if side else letters + edge)
            if (j, p) in other:
                there = other[j, p]
                joint = (label[0] + there[0], there[1] + label[1] if side else label[1] + there[1])
                best = joint if best is None or joint < best else best
            if (j, p) not in mine or label < mine[j, p]:
                mine[j, p] = label
                heappush(heaps[side], (label[0], n - j if side else j, label[1], p))
    return best


@lru_cache(1 << 14)
def _leaf(code: tuple, start: int, ends: tuple[int, ...]) -> tuple[int, str] | None:
    steps = tuple(deleted_edges(step) if isinstance(step, int) else row_edges(*step) for step in code)
    return cheapest(steps, start, ends, STILL)


def solve(code: tuple) -> tuple[int, str]:
    """The cheapest edits of a whole conversation: a step is the number of rows that have to go, or (initial, truncated)."""
    return _leaf(code, 0, LEGAL_ENDS)


def matrix(code: tuple) -> list[Edge]:
    """The cheapest edits of a stretch of a conversation between any two states."""
    found = ((a, b, _leaf(code, a, (b,))) for a in STATES for b in STATES)
    return [(a, b, *way) for a, b, way in found if way]


def compose(parts: list[list[Edge]]) -> list[Edge]:
    """The matrix of stretches that follow each other; each may insert at its borders."""
    steps = tuple(tuple(part) for part in parts)
    found = ((a, b, cheapest(steps, a, (b,))) for a in STATES for b in STATES)
    return [(a, b, *way) for a, b, way in found if way]


def write(letters: str, state: int, rows) -> list[tuple[str, str]]:
    """The (role, text) turns that the edits make of (role, text, times) rows, where a null role stands for rows that have to go."""
    def singles():
        for role, text, times in rows:
            for i in range(times):
                yield (role, text) if i == 0 else (None, None)

    turns, row = [], singles()
    for letter in letters:
        if letter == "D":
            next(row)
            continue
        role, text = next(row) if letter != "I" else (None, "")
        if letter != "K":
            role = "assistant" if state == 2 else "user"
        state = AFTER[role[:1], state]
        turns.append((role, text))
    return turns
