"""Cheapest edits of a row sequence to a grammar of roles, by dynamic programming over runs.

A sequence may hold one system row at its start and then pairs of user and assistant, or nothing.
Rows are symbols: what their role allows and what their fault demands. A symbol's transition between
the four states of the grammar is a matrix over (min, +). Equal symbols in a row are one run, and the
matrix of a run is made of cached binary powers of the symbol's, so the costs to go at the borders of
runs are found in the logarithm of their lengths. Inside a run the choices are then unrolled.

Edits are written by their initials: Delete, Insert, Keep, Rerole. Of the cheapest edits the
ASCII-least string is taken. Every edit leads from a state to one state only, so the string says all.
"""

from __future__ import annotations

from itertools import groupby

NEVER = 1 << 60
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
ROLES = {"s": 0, "u": 1, "a": 2}
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: The state after a user or assistant row is put after each state.
NEXT = (USER, USER, ASSISTANT, USER)
#: The state after a row of each role is kept, by role and state before; none for the other roles.
KEPT = ((SYSTEM, None, None, None), (USER, USER, None, USER), (None, None, ASSISTANT, None),
        (None,) * 4)
_AT_ONCE = 32  # rows of a run whose costs to go are held together

Vector = tuple[int, int, int, int]
Run = tuple[int, int]


def symbol(role: str, gone: bool, truncated: bool) -> int:
    """0 for a row that has to go; else role (1, 3, 5, 7) and whether it is truncated (plus 1)."""
    return 0 if gone else 1 + 2 * ROLES.get(role[:1], 3) + truncated


def collapse(symbols: list[Run]) -> list[Run]:
    """Neighbouring runs of one symbol as one run."""
    return [(s, sum(n for _, n in own)) for s, own in groupby(symbols, key=lambda run: run[0])]


def _settle(costs: Vector) -> Vector:
    """Costs to go when rows may be put in first."""
    for _ in range(3):
        costs = tuple(min(costs[q], INSERT + costs[NEXT[q]]) for q in STATES)
    return costs


#: Costs to go where no row is left.
DONE: Vector = _settle((0, NEVER, NEVER, 0))


def _moves(of: int, q: int) -> list[tuple[str, int, int]]:
    """(initial, cost, next state) of what may be done with a row of this symbol, by initial."""
    found = [("D", DELETE, q)]
    if of:
        late = TRUNCATED * ((of - 1) % 2)
        kept = KEPT[(of - 1) // 2][q]
        if kept is not None:
            found.append(("K", late, kept))
        found.append(("R", REROLE + late, NEXT[q]))
    return found


_MOVES = [[_moves(of, q) for q in STATES] for of in range(9)]


def _multiply(a: tuple[Vector, ...], b: tuple[Vector, ...]) -> tuple[Vector, ...]:
    return tuple(tuple(min(min(a[i][k] + b[k][j] for k in STATES), NEVER) for j in STATES)
                 for i in STATES)


def _apply(a: tuple[Vector, ...], costs: Vector) -> Vector:
    return tuple(min(a[q][k] + costs[k] for k in STATES) for q in STATES)


def _before(of: int, costs: Vector) -> Vector:
    """Costs to go before a row from those after it."""
    return _settle(tuple(min(c + costs[to] for _, c, to in _MOVES[of][q]) for q in STATES))


def _unit(i: int) -> Vector:
    return tuple(0 if i == j else NEVER for j in STATES)


_IDENTITY = tuple(_unit(i) for i in STATES)
#: Per symbol the matrix of 1, 2, 4, ... rows; longer powers are added on first use.
_POWERS: list[list[tuple[Vector, ...]]] = [
    [tuple(zip(*(tuple(min(c, NEVER) for c in _before(of, _unit(j))) for j in STATES)))]
    for of in range(9)]


def _powers(of: int, rows: int) -> list[tuple[Vector, ...]]:
    """The matrices whose product is that of so many rows."""
    known = _POWERS[of]
    while rows >> len(known):
        known.append(_multiply(known[-1], known[-1]))
    return [known[bit] for bit in range(rows.bit_length()) if rows >> bit & 1]


def advance(run: Run, costs: Vector) -> Vector:
    """Costs to go before a run from those after it."""
    for matrix in _powers(*run):
        costs = _apply(matrix, costs)
    return costs


def transition(runs: list[Run]) -> tuple[Vector, ...]:
    """The matrix of a sequence of runs."""
    total = _IDENTITY
    for run in runs:
        for matrix in _powers(*run):
            total = _multiply(total, matrix)
    return total


def _unroll(run: Run, after: Vector, q: int, out: list[str]) -> int:
    """Append the edits of a run and return the state behind it."""
    of, rows = run
    if rows > _AT_ONCE:
        half = rows // 2
        middle = advance((of, rows - half), after)
        q = _unroll((of, half), middle, q, out)
        return _unroll((of, rows - half), after, q, out)
    costs = [after]
    for _ in range(rows):
        costs.append(_before(of, costs[-1]))
    for now, then in zip(costs[:0:-1], costs[-2::-1]):
        while True:
            moves = [m for m in _MOVES[of][q] if m[1] + then[m[2]] == now[q]]
            if INSERT + now[NEXT[q]] == now[q] and not (moves and moves[0][0] < "I"):
                out.append("I")
                q = NEXT[q]
                continue
            out.append(moves[0][0])
            q = moves[0][2]
            break
    return q


def cheapest_edits(runs: list[Run], after: Vector, q: int, end: bool) -> tuple[str, int]:
    """The edits of the runs from state ``q`` on, and the state behind them.

    ``after`` are the costs to go behind the runs; ``end`` says that no row follows.
    """
    borders = [after]
    for run in reversed(runs):
        borders.append(advance(run, borders[-1]))
    out: list[str] = []
    for run, then in zip(runs, borders[-2::-1]):
        q = _unroll(run, then, q, out)
    while end and DONE[q]:
        out.append("I")
        q = NEXT[q]
    return "".join(out), q
