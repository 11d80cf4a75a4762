"""The cheapest repair of a conversation by iterative-deepening A*.

A conversation is one byte a row: the kind of its role (``KINDS``), plus ``MUST_GO`` for a blank or
repeated row and ``CUT`` for a truncated one. Edits are tried in the order of their letters (D, I, K, R) in a
depth-first search under a cost bound; what costs more than the bound by its lower estimate
is put off, and the least such cost is the next bound. States that failed are kept with the least
cost they failed at and are not searched again at that cost or more. No bound passes over the least cost, so
the first path accepted is the cheapest one with the least letters.

The estimate is what it costs to make users and assistants alternate from there on, wherever
that begins and ends: it knows which rows must go and what each edit costs, and leaves out that a repaired
conversation must open with a system or user and close with an assistant. It misses by what the two ends
cost, so the bounds are few and the time follows the number of rows.
"""

from __future__ import annotations

KINDS = "suax"
MUST_GO, CUT = 4, 8

#: The roles written so far: none, system, ... user, ... assistant.
NONE, SYSTEM, USER, ASSISTANT = range(4)
#: The state after one more user or assistant, whichever may follow.
NEXT = (USER, USER, ASSISTANT, USER)
#: The state after keeping a row of kind s, u, a or x; None where it may not follow.
KEEP = (
    (SYSTEM, USER, None, None),
    (None, USER, None, None),
    (None, None, ASSISTANT, None),
    (None, USER, None, None),
)
NAMES = {USER: "user", ASSISTANT: "assistant"}


def kind_of(role: str) -> int:
    """The place of a role's first character in KINDS."""
    return max(0, KINDS.find(role[0])) if role and role[0] in KINDS else 3


def estimates(codes: bytes) -> list[list[int]]:
    """For each state the estimates from every row on, the end included."""
    n = len(codes)
    none, user, assistant = [0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        code = codes[i]
        if code & MUST_GO:
            user[i], assistant[i], none[i] = user[i + 1] + 3, assistant[i + 1] + 3, none[i + 1] + 3
            continue
        kind, cut = KINDS[code & 3], 1 if code & CUT else 0
        to_user, to_assistant = user[i + 1] + cut, assistant[i + 1] + cut
        after_user = min(3 + user[i + 1], to_assistant + (0 if kind == "a" else 2))
        after_assistant = min(3 + assistant[i + 1], to_user + (0 if kind == "u" else 2))
        user[i], assistant[i] = min(after_user, after_assistant + 2), min(after_assistant, after_user + 2)
        none[i] = min(user[i], assistant[i], 3 + none[i + 1])
        if kind == "s":
            none[i] = min(none[i], to_assistant)
    return [none, assistant, user, assistant]


def cheapest_repair(codes: bytes) -> tuple[int, str]:
    """(cost, edit letters) of the cheapest repair; of equal costs the ASCII-least letters."""
    n = len(codes)
    ahead = estimates(codes)
    bound = ahead[NONE][0]
    while True:
        least_over = None
        failed: dict[int, int] = {}
        # A frame is [row, state, cost, edits tried so far]; letters[k] led to frame k + 1.
        frames, letters = [[0, NONE, 0, 0]], []
        while frames:
            frame = frames[-1]
            i, state, cost, tried = frame
            if i == n and tried == 0 and state in (NONE, ASSISTANT):
                return cost, "".join(letters)
            frame[3] += 1
            if tried == 4:
                failed[4 * i + state] = cost
                frames.pop()
                if letters:
                    letters.pop()
                continue
            code = codes[i] if i < n else MUST_GO
            if tried == 0:
                if i == n:
                    continue
                letter, to, after, price = "D", i + 1, state, 3
            elif tried == 1:
                letter, to, after, price = "I", i, NEXT[state], 2
            elif code & MUST_GO:
                continue
            elif tried == 2:
                letter, to, after, price = "K", i + 1, KEEP[state][code & 3], bool(code & CUT)
                if after is None:
                    continue
            else:
                letter, to, after, price = "R", i + 1, NEXT[state], 2 + bool(code & CUT)
                if KEEP[state][code & 3] == after:
                    continue
            total = cost + price
            over = total + ahead[after][to]
            if over > bound:
                least_over = over if least_over is None else min(least_over, over)
            elif total < failed.get(4 * to + after, total + 1):
                frames.append([to, after, total, 0])
                letters.append(letter)
        bound = least_over
