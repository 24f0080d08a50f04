"""Folds as a user writes them, for the registered queries."""

from __future__ import annotations

from millrace.operators.folds import Fold


def _add(state, value):
    return state if value is None else (state[0] + value, state[1] + 1)


AVERAGE = Fold(
    init=lambda: (0.0, 0),
    fold=_add,
    merge=lambda a, b: (a[0] + b[0], a[1] + b[1]),
    finish=lambda s: (s[0] / s[1] if s[1] else None, s[1]),
)

COUNT = Fold(init=int, fold=lambda s, _: s + 1, merge=lambda a, b: a + b, finish=lambda s: (s,))


def _longer(a, b):
    """The longer word, of two equally long ones the smaller."""
    if a is None or b is None:
        return b if a is None else a
    return min(a, b, key=lambda w: (-len(w), w))


LONGEST_WORD = Fold(
    init=lambda: None, fold=_longer, merge=_longer, finish=lambda s: (s, None if s is None else len(s))
)


def _with(state, value):
    if value is not None:
        state.add(value)
    return state


def _union(a, b):
    a |= b
    return a


DISTINCT = Fold(init=set, fold=_with, merge=_union, finish=lambda s: (len(s),))
