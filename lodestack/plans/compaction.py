"""Which two components to merge: sizes are kept at Fibonacci numbers."""

from __future__ import annotations


def _fibonacci_up_to(n: int) -> set[int]:
    out, a, b = set(), 1, 2
    while a <= n:
        out.add(a)
        a, b = b, a + b
    return out


def _next_fibonacci(n: int) -> int:
    a, b = 1, 2
    while a <= n:
        a, b = b, a + b
    return a


def choose(components: list[tuple[int, str]]) -> tuple[tuple[int, str], tuple[int, str]] | None:
    """The pair of components (size, path) to merge next, or None.

    While some size is no Fibonacci number, the greatest of these is worked on: what it lacks to the next one is filled
    by a component of just that size; else the neighbours by size (without it) of the greatest sum within that gap are
    merged, the last of equals. Of nothing but Fibonacci sizes, the neighbours whose sum is the greatest Fibonacci number
    are, the first of equals.
    """
    rows = sorted(components)
    fib = _fibonacci_up_to(2 * max((n for n, _ in rows), default=0))
    odd = [c for c in rows if c[0] not in fib]
    if not odd:
        sums = [(a[0] + b[0], -i) for i, (a, b) in enumerate(zip(rows, rows[1:])) if a[0] + b[0] in fib]
        if not sums:
            return None
        i = -max(sums)[1]
        return rows[i], rows[i + 1]
    big = odd[-1]
    rest = [c for c in rows if c is not big]
    gap = _next_fibonacci(big[0]) - big[0]
    filler = next((c for c in rest if c[0] == gap), None)
    if filler:
        return filler, big
    sums = [(a[0] + b[0], i) for i, (a, b) in enumerate(zip(rest, rest[1:])) if a[0] + b[0] <= gap]
    if not sums:
        return None
    i = max(sums)[1]
    return rest[i], rest[i + 1]
