"""Line differences of two texts by Myers' algorithm (1986), in linear space."""

from __future__ import annotations


def middle_snake(x: list[str], y: list[str], most_edits: int) -> tuple[int, int, int, int, int] | None:
    """(edits, x0, y0, x1, y1): the least number of edits and a run of equal lines in the middle of a shortest script.

    Two searches, from both ends, meet half-way; each keeps the furthest point on every diagonal alone.
    """
    n, m = len(x), len(y)
    delta, odd = n - m, (n - m) % 2 == 1
    forward, backward = {1: 0}, {1: 0}
    for d in range((n + m + 1) // 2 + 1):
        if 2 * d - 1 > most_edits:
            return None
        for k in range(-d, d + 1, 2):
            i = forward[k + 1] if k == -d or (k != d and forward[k - 1] < forward[k + 1]) else forward[k - 1] + 1
            a = i
            while i < n and i - k < m and x[i] == y[i - k]:
                i += 1
            forward[k] = i
            if odd and -d < delta - k < d and i + backward[delta - k] >= n:
                return (2 * d - 1, a, a - k, i, i - k)
        for k in range(-d, d + 1, 2):
            i = backward[k + 1] if k == -d or (k != d and backward[k - 1] < backward[k + 1]) else backward[k - 1] + 1
            a = i
            while i < n and i - k < m and x[n - 1 - i] == y[m - 1 - i + k]:
                i += 1
            backward[k] = i
            if not odd and -d <= delta - k <= d and i + forward[delta - k] >= n:
                return (2 * d, n - i, m - i + k, n - a, m - a + k) if 2 * d <= most_edits else None
    return None


def matching_lines(a: list[str], b: list[str], most_edits: int = 100_000) -> list[tuple[int, int]] | None:
    """1-based pairs of lines that a shortest edit script keeps; None beyond ``most_edits``."""
    pairs, todo, whole = [], [(0, len(a), 0, len(b))], True
    while todo:
        lo, hi, low, high = todo.pop()
        while lo < hi and low < high and a[lo] == b[low]:
            pairs.append((lo + 1, low + 1))
            lo, low = lo + 1, low + 1
        while lo < hi and low < high and a[hi - 1] == b[high - 1]:
            hi, high = hi - 1, high - 1
            pairs.append((hi + 1, high + 1))
        if lo == hi or low == high:
            if whole and hi - lo + high - low > most_edits:
                return None
            whole = False
            continue
        found = middle_snake(a[lo:hi], b[low:high], most_edits if whole else len(a) + len(b))
        if found is None:
            return None
        whole = False
        _, x0, y0, x1, y1 = found
        pairs += [(lo + x0 + i + 1, low + y0 + i + 1) for i in range(x1 - x0)]
        todo += [(lo, lo + x0, low, low + y0), (lo + x1, hi, low + y1, high)]
    return sorted(pairs)
