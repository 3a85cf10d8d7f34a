"""Line-by-line differences: a longest common subsequence by matching pairs, and side-by-side edits."""

from __future__ import annotations

from bisect import bisect_left


def common(left: list, right: list) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence; equal ends are matched first."""
    n = min(len(left), len(right))
    head = next((k for k in range(n) if left[k] != right[k]), n)
    tail = next((k for k in range(n - head) if left[-1 - k] != right[-1 - k]), n - head)
    where: dict = {}
    for j in range(len(right) - tail - 1, head - 1, -1):
        where.setdefault(right[j], []).append(j)  # later positions first
    ends: list[int] = []  # smallest right end of a common run of each length
    chains: list[tuple] = []
    for i in range(head, len(left) - tail):
        for j in where.get(left[i], ()):
            k = bisect_left(ends, j)
            if k < len(ends) and ends[k] == j:
                continue
            chain = (i, j, chains[k - 1] if k else None)
            ends[k : k + 1] = [j]
            chains[k : k + 1] = [chain]
    middle, at = [], chains[-1] if chains else None
    while at:
        middle.append(at[:2])
        at = at[2]
    a, b = len(left) - tail, len(right) - tail
    return [(k, k) for k in range(head)] + middle[::-1] + [(a + k, b + k) for k in range(tail)]


def sdiff(left: list[str], right: list[str]) -> list[tuple[str, str | None, str | None]]:
    """Rows (same, modified, removed or added; left line; right line). Between matches lines pair up, the rest spills."""
    out, i, j = [], 0, 0
    for a, b in [*common(left, right), (len(left), len(right))]:
        gone, new = left[i:a], right[j:b]
        both = min(len(gone), len(new))
        out += [("modified", x, y) for x, y in zip(gone, new)]
        out += [("removed", x, None) for x in gone[both:]] + [("added", None, y) for y in new[both:]]
        if a < len(left):
            out.append(("same", left[a], right[b]))
        i, j = a + 1, b + 1
    return out


def delta(left: list[str], right: list[str]) -> tuple[int, int, int, int]:
    """(same, modified, added, removed) lines."""
    kinds = [k for k, _, _ in sdiff(left, right)]
    return tuple(kinds.count(k) for k in ("same", "modified", "added", "removed"))


def code_flags(solid: list[str], stripped: list[str]) -> list[bool]:
    """Of each line of solid: whether it survives in stripped (changed counts as survived)."""
    return [k != "removed" for k, x, _ in sdiff(solid, stripped) if x is not None]
