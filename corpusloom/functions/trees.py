"""Edit distance of ordered labelled trees: exact, with bounds that decide most comparisons before it.

Adding or dropping a node, and changing its type, costs CHANGE; nodes of one type cost one for each detail that differs.
The distance is Zhang and Shasha's recursion over pairs of key roots.  All key roots of one tree are advanced together, as
rows of numbers laid end to end, so that a row of the other tree costs a few array operations; roots within others come
first where a row needs their results.  The trees may be read from the left or, mirrored, from the right, and either may
give the rows: whichever makes the tables smallest.
"""

from __future__ import annotations

from collections import Counter
from functools import cached_property

import numpy as np

CHANGE = 10
#: The most that a label can cost.
MOST = 255
#: Pairs of nodes of trees whose distances are kept.
FEW = 40_000
Label = tuple[str, ...]
#: Pairs of trees whose distances are kept.
PAIRS = 500_000


def label_cost(a: Label, b: Label) -> int:
    """CHANGE between types, else one for each detail that differs."""
    return CHANGE if a[0] != b[0] else min(MOST, sum(map(str.__ne__, a[1:], b[1:])))


class Order:
    """A tree's nodes in postorder, read from one side: labels, first leaf below each node, and key roots."""

    def __init__(self, labels: list[Label], left: list[int]):
        self.labels, self.left = labels, np.array(left, np.int64)
        self.roots = np.array(sorted({leaf: i for i, leaf in enumerate(left)}.values()), np.int64)
        self.rows = int((self.roots - self.left[self.roots] + 1).sum())

    @cached_property
    def segments(self) -> tuple:
        """The key roots' subtrees laid end to end, those within others first: for each place its node, the place where its
        own subtree begins, whether it is on the path from the root to its first leaf; then the root, start and end of each
        segment, and the ends of the levels."""
        levels = np.zeros(len(self.roots), np.int64)
        for i, root in enumerate(self.roots):  # a root's subtree ends with it
            levels[i] = np.count_nonzero((self.roots > root) & (self.left[self.roots] <= root))
        order = np.lexsort((self.roots, -levels))
        nodes, inner, path, starts, ends, at = [], [], [], [], [], 0
        for root in self.roots[order]:
            own = np.arange(self.left[root], root + 1)
            nodes.append(np.concatenate([[-1], own]))
            inner.append(np.concatenate([[at], at + self.left[own] - own[0]]))
            path.append(np.concatenate([[False], self.left[own] == own[0]]))
            starts.append(at)
            at += len(own) + 1
            ends.append(at)
        cuts = [ends[i] for i in range(len(order)) if i + 1 == len(order) or levels[order[i]] != levels[order[i + 1]]]
        return np.concatenate(nodes), np.concatenate(inner), np.concatenate(path), np.array(starts), np.array(ends), cuts


class Tree:
    """What comparisons need of a tree: nodes as (label, numbers of the children) in preorder.  Those of a process are numbered."""

    made = 0

    def __init__(self, nodes: list[tuple[Label, list[int]]]):
        Tree.made += 1
        self.nodes, self.size, self.no = nodes, len(nodes), Tree.made
        self.types, self.labels = Counter(label[0] for label, _ in nodes), Counter(label for label, _ in nodes)

    @cached_property
    def orders(self) -> tuple[Order, Order]:
        return self.read(False), self.read(True)

    def read(self, mirrored: bool) -> Order:
        labels, left, stack = [], [], [(0, None)]
        while stack:
            node, first = stack.pop()
            label, children = self.nodes[node]
            if first is None:
                stack.append((node, len(labels)))
                stack += [(c, None) for c in (children if mirrored else reversed(children))]
            else:
                labels.append(label)
                left.append(first)
        return Order(labels, left)

    @cached_property
    def type_sequences(self) -> tuple[list[str], list[str]]:
        return [label[0] for label, _ in self.nodes], [label[0] for label in self.orders[0].labels]


def sequence_distance(one: list[str], two: list[str]) -> int:
    """Number of additions, drops and changes between two sequences, a whole column of the table held in one number."""
    if not one or not two:
        return max(len(one), len(two))
    at: dict[str, int] = {}
    for i, x in enumerate(one):
        at[x] = at.get(x, 0) | 1 << i
    every, last = (1 << len(one)) - 1, 1 << len(one) - 1
    rises, falls, score = every, 0, len(one)
    for x in two:
        same = at.get(x, 0)
        along = (((same & rises) + rises) ^ rises) | same | falls
        up, down = falls | ~(along | rises) & every, rises & along
        score += bool(up & last) - bool(down & last)
        up, down = (up << 1 | 1) & every, down << 1 & every
        rises, falls = down | ~(along | falls | up) & every, up & (along | falls)
        along = None
    return score


def quick_bound(a: Tree, b: Tree) -> int:
    """A lower bound of the distance by the numbers of nodes of each type and label."""
    types, labels = (sum((x & y).values()) for x, y in ((a.types, b.types), (a.labels, b.labels)))
    return CHANGE * (max(a.size, b.size) - types) + types - labels


def lower_bound(a: Tree, b: Tree) -> int:
    """A lower bound by the types in preorder and in postorder, besides the quick one: each costly edit is one of a sequence."""
    return max(quick_bound(a, b), *(CHANGE * sequence_distance(x, y) for x, y in zip(a.type_sequences, b.type_sequences)))


def cost_table(one: list[Label], two: list[Label]) -> np.ndarray:
    rows, columns = {}, {}
    at = [rows.setdefault(x, len(rows)) for x in one], [columns.setdefault(x, len(columns)) for x in two]
    table = np.array([[label_cost(x, y) for y in columns] for x in rows], np.uint8)
    return table[np.ix_(*at)]


class Known(dict):
    """Distances of pairs of shapes and costs met before, emptied when their keys hold too many bytes; and those of pairs of
    trees by their numbers, emptied when they are too many."""

    def __init__(self, most: int = 64 << 20):
        super().__init__()
        self.most, self.held, self.pairs = most, 0, {}

    def __setitem__(self, key: tuple[bytes, ...], value: int) -> None:
        if self.held > self.most:
            self.clear()
            self.held = 0
        self.held += sum(map(len, key))
        super().__setitem__(key, value)


def distance(a: Tree, b: Tree, limit: int | None = None, known: Known | None = None) -> int | None:
    """The edit distance; None if it is found to exceed the limit.  known: keeps what is found, for pairs that differ in
    labels alone and have the same costs between them."""
    if known is not None and (a.no, b.no) in known.pairs:
        found = known.pairs[a.no, b.no]
        return None if limit is not None and found > limit else found
    if limit is not None and quick_bound(a, b) > limit:
        return None
    if known is not None and a.size * b.size <= FEW:
        key = (a.orders[0].left.tobytes(), b.orders[0].left.tobytes(), cost_table(a.orders[0].labels, b.orders[0].labels).tobytes())
        if key not in known:
            known[key] = distance(a, b)
        if len(known.pairs) >= PAIRS:
            known.pairs.clear()
        known.pairs[a.no, b.no] = known[key]
        return None if limit is not None and known[key] > limit else known[key]
    pairs = [(x.orders[side], y.orders[side]) for side in (0, 1) for x, y in ((a, b), (b, a))]
    one, two = min(pairs, key=lambda p: p[0].rows * (p[1].rows + 500 * len(p[1].segments[5])))  # a level costs as much as some numbers
    costs = cost_table(one.labels, two.labels)
    return advanced(one, two, costs, limit)


def advanced(one: Order, two: Order, costs: np.ndarray, limit: int | None) -> int | None:
    nodes, inner, path, starts, ends, cuts = two.segments
    n, m = len(one.labels), len(two.labels)
    places = np.arange(len(nodes))
    within = places - np.repeat(starts, ends - starts)
    # a prefix minimum of row - shift is one of each segment alone, and adds CHANGE a place
    shift = CHANGE * within + np.repeat(np.arange(len(starts)), ends - starts) * (2 * CHANGE * (n + m + 2))
    inside = nodes >= 0
    known = np.zeros((n, m + 1), np.int64)  # distances of subtrees; the last column stands for no node
    final = slice(int(starts[-1]), int(ends[-1]))
    left = m - 1 - nodes[final]
    slices = [slice(a, b) for a, b in zip([0, *cuts[:-1]], cuts)]
    own = [(s, inside[s] & path[s], np.flatnonzero(inside[s] & path[s])) for s in slices]
    first_row = CHANGE * within
    for i in one.roots.tolist():
        start = int(one.left[i])
        last_use = {int(one.left[x]) - start: x for x in range(start, i + 1)}
        rows, above = {0: first_row}, first_row
        for x in range(start, i + 1):
            below = int(one.left[x]) - start
            row = above + CHANGE
            if below:
                step = rows[below][inner] + known[x][nodes]
                np.minimum(row, step, out=row, where=inside)
                row = np.minimum.accumulate(row - shift) + shift
            else:
                changed = np.empty_like(row)
                changed[0] = 0
                changed[1:] = above[:-1]
                changed += costs[x][nodes]
                for s, on_path, at in own:
                    part = row[s]
                    step = np.where(on_path, changed[s], first_row[inner[s]] + known[x][nodes[s]])
                    np.minimum(part, step, out=part, where=inside[s])
                    part = np.minimum.accumulate(part - shift[s]) + shift[s]
                    row[s] = part
                    known[x][nodes[s][at]] = part[at]
            if last_use.get(below) == x and below:
                rows.pop(below, None)
            if x + 1 - start in last_use:
                rows[x + 1 - start] = row
            above = row
            if limit is not None and i == n - 1 and int((row[final] + CHANGE * np.abs(n - 1 - x - left)).min()) > limit:
                return None
    found = int(known[n - 1, m - 1])
    return None if limit is not None and found > limit else found


def similarity(found: int, size: int) -> float:
    """1 - distance / (CHANGE * size of the larger tree), 0 at least."""
    return max(0.0, 1 - found / (CHANGE * size))


def farthest(least: float, size: int) -> int | None:
    """The largest distance with at least this similarity; None if there is none, as 0 is the least of all."""
    return int((1 - least) * CHANGE * size + 1e-6) if least > 0 else None


def most_similar(query: tuple[Tree, int], others: list[tuple[Tree, int]], k: int, known: Known | None = None) -> tuple[list[tuple[int, float]], int]:
    """(place, similarity) of the k trees most similar to a query, ties to the earlier place, and how many distances were
    begun; a tree comes with the size that its similarity is measured by.

    Trees are taken in order of the best similarity that their bounds allow, first by quick bounds, and left out once k
    others are better than that; a distance is given up where it cannot be among the k."""
    tree, size = query
    most = lambda bound, i: similarity(bound, max(size, others[i][1]))
    best: list[tuple[float, int]] = []  # -similarity, place
    begun = 0
    for above, i in sorted((-most(quick_bound(tree, t), i), i) for i, (t, _) in enumerate(others)):
        limit = None
        if len(best) == k:
            if (above, i) > best[-1] and above > best[-1][0]:
                break
            if (above, i) > best[-1] or (-most(lower_bound(tree, others[i][0]), i), i) > best[-1]:
                continue
            limit = farthest(-best[-1][0], max(size, others[i][1]))
        begun += 1
        found = distance(tree, others[i][0], limit, known)
        if found is not None:
            best = sorted([*best, (-most(found, i), i)])[:k]
    return [(i, -s) for s, i in best], begun


def rank_among(query: tuple[Tree, int], others: list[tuple[Tree, int]], place: int, known: Known | None = None) -> tuple[int, int]:
    """The rank, from 1, of the tree at a place among all by similarity to a query, ties to the earlier place, and how many
    distances were begun: only its own, and of those whose bounds allow a better place."""
    tree, size = query
    own = similarity(distance(tree, others[place][0], None, known), max(size, others[place][1]))
    rank = begun = 1
    for i, (other, more) in enumerate(others):
        if i == place:
            continue
        larger = max(size, more)
        ahead = lambda s: s > own or s == own and i < place  # noqa: E731, B023
        if ahead(similarity(quick_bound(tree, other), larger)) and ahead(similarity(lower_bound(tree, other), larger)):
            begun += 1
            found = distance(tree, other, farthest(own, larger), known)
            rank += found is not None and ahead(similarity(found, larger))
    return rank, begun
