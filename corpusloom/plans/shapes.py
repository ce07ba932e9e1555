"""What the code templates parse to, stated once by plain recursion, as table expressions for SQL twins.

A file's tree depends on its template alone but for the key in its names and constants, which SQL fills in.
"""

from __future__ import annotations

import ast
import difflib
import functools
import json
import math
import zlib
from collections import Counter

from .fixtures import SHAPES, TEMPLATES, quoted

#: Stands for the key in what is stated here.
KEY = "777777"
#: First and last line of each template's block; 0 for none.
LINES = ((0, 0), (1, 8), (1, 8), (0, 0), (0, 0), (1, 8), (1, 8), (6, 13))


def tree_of(template: int) -> ast.Module | None:
    return ast.parse(TEMPLATES[template].replace("{k}", KEY)) if SHAPES[template][0] else None


def names_of(node: ast.AST) -> list[str]:
    return [type(node).__name__, *(x for child in ast.iter_child_nodes(node) for x in names_of(child))]


def depth_of(node: ast.AST) -> int:
    return 1 + max(map(depth_of, ast.iter_child_nodes(node)), default=0)


def plain(value, kind: str, fields: str, lenient: bool):
    """A tree in dictionaries; lenient: bytes as text, else no JSON can hold them."""
    if isinstance(value, list):
        return [plain(x, kind, fields, lenient) for x in value]
    if isinstance(value, bytes) and lenient:
        return repr(value)
    if not isinstance(value, ast.AST):
        return value
    return {kind: type(value).__name__, fields: {f: plain(getattr(value, f, None), kind, fields, lenient) for f in value._fields if hasattr(value, f)}}


def json_of(node: ast.AST | None, kind: str = "_type", fields: str = "_fields", lenient: bool = False) -> str | None:
    try:
        return node and json.dumps(plain(node, kind, fields, lenient))
    except TypeError:
        return None


def level_order(tree: ast.AST, levels: int, most: int) -> list[ast.AST]:
    level, out = [tree], []
    for _ in range(levels):
        out += level
        level = [c for n in level for c in ast.iter_child_nodes(n)]
    return out[:most]


def block_of(template: int) -> tuple[str, ast.AST] | None:
    first, last = LINES[template]
    if not first:
        return None
    text = "\n".join(TEMPLATES[template].replace("{k}", KEY).split("\n")[first - 1:last])
    whole = tree_of(template)
    return text, whole if template == 6 else next(n for n in whole.body if n.lineno == first)


def literal(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, (int, float)) else quoted(x).replace("\n", "' || chr(10) || '")


def values(name: str, columns: str, rows: list[tuple]) -> str:
    return f"{name}({columns}) AS (VALUES " + ", ".join(f"({', '.join(map(literal, r))})" for r in rows) + ")"


TREES = [tree_of(i) for i in range(len(TEMPLATES))]
NAMES = [t and names_of(t) for t in TREES]


def filled(column: str) -> str:
    """A stated text with a file's key in place of KEY."""
    return f"replace({column}, '{KEY}', (id % 200)::VARCHAR)"


TREE_ROWS = values(
    "trees", "template, nodes, ast, alternative",
    [(i, names and " ".join(names), json_of(t), json_of(t, "node_type", "fields", True)) for i, (t, names) in enumerate(zip(TREES, NAMES))],
)
BLOCK_ROWS = values("blocks", "template, code, ast, depth", [(i, b[0], json_of(b[1]), depth_of(b[1])) for i in range(len(TEMPLATES)) if (b := block_of(i))])
#: Normalised blocks: the same, and the one function of the first template, which has too few lines otherwise.
NORMAL_ROWS = values(
    "blocks", "template, code, depth",
    [(0, TEMPLATES[0].replace("{k}", KEY).strip(), depth_of(TREES[0].body[0])), *((i, b[0], depth_of(b[1])) for i in range(len(TEMPLATES)) if (b := block_of(i)))],
)
SUBTREE_ROWS = values(
    "subtrees", "template, no, nodes",
    [(i, no, " ".join(names_of(n)[:150])) for i, t in enumerate(TREES) if t for no, n in enumerate(level_order(t, 10, 70))],
)
RATIO_ROWS = values(
    "ratios", "a, b, ratio",
    [(i, j, repr(difflib.SequenceMatcher(None, x, y).ratio() if x and y else 0.0)) for i, x in enumerate(NAMES) for j, y in enumerate(NAMES)],
)


def weights(names: list[str], width: int = 64) -> list[tuple[int, float]]:
    bag = Counter(zlib.crc32(x.encode()) % width for x in names)
    return [(at, round(n / math.sqrt(sum(x * x for x in bag.values())), 6)) for at, n in sorted(bag.items())]


def marks_of(node: ast.AST, depth: int) -> list[int]:
    """The marks of a node up to a depth, by recursion: of its type, then of its mark and its children's before."""
    below = [marks_of(c, depth - 1) for c in ast.iter_child_nodes(node)] if depth else []
    out = [zlib.crc32(type(node).__name__.encode())]
    for i in range(depth):
        out.append(zlib.crc32(f"{out[-1]}({','.join(str(b[i]) for b in below)})".encode()) if below else out[-1])
    return out


def structure(tree: ast.AST, width: int = 256, rounds: int = 3) -> list[tuple[int, float]]:
    """The parts of a tree's structure vector that are not zero."""
    marks = Counter(m for n in ast.walk(tree) for i, m in enumerate(marks_of(n, rounds)) if i == 0 or any(True for _ in ast.iter_child_nodes(n)))
    parts = [0.0] * width
    for mark, n in marks.items():
        parts[mark % width] += math.sqrt(n) if mark // width % 2 else -math.sqrt(n)
    norm = math.sqrt(sum(x * x for x in parts))
    return [(i, round(x / norm, 4) + 0.0) for i, x in enumerate(parts) if round(x / norm, 4)]


STRUCTURE_ROWS = values("structures", "template, bucket, weight", [(i, at, w) for i, t in enumerate(TREES) if t for at, w in structure(t)])


def labelled(node: ast.AST) -> tuple:
    """A tree of (label, subtrees) without contexts: types, and what constants, operators and called names tell."""
    told = (type(node).__name__,)
    if isinstance(node, ast.Constant):
        told += (type(node.value).__name__, str(node.value))
    elif isinstance(node, ast.Call) and isinstance(node.func, ast.Name):
        told += (node.func.id,)
    elif isinstance(node, ast.BinOp):
        told += (type(node.op).__name__,)
    elif isinstance(node, ast.Compare):
        told += tuple(type(x).__name__ for x in node.ops)
    return told, tuple(labelled(c) for c in ast.iter_child_nodes(node) if not isinstance(c, ast.expr_context))


def forest_distance(one: tuple, two: tuple, known: dict) -> int:
    """The edit distance of two forests, by the last tree of each."""
    if (one, two) not in known:
        drop = lambda f: f[:-1] + f[-1][1]
        if not one or not two:
            known[one, two] = 10 * sum(map(nodes_in, one + two))
        else:
            (a, below), (b, under) = one[-1], two[-1]
            change = 10 if a[0] != b[0] else sum(x != y for x, y in zip(a[1:], b[1:]))
            known[one, two] = min(
                forest_distance(drop(one), two, known) + 10, forest_distance(one, drop(two), known) + 10,
                forest_distance(one[:-1], two[:-1], known) + forest_distance(below, under, known) + change,
            )
    return known[one, two]


def nodes_in(tree: tuple) -> int:
    return 1 + sum(map(nodes_in, tree[1]))


@functools.cache
def distance_rows() -> str:
    """distance and cosine of each two templates, by whether their keys are alike or the 0 that a template has as constant."""
    keys = {(False, False, True): (5, 5), (False, False, False): (5, 6), (True, True, True): (0, 0), (True, False, False): (0, 5), (False, True, False): (5, 0)}
    held = [i for i, names in enumerate(NAMES) if names]
    trees = {(i, key): (labelled(ast.parse(TEMPLATES[i].replace("{k}", str(key)))),) for i in held for key in (0, 5, 6)}
    bags = {i: Counter(zlib.crc32(x.encode()) % 64 for x in NAMES[i]) for i in held}
    cosine = lambda x, y: sum(n * y[at] for at, n in x.items()) / math.sqrt(sum(n * n for n in x.values()) * sum(n * n for n in y.values()))
    rows, known = [], {}
    for i in held:
        for j in held:
            for (left, right, same), (a, b) in keys.items():
                rows.append((i, j, left, right, same, forest_distance(trees[i, a], trees[j, b], known), repr(round(cosine(bags[i], bags[j]), 9))))
    return "distances(a, b, left_zero, right_zero, same, distance, cosine) AS (VALUES " + ", ".join(f"({', '.join(map(str, r))})" for r in rows) + ")"


BAG_ROWS = values("bags", "template, bucket, weight", [(i, at, w) for i, names in enumerate(NAMES) if names for at, w in weights(names)])
#: node_type and node_id: numbered from 1 in order of first appearance over files by id.
VOCABULARY = """seen AS (SELECT id, unnest(string_split(nodes, ' ')) AS node_type, generate_subscripts(string_split(nodes, ' '), 1) AS pos FROM code_files JOIN trees USING (template) WHERE nodes IS NOT NULL),
first AS (SELECT node_type, min((id, pos)) AS first FROM seen GROUP BY node_type),
vocabulary AS (SELECT node_type, row_number() OVER (ORDER BY first)::INTEGER AS node_id FROM first)"""
