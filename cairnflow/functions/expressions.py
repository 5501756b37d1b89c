"""Mathematical expressions of untrusted text as trees: numbers, names, operators and a list of functions, and nothing else.

Python's own parser reads the text, but nothing is evaluated; what isn't on the list is refused,
and so is what would grow out of bounds: long texts, deep trees, large numbers and powers.
"""

from __future__ import annotations

import ast
import re

#: (kind, …): ("number", text), ("name", text), ("call", function, tree), (operator, tree, tree).
Tree = tuple

LONGEST, DEEPEST, NODES = 500, 40, 200
#: Digits of a number, and the largest exponent.
DIGITS, EXPONENT = 40, 64
OPERATORS = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.Pow: "**"}
FUNCTIONS = {"sqrt", "exp", "log", "ln", "sin", "cos", "tan", "asin", "acos", "atan", "sinh", "cosh", "tanh", "Abs"}
CONSTANTS = {"pi", "E", "I"}
NUMBER = re.compile(r"\d+(\.\d*)?|\.\d+")
NAME = re.compile(r"[A-Za-z][A-Za-z0-9_]{0,19}")


def tree(text: str) -> Tree | None:
    """The tree of an expression; None for anything else."""
    if len(text) > LONGEST:
        return None
    try:
        top = ast.parse(text.strip(), mode="eval").body
        if sum(1 for _ in ast.walk(top)) > 3 * NODES:
            return None
        return read(top, text.strip(), DEEPEST)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def read(node: ast.AST, text: str, depth: int) -> Tree:
    """ValueError for what isn't on the list."""
    if depth == 0:
        raise ValueError("too deep")
    if isinstance(node, ast.Constant):
        said = ast.get_source_segment(text, node) or ""
        if not NUMBER.fullmatch(said) or len(said) > DIGITS:
            raise ValueError(said)
        return "number", said
    if isinstance(node, ast.Name) and NAME.fullmatch(node.id):
        return "name", node.id
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
        inner = read(node.operand, text, depth - 1)
        return ("*", ("number", "-1"), inner) if isinstance(node.op, ast.USub) else inner
    if isinstance(node, ast.BinOp) and type(node.op) in OPERATORS:
        left, right = read(node.left, text, depth - 1), read(node.right, text, depth - 1)
        if isinstance(node.op, ast.Pow) and not small(right):
            raise ValueError("the power is too large")
        return OPERATORS[type(node.op)], left, right
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in FUNCTIONS and len(node.args) == 1 and not node.keywords:
        return "call", node.func.id, read(node.args[0], text, depth - 1)
    raise ValueError(ast.dump(node)[:100])


def small(power: Tree) -> bool:
    """Whether an exponent is a small number, a name, or a fraction or negative of such: never itself a power."""
    if power[0] == "number":
        return abs(float(power[1])) <= EXPONENT
    return power[0] == "name" or power[0] in "*/" and all(small(p) for p in power[1:])


def symbolic(t: Tree):
    """SymPy's expression of a tree."""
    import sympy

    if t[0] == "number":
        return sympy.Rational(t[1]) if "." not in t[1] else sympy.Float(t[1])
    if t[0] == "name":
        return getattr(sympy, t[1]) if t[1] in CONSTANTS else sympy.Symbol(t[1])
    if t[0] == "call":
        return getattr(sympy, t[1])(symbolic(t[2]))
    a, b = symbolic(t[1]), symbolic(t[2])
    return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "**": lambda: a**b}[t[0]]()


def equal(a: str, b: str) -> bool:
    """Whether the difference of two expressions simplifies to zero; false where one can't be read, or without SymPy."""
    left, right = tree(a), tree(b)
    if left is None or right is None:
        return False
    if left == right:
        return True
    try:
        import sympy
    except ImportError:
        return False
    try:
        return bool(sympy.simplify(symbolic(left) - symbolic(right)) == 0)
    except Exception:  # noqa: BLE001  what can't be simplified is not the same
        return False
