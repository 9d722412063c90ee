"""No module defines a function, class or test twice: the later one would silently take the earlier one's place."""

import ast
from collections import Counter
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
FILES = [*ROOT.glob("odolith/**/*.py"), *ROOT.glob("tests/**/*.py"), *ROOT.glob("*.py")]


def scopes(tree):
    yield "module", tree.body
    for node in ast.walk(tree):
        if isinstance(node, ast.ClassDef | ast.FunctionDef):
            yield node.name, node.body


@pytest.mark.parametrize("path", FILES, ids=lambda p: str(p.relative_to(ROOT)))
def test_names_are_defined_once(path):
    for scope, body in scopes(ast.parse(path.read_text())):
        names = Counter(n.name for n in body if isinstance(n, ast.FunctionDef | ast.ClassDef) and n.name != "_")
        assert not [n for n, k in names.items() if k > 1], scope
