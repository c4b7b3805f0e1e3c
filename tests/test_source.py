"""Guards on the source itself."""

import ast
import builtins
from collections import Counter
from pathlib import Path

import pytest

FILES = sorted((Path(__file__).resolve().parent.parent / "passagemill").rglob("*.py"))


@pytest.mark.parametrize("path", FILES, ids=lambda p: p.stem)
def test_no_name_is_defined_twice(path):
    tree = ast.parse(path.read_text())
    for scope in [tree, *(n for n in ast.walk(tree) if isinstance(n, ast.ClassDef))]:
        names = Counter(n.name for n in scope.body if isinstance(n, (ast.FunctionDef, ast.ClassDef)))
        assert not [n for n, times in names.items() if times > 1]


@pytest.mark.parametrize("path", FILES, ids=lambda p: p.stem)
def test_every_name_read_is_bound_somewhere(path):
    tree = ast.parse(path.read_text())
    bound = set(dir(builtins)) | {"__file__", "__name__"}
    for node in ast.walk(tree):
        if isinstance(node, ast.Name) and not isinstance(node.ctx, ast.Load):
            bound.add(node.id)
        elif isinstance(node, (ast.FunctionDef, ast.ClassDef)):
            bound.add(node.name)
        elif isinstance(node, ast.arg):
            bound.add(node.arg)
        elif isinstance(node, (ast.Import, ast.ImportFrom)):
            bound.update((a.asname or a.name).split(".")[0] for a in node.names)
        elif isinstance(node, ast.ExceptHandler) and node.name:
            bound.add(node.name)
    read = {n.id for n in ast.walk(tree) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Load)}
    assert not read - bound
