"""Test files of the same name in different folders: each folder is a package, or only one of them is collected."""

from pathlib import Path


def test_folders_of_tests_are_packages():
    assert all((p.parent / "__init__.py").exists() for p in Path(__file__).parent.rglob("test_*.py"))
