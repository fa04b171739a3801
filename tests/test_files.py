"""The test files themselves."""

from collections import Counter
from pathlib import Path


def test_file_names_are_unique():
    """Two files of one name cannot both be collected, as the folders are no packages."""
    names = Counter(path.name for path in Path(__file__).parent.rglob("test_*.py"))
    assert [name for name, n in names.items() if n > 1] == []
