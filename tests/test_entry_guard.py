"""The entry works without the corpus subpackage or its libraries, and hides no other import error."""

import sys

import pytest

import __spark_entry__ as entry
from riskloom.plans.queries import Q


class Absent:
    def __init__(self, name):
        self.name = name

    def find_spec(self, fullname, path=None, target=None):
        if fullname == self.name:
            raise ModuleNotFoundError(f"No module named {fullname!r}", name=fullname)


def hidden(monkeypatch, name):
    for m in list(sys.modules):
        if m == "corpus_pipeline" or m.startswith("riskloom.llm"):
            monkeypatch.delitem(sys.modules, m)
    import riskloom
    monkeypatch.delattr(riskloom, "llm", raising=False)
    monkeypatch.setattr(sys, "meta_path", [Absent(name), *sys.meta_path])


@pytest.mark.parametrize("name", ["corpus_pipeline", "riskloom.llm"])
def test_without_the_subpackage(monkeypatch, name):
    hidden(monkeypatch, name)
    assert set(entry.queries()) == set(Q)
    assert all(n in Q for n in entry.oracle_sql())


def test_without_a_library_of_the_subpackage(monkeypatch):
    pytest.importorskip("corpus_pipeline")
    hidden(monkeypatch, "public_tokenizers")
    monkeypatch.delitem(sys.modules, "public_tokenizers", raising=False)
    with pytest.warns(UserWarning, match="public_tokenizers"):
        assert set(entry.queries()) == set(Q)


def test_a_missing_part_of_the_library_is_an_error(monkeypatch):
    pytest.importorskip("corpus_pipeline")
    hidden(monkeypatch, "riskloom.llm.bpe")
    with pytest.raises(ImportError):
        entry.queries()
