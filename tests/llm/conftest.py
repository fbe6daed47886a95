"""Small chunks in small tests."""

import pytest
from millrace.llm import rounds


@pytest.fixture(autouse=True)
def small_chunks(monkeypatch):
    monkeypatch.setattr(rounds, "PAIR_BYTES", 1)
