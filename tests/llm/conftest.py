import pytest

pytest.importorskip("quantloom.llm")
