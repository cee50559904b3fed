import pytest

pytest.importorskip("tidemark.llm")
