import pytest

CLASH = {"class": "x", "node": 5, "n_words": "many", "slot": 1.5, "_c0": "c", "kept": "no", "component_id": "y", "score": "z", "k": 3, "part": 1, "host": "h", "row": 0}


@pytest.fixture
def with_clashes():
    """Adds columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    return lambda df: df.withColumns({k: F.lit(v) for k, v in CLASH.items() if k not in df.columns})
