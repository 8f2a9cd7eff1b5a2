import pytest

SCHEMA = "bacdive_id bigint, iso_sample_text string, n_words string, score string"


@pytest.fixture(scope="session")
def samples(spark):
    """Isolation texts from ``{id: text}`` or ``[(id, text)]``, with extra columns."""

    def make(rows):
        rows = rows.items() if isinstance(rows, dict) else rows
        return spark.createDataFrame([(k, t, "extra", "extra") for k, t in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and long texts, ties and repeated rows."""
    soil = "soil from a salt marsh near the river mouth at low tide"
    return [
        (1, None), (2, ""), (3, " \n\t "), (None, soil), (None, None), (4, soil), (4, soil), (5, soil),
        (6, "hot spring " * 9000), (7, "x" * 50000), (8, "é" * 300 + "\n\n" + soil),
    ]
