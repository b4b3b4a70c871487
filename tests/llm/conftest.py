import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns whose names the operators use themselves.
CLASH = "size, key, id, row, score, copy, n, h1, runs, path, label, spans, component, taken, a.b, two words"


@pytest.fixture(scope="session")
def docs(spark):
    """docs(rows of (doc_id, text[, source])) -> documents with extra, clashing columns."""
    from pyspark.sql import functions as F

    def make(rows, clash=True):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        return df.withColumns({c: F.lit(1) for c in CLASH.split(", ")}) if clash else df

    return make
