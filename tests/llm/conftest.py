"""Small tables for the operators: rows as dictionaries, with extra columns whose names clash with inner ones."""
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

SF_SMALL = "/root/testdata/sf0.001"            # the name that tests beside this folder import, if both run in one call
CLASH = ("body", "th", "v", "key", "_d", "_t", "_s", "size", "row_id", "start", "n", "spans", "id")


@pytest.fixture(scope="session")
def docs_of(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                           T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                           T.StructField("n_chars", T.LongType())])

    def make(rows, clash=True):
        """rows: (doc_id, text) or (doc_id, text, source)."""
        full = [(r[0], r[1], None, r[2] if len(r) > 2 else "s", None) for r in rows]
        df = spark.createDataFrame(full, schema).repartition(3)
        return df.withColumns({c: F.lit(1) for c in CLASH}) if clash else df
    return make
