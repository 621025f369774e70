"""Every query of problems 2 to 9 over empty tables, nulls in each column, and columns with clashing names."""

import pytest
from pyspark.sql import functions as F

from tidewell.llm import queries as Q

TABLES = "documents parsed_documents quality_rejected intake_cases workorders dialogue_turns transcript_segments chunk_limits eval_items".split()
CLASHING = "status idx role body place kind template host masked ids clean pos start district url quote rec_key src key_a".split()


@pytest.fixture(scope="module", params=["empty", "nulls", "clashes"])
def odd(request, spark, tiny, tmp_path_factory):
    out = tmp_path_factory.mktemp(request.param)
    for t in TABLES:
        df = spark.read.parquet(f"{tiny}/{t}.parquet")
        if request.param == "empty":
            df = df.limit(0)
        elif request.param == "nulls":
            few = df.limit(3)
            for c in [None, *df.columns]:
                df = df.unionByName(few.select(*[F.lit(None).cast(f.dataType).alias(f.name) if c in (None, f.name) else F.col(f.name) for f in few.schema.fields]))
        else:
            df = df.withColumns({c: F.lit("clash") for c in CLASHING if c not in df.columns})
        df.coalesce(1).write.parquet(f"{out}/{t}.parquet")
    return request.param, str(out)


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(name, odd, spark, tiny):
    kind, path = odd
    rows = Q.queries()[name](spark, path).collect()
    if kind == "empty":
        assert rows == []
    elif kind == "clashes":
        want = Q.queries()[name](spark, tiny)
        assert len(rows) == want.count() and rows[0].asDict().keys() == dict(want.dtypes).keys()
    else:
        assert rows
