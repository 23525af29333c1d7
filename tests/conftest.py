import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from workload.check import session
    return session()


@pytest.fixture
def make(spark):
    """Listings from dicts; ids and order are filled in."""
    from pyspark.sql import types as T
    from sieveline.model import LISTING

    def build(*rows):
        schema = T.StructType(LISTING.fields)
        full = [{**{f: None for f in LISTING.fieldNames()}, "cid": f"c{i}", "name": "", "ord": i, **r}
                for i, r in enumerate(rows)]
        return spark.createDataFrame([tuple(r[f] for f in LISTING.fieldNames()) for r in full], schema)
    return build
