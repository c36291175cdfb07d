"""Every query for training data beside its SQL, over the smallest tables."""

from pathlib import Path

import pytest

from oracle import canon, duck
from tesserae.llm import bpe, queries, sql

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not (Path(bpe.TOKENIZER_DIR) / bpe.VOCABULARY).exists(), reason="no public vocabulary")


@pytest.fixture(scope="module")
def con():
    if not Path(FOLDER).exists():
        pytest.skip("no test tables")
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    got = canon(queries.QUERIES[name](spark, FOLDER).toPandas())
    if name in sql.SQL:
        assert got == canon(con.execute(sql.SQL[name]).df())


def test_every_statement_has_its_query():
    assert set(sql.SQL) <= set(queries.QUERIES)
