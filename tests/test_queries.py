"""Every query of the core next to its SQL, over the smallest tables."""

from pathlib import Path

import pytest

from oracle import canon, duck
from tesserae.plans import catalog

FOLDER = "/root/testdata/sf0.001"
catalog.load()


@pytest.fixture(scope="module")
def con():
    if not Path(FOLDER).exists():
        pytest.skip("no test tables")
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    got = canon(catalog.QUERIES[name](spark, FOLDER).toPandas())
    if name in catalog.SQL:
        assert got == canon(con.execute(catalog.SQL[name]).df())


def test_core_does_not_import_the_training_data_operators():
    home = Path(__file__).resolve().parents[1] / "tesserae"
    for p in home.rglob("*.py"):
        if "llm" not in p.relative_to(home).parts:
            assert "tesserae.llm" not in p.read_text(), p
