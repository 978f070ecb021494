"""Every registered query against its SQL twin in DuckDB."""

import os
from pathlib import Path

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from arrearly import read_tables
from arrearly.sources.schemas import SCHEMAS
from catalog import oracle
from catalog.fixtures import StarTables, copied
from catalog.queries import BUILDERS

SF_DIR = Path(os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001"))
NAMES = sorted(BUILDERS)


def compare(df, relation):
    columns = sorted(df.columns)
    assert sorted(c[0] for c in relation.description) == columns
    order = [[c[0] for c in relation.description].index(c) for c in columns]
    found = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    wanted = sorted((tuple(r[i] for i in order) for r in relation.fetchall()), key=repr)
    assert found == wanted
    return found


def test_names_agree():
    assert set(BUILDERS) <= set(queries())
    assert set(BUILDERS) <= set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.fixture(scope="module")
def star():
    con = duckdb.connect()
    for path in SF_DIR.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_star_tables(spark, star, name):
    assert compare(queries()[name](spark, str(SF_DIR)), star.execute(oracle_sql()[name]))


@pytest.fixture(scope="module", params=[(1, False), (2, True)], ids=["seed1", "hot"])
def random_case(request, make_tables):
    """Random tables full of NULLs, repeats and edge values, in both engines."""
    tables = make_tables(*request.param)
    con = duckdb.connect()
    for table in SCHEMAS:
        con.register(f"{table}_rows", getattr(tables, table).toArrow())
    return tables, con


@pytest.mark.parametrize("name", NAMES)
def test_random_tables(random_case, name):
    tables, con = random_case
    inputs = {table: f"SELECT * FROM {table}_rows" for table in SCHEMAS}
    compare(BUILDERS[name](tables), con.execute(oracle.sql(name, inputs)))


@pytest.fixture(scope="module")
def hot_copies(spark, tmp_path_factory):
    """Six copies of the smallest test tables; one customer has a third of the
    rows of every table but the exclusions, which would remove that customer."""
    folder = tmp_path_factory.mktemp("hot")
    source = StarTables(spark, "/root/testdata/sf0.001")
    for table in SCHEMAS:
        df = copied(getattr(source, table), 6, hot=table != "third_party")
        df.repartition(4).write.parquet(str(folder / table))
    tables = read_tables(spark, {table: str(folder / table) for table in SCHEMAS})
    inputs = {t: f"SELECT * FROM read_parquet('{folder}/{t}/*.parquet')" for t in SCHEMAS}
    return tables, inputs


@pytest.mark.parametrize("name", NAMES)
def test_hot_customer(hot_copies, name):
    tables, inputs = hot_copies
    compare(BUILDERS[name](tables), duckdb.execute(oracle.sql(name, inputs)))
