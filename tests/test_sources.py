from datetime import date

import pytest

from arrearly import read_tables
from arrearly.sources.schemas import CORE_NAMES, DIRECTORY_NAMES, SCHEMAS, STAGING_NAMES
from arrearly.sources.tables import conform
from catalog.fixtures import StarTables


def test_every_vocabulary_maps_to_canonical_columns():
    for names in (STAGING_NAMES, CORE_NAMES, DIRECTORY_NAMES):
        for table, renames in names.items():
            assert set(renames.values()) <= set(SCHEMAS[table].names)


def test_conform_renames_widens_and_keeps_unknown_columns(spark):
    raw = spark.createDataFrame(
        [(57, date(2026, 6, 1), "V1", "note")],
        "cliente_sindig int, fechacarga date, canal_cobranza string, extra string",
    )
    got = conform(raw, "third_party", DIRECTORY_NAMES["third_party"])
    assert got.columns == ["customer_id", "load_ts", "channel", "extra"]
    assert dict(got.dtypes)["customer_id"] == "bigint"
    assert dict(got.dtypes)["load_ts"] == "date"


@pytest.mark.parametrize(
    ("table", "ddl", "read_as"),
    [
        ("payments", "amount decimal(18,2)", "decimal(18,2)"),
        ("payments", "amount decimal(9,0)", "decimal(12,2)"),
        ("interactions", "outcome_code smallint", "int"),
        ("scores", "cutoff_date timestamp_ntz", "date"),
        ("portfolio", "load_ts timestamp", "timestamp"),
    ],
)
def test_conform_widens(spark, table, ddl, read_as):
    df = conform(spark.createDataFrame([], ddl), table)
    assert df.dtypes == [(ddl.split()[0], read_as)]


@pytest.mark.parametrize(
    ("table", "ddl"),
    [
        ("payments", "amount double"),
        ("payments", "amount decimal(24,2)"),
        ("payments", "amount decimal(12,4)"),
        ("interactions", "outcome_code bigint"),
        ("third_party", "load_ts string"),
    ],
)
def test_conform_rejects_types_that_lose_values(spark, table, ddl):
    with pytest.raises(TypeError, match=ddl.split()[0]):
        conform(spark.createDataFrame([], ddl), table)


def test_read_tables(spark, random_tables, tmp_path):
    for table in ("portfolio", "third_party"):
        getattr(random_tables, table).write.parquet(str(tmp_path / table))
    random_tables.payments.createOrReplaceTempView("some_payments")
    tables = read_tables(
        spark,
        {
            "portfolio": str(tmp_path / "portfolio"),
            "third_party": str(tmp_path / "third_party"),
            "payments": "some_payments",
        },
    )
    assert tables.portfolio.count() == random_tables.portfolio.count()
    assert tables.payments.count() == random_tables.payments.count()
    assert tables.scores is None


def test_read_tables_names_missing_columns(spark, random_tables):
    random_tables.third_party.drop("channel").createOrReplaceTempView("no_channel")
    with pytest.raises(ValueError, match="channel"):
        read_tables(spark, {"third_party": "no_channel"})


def test_fixture_has_the_canonical_schema(spark):
    star = StarTables(spark, "/root/testdata/sf0.001")
    for table, schema in SCHEMAS.items():
        found = {f.name: f.dataType for f in getattr(star, table).schema.fields}
        assert found == {f.name: f.dataType for f in schema.fields}
