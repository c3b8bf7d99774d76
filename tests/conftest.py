import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gleaner.session import checkpoint_dir, get_session, scratch_path, ship_package

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = get_session(
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "4g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(session)
    ship_package(session)
    yield session
    session.stop()


@pytest.fixture
def scratch(spark):
    return lambda name: scratch_path(spark, name)


@pytest.fixture
def plan():
    def text(df):
        return df._jdf.queryExecution().executedPlan().toString()

    return text


RAW_DDL = (
    "seq bigint, link string, tieu_de string, summary string, nguon string, "
    "tac_gia string, ngay_dang string, so_binh_luan string, noi_dung string"
)


@pytest.fixture
def raw_rows(spark):
    """Raw articles from dicts; whatever is left out is null."""
    names = [column.split()[0] for column in RAW_DDL.split(", ")]

    def build(rows):
        filled = [
            tuple({"seq": nth, **row}.get(name) for name in names)
            for nth, row in enumerate(rows)
        ]
        return spark.createDataFrame(filled, RAW_DDL)

    return build
