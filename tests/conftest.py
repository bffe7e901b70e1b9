import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from markbook.session import build_session  # noqa: E402


# Started on import: the test modules build columns at module level.
SESSION = build_session(
    "local[4]",
    spark__sql__shuffle__partitions=4,
    spark__ui__enabled="false",
    spark__ui__showConsoleProgress="false",
    spark__driver__memory="6g",
)
SESSION.sparkContext.setLogLevel("ERROR")


@pytest.fixture(scope="session")
def spark():
    yield SESSION
    SESSION.stop()


@pytest.fixture
def values(spark):
    """Evaluate expressions over the rows of one text column, in order."""

    def run(texts, *columns):
        rows = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
        got = rows.select("i", *[c.alias(f"c{n}") for n, c in enumerate(columns)]).orderBy("i").collect()
        out = [tuple(r[1:]) for r in got]
        return [r[0] for r in out] if len(columns) == 1 else out

    return run


def plan_of(df) -> str:
    """The formatted physical plan as text."""
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
