import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from corpusrules.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = build_session(
        "tests",
        "local[4]",
        spark__checkpoint__dir=str(shared),
        spark__driver__memory="4g",
        spark__sql__shuffle__partitions="2",
        spark__sql__codegen__wholeStage="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def files(spark):
    """Texts to a table of files: ``files({path: content})``."""

    def make(texts: dict[str, str]):
        return spark.createDataFrame(list(texts.items()), "file_path string, content string")

    return make
