import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from queuelens.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g",
        spark__ui__showConsoleProgress="false", spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def job_rows(spark):
    """Builds a job frame from partial rows; everything not given has an ordinary value."""
    from datetime import datetime, timezone

    from queuelens.schema import JOB_SCHEMA

    base = {
        "user": "u1", "account": "p", "name": "run", "state": "COMPLETED", "partition": "gpu", "qos": "normal",
        "submit_time": datetime(2024, 1, 3, 10, 0, tzinfo=timezone.utc), "start_time": datetime(2024, 1, 3, 10, 5, tzinfo=timezone.utc),
        "end_time": datetime(2024, 1, 3, 11, 5, tzinfo=timezone.utc), "run_time": 3600, "wallclock_req": 7200.0,
        "nodes_req": 1, "processors_req": 16, "mem_req": 32000.0, "gpus_req": 0, "exit_code": 0, "derived_exit_code": 0,
    }

    def build(*rows):
        full = [{"job_id": i, **base, **row} for i, row in enumerate(rows)]
        return spark.createDataFrame([[r[f.name] for f in JOB_SCHEMA.fields] for r in full], JOB_SCHEMA)

    return build
