import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tracehold.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8]",
        spark__sql__shuffle__partitions=8,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="8g",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoint")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sample_alerts(spark):
    """Eight alerts of three addresses on one day."""
    rows = [
        ("BF-SSH-001", "MEDIUM", "10:00:00", "root", "192.168.1.100"),
        ("BF-SSH-001", "MEDIUM", "10:00:15", "root", "192.168.1.100"),
        ("BF-SSH-001", "MEDIUM", "10:00:30", "root", "192.168.1.100"),
        ("PE-SUDO-003", "HIGH", "10:15:00", "root", "192.168.1.100"),
        ("MW-PROC-001", "HIGH", "11:30:00", "root", "192.168.1.100"),
        ("UA-FILE-001", "HIGH", "14:00:00", "user1", "192.168.1.101"),
        ("BF-SSH-001", "MEDIUM", "15:00:00", "admin", "192.168.1.102"),
        ("BF-SSH-001", "MEDIUM", "15:00:10", "admin", "192.168.1.102"),
    ]
    data = [(i, r, s, f"2023-01-01 {t}", u, ip) for i, (r, s, t, u, ip) in enumerate(rows)]
    df = spark.createDataFrame(data, "event_id long, RULE_ID string, SEVERITY string, ts string, username string, ip_address string")
    return df.withColumn("ts", df.ts.cast("timestamp")).cache()
