import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from strandline.session import clean, local_session

DATA = os.environ.get("STRANDLINE_TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = local_session(4, "tests", 4, scratch=str(tmp_path_factory.mktemp("shared")))
    yield s
    clean(s)


@pytest.fixture(scope="session")
def sf():
    path = f"{DATA}/sf0.01"
    if not os.path.isdir(path):
        pytest.skip("no test tables here")
    return path


@pytest.fixture(scope="session")
def make(spark):
    """make(schema, *rows): a table; rows are dicts, missing columns are null."""

    def build(schema: str, *rows: dict):
        names = [c.strip().split()[0] for c in schema.split(",")]
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)

    return build


MESSAGE = "seq long, slug string, source_file string, line_no int, role string, content string, timestamp string, source_type string, sender string, metadata string, ingested_at timestamp"
SOURCE_INDEX = "filename string, slug string, adapter string, source string, imported_at timestamp, lines int, assistant_turns int, content_hash string, pii_flags string, time_zone string, locale string"
EVIDENCE = "evidence_no long, message_id string, slug string, sender string, source_file string, timestamp string, excerpt string, score double, source_type string"
LEDGER = (
    "ledger_line long, slug string, event_id string, event_type string, claim_id string, target_claim_id string, created_at string, retract_subject string, retract_predicate string, retract_object string, "
    "assert_subject string, assert_predicate string, assert_object string, confidence double, raw_text string, authority string, authored_by string, fingerprint string"
)
