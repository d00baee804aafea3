import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from onsetlens.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", shuffle_partitions=8, memory="8g")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


@pytest.fixture
def make_tests(spark):
    """Aligned tests from (num_id, days_since_onset, result); other fields may be given."""
    from onsetlens.operators.align import align_days
    from onsetlens.sources.schema import TESTS

    usual = dict(
        time_period="Second",
        included_main_analysis="Include",
        immunised="Yes",
        overseas="No",
        gender="Female",
        age_group="over40",
        comorbidities=1,
        ethnicity="Other",
    )

    def make(rows, **other):
        filled = [
            {"num_id": r[0], "days_since_onset": r[1], "pcr_result": r[2], **usual, **other, **(r[3] if len(r) > 3 else {})}
            for r in rows
        ]
        return align_days(spark.createDataFrame([tuple(f[n] for n in TESTS.fieldNames()) for f in filled], TESTS))

    return make
