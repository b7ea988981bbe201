import datetime as dt
import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]

from minilog import CASES_DDL, EVENTS_DDL, T0, case_rows, event_rows  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from millrace.session import session
    s = session("local[4]", 4, **{"spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.sql.session.timeZone": "UTC"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def mini(spark):
    from millrace.plans.context import Log
    return Log(spark.createDataFrame(event_rows(), EVENTS_DDL), spark.createDataFrame(case_rows(), CASES_DDL))


@pytest.fixture()
def make_log(spark):
    """A log from (case, activity, hours after T0, resource) rows and (case, category, vendor, document) rows."""
    from millrace.model import Settings
    from millrace.plans.context import Log

    def make(events, cases, settings=Settings()):
        rows = [(c, a, None if h is None else T0 + dt.timedelta(hours=h), k, r, 1.0) for k, (c, a, h, r) in enumerate(events)]
        att = [(c, doc, "Standard", True, True, "companyID_0000", vendor, "v", "Standard PO", cat) for c, cat, vendor, doc in cases]
        return Log(spark.createDataFrame(rows, EVENTS_DDL), spark.createDataFrame(att, CASES_DDL), settings)

    return make
