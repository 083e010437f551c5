"""What colony parameters join through the driver."""

import re

from fieldtrace.plans import colony  # noqa: F401
from fieldtrace.plans.catalogue import QUERIES


def test_no_table_of_points_is_broadcast(spark, sf_dir):
    plan = QUERIES["colony_parameters"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"BroadcastHashJoin \[([^\]]*)\]", plan)
    #: Only a frame's mean, centre and rim, by frame or by frame and angle.
    assert keys and all(re.fullmatch(r"tp#\d+(, k[01]?#\d+L)?", k) for k in keys)
