import os

import pytest
from oracle import DATA

from afterbell.plans import registry

pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")


@pytest.mark.parametrize("name", ["ml8_control_comparison", "ml8_signal_gates"])
def test_events_and_controls_read_a_study_that_is_computed_once(spark, name):
    assert "lineitem" not in registry.queries()[name](spark, DATA)._jdf.queryExecution().toString()
