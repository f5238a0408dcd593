"""Records go over the network once for a tree, and not once more to tell apart what a minimum takes anyway."""

import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import __spark_entry__


def _plan(spark, name):
    return __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_both_sides_of_a_tree_come_from_one_pass(spark):
    # Three dimensions for the children and, by the same exchange, for their parents.
    assert _plan(spark, "r04_connection_tree_interface").count("Join LeftOuter") <= 6


def test_marking_does_not_deduplicate_records(spark):
    assert len(re.findall(r"Aggregate \[dst_address#\d+, observed_at#\d+L\]", _plan(spark, "d04_classify_destinations"))) == 1
