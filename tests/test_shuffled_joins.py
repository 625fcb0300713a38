"""Tables of exploded rows are never broadcast: Spark takes them for as small as the file that they come from."""

import re

import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
#: A broadcast join; the vocabulary of the statement (joined by _key) has some forty words whatever the input.
BROADCAST = re.compile(r"BroadcastNestedLoopJoin|BroadcastHashJoin(?: \[codegen id : \d+\])?(?: |\nLeft keys \[\d+\]: )\[(?!_key|codegen)")


def plan_of(found):
    return found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["meaning_changes", "conflicting_words", "statement_search", "verify_pages", "generated_verified", "verify_labels", "planted_audit", "evidence_words"])
def test_no_table_of_words_or_lines_is_broadcast(spark, name):
    seen = []
    manager = spark._jsparkSession.sharedState().statusStore()
    before = manager.executionsCount()
    found = __spark_entry__.queries()[name](spark, SF)
    seen.append(plan_of(found))
    runs = manager.executionsList()
    seen += [runs.apply(i).physicalPlanDescription() for i in range(int(before), runs.size())]  # the checkpoints on the way
    assert not [m[0] for p in seen for m in BROADCAST.finditer(p)]
