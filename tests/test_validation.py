"""Validation and repeated evaluations cover every family."""

import os

import pytest

from tallyweave.plans import catalog, scorers
from tallyweave.plans.workbench import workbench

FOLDER = "/root/testdata/sf0.001"


def test_five_runs_of_every_family_are_registered():
    assert {f"evaluate_{family}_runs" for family in scorers.FAMILIES} <= set(catalog.queries())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")
def test_validation_auc_covers_every_family(spark):
    found = catalog.queries()["validation_auc"](spark, FOLDER).collect()
    families = {"conversation", "session", "keyword", "joint", "relative", "relative_encoded", "neutral", "generated", "neighbour", "student"}
    assert {r["model"] for r in found} == families


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")
def test_families_share_what_they_have_in_common(spark, rows):
    """Each family once pooled the same steps, and met the items on sale at every event of the train part."""
    w = workbench(spark, FOLDER)
    for vectors in (scorers.session_vectors, scorers.joint_vectors, scorers.generated_vectors, scorers.neighbour_vectors):
        vectors(w, "train")
    catalog.queries()["validation_auc"](spark, FOLDER)
    assert {"pooled-train", "pooled-intersection-train", "available-validation"} <= set(w._kept)
    valid = w.validation_events()
    assert rows(w.keep("available-validation", None)) == rows(w.available("train").join(valid, "purchase_event_id"), "purchase_event_id", "item_id")
    # the steps of events with a session and those made for the others, as if pooled together
    steps = scorers._steps(w, "train").unionByName(scorers.neighbour_steps(w, "train"), allowMissingColumns=True)
    together = scorers._pooled(w, steps, w.intersection_vocabulary(), ("session_id",))
    assert rows(scorers._with_pooled(w, "train", scorers.neighbour_steps(w, "train"))) == rows(together)
