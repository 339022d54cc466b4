"""Queries that do the whole job next to those that show a cap or few draws."""

import inspect

import numpy as np
import pytest

import __spark_entry__ as registry
from bagstats.operators import bootstrap as BS
from suite.scoring import WIDE_HEAD
from suite.views import embed_patches


@pytest.mark.parametrize("name, left", [("L7_score_whole_bags_function", lambda k: True), ("L7_score_whole_after_dropout", lambda k: k % 3 != 0)])
def test_every_patch_of_a_bag_is_scored(spark, sf, name, left):
    w, b = WIDE_HEAD
    rows = embed_patches(spark, sf).select("slide_id", "patch_idx", "features").collect()
    got = {r.slide_id: r for r in registry.queries()[name](spark, sf).collect()}
    assert set(got) == {r.slide_id for r in rows}
    for slide, found in got.items():
        bag = np.array([r.features for r in rows if r.slide_id == slide and left(r.patch_idx)])
        logits = w @ bag.mean(axis=0) + b
        assert [found[f"logit_{c}"] for c in range(len(b))] == pytest.approx(logits, abs=2e-6)


@pytest.mark.parametrize("name, operator", [("A27_bootstrap_ci_default", BS.bootstrap_ci), ("A27_bootstrap_poisson_default", BS.bootstrap_ci), ("A28_metrics_with_ci_default", BS.metrics_with_ci)])
def test_as_many_draws_as_the_operator_makes(spark, sf, name, operator):
    draws = inspect.signature(operator).parameters["n_bootstrap"].default
    assert {r.n_bootstrap for r in registry.queries()[name](spark, sf).collect()} == {draws} == {2000}
