"""Aggregation models.

Protocol: ``fit(scores, verifiers, group_col=None) -> params DataFrame`` (one row,
or one row per group) and ``score(scores, params, verifiers) -> scores + p1``.
Fitting is one grouped aggregate (or a few, for iterative models); scoring is a
projection after joining the parameters (broadcast when there is one row).
"""

from pickwise.models.naive_bayes import nb_fit, nb_score  # noqa: F401
from pickwise.models.simple import class_balance, naive_ensemble  # noqa: F401
from pickwise.models.moments import gram, triplet_fit, triplet_score  # noqa: F401
