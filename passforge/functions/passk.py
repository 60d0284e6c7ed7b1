"""H1: the unbiased pass@k estimator as a native column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import as_col


def pass_at_k(n, c, k) -> Column:
    """1 - C(n-c, k) / C(n, k) as a product of k factors, so it never overflows and its
    length does not depend on the counts.

    C(n-c,k)/C(n,k) = prod_{j=0}^{k-1} (n-c-j) / (n-j).  Guards, in order:
    n <= 0, c <= 0 or k <= 0 gives 0; c >= n or k >= n gives 1; n - c < k gives 1.
    """
    n, c, k = as_col(n), as_col(c), as_col(k)
    rest = (n.cast("long") - c.cast("long")).cast("double")
    total = n.cast("double")
    steps = F.sequence(F.lit(1).cast("long"), F.greatest(k.cast("long"), F.lit(1).cast("long")))
    product = F.aggregate(
        steps, F.lit(1.0).cast("double"),
        lambda acc, j: acc * ((rest - j + 1) / (total - j + 1)),
    )
    return (
        F.when((n <= 0) | (c <= 0) | (k <= 0), F.lit(0.0))
        .when((c >= n) | (k >= n), F.lit(1.0))
        .when((n - c) < k, F.lit(1.0))
        .otherwise(F.lit(1.0) - product)
    )
