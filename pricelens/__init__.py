"""pricelens — listing-price analytics as Spark DataFrame jobs.

Observations of marketplace listings go in; versioned listing state, a
change-only price history, market reports, deal scores and the derived
read models come out.  Every operator is a function ``DataFrame -> DataFrame``
built from Spark SQL expressions so Catalyst can push filters, prune columns
and plan the shuffles.
"""

from pricelens.params import Params  # noqa: F401

__all__ = ["Params"]
