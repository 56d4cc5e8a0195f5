"""tagweave: tag and group documents and web pages with Spark DataFrames.

Every operator is a plain function ``DataFrame -> DataFrame``. Per-document work
(cleaning, term counts, keyword scores) stays inside one row with Spark's
higher-order array functions, so it runs map-side without a shuffle; corpus
work (document frequency, similarity, clustering) is expressed as joins and
aggregations that Catalyst and AQE plan.
"""

from tagweave.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
