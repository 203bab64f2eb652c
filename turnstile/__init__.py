"""turnstile — ticketing fraud, pricing and monitoring analytics on Spark.

Every operator is a plain ``DataFrame -> DataFrame`` function built from
Spark SQL / DataFrame primitives so Catalyst can prune, push down and
re-plan it.  Sub-packages:

* ``sources``    scans, decoders and sinks (A*)
* ``functions``  column helpers (K*) and distributed prefix sums / order statistics
* ``operators``  batch operators (B* .. I*)
* ``streaming``  Structured Streaming jobs (A6, C3-C5, D4, H3)
* ``plans``      logical-table views, composite pipelines (P*) and the query catalogue
"""

from turnstile.session import get_spark, checkpoint_root  # noqa: F401

__version__ = "0.1.0"
