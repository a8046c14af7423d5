"""segmint: customer segmentation analytics as Spark DataFrame operators.

Every operator is a function ``DataFrame -> DataFrame`` (plus a few helpers
that return small, bounded Python values such as quantile boundaries). The
package is organised as:

* ``sources``   – table loading, the customer snapshot built from fact tables,
                  CSV scan / sinks.
* ``functions`` – column-level helpers (parsing, formatting) and fixed values.
* ``operators`` – schema mapping, quality checks, enrichment, exact ranking,
                  RFM, filters, summaries, strategy, clustering, models.
* ``plans``     – end-to-end compositions wired to the driver tables.
* ``streaming`` – incremental maintenance of the customer snapshot.
"""

__all__ = ["__version__"]
__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Functions that run inside tasks are shipped by value, so executors need no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
