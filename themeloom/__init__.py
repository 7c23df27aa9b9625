"""Company-theme analytics as Spark jobs.

Every public function takes and returns DataFrames.  The package is split by
what a job does: ``sources`` reads and writes tables, ``functions`` holds column
expressions, ``operators`` the relational and vector work, ``plans`` the named
end-to-end jobs and ``streaming`` the incremental feeds.
"""

import sys

from pyspark import cloudpickle

# Functions run by tasks travel with them, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
