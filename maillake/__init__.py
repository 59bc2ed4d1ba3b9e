"""maillake: mail-corpus ETL and conversation analytics as Spark jobs.

Landed raw messages go in; parsed, normalised, enriched and threaded tables come out.
Column builders live in ``functions``, DataFrame jobs in ``operators``, readers and
writers in ``sources`` and the end-to-end flows in ``plans``.
"""

import sys

from pyspark import cloudpickle

# Arrow functions travel to the workers by value, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
