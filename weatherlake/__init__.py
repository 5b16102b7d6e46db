"""Weather-to-market analytics as plain PySpark DataFrame functions."""

import sys

from pyspark import cloudpickle

# Executors need no installed copy: functions used inside tasks travel with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
