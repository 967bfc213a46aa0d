"""Streams. Spark's planners of Python sources and of typed state run in processes of their own beside the driver, which do not get what ``ship`` sends: so classes of this subpackage go to them whole, not by name."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])
