"""emberline: finding and reporting issues in logs with Spark DataFrames.

Lines come in as a table ``(source, line_no, line)``; every stage takes a
DataFrame and gives a DataFrame, so the same functions serve batch tables and
the micro-batches of a stream.
"""

from pyspark import cloudpickle

from emberline.functions import patterns
from emberline.plans import kernels
from emberline.sources import delivery, tail
from emberline.streaming import states

# The few pandas helpers travel to the executors inside the task itself, so a
# job needs no copy of this package installed on the workers.
for _module in (kernels, patterns, states, tail, delivery):
    cloudpickle.register_pickle_by_value(_module)

__version__ = "0.1.0"
