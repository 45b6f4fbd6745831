"""Multichannel signal processing and telemetry analytics as Spark jobs."""

from pyspark import cloudpickle

import wavetally as _self

# Functions of this package that run inside tasks travel with their code, so
# executors do not need the package installed.
cloudpickle.register_pickle_by_value(_self)
