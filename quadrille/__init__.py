"""Quadrille: a graph engine on Spark. RDF-style quads, SPARQL 1.1 and a graph API over DataFrames."""

import sys

from pyspark import cloudpickle

# Functions are shipped by value, so executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
