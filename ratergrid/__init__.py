"""ratergrid: post sampling, annotation planning and rater agreement on Spark DataFrames."""

__version__ = "0.1.0"
