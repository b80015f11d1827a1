"""Literature relation mining on Spark: terms in text, term pairs, A-B-C hypotheses, timelines."""

__version__ = "0.1.0"
