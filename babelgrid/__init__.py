"""babelgrid: cross-lingual transfer evaluation as Spark plans."""

__version__ = "0.1.0"
